"""Three-valued reconciliation rules: pass, flag or unknown; missing or invalid inputs are never a pass or a flag.

Amounts are decimals, ratios are compared by cross-multiplication, and tolerances are inclusive, so no verdict depends
on floating rounding. Each function takes columns (or a DataFrame where rows are gathered) and returns a verdict column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PASS, FLAG, UNKNOWN = "pass", "flag", "unknown"
#: Shares of similarity below which names are a variation, or differ.
NAME_SAME, NAME_NEAR = 0.85, 0.70


def dec(x: Column, scale: int = 2) -> Column:
    return x.cast(f"decimal(18,{scale})")


def within(stated: Column, observed: Column, tolerance: float) -> Column:
    """|stated - observed| <= tolerance * stated, exactly, for positive amounts; else unknown."""
    tol = F.lit(str(tolerance)).cast("decimal(6,4)")
    sound = stated.isNotNull() & observed.isNotNull() & (stated > 0) & (observed > 0)
    return F.when(~F.coalesce(sound, F.lit(False)), UNKNOWN).when(F.abs(stated - observed) <= tol * stated, PASS).otherwise(FLAG)


def income(net: Column, credits: Column, tolerance: float = 0.05) -> Column:
    """RULE-INC-01: stated net pay against the mean of the credits (array of decimals); n * net and the sum are compared."""
    n = F.size(credits)
    total = F.aggregate(credits, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    sound = net.isNotNull() & (n > 0) & ~F.exists(credits, lambda x: x.isNull() | (x <= 0)) & (net > 0)
    tol = F.lit(str(tolerance)).cast("decimal(6,4)")
    return F.when(~F.coalesce(sound, F.lit(False)), UNKNOWN).when(F.abs(net * n - total) <= tol * net * n, PASS).otherwise(FLAG)


def tax(stated: Column, yearly: Column, monthly: Column | None = None, tolerance: float = 0.10, period: Column | None = None, is_monthly: Column | None = None) -> Column:
    """RULE-TAX-01: annual income of the tax return against twelve times the monthly one, or without it against the stated one.

    Whether the stated one is a month's says is_monthly, else period ("annual", "monthly"), else which of the two is closer to the return.
    An invalid tolerance counts as 0.10.
    """
    closer = F.abs(yearly * 12 - stated) < F.abs(yearly - stated)
    flag, named = (F.lit(None) if x is None else x for x in (is_monthly, period))
    of_month = F.coalesce(flag.cast("boolean"), F.when(named == "monthly", True).when(named == "annual", False), closer)
    base = F.when(of_month, yearly * 12).otherwise(yearly)
    base = base if monthly is None else F.coalesce(monthly * 12, base)
    return within(base, stated, tolerance if 0 <= tolerance < float("inf") else 0.10)


def deviation_direction(stated: Column, observed: Column) -> Column:
    return F.when(observed < stated, "under_reports").when(observed > stated, "over_reports").otherwise("equal")


def bank_balance(opening: Column, closing: Column, credits: Column, debits: Column, tolerance: str = "0.05") -> Column:
    """RULE-BANK-01: closing = opening + credits - debits within an absolute tolerance. Null totals are unknown."""
    gap = F.abs(closing - (opening + credits - debits))
    sound = opening.isNotNull() & closing.isNotNull() & credits.isNotNull() & debits.isNotNull() & (credits >= 0) & (debits >= 0)
    return F.when(~F.coalesce(sound, F.lit(False)), UNKNOWN).when(gap <= F.lit(tolerance).cast("decimal(18,2)"), PASS).otherwise(FLAG)


def poisoned_sum(amount: Column) -> Column:
    """A group's sum; null if an element is missing or negative."""
    return F.when(~F.bool_or(amount.isNull() | (amount < 0)), F.sum(amount))


def completeness(documents: DataFrame, required: dict[str, int], key: str, kind: str) -> DataFrame:
    """RULE-COMP-01: (key, verdict, missing) from documents (key, kind) and the number needed of each type.

    Any unusable type makes the key unknown; a type with fewer documents than needed flags it.
    """
    typed = documents.select(key, T.normal_type(kind).alias("doc_type"))
    counts = typed.groupBy(key, "doc_type").agg(F.count(F.lit(1)).alias("present"))
    bad = counts.groupBy(key).agg(F.bool_or(F.col("doc_type").isNull() | F.col("doc_type").isin(T.UNUSABLE_TYPES)).alias("bad"))
    wanted = bad.select(key, "bad", F.explode(F.array(*[F.struct(F.lit(k).alias("doc_type"), F.lit(n).alias("needed")) for k, n in required.items()])).alias("x")).select(key, "bad", "x.*")
    have = wanted.join(counts, [key, "doc_type"], "left")
    short = F.coalesce(F.col("present"), F.lit(0)) < F.col("needed")
    found = have.groupBy(key).agg(F.bool_or("bad").alias("bad"), F.sort_array(F.collect_list(F.when(short, F.col("doc_type")))).alias("missing"))
    verdict = F.when(F.col("bad"), UNKNOWN).when(F.size("missing") > 0, FLAG).otherwise(PASS)
    return found.select(key, verdict.alias("verdict"), F.array_join("missing", ",").alias("missing"))


def name_level(score: Column) -> Column:
    return F.when(score < NAME_NEAR, 2).when(score < NAME_SAME, 1).otherwise(0)


def identity(names: DataFrame, key: str) -> DataFrame:
    """RULE-ID-01 from rows (key, applicant, applicant_pan, other, other_pan): the applicant against each document.

    PANs are compared before names; no document to compare with is unknown.
    """
    pan, other = T.normal_pan("applicant_pan"), T.normal_pan("other_pan")
    rows = names.select(key, (T.normal_name("applicant") == "").alias("nameless"), F.coalesce(pan != other, F.lit(False)).alias("pan_differs"), (F.col("other_pan").isNotNull() & other.isNull()).alias("pan_missing"), F.when(T.normal_name("other") != "", T.name_similarity("applicant", "other")).alias("score"))
    found = rows.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in ("nameless", "pan_differs", "pan_missing")], F.min("score").alias("score"))
    verdict = F.when(F.col("nameless"), UNKNOWN).when(F.col("pan_missing"), UNKNOWN).when(F.col("pan_differs"), FLAG).when(F.col("score").isNull(), UNKNOWN).when(name_level(F.col("score")) > 0, FLAG).otherwise(PASS)
    return found.select(key, verdict.alias("verdict"), F.round("score", 4).alias("min_score"))


def identity_documents(names: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """RULE-ID-02: a key's first document against each other one; keys with fewer than two give no row."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = names.select(key, order, F.col(name).alias("name"), F.first(name).over(w).alias("first"), F.row_number().over(w).alias("n"))
    level = ranked.filter("n > 1").withColumn("level", name_level(T.name_similarity("first", "name")))
    return level.groupBy(key).agg(F.max("level").alias("level"), F.count(F.lit(1)).alias("compared")).select(key, F.element_at(F.array(F.lit("pass"), F.lit("variation"), F.lit("mismatch")), F.col("level") + 1).alias("verdict"), "compared")


def findings(**verdicts: Column) -> Column:
    """An array of (rule_id, verdict) in the given order."""
    return F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("rule_id"), v.alias("verdict")) for k, v in verdicts.items()])


def all_clear(found: Column) -> Column:
    return ~F.exists(found, lambda x: x["verdict"] != PASS)


def review_problem(decision: Column, notes: Column, corrections: Column, typed_id: Column, application_id: Column) -> Column:
    """What forbids a reviewer's decision, the first of: notes too short or too long, too many corrections, another id typed. Null if nothing does."""
    clean = F.length(F.regexp_replace(F.coalesce(notes, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (
        F.when(decision.isin("REJECTED", "NEEDS_INFO") & (clean < 5), "notes_too_short")
        .when(clean > 5000, "notes_too_long")
        .when(F.coalesce(F.size(corrections), F.lit(0)) > 50, "too_many_corrections")
        .when(F.regexp_replace(typed_id, r"(?U)^\s+|\s+$", "") != application_id, "id_differs")
    )
