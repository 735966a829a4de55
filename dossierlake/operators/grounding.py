"""Gates for generated text: citations must be authorised, numbers must be known, injected commands are found and defused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CITATION = r"\[([a-zA-Z0-9_\-]+)\]"
# Tags that are no citations.
EXEMPT = ["PASS", "FLAG", "UNKNOWN", "ABSTENTION", "DOC", "APP"]
BADGES = ["PASS", "FLAG", "UNKNOWN", "ABSTENTION"]
# Words that a claim must not use without a citation.
CLAIM_WORDS = ["salary", "inr", "ratio", "dti", "pass", "flag", "approved"]
# Patterns of injected commands.
INJECTIONS = [
    r"\b(system\s+override|ignore\s+(?:all\s+)?previous\s+(?:rules|instructions|prompts))\b",
    r"\b(disregard\s+(?:all\s+)?(?:previous\s+)?instructions)\b",
    r"\b(assign\s+pass\s+to\s+all|override\s+all\s+(?:rules|checks)|bypass\s+credit\s+checks)\b",
    r"\b(you\s+are\s+now\s+in\s+developer\s+mode|jailbreak|dan\s+mode)\b",
    r"\b(new\s+system\s+prompt|print\s+system\s+prompt|reveal\s+instructions)\b",
    r"\b(verdict\s*:\s*pass\s+regardless|force\s+pass|approve\s+unconditionally)\b",
]
# Patterns of decisions that are left to people.
DISPOSITIONS = [
    r"\b(approve[sd]?|approving|approval\s+(?:granted|is\s+therefore))\b",
    r"\b(reject[sed]?|rejecting|rejection)\b",
    r"\b(sanction[sed]?|sanctioning)\b",
    r"\b(loan\s+(?:is\s+)?(?:approved|rejected|sanctioned|denied|declined|granted))\b",
    r"\b(credit\s+decision\s+is\s+(?:favourable|favorable|positive|negative))\b",
]
# Names under which policy passages may be cited.
POLICY_ALIASES = {
    "credit_policy_v1_p1": ["CHUNK-POLICY-SAL-02", "CHUNK-POLICY-TAX-03", "credit_policy_v1_p1_c0"],
    "credit_policy_v1_p2": ["CHUNK-POLICY-REQ-01", "credit_policy_v1_p2_c0"],
    "kyc_guidelines_v1_p1": ["CHUNK-POLICY-KYC-01", "kyc_guidelines_v1_p1_c0"],
}
# What a gated answer says, and what is wrong with a narrative.
DROPPED_LINE = "> ⚠️ [UNGROUNDED CLAIM DROPPED - Unauthorized citations: "
SOME_DROPPED = "> ⚠️ [ABSTENTION: One or more claims were dropped due to lack of verified citation grounding.]"
NONE_CITED = "> ⚠️ [ABSTENTION: This answer did not cite any verified policy or application evidence and has been withheld. Rephrase the question or consult the source documents directly.]"
EMPTY_ANSWER = "> ⚠️ [ABSTENTION: Summary empty or missing.]"
NO_EVIDENCE = "> ⚠️ [ABSTENTION: Mandatory supporting evidence missing or unverified.]"
NO_FINDINGS = "no deterministic findings supplied: narrative has no numeric anchor"
DECIDES = "autonomous disposition language forbidden: "
LOOSE_FIGURE = "ungrounded monetary figure not in findings: "
LOOSE_CITATION = "unauthorized citation in narrative: "
INJECTED = "prompt-injection pattern in narrative: "
EMPTY_NARRATIVE = "empty narrative: nothing to verify"


def citations(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def expand_aliases(authorised: Column) -> Column:
    """An array of ids with all names of every passage that any of its names authorises."""
    groups = [F.array(*map(F.lit, [k, *v])) for k, v in POLICY_ALIASES.items()]
    more = [F.when(F.arrays_overlap(authorised, g), g).otherwise(F.array().cast("array<string>")) for g in groups]
    return F.array_distinct(F.concat(authorised, *more))


def resolved(cited: DataFrame, authorised: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, cited, passage, authorised) of cited rows (key, cited), from authorised ids (key, id) and a table of aliases (alias, passage).

    Both sides go by the passage that an id is an alias of, or by the id itself, so any name of a passage authorises all of them. An alias
    of several passages stands for each. Ids meet by joins, so neither table need fit one place.
    """
    names = aliases.select("alias", F.col("passage").alias("_p")).distinct()
    passage = lambda df, c: df.join(names, F.col(c) == F.col("alias"), "left").withColumn("passage", F.coalesce("_p", c)).drop("alias", "_p")
    allowed = passage(authorised.select(key, "id"), "id").select(key, "passage").distinct().withColumn("_ok", F.lit(True))
    return passage(cited, "cited").join(allowed, [key, "passage"], "left").select(key, "cited", "passage", F.coalesce("_ok", F.lit(False)).alias("authorised"))


def _exempt(tag: Column, prefixes: list[str]) -> Column:
    up = F.upper(tag)
    out = F.lit(False)
    for p in prefixes:
        out = out | up.startswith(p)
    return out


def unauthorised(text: Column | str, authorised: Column, prefixes: list[str] = EXEMPT) -> Column:
    """The citations of a text that are neither authorised nor exempt."""
    return F.filter(F.array_except(citations(text), authorised), lambda c: ~_exempt(c, prefixes))


def valid_claims(claims: DataFrame, key: str, text: str, cited: str, authorised: str) -> DataFrame:
    """(key, valid) from claims (key, text, array of cited ids, array of authorised ids).

    Valid: something is authorised, no claim cites anything else, claims on figures and verdicts cite, and one citation holds.
    """
    allowed = expand_aliases(F.col(authorised))
    n = F.coalesce(F.size(cited), F.lit(0))
    asserts = F.lit(False)
    for w in CLAIM_WORDS:
        asserts = asserts | F.lower(text).contains(w)
    rows = claims.select(key, F.coalesce(F.size(authorised), F.lit(0)).alias("have"), ((n <= 0) & asserts).alias("bare"), ((n > 0) & (F.size(F.array_except(cited, allowed)) > 0)).alias("foreign"), (n > 0).alias("cites"))
    return rows.groupBy(key).agg((F.bool_and(F.col("have") > 0) & ~F.bool_or("bare") & ~F.bool_or("foreign") & F.bool_or("cites")).alias("valid"))


def grounded(claims: DataFrame, cited: str, authorised: str, keep: bool = True) -> DataFrame:
    """The claims of which every citation is authorised and at least one is there; with keep=False, the others."""
    good = F.coalesce((F.size(cited) > 0) & (F.size(F.array_except(cited, expand_aliases(F.col(authorised)))) == 0), F.lit(False))
    return claims.filter(good if keep else ~good)


def sanitised(text: Column, authorised: Column, cites: Column | None = None) -> Column:
    """A text without the lines that cite what isn't authorised; withheld if nothing is cited at all. ``cites``: the text's citations, where they are known.

    No citation goes over a line's end, so a text of which no citation is bad has no bad line, and only the others are taken apart. What a
    line needs of its text is computed once a text.
    """

    def checked(t: Column, have: Column, allowed: Column) -> Column:
        bad = lambda of: F.filter(F.array_except(of, allowed), lambda c: ~_exempt(c, EXEMPT))
        kept = F.transform(F.split(t, "\n"), lambda x: T.let(bad(citations(x)), lambda b: F.when(F.size(b) > 0, F.concat(F.lit(DROPPED_LINE), F.array_join(b, ", "), F.lit("]"))).otherwise(x)))
        return F.when(F.size(have) == 0, NONE_CITED).when(F.size(bad(have)) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n\n" + SOME_DROPPED))).otherwise(t)

    def gate(t: Column) -> Column:
        parts = T.let(F.struct((citations(t) if cites is None else cites).alias("have"), expand_aliases(authorised).alias("allowed")), lambda s: checked(t, s["have"], s["allowed"]))
        return F.when(F.coalesce(t, F.lit("")) == "", EMPTY_ANSWER).when(F.coalesce(F.size(authorised), F.lit(0)) <= 0, F.concat(t, F.lit("\n\n" + NO_EVIDENCE))).otherwise(parts)

    return T.let(text, gate)


def injections(text: Column | str) -> Column:
    """The distinct injected commands in a text."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in INJECTIONS]))


def defused(text: Column | str) -> Column:
    """A text in which injected commands are marked, and code fences are plain quotes."""
    out = F.col(text) if isinstance(text, str) else text
    for p in INJECTIONS:
        out = F.regexp_replace(out, "(?i)" + p, "[DEFUSED_ADVERSARIAL_SPAN: $1]")
    return F.replace(out, F.lit("```"), F.lit("'''"))


def narrative_issues(text: Column, known_numbers: Column, authorised: Column, findings: Column) -> Column:
    """What is wrong with a generated narrative, in order; an empty array if it is grounded."""
    some = lambda cond, message: F.when(cond, F.array(message)).otherwise(F.array().cast("array<string>"))
    parts = [some(F.coalesce(findings, F.lit(0)) == 0, F.lit(NO_FINDINGS))]
    for p in DISPOSITIONS:
        hit = F.trim(F.regexp_extract(text, "(?i)" + p, 0))
        parts.append(some(hit != "", F.concat(F.lit(DECIDES + "'"), hit, F.lit("'"))))
    loose = F.array_except(T.amounts(text), known_numbers)
    parts.append(F.transform(loose, lambda x: F.concat(F.lit(LOOSE_FIGURE), F.format_number(x, 2))))
    parts.append(F.transform(unauthorised(text, expand_aliases(authorised), BADGES), lambda c: F.concat(F.lit(LOOSE_CITATION + "["), c, F.lit("]"))))
    found = injections(text)
    parts.append(some(F.size(found) > 0, F.concat(F.lit(INJECTED), F.get(found, F.lit(0)))))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array(F.lit(EMPTY_NARRATIVE))).otherwise(F.concat(*parts))
