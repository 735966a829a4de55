"""Queries that reconcile ledgers with the rules of ``operators.rules``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as R
from ..sources import synth
from ..sources.readers import spread, table
from .catalog import query

_LINES = "SELECT l_orderkey, sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS DECIMAL(18,2))) AS observed FROM lineitem GROUP BY l_orderkey"
_RECON = f"""SELECT o_orderkey, CASE WHEN observed IS NULL OR observed <= 0 OR stated <= 0 THEN 'unknown' WHEN abs(stated - observed) <= CAST(TOL AS DECIMAL(6,4)) * stated THEN 'pass' ELSE 'flag' END AS verdict,
 CASE WHEN observed < stated THEN 'under_reports' WHEN observed > stated THEN 'over_reports' ELSE 'equal' END AS direction
 FROM (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS stated FROM orders) LEFT JOIN ({_LINES}) ON o_orderkey = l_orderkey"""


def _money(c):
    """Two places in decimals; the round keeps both engines from casting a binary half differently."""
    return F.round(c, 2).cast("decimal(18,2)")


def _recon(spark: SparkSession, sf_dir: str, tolerance: float) -> DataFrame:
    line = _money(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(line).alias("observed"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _money(F.col("o_totalprice")).alias("stated"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", R.within(F.col("stated"), F.col("observed"), tolerance).alias("verdict"), R.deviation_direction(F.col("stated"), F.col("observed")).alias("direction"))


@query("recon_order_total", _RECON.replace("TOL", "0.05"))
def recon_order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated order totals against the sum of their lines, five in a hundred."""
    return _recon(spark, sf_dir, 0.05)


@query("recon_order_total_10pct", _RECON.replace("TOL", "0.10"))
def recon_order_total_10pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon(spark, sf_dir, 0.10)


_D = "CAST(round(o_totalprice, 2) AS DECIMAL(18,2))"


@query(
    "recon_annualised",
    f"""WITH m AS (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS mo, sum({_D}) AS total FROM orders GROUP BY ALL),
 a AS (SELECT o_custkey, y, min_by(total, mo) AS first_month, sum(total) AS yearly FROM m GROUP BY ALL)
 SELECT o_custkey, CAST(y AS INTEGER) AS y, CASE WHEN first_month * 12 <= 0 OR yearly <= 0 THEN 'unknown' WHEN abs(first_month * 12 - yearly) <= CAST(0.10 AS DECIMAL(6,4)) * first_month * 12 THEN 'pass' ELSE 'flag' END AS verdict FROM a""",
)
def recon_annualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve times a customer's first month of a year against the year."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    months = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).agg(F.sum(_money(F.col("o_totalprice"))).alias("total"))
    years = months.groupBy("o_custkey", "y").agg(F.min_by("total", "mo").alias("first_month"), F.sum("total").alias("yearly"))
    return years.select("o_custkey", "y", R.tax(F.col("yearly"), F.col("yearly"), F.col("first_month")).alias("verdict"))


@query(
    "balance_equation",
    f"""WITH o AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN {_D} ELSE 0 END) AS credits, sum(CASE WHEN o_orderstatus <> 'F' THEN {_D} ELSE 0 END) AS debits FROM orders GROUP BY 1),
 c AS (SELECT c_custkey, CAST(round(c_acctbal, 2) AS DECIMAL(18,2)) AS opening, credits, debits FROM customer LEFT JOIN o ON c_custkey = o_custkey),
 d AS (SELECT *, opening + credits - debits + CASE WHEN c_custkey % 3 = 0 THEN CAST(0.05 AS DECIMAL(18,2)) WHEN c_custkey % 3 = 1 THEN CAST(0.06 AS DECIMAL(18,2)) ELSE 0 END AS closing FROM c)
 SELECT c_custkey, CASE WHEN closing IS NULL THEN 'unknown' WHEN abs(closing - (opening + credits - debits)) <= CAST(0.05 AS DECIMAL(18,2)) THEN 'pass' ELSE 'flag' END AS verdict FROM d""",
)
def balance_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening + credits - debits against a closing balance that is off by five or six hundredths for some customers."""
    amount, done = _money(F.col("o_totalprice")), F.col("o_orderstatus") == "F"
    moves = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(done, amount).otherwise(0)).alias("credits"), F.sum(F.when(~done, amount).otherwise(0)).alias("debits"))
    c = table(spark, sf_dir, "customer").select("c_custkey", _money(F.col("c_acctbal")).alias("opening")).join(moves, F.col("c_custkey") == F.col("o_custkey"), "left")
    off = F.when(F.col("c_custkey") % 3 == 0, F.lit("0.05")).when(F.col("c_custkey") % 3 == 1, F.lit("0.06")).otherwise(F.lit("0")).cast("decimal(18,2)")
    c = c.withColumn("closing", F.col("opening") + F.col("credits") - F.col("debits") + off)
    return c.select("c_custkey", R.bank_balance(*map(F.col, ("opening", "closing", "credits", "debits"))).alias("verdict"))


@query(
    "poisoned_sums",
    """SELECT user_id, CASE WHEN NOT bool_or(value IS NULL OR value < 0.5) THEN count(*) END AS n FROM events GROUP BY user_id""",
)
def poisoned_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's number of events, missing if one of their values is missing or too small."""
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value").isNull() | (F.col("value") < 0.5), -1).otherwise(1).alias("one"))
    return rows.groupBy("user_id").agg(R.poisoned_sum(F.col("one")).alias("n"))


_NEEDED = {"click": 3, "purchase": 2, "signup": 1, "view": 3}


@query(
    "completeness_by_user",
    """WITH need(doc_type, needed) AS (VALUES ('click', 3), ('purchase', 2), ('signup', 1), ('view', 3)),
 c AS (SELECT user_id, event_type, count(*) AS present FROM events WHERE event_type <> 'error' OR value > 90 GROUP BY ALL), u AS (SELECT user_id, bool_or(event_type = 'error') AS bad FROM c GROUP BY 1),
 h AS (SELECT u.user_id, bad, doc_type, coalesce(present, 0) < needed AS short FROM u CROSS JOIN need LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = doc_type)
 SELECT user_id, CASE WHEN bool_or(bad) THEN 'unknown' WHEN bool_or(short) THEN 'flag' ELSE 'pass' END AS verdict, coalesce(string_agg(CASE WHEN short THEN doc_type END, ',' ORDER BY doc_type), '') AS missing FROM h GROUP BY user_id""",
)
def completeness_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of events a user has too few of; large errors make the user unknown."""
    events = table(spark, sf_dir, "events").filter("event_type <> 'error' or value > 90")
    return R.completeness(events, _NEEDED, "user_id", "event_type")




_NAME = "array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')), ' ')"
_CODES = "list_transform(string_split({}, ''), lambda c: [CAST(unicode(c) AS INTEGER)])"
# Rows of the table of common subsequences, one a letter of x, each an array that a fold over the letters of y appends to.
_COMMON = f"""list_reduce({_CODES.format('x')}, lambda prev, ch: list_reduce(list_transform(range(1, length(y) + 1), lambda j: [CAST(j AS INTEGER)]), lambda cur, j: list_append(cur, CASE WHEN ch[1] = ys[j[1]][1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[len(cur)]) END), [0]), list_transform(range(0, length(y) + 1), lambda z: 0))[-1]"""
_LIKE = f"CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 ELSE 2.0 * {_COMMON} / (length(x) + length(y)) END"


@query(
    "name_similarity_parts",
    f"""WITH p AS (SELECT p_partkey, {_NAME.format('p_name')} AS n, {_NAME.format("array_to_string(list_reverse(string_split(p_name, ' ')), ' ')")} AS turned, {_NAME.format('p_type')} AS kind FROM part),
 a AS (SELECT p_partkey, n AS x, turned AS y, {_CODES.format('turned')} AS ys FROM p), b AS (SELECT p_partkey, n AS x, kind AS y, {_CODES.format('kind')} AS ys FROM p)
 SELECT p_partkey, round(t, 4) AS turned, round(w, 4) AS with_type FROM (SELECT p_partkey, {_LIKE} AS t FROM a) JOIN (SELECT p_partkey, {_LIKE} AS w FROM b) USING (p_partkey)""",
)
def name_similarity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the name of its brand and type turned round."""
    parts = spread(table(spark, sf_dir, "part"))
    return parts.select("p_partkey", F.round(T.name_similarity("p_name", F.concat_ws(" ", F.reverse(F.split("p_name", " ")))), 4).alias("turned"), F.round(T.name_similarity("p_name", "p_type"), 4).alias("with_type"))


@query(
    "identity_documents",
    """WITH r AS (SELECT c_nationkey, c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g') AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
 f AS (SELECT c_nationkey, name AS first FROM r WHERE n = 1)
 SELECT c_nationkey, CASE WHEN bool_or(name <> first) THEN 'mismatch' ELSE 'pass' END AS verdict, count(*) AS compared FROM r JOIN f USING (c_nationkey) WHERE n > 1 GROUP BY 1""",
)
def identity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer's segment of each nation against the others'; segments are names that differ entirely."""
    return R.identity_documents(table(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_mktsegment"), "c_nationkey", "c_custkey", "c_mktsegment")


_NAMES = ", ".join(f"'{name}'" for name, (n, _) in synth.SCENARIOS.items() for _ in range(n))
_EXPECTED = "CASE " + " ".join(f"WHEN scenario = '{name}' AND rule_id = '{rule}' THEN '{verdict}'" for name, (_, odd) in synth.SCENARIOS.items() for rule, verdict in odd.items()) + " ELSE 'pass' END"


@query(
    "dossier_findings",
    f"""WITH s AS (SELECT i AS seed, [{_NAMES}][CAST(i % 50 + 1 AS BIGINT)] AS scenario, CAST(40000 + (i * 1375) % 90000 AS DECIMAL(18,2)) AS gross FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS i)),
 n AS (SELECT *, CAST(round(gross * 0.82, 2) AS DECIMAL(18,2)) AS net, scenario IN ('salary_mismatch', 'bank_mismatch', 'multiple_inconsistencies') AS off_bank, scenario IN ('tax_mismatch', 'multiple_inconsistencies') AS off_tax FROM s),
 d AS (SELECT *, CASE WHEN off_bank THEN CAST(round(net * {synth.LOW_CREDIT}, 2) AS DECIMAL(18,2)) ELSE net END AS credit, CASE WHEN scenario <> 'missing_itr' THEN CASE WHEN off_tax THEN CAST(round(gross * 12 * {synth.LOW_TAX}, 2) AS DECIMAL(18,2)) ELSE gross * 12 END END AS itr FROM n),
 b AS (SELECT *, CAST(round(credit * 3 * {synth.SPENT}, 2) AS DECIMAL(18,2)) AS debit FROM d), c AS (SELECT *, CAST({synth.OPENING} AS DECIMAL(18,2)) + credit * 3 - debit AS closing FROM b),
 f AS (SELECT printf('APP-%05d', seed) AS application_id, scenario, unnest([struct_pack(rule_id := 'RULE-COMP-01', verdict := CASE WHEN scenario IN ('missing_payslip', 'missing_itr') THEN 'flag' ELSE 'pass' END),
 struct_pack(rule_id := 'RULE-INC-01', verdict := CASE WHEN scenario = 'missing_payslip' THEN 'unknown' WHEN abs(net * 3 - credit * 3) <= 0.05 * net * 3 THEN 'pass' ELSE 'flag' END),
 struct_pack(rule_id := 'RULE-TAX-01', verdict := CASE WHEN scenario = 'missing_payslip' OR itr IS NULL THEN 'unknown' WHEN abs(gross * 12 - itr) <= 0.10 * gross * 12 THEN 'pass' ELSE 'flag' END),
 struct_pack(rule_id := 'RULE-ID-01', verdict := CASE WHEN scenario IN ('identity_mismatch', 'multiple_inconsistencies') THEN 'flag' ELSE 'pass' END),
 struct_pack(rule_id := 'RULE-BANK-01', verdict := CASE WHEN abs(closing - ({synth.OPENING} + credit * 3 - debit)) <= 0.05 THEN 'pass' ELSE 'flag' END)]) AS f FROM c), r AS (SELECT application_id, scenario, f.rule_id AS rule_id, f.verdict AS verdict FROM f)
 SELECT application_id, scenario, rule_id, verdict, {_EXPECTED} AS expected FROM r""",
)
def dossier_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rules over a dossier made of each customer's number, beside the outcomes that their scenarios expect."""
    d = synth.of_seeds(spread(table(spark, sf_dir, "customer", (F.col("c_custkey") + 1).alias("seed"))))
    comp = R.completeness(d.select("application_id", F.explode("documents").alias("kind")), {"application_form": 1, "bank_statement": 1, "id_card": 1, "payslip": 3, "tax_acknowledgement": 1}, "application_id", "kind").select("application_id", F.col("verdict").alias("comp"))
    ident = R.identity(d.select("application_id", F.col("full_name").alias("applicant"), F.col("pan").alias("applicant_pan"), F.col("payslip_name").alias("other"), F.lit(None).cast("string").alias("other_pan")), "application_id").select("application_id", F.col("verdict").alias("ident"))
    has_pay = F.array_contains("documents", "payslip")
    net, gross = F.when(has_pay, F.col("net")), F.when(has_pay, F.col("gross"))
    credits = F.aggregate("credits", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    rows = d.join(comp, "application_id").join(ident, "application_id")
    found = {"RULE-COMP-01": F.col("comp"), "RULE-INC-01": R.income(net, F.col("credits")), "RULE-TAX-01": R.tax(F.col("itr"), F.lit(None).cast("decimal(18,2)"), gross), "RULE-ID-01": F.col("ident"), "RULE-BANK-01": R.bank_balance(F.col("opening"), F.col("closing"), credits, F.col("debit"))}
    long = F.array(*[F.struct(F.lit(k).alias("rule_id"), v.alias("verdict"), F.element_at("expected", k).alias("expected")) for k, v in found.items()])
    return rows.select("application_id", "scenario", F.explode(long).alias("f")).select("application_id", "scenario", "f.*")


@query(
    "bbox_union",
    """SELECT l_orderkey, round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1 FROM (
 SELECT l_orderkey, greatest(0.0, least(l_quantity * 20, 612.0)) AS x0, greatest(0.0, least(l_linenumber * 150.0, 792.0)) AS y0,
 greatest(greatest(0.0, least(l_quantity * 20, 612.0)), greatest(0.0, least(l_quantity * 20 + 40 - l_linenumber * 10, 612.0))) AS x1, greatest(greatest(0.0, least(l_linenumber * 150.0, 792.0)), greatest(0.0, least(l_linenumber * 150.0 + 12, 792.0))) AS y1 FROM lineitem) GROUP BY 1""",
)
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of lines' numbers, kept within a page, and their union by order."""
    x, y = F.col("l_quantity") * 20, F.col("l_linenumber") * F.lit(150.0)
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", *[c.alias(n) for c, n in zip(T.clamp_box(x, y, x + 40 - F.col("l_linenumber") * 10, y + 12, 612.0, 792.0), ("x0", "y0", "x1", "y1"), strict=True)])
    return boxes.groupBy("l_orderkey").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(
    "memo_lines",
    """SELECT o_orderkey, concat('- [', CASE WHEN o_orderstatus = 'F' THEN 'PASS' WHEN o_orderstatus = 'O' THEN 'FLAG' ELSE 'UNKNOWN' END, '] order ', o_orderkey, ' (Page ', o_orderkey % 7 + 1, '): INR ', format('{:,.2f}', round(o_totalprice, 2))) AS line FROM orders""",
)
def memo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a memo for each order: badge, evidence and amount."""
    badge = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FLAG").otherwise("UNKNOWN")
    line = F.concat(F.lit("- ["), badge, F.lit("] order "), F.col("o_orderkey"), F.lit(" (Page "), F.col("o_orderkey") % 7 + 1, F.lit("): "), T.format_money(_money(F.col("o_totalprice"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query(
    "emi_by_order",
    """SELECT o_orderkey, round(o_totalprice * (0.085 / 12) * pow(1 + 0.085 / 12, n) / (pow(1 + 0.085 / 12, n) - 1), 4) AS emi FROM (SELECT o_orderkey, o_totalprice, 12 * (o_orderkey % 5 + 1) AS n FROM orders)""",
)
def emi_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly instalment of a loan of each order's total over one to five years."""
    r, n = 0.085 / 12, 12 * (F.col("o_orderkey") % 5 + 1)
    grown = F.pow(F.lit(1 + r), n)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * r * grown / (grown - 1), 4).alias("emi"))


@query(
    "verdict_counts",
    f"SELECT verdict, direction, count(*) AS n FROM ({_RECON.replace('TOL', '0.05')}) GROUP BY ALL",
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recon(spark, sf_dir, 0.05).groupBy("verdict", "direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "uninspected_flags",
    f"SELECT o_orderkey FROM ({_RECON.replace('TOL', '0.05')}) WHERE verdict = 'flag' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def uninspected_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags without a returned line as evidence."""
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    flags = _recon(spark, sf_dir, 0.05).filter("verdict = 'flag'").select("o_orderkey")
    return flags.join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query(
    "first_and_latest_order",
    """SELECT o_custkey, first_key, last_key FROM (SELECT o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_key,
 first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def first_and_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By aggregates instead of windows, so that partial results go before the shuffle."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_key"), F.max_by("o_orderkey", at).alias("last_key"))


