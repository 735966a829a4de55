"""A parent with its children, and the appraisal memo that is written from them and then gated by its own citations.

Every child table is gathered to one ordered array a key, by the same key as the parent, so all joins share one
partitioning. A memo is one text a key, so a key's rows meet in one task however many there are; that is bounded by
the memo's own length. Lines without a value are left out, missing values say UNKNOWN, and ids are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import grounding as G

# Headings, labels and badges of a memo.
TITLE, APPLICANT = "# Credit Appraisal Memo (CAM) — ", "**Applicant Name:** "
SECTIONS = ["## 1. Executive Summary", "## 2. Applicant Details", "## 3. Financial Analysis", "## 4. Rule Findings", "## 5. Evidence / Grounding", "## 6. Human Underwriter Review"]
BADGES = {"pass": "✅ PASS", "flag": "⚠️ FLAG", "unknown": "❓ UNKNOWN"}
ALL_UPLOADED = "- **Missing Mandatory Documents:** None (All mandatory documents uploaded)"
GROUPS = {"flag": ("#### ⚠️ Flagged Findings (Attention Required)", "- None (No discrepancies flagged)."), "pass": ("#### ✅ Passed Findings (Verified)", "- None."), "unknown": ("#### ❓ Unknown Findings (Information Needed / Incomplete)", "- None.")}
NO_RULES, NO_EVIDENCE = "No deterministic rule findings have been evaluated.", "- **Supporting Evidence Citations:** None attached."
NO_DOCUMENTS, NO_PASSAGES = "- No uploaded documents registered in dossier manifest.", "- No underwriting policy passages retrieved."
GROUNDED, PENDING = "✅ PASS (Strictly Grounded)", "ℹ️ PENDING / UNVERIFIED"
#: Parts of the financial section: heading, document type, and its lines as (label, fact, how it is shown).
FINANCIAL = [
    ("### Payslip Financial Facts", "payslip", [("Pay Period", "pay_period", "text"), ("Gross Monthly Salary", "gross_salary", "money"), ("Net Take-Home Salary", "net_salary", "money"), ("Total Deductions", "deductions", "money")]),
    ("### Bank Statement Financial Facts", "bank_statement", [("Bank Name", "bank_name", "text"), ("Account Holder", "account_holder", "text"), ("Account Number (Masked)", "account_number", "account"), ("Average Monthly Salary Credit", "average_salary_credit", "money"), ("Closing Account Balance", "closing_balance", "money"), ("Bounced Transactions Count", "bounced", "text")]),
    ("### Income Tax Return (ITR-V) Facts", "tax_acknowledgement", [("Assessee Name", "assessee_name", "text"), ("Assessment Year", "assessment_year", "text"), ("Gross Total Annual Income", "gross_total_income", "money"), ("Total Tax Paid", "tax_paid", "money")]),
]
EVIDENCE = ["document_id", "document_type", "page_number", "quoted_span"]
BLANKS = ["- **Reviewer:** _________________________________________", "- **Decision:** [ ] APPROVED   [ ] REJECTED   [ ] NEEDS_INFO", "- **Comments:** _________________________________________", "- **Signature:** _________________________________________", "- **Date:** ____________________"]
# Own words for the two notices.
RULES_DECIDE = "> Verdicts and totals come from fixed rules; generated text only explains them, and a person decides. Every fact names its document and page."
SIGN_OFF = "> **SIGN-OFF:** No lending decision is made here. A qualified underwriter inspects all findings above before deciding."


def nested(parent: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """``parent`` with an array of each child's rows (table, columns that order them); keys without children have empty arrays.

    Rows of an array are structs of all of the child's columns but the key, the ordering ones first. Children of no parent are left out.
    """
    out = parent
    for name, (child, order) in children.items():
        row = F.struct(*order, *[c for c in child.columns if c not in [key, *order]])
        rows = child.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias(name))
        kind = rows.schema[name].dataType
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def without_children(children: dict[str, DataFrame], key: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """All child tables without the rows of deleted parents (key)."""
    gone = deleted.select(key).distinct()
    return {name: child.join(gone, key, "left_anti").select(*child.columns) for name, child in children.items()}


def _labelled(label: str, value: Column, tick: bool = False) -> Column:
    quote = "`" if tick else ""
    return F.concat(F.lit(f"- **{label}:** {quote}"), value.cast("string"), F.lit(quote))


def _cited(e: Column) -> Column:
    """An evidence struct as text; null for null."""
    return F.concat(F.lit("`["), e["document_id"], F.lit("]` "), F.coalesce(e["document_type"], F.lit("document")), F.lit(" (Page "), F.coalesce(e["page_number"], F.lit(1)).cast("string"), F.lit('): "'), F.coalesce(e["quoted_span"], F.lit("")), F.lit('"'))


def _lines(of: Column, to_line, none: str) -> Column:
    return F.when(F.size(of) > 0, F.array_join(F.transform(of, to_line), "\n")).otherwise(none)


def _financial(facts: Column) -> list[Column]:
    out = []
    for heading, kind, rows in FINANCIAL:
        out.append(F.lit(heading))
        for label, fact, how in rows:
            f = F.element_at(facts, F.lit(f"{kind}.{fact}"))
            value = T.format_money(f["amount"]) if how == "money" else T.mask_account(f["value"]) if how == "account" else F.coalesce(T.known(f["value"]), F.lit("UNKNOWN"))
            out.append(_labelled(label, value, how == "account"))
            if how == "money":
                out.append(F.concat(F.lit("  - *Evidence:* "), _cited(f["evidence"])))
        out.append(F.lit(""))
    return out


def _badge(verdict: Column) -> Column:
    return F.when(verdict == "pass", BADGES["pass"]).when(verdict == "flag", BADGES["flag"]).otherwise(BADGES["unknown"])


def _detail(f: Column) -> Column:
    """All lines of one finding."""
    badge = _badge(f["verdict"])
    evidence = _lines(f["evidence"], lambda e: F.concat(F.lit("  - "), _cited(e)), NO_EVIDENCE)
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), badge, F.lit(" "), f["rule_id"], F.lit(": "), f["rule_name"]), _labelled("Verdict", badge), _labelled("Policy Version", f["policy_version"], True),
        _labelled("Determination", f["reason"]), F.concat(F.lit("- **"), f["rule_name"], F.lit("** ("), f["rule_id"], F.lit(") ["), badge, F.lit("]: "), f["reason"]),
        F.when(F.size(f["evidence"]) > 0, F.lit("- **Supporting Evidence Citations:**")), evidence, F.lit(""),
    )


def memos(applications: DataFrame, key: str, documents: DataFrame, missing: DataFrame, facts: DataFrame, findings: DataFrame, evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, memo, documents, passages): one text of six sections a row of ``applications``; see ``gated``.

    applications: key, status, full_name, dob, pan, aadhaar, decision, notes. The others hold the key and
    documents: document_id, doc_type; missing: doc_type; facts: kind, fact, value, amount, evidence (struct of document_id,
    document_type, page_number, quoted_span), of which a kind's and fact's first by document stays;
    findings: seq, rule_id, rule_name, verdict, reason, policy_version; evidence: rule_id and the fields of evidence; passages: seq, chunk_id.
    """
    fields = EVIDENCE
    # evidence goes by its line's text: the bracket after an id sorts behind digits, so ids alone order it otherwise where one begins another
    of_rule = evidence.groupBy(key, "rule_id").agg(F.sort_array(F.collect_list(F.struct(_cited(F.struct(*fields)).alias("line"), *fields))).alias("evidence"))
    ruled = findings.join(of_rule, [key, "rule_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(of_rule.schema["evidence"].dataType)))
    named = facts.groupBy(key, F.concat_ws(".", "kind", "fact").alias("name")).agg(F.min_by(F.struct("value", "amount", "evidence"), F.struct(F.col("evidence.document_id").isNull(), "evidence.document_id")).alias("fact"))
    known = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "fact"))).alias("facts"))
    all_ = nested(applications, key, documents=(documents, ["document_id"]), missing=(missing, ["doc_type"]), findings=(ruled, ["seq"]), passages=(passages, ["seq"])).join(known, key, "left")
    return written(all_, key)


def evidence_of(*shown: Column) -> Column:
    """The evidence of one finding as ``written`` takes it, from structs of which those that are null show nothing; ordered by their lines' text, as in ``memos``."""
    line = lambda e: F.struct(_cited(e).alias("line"), *[e[c].alias(c) for c in EVIDENCE])
    return F.sort_array(F.transform(F.filter(F.array(*shown), lambda e: e.isNotNull()), line))


def written(rows: DataFrame, key: str) -> DataFrame:
    """(key, memo, documents, passages) of applications that hold their children already: arrays documents, missing, findings (each with its evidence) and
    passages in their order, and a map of facts by kind and name."""
    found, docs, ids = F.col("findings"), F.col("documents"), F.transform("passages", lambda p: p["chunk_id"])
    count = lambda v: F.size(F.filter(found, lambda f: _badge(f["verdict"]) == BADGES[v])).cast("string")
    name, lacking = T.known("full_name"), F.array_join(F.transform("missing", lambda m: m["doc_type"]), ", ")
    employer = F.element_at("facts", F.lit("payslip.employer_name"))["value"]
    source = F.element_at("facts", F.lit("id_card.full_name"))["evidence"]
    group = lambda v: [F.lit(GROUPS[v][0]), _lines(F.filter(found, lambda f: _badge(f["verdict"]) == BADGES[v]), lambda f: F.concat(F.lit("- **"), f["rule_id"], F.lit(" ("), f["rule_name"], F.lit("):** "), f["reason"]), GROUPS[v][1]), F.lit("")]
    blank = F.lit("")
    sections = [
        [F.concat(F.lit(TITLE), F.col(key).cast("string")), F.concat(F.lit("### Credit Appraisal Memo — "), F.col(key).cast("string")), F.concat(F.lit(APPLICANT), F.coalesce(name, F.lit("Unknown Applicant"))), blank],
        [
            _labelled("Application ID", F.col(key)), _labelled("Status at Memo Generation", F.col("status"), True), _labelled("Total Rules Evaluated", F.size(found)),
            _labelled("Audit Verdict Summary", F.concat(count("pass"), F.lit(" Passed | "), count("flag"), F.lit(" Flagged | "), count("unknown"), F.lit(" Unknown"))),
            _labelled("Documents Uploaded / Checked", F.concat(F.size(docs).cast("string"), F.lit(" registered"))),
            F.when(F.size("missing") > 0, F.concat(F.lit("- **Missing Mandatory Documents:** ⚠️ `"), lacking, F.lit("`\n**Missing Mandatory Documents:** "), lacking)).otherwise(ALL_UPLOADED), blank, F.lit(RULES_DECIDE), blank,
        ],
        [
            _labelled("Applicant Full Name", F.coalesce(name, F.lit("UNKNOWN"))), _labelled("Date of Birth", F.coalesce(T.known("dob"), F.lit("UNKNOWN"))), _labelled("Permanent Account Number (PAN)", T.mask_pan("pan"), True),
            _labelled("Aadhaar ID (Masked)", T.mask_aadhaar("aadhaar"), True), _labelled("Employer / Organization", F.coalesce(T.known(employer), F.lit("UNKNOWN"))),
            F.concat(F.lit("- **Identity Source Citation:** `["), source["document_id"], F.lit("]` Page "), source["page_number"].cast("string"), F.lit(' (Quoted: "'), source["quoted_span"], F.lit('")')), blank,
        ],
        _financial(F.col("facts")),
        [F.when(F.size(found) == 0, F.lit(NO_RULES)).otherwise(F.concat_ws("\n", F.lit("### Findings Verdict Grouping"), blank, *group("flag"), *group("pass"), *group("unknown"), F.lit("### Detailed Rule Evaluation"), blank, F.array_join(F.transform(found, _detail), "\n")))],
        [
            F.lit("### Dossier Manifest Provenance"), _lines(docs, lambda d: F.concat(F.lit("- `["), d["document_id"], F.lit("]` Classified Type: **"), F.coalesce(d["doc_type"], F.lit("unknown")), F.lit("**")), NO_DOCUMENTS), blank,
            F.lit("### Authoritative Policy Guidance & Citations"), F.concat(F.lit("Referenced guidelines: "), F.when(F.size(ids) > 0, F.array_join(F.transform(ids, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")).otherwise("None")),
            _lines(ids, lambda c: F.concat(F.lit("- Referenced Policy Passage: ["), c, F.lit("]")), NO_PASSAGES), blank, _labelled("Citation Grounding Gate Status", F.lit(PENDING)), blank,
        ],
        [F.lit(SIGN_OFF), blank, _labelled("Reviewer Decision Recorded", F.col("decision"), True), F.when(F.col("decision").isNotNull(), _labelled("Underwriter Notes", F.col("notes"))), F.when(F.col("decision").isNotNull(), blank), *map(F.lit, BLANKS), blank],
    ]
    head, *rest = sections
    lines = [*head, *[x for heading, body in zip(SECTIONS, rest, strict=True) for x in (F.lit(heading), blank, *body)]]
    return rows.select(key, F.concat_ws("\n", *lines).alias("memo"), F.transform(docs, lambda d: d["document_id"]).alias("documents"), ids.alias("passages"))


def gated(memos_: DataFrame, memo: str = "memo", documents: str = "documents", passages: str = "passages") -> DataFrame:
    """``memos_`` with the gate's outcome: cited (the memo's own citations but for its documents), grounded, and the memo without lines that cite anything else."""
    seen, some = "_cites", F.size(passages) > 0
    rows = memos_.withColumn(seen, G.citations(memo))  # a text is searched once
    cited = F.filter(F.array_except(seen, documents), lambda c: ~G._exempt(c, G.EXEMPT))
    grounded = some & (F.size("cited") > 0) & (F.size(F.array_except("cited", G.expand_aliases(F.col(passages)))) == 0)
    # documents count as authorised for the lines, and as nothing where no passage was retrieved
    known = F.when(some, F.concat(F.col(passages), F.col(documents))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("cited", cited).withColumns({"grounded": grounded, memo: G.sanitised(F.col(memo), known, F.col(seen))}).drop(seen)
