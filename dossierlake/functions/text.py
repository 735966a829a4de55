"""Text functions as column expressions: tokens, normal forms, masks, money, similarity. All but similarity run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WORD = r"[\p{L}\p{M}\p{N}_]+"
#: A word, or one character that is neither of a word nor white space.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"

# Honorifics that a name may carry.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "shri", "smt", "prof"]

# Names under which document types are known.
DOC_TYPE_ALIASES = {
    "application_form": ["application_form", "application", "loan_application", "application.pdf"],
    "payslip": ["payslip", "payslips", "salary_slip", "salary_payslip", "payslip_1.pdf", "payslip_2.pdf", "payslip_3.pdf"],
    "bank_statement": ["bank_statement", "bank_stmt", "bank_statement.pdf"],
    "tax_acknowledgement": ["tax_acknowledgement", "itr", "itr_v", "itr.pdf", "tax_return"],
    "id_card": ["id_card", "kyc", "kyc_id", "kyc.pdf", "pan_card", "aadhaar"],
}
# Types that tell nothing.
UNUSABLE_TYPES = ["unknown", "unclassified", "unreadable", "corrupted", "unusable", "error"]
# Words that stand for a document type, in the order in which they are tried.
TYPE_WORDS = [
    ("payslip", ["payslip", "salary"]),
    ("bank_statement", ["bank", "statement"]),
    ("tax_acknowledgement", ["tax", "itr", "form16"]),
    ("id_card", ["pan", "aadhaar", "kyc", "id"]),
    ("application_form", ["form", "app"]),
]
# The pattern of an amount in free text.
MONEY_IN_TEXT = r"(?:₹|INR|Rs\.?)?\s*(\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+\.\d{1,2})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-cased words; empty for a text without any."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column | str) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def known(text: Column | str) -> Column:
    """The trimmed text; null where it is empty or says UNKNOWN."""
    t = F.trim(_c(text))
    return F.when(~F.upper(t).isin("", "UNKNOWN", "NONE"), t)


def money(text: Column | str) -> Column:
    """The first amount in a text, without currency, grouping and blanks; null if there is none."""
    bare = F.regexp_replace(_c(text), "₹|INR|Rs\\.?|[, ]", "")
    return F.bround(F.regexp_extract(bare, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("decimal(20,6)"), 2).cast("decimal(18,2)")


def amounts(text: Column | str) -> Column:
    """The distinct amounts in free text: grouped digits or decimals, as decimals."""
    found = F.regexp_extract_all(_c(text), F.lit(MONEY_IN_TEXT), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(20,2)"))))


def format_money(amount: Column | str, currency: str = "INR") -> Column:
    return F.coalesce(F.concat(F.lit(f"{currency} "), F.format_number(_c(amount).cast("decimal(18,2)"), 2)), F.lit("UNKNOWN"))


def normal_pan(pan: Column | str) -> Column:
    """Upper case without blanks, hyphens and underscores; null if nothing is left or it says UNKNOWN."""
    p = F.upper(F.regexp_replace(_c(pan), r"[\s\-_]", ""))
    return F.when(~p.isin("", "UNKNOWN"), p)


def normal_name(name: Column | str) -> Column:
    """Sorted lower-case name parts; titles go if other parts stay."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(_c(name)), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+"), lambda x: x != "")
    bare = F.filter(parts, lambda x: ~x.isin(TITLES))
    kept = F.when((F.size(parts) > 1) & (F.size(bare) > 0), bare).otherwise(parts)
    return F.coalesce(F.array_join(F.array_sort(kept), " "), F.lit(""))


def normal_type(kind: Column | str) -> Column:
    """The document type that a name stands for; other names as they are, trimmed and lower-cased."""
    k = F.lower(F.trim(_c(kind)))
    out = F.when(F.lit(False), k)
    for name, aliases in DOC_TYPE_ALIASES.items():
        out = out.when(k.isin(aliases), F.lit(name))
    return out.otherwise(k)


def type_by_words(text: Column | str) -> Column:
    """The first type of which a word occurs anywhere in the text, within words too; else unknown."""
    t = F.lower(_c(text))
    out = F.when(F.lit(False), t)
    for name, marks in TYPE_WORDS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | t.contains(m)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def _masked(value: Column, digits: Column, prefix: str) -> Column:
    clean = known(value)
    return F.when(clean.isNull(), "UNKNOWN").when(F.length(digits) >= 4, F.concat(F.lit(prefix), F.right(digits, F.lit(4)))).when(F.length(clean) >= 4, F.concat(F.lit(prefix), F.right(clean, F.lit(4))))


def mask_pan(pan: Column | str) -> Column:
    """The four digits of a PAN, or its last four characters, behind a mask."""
    p = F.upper(F.trim(_c(pan)))
    digits = F.regexp_extract(p, r"\d{4}", 0)
    return F.when(known(p).isNull(), "UNKNOWN").when(digits != "", F.concat(F.lit("XXXXXX"), digits)).when(F.length(p) >= 4, F.concat(F.lit("XXXXXX"), F.right(p, F.lit(4)))).otherwise("XXXXXX")


def mask_account(account: Column | str) -> Column:
    return F.coalesce(_masked(_c(account), F.regexp_replace(_c(account), r"\D", ""), "XXXXXXXX"), F.lit("XXXXXXXX"))


def mask_aadhaar(number: Column | str) -> Column:
    return F.coalesce(_masked(_c(number), F.regexp_replace(_c(number), r"\D", ""), "XXXX-XXXX-"), F.lit("XXXX-XXXX-XXXX"))


# Fixed values: (pattern, replacement) in the order of application: PAN, grouped and plain Aadhaar, account after a keyword, long digit runs.
PII_STEPS = [
    (r"\b[A-Za-z]{5}([0-9]{4})[A-Za-z]\b", "XXXXXX$1"),
    (r"\b\d{4}[ -]\d{4}[ -](\d{4})\b", "XXXX-XXXX-$1"),
    (r"\b\d{8}(\d{4})\b", "XXXX-XXXX-$1"),
    (r"(?i)((?:A/C|Account|Acc|Bank\s*A/c)\s*[:#]?\s*)\d{5,14}(\d{4})\b", "$1XXXXXX$2"),
    (r"\b\d{6,14}(\d{4})\b", "XXXXXX$1"),
]


def scrub_pii(text: Column | str) -> Column:
    out = _c(text)
    for pattern, to in PII_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of its table at a time: bit i of ``open_`` is 0 where the length grows at a's letter i."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    whole = open_ = (1 << len(a)) - 1
    for ch in b:
        met = open_ & at.get(ch, 0)
        open_ = (open_ + met | open_ - met) & whole
    return len(a) - open_.bit_count()


@F.arrow_udf(DoubleType())
def _alike(x: pa.Array, y: pa.Array) -> pa.Array:
    pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
    return pa.array([0.0 if not a or not b else 1.0 if a == b else 2.0 * common_subsequence(a, b) / (len(a) + len(b)) for a, b in pairs], pa.float64())


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """0 to 1: twice the common subsequence over both lengths, of the normal names; 0 if one is empty."""
    return _alike(normal_name(a), normal_name(b))


def safe_file_name(name: Column | str) -> Column:
    """The last path part with anything but letters, digits, dots, hyphens and underscores replaced."""
    return F.regexp_replace(F.regexp_extract(_c(name), r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def short_hash(value: Column | str) -> Column:
    return F.substring(F.sha2(_c(value).cast("string"), 256), 1, 16)


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> list[Column]:
    """A box within the page, with ends not before starts, to two places."""
    cut = lambda v, top: F.greatest(F.lit(0.0), F.least(v, F.lit(top)))
    a, b = cut(x0, width), cut(y0, height)
    return [F.round(a, 2), F.round(b, 2), F.round(F.greatest(a, cut(x1, width)), 2), F.round(F.greatest(b, cut(y1, height)), 2)]


def page_route(chars: Column, words_: Column, coverage: Column, least_chars: int = 100, least_words: int = 10, most_coverage: float = 0.5) -> Column:
    """native if a page has text enough and few images, else ocr."""
    return F.when((chars >= least_chars) & (words_ >= least_words) & (coverage < most_coverage), "pymupdf_native").otherwise("tesseract_cpu")
