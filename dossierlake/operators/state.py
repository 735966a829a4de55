"""The JSON state of an application: its first form, and how columns and patches are laid over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Objects within objects that are merged key by key; what lies deeper is replaced whole.
DEPTH = 6


def new_id(*seed: Column | str) -> Column:
    """An application's id that follows from what it is made of."""
    return F.concat(F.lit("APP-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *seed), 256), 1, 8)))


def initial(application_id: Column, at: Column) -> Column:
    """The state of a new application as JSON: uploaded, with nothing read, found or decided yet."""
    now = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    move = F.struct(F.lit("UPLOADED").alias("from_status"), F.lit("UPLOADED").alias("to_status"), now.alias("timestamp"), F.lit("Application dossier created").alias("reason"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    lists = ["document_ids", "findings", "missing_documents", "retrieved_chunk_ids", "corrections_applied"]
    nulls = ["applicant", "payslip", "bank_statement", "tax_return", "summary_markdown", "reviewer_decision", "reviewer_notes"]
    maps = ["document_manifest", "classified_types"]
    flags = ["summary_grounded", "review_paused"]
    fields = [application_id.alias("application_id"), F.lit("UPLOADED").alias("status"), F.array(move).alias("status_history"), *[empty.alias(c) for c in lists], *[none.alias(c) for c in nulls], *[F.create_map().cast("map<string,string>").alias(c) for c in maps], *[F.lit(False).alias(c) for c in flags]]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _merged(a: str, b: str, depth: int, drop: bool) -> str:
    """The VARIANT of ``b`` laid over that of ``a``, as an expression."""
    if not depth:
        return b
    k, x, y = f"k{depth}", f"x{depth}", f"y{depth}"
    of = lambda v: f"schema_of_variant({v}) like 'OBJECT%'"
    null = "cast(null as variant)" if drop else y
    zipped = f"map_zip_with(cast({a} as map<string,variant>), cast({b} as map<string,variant>), ({k}, {x}, {y}) -> case when {y} is null then {x} when is_variant_null({y}) then {null} else {_merged(x, y, depth - 1, drop)} end)"
    return f"case when {b} is null then {a} when {a} is not null and {of(a)} and {of(b)} then to_variant_object(map_filter({zipped}, ({k}, {x}) -> {x} is not null)) else {b} end"


def overlaid(state: str, patch: str, drop_nulls: bool = False, depth: int = DEPTH) -> Column:
    """The JSON column ``state`` with that of ``patch`` laid over it: objects meet key by key, anything else is replaced.

    A null in the patch is a value, or takes the key away (``drop_nulls``). A null or unreadable patch changes nothing; over a
    null or unreadable state, or one that is no object, the patch alone stays. Keys come out sorted.
    """
    return F.to_json(F.expr(_merged(f"try_parse_json({state})", f"try_parse_json({patch})", depth, drop_nulls)))
