"""Raw columns or records -> canonical lead columns, and the valid/reject split.

Presence decides, not value: a field's own name wins over its aliases, the first alias that is
present wins over later ones, even if its value is blank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions.text import NO_TEXT, blank_to_null, digits, q, strip
from leadloom.settings import MappingOptions

REASON = "reject_reason"


def _candidate_keys(field: str, opts: MappingOptions) -> list[str]:
    keys = [field, *(a.strip().lower() for a in opts.aliases.get(field) or ())]
    return list(dict.fromkeys(keys))


def _field(field: str, value: str, opts: MappingOptions) -> str:
    given = opts.defaults.get(field)
    default = "" if given is None else str(given).strip()
    return f"coalesce({value}, {q(default)}) AS {field}" if default else f"{value} AS {field}"


def _sources(header: list[str], columns: list[str], opts: MappingOptions) -> list[str | None]:
    """The column that holds each canonical field, if any, given the raw header of every column."""
    by_key = {h.strip().lower(): c for h, c in zip(header, columns)}  # rightmost wins
    return [next((by_key[k] for k in _candidate_keys(f, opts) if k in by_key), None) for f in K.CANONICAL_FIELDS]


def map_columns(df: DataFrame, opts: MappingOptions = MappingOptions(), row_id: str = "row_id") -> DataFrame:
    """Pick one source column per canonical field. Presence is a fact of the header, so it costs nothing per row."""
    types = dict(df.dtypes)
    columns = [c for c in df.columns if c != row_id]
    picked = []
    for field, source in zip(K.CANONICAL_FIELDS, _sources(columns, columns, opts)):
        is_text = source is not None and types[source] == "string"
        picked.append(_field(field, blank_to_null(f"`{source}`") if is_text else NO_TEXT, opts))
    return df.selectExpr(row_id, *picked)


def map_headed_rows(
    df: DataFrame, headers: list[list[str]], opts: MappingOptions = MappingOptions(), row_id: str = "row_id"
) -> DataFrame:
    """The same for rows of files with different headers: text columns c0, c1, ... and `_header`, the number of the row's header."""
    found = [_sources(h, [f"c{i}" for i in range(len(h))], opts) for h in headers]
    picked = []
    for field, sources in zip(K.CANONICAL_FIELDS, zip(*found)):
        if len(set(sources)) == 1:
            value = sources[0]
        else:
            value = f"(CASE _header {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(sources) if c)} END)"
        picked.append(_field(field, blank_to_null(value) if value else NO_TEXT, opts))
    return df.selectExpr(row_id, *picked)


def map_records(
    df: DataFrame, opts: MappingOptions = MappingOptions(), row_id: str = "row_id", record: str = "record"
) -> DataFrame:
    """Map one VARIANT object per row. Key presence and value types are per record; nothing is shuffled."""
    is_object = f"coalesce(schema_of_variant({record}) LIKE 'OBJECT<%', false)"
    entries = (
        f"transform(map_entries(if({is_object}, try_variant_get({record}, '$', 'map<string,variant>'), NULL)), "
        f"en -> named_struct('k', lower({strip('en.key')}), 'v', en.value))"
    )
    keyed = df.selectExpr(row_id, f"{is_object} AS _is_object", f"{entries} AS _entries")

    def entry(field: str) -> str:
        # several keys may differ only in case or blanks: the last one counts
        found = [f"try_element_at(filter(_entries, en -> en.k = {q(k)}), -1)" for k in _candidate_keys(field, opts)]
        return f"coalesce({', '.join(found)})"

    found = keyed.selectExpr(row_id, "_is_object", *[f"{entry(f)}.v AS {f}" for f in K.CANONICAL_FIELDS])

    def text(field: str) -> str:
        return f"if(schema_of_variant({field}) = 'STRING', try_variant_get({field}, '$', 'string'), NULL)"

    return found.selectExpr(
        row_id,
        *[_field(f, blank_to_null(text(f)), opts) for f in K.CANONICAL_FIELDS],
        "if(_is_object, NULL, 'invalid_record_type') AS _bad_record",
    )


def listing_record(record: str) -> str:
    """Listing export -> lead-like object: fixed renames; listing address and link are left out on purpose."""

    def filled(name: str, *others: str) -> str:
        """First value that is not empty; a value that is not text yields null but is not passed over."""
        value = f"try_variant_get({record}, '$.{name}', 'variant')"
        kind = f"schema_of_variant({value})"
        empty = f"{kind} = 'VOID' OR to_json({value}) IN ('\"\"', '0', '0.0', 'false', '[]', '{{}}')"
        following = filled(*others) if others else "NULL"
        return (
            f"CASE WHEN {value} IS NULL OR {empty} THEN {following} "
            f"WHEN {kind} = 'STRING' THEN try_variant_get({record}, '$.{name}', 'string') END"
        )

    lead = (
        f"named_struct('company_name', {filled('agency_name')}, 'agent_name', {filled('agent_name')}, "
        f"'phone', {filled('agent_phone')}, 'email', {filled('agent_email', 'email')}, "
        f"'source', {filled('source_site', 'source')})"
    )
    return f"if(schema_of_variant({record}) LIKE 'OBJECT<%', to_variant_object({lead}), {record})"


def reject_reason(opts: MappingOptions = MappingOptions()) -> str:
    """Reason a mapped row is refused, or null. The first failing check wins."""
    required = list(opts.required_any) or list(K.REQUIRED_ANY)
    nameless = " AND ".join(f"{f} IS NULL" for f in required)
    strict = (
        f"WHEN NOT email RLIKE {q(K.LOOSE_EMAIL)} THEN 'invalid_email' "
        f"WHEN length({digits('phone')}) < {K.MIN_PHONE_DIGITS} THEN 'invalid_phone' "
        "WHEN contains(website, ' ') OR (NOT website RLIKE '^https?://' AND NOT contains(website, '.')) "
        "THEN 'invalid_website' "
    )
    return f"CASE WHEN {nameless} THEN 'missing_required_identity' {strict if opts.strict_contacts else ''}END"


def tag_rejects(mapped: DataFrame, opts: MappingOptions = MappingOptions()) -> DataFrame:
    """Mapped rows with their reject reason; both sides of the split then come from one scan."""
    if "_bad_record" in mapped.columns:
        reason = f"coalesce(_bad_record, {reject_reason(opts)})"
        return mapped.withColumn(REASON, F.expr(reason)).drop("_bad_record")
    return mapped.withColumn(REASON, F.expr(reject_reason(opts)))


def valid_leads(tagged: DataFrame) -> DataFrame:
    return tagged.where(f"{REASON} IS NULL").drop(REASON)


def rejected_rows(tagged: DataFrame, row_id: str = "row_id") -> DataFrame:
    return tagged.where(f"{REASON} IS NOT NULL").selectExpr(f"{row_id} AS row_index", f"{REASON} AS reason")
