"""Not-modified revisit records resolved to the response they confirm.

Records are rows (record_id, target_uri, warc_date, warc_type, http_head, payload_digest); `http_head` is the raw status line
and header block. A revisit is joined as of its date to the latest earlier full response (status 200) of its canonical url. Its
validators must agree: the entity tag if it has one (weakly compared), else the modification date, else the payload digest. Where
they do, the response's headers are kept and the permitted ones that the revisit sends are put in their place.

The as-of join is two windows that never hold a whole url: records are range-partitioned by (url, date, record), so a url with a
third of all records spans many partitions; one window fills forward within (url, partition), the other carries the last response
of each earlier partition of the url, one row per url and partition. Payloads take no part; the result names the record that has it.

Defined results: a null url resolves to nothing (`no_url`); no earlier response: `no_response`; validators that differ, or none on
both sides: `mismatch`; records of one date go by record id, null dates first; repeated rows are resolved each; other types than
response and revisit are passed with `other`; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import let
from leadloom.operators.stages import stage_table

#: Headers of a not-modified response that replace those of the stored one.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that do not name another document.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|sid"


def canonical_url(url: str) -> str:
    """SQL expression: host in lower case without `www.` and default port, path without a closing slash, the query
    without tracking parameters and in order, no scheme, no fragment. Null if there is no `://`."""
    rest = f"regexp_extract({url}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1)"
    host = "regexp_replace(lower(regexp_extract(_r, '(?s)^[^/?]*', 0)), '^www[.]|:(80|443)$', '')"
    path = "regexp_replace(regexp_extract(_r, '(?s)^[^/?]*([^?]*)', 1), '/$', '')"
    query = f"array_join(array_sort(filter(split(regexp_extract(_r, '(?s)[?](.*)$', 1), '&'), x -> x <> '' AND NOT x rlike '^({TRACKING})(=|$)')), '&')"
    joined = f"concat({host}, {path}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END)"
    return f"CASE WHEN {url} rlike '^[A-Za-z][A-Za-z0-9+.-]*://' THEN {let('_r', rest, joined)} END"


def status(head: str) -> str:
    return f"CAST(nullif(regexp_extract({head}, '^HTTP/[0-9.]+ ([0-9]{{3}})', 1), '') AS INT)"


def headers(head: str) -> str:
    """SQL expression: array of (name, value), names in lower case, in the order of the block."""
    lines = f"filter(split(coalesce({head}, ''), '\\r?\\n'), (x, i) -> i > 0 AND instr(x, ':') > 1)"
    return f"transform({lines}, x -> named_struct('name', lower(trim(substring_index(x, ':', 1))), 'value', trim(substring(x, instr(x, ':') + 1))))"


def header(of: str, name: str) -> str:
    return f"get(filter({of}, h -> h.name = '{name}'), 0).value"


def resolve(records: DataFrame) -> DataFrame:
    """One row per record: record_id, canonical_url, warc_type, resolution (full, resolved, mismatch, no_response, no_url
    or other), source_record_id, status, payload_digest and headers (lines `name: value`, sorted)."""
    narrow = records.selectExpr("record_id", f"{canonical_url('target_uri')} AS canonical_url", "warc_date", "warc_type", f"{status('http_head')} AS _status", f"{headers('http_head')} AS _headers", "payload_digest")
    arranged = narrow.repartitionByRange("canonical_url", "warc_date", "record_id").withColumn("_part", F.spark_partition_id())
    arranged = stage_table(arranged, "warc-records")
    full = "CASE WHEN warc_type = 'response' AND _status = 200 AND canonical_url IS NOT NULL THEN named_struct('id', record_id, 'headers', _headers, 'digest', payload_digest) END"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    near = arranged.selectExpr("*", f"{full} AS _full").selectExpr("*", f"last(_full, true) OVER (PARTITION BY canonical_url, _part ORDER BY warc_date, record_id {earlier}) AS _near")
    responses = arranged.filter("warc_type = 'response' AND _status = 200 AND canonical_url IS NOT NULL")
    tails = responses.groupBy("canonical_url", "_part").agg(F.expr(f"max_by({full}, named_struct('d', warc_date, 'r', record_id)) AS _tail"))
    spans = arranged.select("canonical_url", "_part").distinct().join(tails, ["canonical_url", "_part"], "left")
    carried = spans.selectExpr("canonical_url", "_part", f"last(_tail, true) OVER (PARTITION BY canonical_url ORDER BY _part {earlier}) AS _carry").filter("_carry IS NOT NULL")
    joined = near.join(carried, ["canonical_url", "_part"], "left").selectExpr("*", "coalesce(_near, _carry) AS _stored")

    tag = "regexp_replace({}, '^W/', '')"
    etag, stored_etag = header("_headers", "etag"), header("_stored.headers", "etag")
    modified, stored_modified = header("_headers", "last-modified"), header("_stored.headers", "last-modified")
    agrees = (
        f"CASE WHEN {etag} IS NOT NULL THEN coalesce({tag.format(etag)} = {tag.format(stored_etag)}, false) "
        f"WHEN {modified} IS NOT NULL THEN coalesce({modified} = {stored_modified}, false) ELSE coalesce(payload_digest = _stored.digest, false) END"
    )
    resolution = (
        "CASE WHEN warc_type = 'response' THEN 'full' WHEN warc_type IS NULL OR warc_type <> 'revisit' THEN 'other' WHEN canonical_url IS NULL THEN 'no_url' "
        f"WHEN _stored IS NULL THEN 'no_response' WHEN {agrees} THEN 'resolved' ELSE 'mismatch' END"
    )
    permitted = ", ".join(f"'{h}'" for h in PERMITTED)
    sent = f"filter(_headers, h -> h.name IN ({permitted}))"
    merged = f"concat(filter(_stored.headers, h -> NOT exists({sent}, s -> s.name = h.name)), {sent})"
    out = joined.selectExpr("*", f"{resolution} AS resolution").selectExpr("*", f"CASE WHEN resolution = 'resolved' THEN {merged} ELSE _headers END AS _merged")
    return out.selectExpr(
        "record_id", "canonical_url", "warc_type", "resolution",
        "CASE resolution WHEN 'full' THEN record_id WHEN 'resolved' THEN _stored.id END AS source_record_id",
        "CASE WHEN resolution = 'resolved' THEN 200 ELSE _status END AS status",
        "CASE WHEN resolution = 'resolved' THEN _stored.digest ELSE payload_digest END AS payload_digest",
        "array_join(array_sort(transform(_merged, h -> concat(h.name, ': ', h.value))), '\\n') AS headers",
    )
