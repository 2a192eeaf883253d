"""URL allow and block lists: a trie over reversed host labels, and below each host over path segments.

The rules are a list (or a table whose row count is checked against `MAX_RULES` before it is collected), built into
nested dicts and broadcast. A url walks the labels of its host from the last one on; at each node that holds rules it
walks the segments of its path. The deepest host wins, then the longest path; of two equal rules block wins.
A rule's path is a prefix in characters: its last segment may be the beginning of the url's.

Defined results: a null url, or one without `://`, has an empty host and path, meets no rule and gets the default
verdict. Repeated rows are judged alike; other columns are kept out of the way by taking only the named ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000  # about 300 MB as dicts in each Python worker
BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_of(table: DataFrame) -> list[tuple[str, str, str]]:
    """Rules (verdict, host, path) of a table, refused if they are more than may be broadcast."""
    rows = table.select("verdict", "host", "path").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [tuple(r) for r in rows]


def build(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Node: {"next": by label, "paths": {"next": by segment, "ends": {rest of the path: (rule, verdict)}}}."""
    root: dict = {"next": {}, "paths": None}
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict: {verdict}")
        node = root
        for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        node["paths"] = node["paths"] or {"next": {}, "ends": {}}
        *whole, rest = path.split("/")
        place = node["paths"]
        for segment in whole:
            place = place["next"].setdefault(segment, {"next": {}, "ends": {}})
        if place["ends"].get(rest, ("", ALLOW))[1] == ALLOW:
            place["ends"][rest] = (host + path, verdict)
    return root


def longest(paths: dict, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that `path` starts with."""
    found, place = None, paths
    for segment in path.split("/"):
        ends = place["ends"]
        if ends:
            found = max(((len(e), ends[e]) for e in ends if segment.startswith(e)), default=(0, found))[1]
        place = place["next"].get(segment)
        if place is None:
            break
    return found


def judge(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    found, node = None, trie
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        if node["paths"]:
            found = longest(node["paths"], path) or found
    return found


def parts(url: str) -> list:
    """Columns host and path of a url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return [F.translate(host, UPPER, LOWER).alias("host"), path.alias("path")]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """`page_id`, host, path, rule (null if none fits) and verdict of every row. Only these two columns are read."""
    shared = pages.sparkSession.sparkContext.broadcast(build(rules))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", *parts("_url"))
    schema = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("rule", "verdict")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            judged = [judge(trie, h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            rule = pa.array([j and j[0] for j in judged], pa.string())
            verdict = pa.array([j[1] if j else default for j in judged], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema)
