"""Records of large JSON files with one list, found in every byte split at once.

Spark cuts the text at closing braces, so that splits begin there however long the lines are. What a brace means depends on all text before
it; each split is therefore read once for both states it may begin in, inside or outside a string, and gives back how that state and the
depth of brackets change, and the members that open on its two lowest levels. Running sums over the splits of a file then say where each
really begins, whether brackets balance, and which member holds the records. The second pass cuts each split into records: values at the
list's own level. A record that lies across splits is put together as in `split`.

Not noticed, because no split sees it: a fault outside the list that keeps brackets balanced, and text without brackets after the root's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom import constants as K
from leadloom.operators.stages import stage_table
from leadloom.sources.split import BROADCAST_SPLITS, HEAD, MIDDLE, PIECES, SPLIT, TAIL, WHOLE, in_order, placed, stitched

END = "}"
FAULT = 4  # a piece that says that the list is no JSON
#: An escaped character is passed over outside strings too: read from the wrong state, an escaped quote must not count either.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\\.|["\[\]{},]', re.DOTALL)
CLOSING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
OPENING = "struct<key:string,list:boolean,at:bigint,count:bigint>"
LEVEL = f"struct<closed:bigint,keys:array<{OPENING}>,last:{OPENING}>"
LEVELS = 3  # of the lowest depths of a split: the root's members are on the second, or on the third where a brace was added at the file's end
CHANGE = f"struct<inside:boolean,depth:bigint,low:bigint,levels:array<{LEVEL}>>"
SUMMARY = f"_file string, _block long, bytes long, first string, outside {CHANGE}, inside {CHANGE}"


def tokens(text: str, inside: bool) -> Iterator[tuple[str, int]]:
    """Brackets and commas outside strings with their places; last ('"', place) if the text ends inside a string."""
    at = 0
    if inside:
        found = CLOSING.match(text)
        if found is None:
            yield '"', 0
            return
        at = found.end()
    for found in TOKEN.finditer(text, at):
        mark = found.group()
        if len(mark) == 1:
            yield mark, found.start()
            if mark == '"':
                return


class Change:
    """What a run of text does to the state it begins in, and what it opens and closes on its lowest levels."""

    def __init__(self, inside: bool, names: frozenset[str]) -> None:
        self.inside, self.names, self.depth, self.low = inside, names, 0, 0
        self.levels: dict[int, list] = {}

    def level(self, depth: int) -> list:
        return self.levels.setdefault(depth, [0, {}, None])

    def read(self, text: str, at: int) -> None:
        before, self.inside = self.inside, False
        for mark, place in tokens(text, before):
            if mark in "[{":
                if self.depth < self.low + LEVELS:
                    name = KEY.search(text, max(0, place - 200), place)
                    if name:
                        opening = {"key": name[1], "list": mark == "[", "at": at, "count": 1}
                        level = self.level(self.depth)
                        level[2] = opening
                        if name[1] in self.names:
                            known = level[1].get((name[1], mark))
                            level[1][name[1], mark] = opening if known is None else known | {"count": known["count"] + 1}
                self.depth += 1
            elif mark in "]}":
                self.depth -= 1
                if self.depth < self.low:
                    self.low = self.depth
                    self.levels = {d: v for d, v in self.levels.items() if d < self.low + LEVELS}
                if self.depth < self.low + LEVELS:
                    self.level(self.depth)[0] += 1
            elif mark == '"':
                self.inside = True

    def value(self) -> dict:
        def said(depth: int) -> dict:
            closed, keys, last = self.levels.get(depth, (0, {}, None))
            return {"closed": closed, "keys": list(keys.values()), "last": last}

        return {"inside": self.inside, "depth": self.depth, "low": self.low, "levels": [said(self.low + k) for k in range(LEVELS)]}


def _summaries(names: frozenset[str], types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, size, first, changes = None, 0, "", []

        def told() -> pa.RecordBatch:
            row = {"_file": split[0], "_block": split[1], "bytes": size, "first": first, "outside": changes[0].value(), "inside": changes[1].value()}
            return pa.RecordBatch.from_pylist([row], types)

        for batch in batches:
            for file, block, at, value in zip(*[batch[c].to_pylist() for c in ("_file", "_block", "_at", "value")], strict=True):
                if (file, block) != split:
                    if split:
                        yield told()
                    split, size, first, changes = (file, block), 0, "", [Change(False, names), Change(True, names)]
                text = value + END
                size += len(text.encode())
                first = first or text.lstrip("﻿ \t\r\n")[:1]
                for change in changes:
                    change.read(text, at)
        if split:
            yield told()

    return run


def read_pieces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The text between closing braces with its place, and (_file, size) of the files."""
    read = spark.read.option("lineSep", END).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    return placed(read), read


def split_states(pieces: DataFrame, list_keys: tuple[str, ...]) -> DataFrame:
    """One row per split: where it begins (`_inside` a string, `_depth`), whether the list of records is open there (`_open`) and in a
    record (`_in_record`, `_ends_in_record`), the file's list member (`_key`, '' for a root list) and `_fault` of the file."""
    spark = pieces.sparkSession
    types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], SUMMARY).schema])
    told = pieces.mapInArrow(_summaries(frozenset(list_keys), types), SUMMARY)
    ordered = Window.partitionBy("_file").orderBy("_block")
    before, upto = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0)
    # a split turns the state over, or does not, whatever it was: the state is a parity
    turned = told.withColumn("_turns", F.col("outside.inside").cast("int"))
    began = turned.withColumn("_inside", F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2 == 1).withColumn("_c", F.when(F.col("_inside"), F.col("inside")).otherwise(F.col("outside")))
    deep = began.withColumn("_depth", F.coalesce(F.sum("_c.depth").over(before), F.lit(0))).withColumn("_least", F.col("_depth") + F.col("_c.low"))

    def on_level(depth: int) -> str:
        return f"get(_c.levels, CAST({depth} - _least AS INT))"

    leveled = deep.withColumn("_members", F.expr(on_level(1))).withColumn("_closed", F.coalesce(F.expr(f"({on_level(0)}).closed"), F.lit(0)))
    last = F.last("_members.last", ignorenulls=True)
    seen = leveled.withColumn("_last", last.over(before)).withColumn("_last_after", last.over(upto))
    whole = seen.groupBy("_file").agg(
        F.min_by("first", "_block").alias("_root"), F.sum("bytes").alias("_bytes"), F.sum("_c.depth").alias("_end"), F.sum("_turns").alias("_odd"),
        F.min("_least").alias("_floor"), F.sum("_closed").alias("_closings"), F.flatten(F.collect_list(F.coalesce("_members.keys", F.array().cast(f"array<{OPENING}>")))).alias("_keys"),
    )
    lists = [f"WHEN exists(_keys, k -> k.key = '{k}' AND k.list) THEN '{k}'" for k in list_keys]
    twice = " OR ".join(f"coalesce(aggregate(filter(_keys, k -> k.key = '{k}'), 0L, (n, k) -> n + k.count), 0L) > 1" for k in list_keys)
    files = whole.withColumn("_key", F.expr(f"CASE WHEN _root = '[' THEN '' WHEN _root = '{{' THEN CASE {' '.join(lists)} END END")).withColumn("_twice", F.expr(f"_root = '{{' AND ({twice})"))
    joined = seen.join(files.select("_file", "_key", "_bytes", "_end", "_odd", "_floor", "_closings", "_twice"), "_file")
    base = F.when(F.col("_key") == "", 1).otherwise(2)
    mine = (F.col("_key") == "") | ((F.col("_last.key") == F.col("_key")) & F.col("_last.list"))
    mine_after = (F.col("_key") == "") | ((F.col("_last_after.key") == F.col("_key")) & F.col("_last_after.list"))
    depth_after, inside_after = F.col("_depth") + F.col("_c.depth"), F.col("_c.inside")
    opened = F.coalesce(mine & (F.col("_depth") >= base), F.lit(False))
    return joined.select(
        *SPLIT, "_inside", "_depth", "_key", opened.alias("_open"), (opened & ((F.col("_depth") > base) | F.col("_inside"))).alias("_in_record"),
        F.coalesce(mine_after & (depth_after >= base) & ((depth_after > base) | inside_after), F.lit(False)).alias("_ends_in_record"),
        "_bytes", "_end", "_odd", "_floor", "_closings", "_twice",
    )


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, out = None, []
    depth = base = at = 0
    inside = opened = carried = capture = comma = False
    filled: bool | None = None  # whether the place after the last comma is taken; None where the split began within it
    key, held, gap = None, [], ""

    def left_over() -> None:
        if opened and (capture or inside):
            out.append((*split, at, MIDDLE if carried else TAIL, "".join(held) if capture else gap))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_file", "_block", "_at", "_kind", "value"])
        out.clear()
        return made

    def put(text: str) -> None:
        nonlocal carried
        out.append((*split, at, HEAD if carried else WHOLE, text))
        carried = False

    names = ("_file", "_block", "_at", "value", "_inside", "_depth", "_key", "_open", "_in_record")
    for batch in batches:
        for file, block, place, value, begins_inside, begins_depth, member, begins_open, in_record in zip(*[batch[c].to_pylist() for c in names], strict=True):
            if (file, block) != split:
                left_over()
                split, inside, depth, key, opened, at = (file, block), begins_inside, begins_depth, member, begins_open, place
                base = 1 if key == "" else 2
                carried, capture, held, gap = in_record, in_record and depth > base, [], ""
                filled, comma = None if opened else False, False
            text = value + END
            since = 0  # where the part of this piece begins that belongs to what is being read
            was_inside, inside = inside, False
            for mark, i in tokens(text, was_inside):
                if mark in "[{":
                    if not opened:
                        name = KEY.search(text, max(0, i - 200), i) if key and depth == 1 and mark == "[" else None
                        if (key == "" and depth == 0) or (name and name[1] == key):
                            opened, filled, comma, since, gap = True, False, False, i + 1, ""
                    elif depth == base and not capture:
                        if (gap + text[since:i]).strip() or filled:
                            out.append((*split, place, FAULT, ""))
                        capture, held, since, at = True, [], i, place
                    depth += 1
                elif mark in "]}":
                    depth -= 1
                    if opened and capture and depth == base:
                        held.append(text[since : i + 1])
                        put("".join(held))
                        capture, filled, since, gap = False, True, i + 1, ""
                    elif opened and depth == base - 1:
                        rest = gap + text[since:i]
                        if rest.strip() and not filled:
                            at = at if carried else place
                            put(rest.strip() if not carried else rest)
                        elif rest.strip() or (comma and not filled):
                            out.append((*split, place, FAULT, ""))
                        opened, gap = False, ""
                elif mark == "," and opened and depth == base and not capture:
                    rest = gap + text[since:i]
                    if rest.strip() and not filled:
                        at = at if carried else place
                        put(rest.strip() if not carried else rest)
                    elif bool(rest.strip()) or filled is False:
                        out.append((*split, place, FAULT, ""))
                    filled, comma, since, gap = False, True, i + 1, ""
                elif mark == '"':
                    inside = True
            if opened and capture:
                held.append(text[since:])
            elif opened:
                at = place if not carried and not gap.strip() else at
                gap += text[since:]
        yield batch_of()
    left_over()
    yield batch_of()


def json_elements(spark: SparkSession, path: str, list_keys: tuple[str, ...] = K.JSON_LIST_KEYS) -> tuple[DataFrame, DataFrame]:
    """(_file, _at, value): the text of every record of every file's list, and the files that hold none or are no JSON. Files are read as
    `list_keys` say: a root list, or the first of these members that is one."""
    pieces, read = read_pieces(spark, path)
    states = stage_table(split_states(pieces, list_keys), "json-splits")  # small, and all text would be read again for it
    small = states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    sizes = read.groupBy(F.col("file_path").alias("_file")).agg(F.max("file_size").alias("_size"))
    # a brace was put behind every piece; if the file's last one had none, that brace ends one level too deep. A byte order mark is not
    # read, so that sizes differ: it is no JSON
    added = F.expr("_bytes - _size = 1")
    whole = states.groupBy("_file").agg(*[F.first(c).alias(c) for c in ("_key", "_bytes", "_end", "_odd", "_floor", "_closings", "_twice")]).join(sizes, "_file")
    sound = (added | F.expr("_bytes = _size")) & (F.col("_odd") % 2 == 0) & (F.col("_end") == F.when(added, -1).otherwise(0)) & (F.col("_floor") == F.when(added, -1).otherwise(0)) & (F.col("_closings") == 1) & ~F.col("_twice")
    unsound = whole.where(~F.coalesce(sound & F.col("_key").isNotNull(), F.lit(False))).select("_file")
    cut = in_order(pieces, states, small).mapInArrow(_cut, PIECES)
    across = in_order(pieces, states.where("_in_record OR _ends_in_record"), small).mapInArrow(_cut, PIECES)
    records = cut.where(F.col("_kind").isin(WHOLE, FAULT)).unionByName(stitched(across.where(F.col("_kind").isin(HEAD, MIDDLE, TAIL)), "").withColumn("_kind", F.lit(WHOLE)))
    return records, unsound
