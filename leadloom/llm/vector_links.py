"""Near pairs of vectors: how vectors are dealt to tasks, and the search within a task.

Vectors have a group, and only vectors of one group are compared. A group of up to `Deal.held` vectors is one task or a part of
one. A larger group is cut into chunks by hash: each task holds one chunk and reads half of the others, so two chunks meet in one
task and a vector travels about half as often as its group has chunks. Vectors travel packed, about a thousand to a row.

Within a task a k-d tree over the held vectors is walked by all queries at once: a query goes on into a part while its
distance to the box around the part, by the numbers that were split on so far, is within reach. What is left is multiplied. No
near pair is lost. A task gives counts of links and a spanning forest, never the links.

Sketches are `DIMS` whole numbers of 16 bits for a unit vector: its coordinates in some orthonormal basis and the length of what is
left of it. The cosine of two sketches is never less than that of their vectors, but for `SLACK`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.simhash_dedup import joined_labels

DIMS = 24
SHORT = 16  # numbers compared before the whole sketch is
UNIT = 32767
SLACK = 5e-4  # rounding moves a sketch by less than 8e-5
REACH_SLACK = 3e-4
LEAF = 128
TILE = 512  # queries and held vectors multiplied at a time
WIDE = 256
QUERIES = 1 << 16  # vectors of other chunks that walk the tree at a time, and their bytes
QUERY_BYTES = 1 << 24
SMALL_PRODUCTS = 1 << 21
TASKS = 16  # at least so many tasks, where chunks would not fall under the least size
HELD_BYTES = 48_000_000  # of held vectors
BLOB_ROWS = 1024
BLOB_BYTES = 256_000
BUFFER_BYTES = 32_000_000
OPEN_LINKS = 200_000
NAME = 24  # bytes of a vector's name
DEALT = "_task int, _length int, _late boolean, names binary, groups binary, copies binary, vectors binary"
FOUND = "a string, b string, n long"


def unit_vectors(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def sketch_basis(units: np.ndarray) -> np.ndarray:
    """The directions in which a sample differs most, as columns; any orthonormal columns would be right."""
    return np.linalg.svd(units - units.mean(axis=0), full_matrices=False)[2][: DIMS - 1].T


def sketches(units: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    length = units.shape[1]
    out = np.zeros((len(units), DIMS))
    if length <= DIMS:
        out[:, :length] = units
    else:
        seen = units[:, : DIMS - 1] if basis is None else units @ basis
        out[:, : seen.shape[1]] = seen
        out[:, -1] = np.sqrt(np.maximum(0, (units * units).sum(axis=1) - (seen * seen).sum(axis=1)))
    return np.rint(np.clip(out, -1, 1) * UNIT).astype("<i2")


def heads(points: np.ndarray) -> np.ndarray:
    """The first numbers of sketches and the length of their rest; products are never less than those of the sketches."""
    rest = np.sqrt((points[:, SHORT - 1 :] ** 2).sum(axis=1, keepdims=True))
    return np.ascontiguousarray(np.hstack((points[:, : SHORT - 1], rest)))


class Tree:
    """k-d tree: each part is split at the median of the number that varies most in it, every number once on a path."""

    def __init__(self, points: np.ndarray):
        count, width = points.shape
        self.order = np.arange(count)
        self.nodes: list[list] = []  # first, last, number (-1: not split), children, their bounds of that number
        todo = [(0, count, (), None, 0)]
        while todo:
            first, last, used, parent, side = todo.pop()
            at = len(self.nodes)
            node = [first, last, -1, -1, -1, None, None]
            self.nodes.append(node)
            if parent is not None:
                self.nodes[parent][3 + side] = at
            if last - first <= LEAF or len(used) == width:
                continue
            some = self.order[first:last]
            spread = points[some[:: max(1, (last - first) // 256)]].var(axis=0)
            spread[list(used)] = -1
            number = int(np.argmax(spread))
            x = points[some, number]
            middle = np.median(x)
            low = x <= middle if (x > middle).any() else x < middle
            cut = first + int(low.sum())
            if cut in (first, last):
                continue
            self.order[first:last] = np.concatenate((some[low], some[~low]))
            node[2] = number
            node[5], node[6] = (x[low].min(), x[low].max()), (x[~low].min(), x[~low].max())
            todo += [(first, cut, (*used, number), at, 0), (cut, last, (*used, number), at, 1)]

    def near(self, queries: np.ndarray, reach: float, own: bool) -> Iterator[tuple[np.ndarray, int, int]]:
        """Queries and the parts (first, last) that they may be near to. With `own` the queries are the tree's points in its order, and
        a part is met only by points of it or behind it."""
        columns = np.ascontiguousarray(queries.T)
        far = queries.dtype.type(reach * reach)
        todo = [(0, np.arange(len(queries), dtype=np.int32), np.zeros(len(queries), queries.dtype))]
        while todo:
            at, rows, cost = todo.pop()
            first, last, number, left, right, *bounds = self.nodes[at]
            if number < 0:
                yield rows, first, last
                continue
            x = columns[number].take(rows)
            for child, (low, high) in zip((left, right), bounds, strict=True):
                gap = np.maximum(low - x, x - high)
                np.maximum(gap, 0, out=gap)
                gap *= gap
                gap += cost
                keep = gap <= far
                if own:
                    keep[: np.searchsorted(rows, self.nodes[child][0])] = False
                keep = np.flatnonzero(keep)
                if len(keep):
                    todo.append((child, rows.take(keep), gap.take(keep)))


class Held:
    """Vectors of one group that a task holds: their counts of links, and labels (places) of what is linked so far."""

    def __init__(self, points: np.ndarray, copies: np.ndarray | None, threshold: float, reach: float, short: bool):
        self.tree = Tree(points)
        self.points = points[self.tree.order]
        self.heads = heads(self.points) if short else self.points
        self.copies = None if copies is None else copies[self.tree.order]
        self.counts = np.zeros(len(points), np.int64)
        self.label = np.arange(len(points))
        self.threshold, self.reach, self.short = threshold, reach, short
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.open = 0
        self.product = np.empty(TILE * WIDE, points.dtype)

    def pairs(self, queries: np.ndarray, first: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of near queries and held vectors; where links are not counted, pairs may be left out whose labels are known to be one.
        `first` has a held vector that a query is linked with, or -1; without it the queries are the held vectors, and a pair is told once."""
        own = first is None
        front = self.heads if own else heads(queries) if self.short else queries
        for rows, low, high in self.tree.near(queries, self.reach, own):
            for at in range(0, len(rows), TILE):
                some = rows[at : at + TILE]
                left = front.take(some, axis=0)
                for start in range(low, high, WIDE):
                    right = self.heads[start : min(start + WIDE, high)]
                    product = np.matmul(left, right.T, out=self.product[: len(left) * len(right)].reshape(len(left), len(right)))
                    if product.max() < self.threshold:
                        continue
                    a, b = np.divmod(np.flatnonzero(product >= self.threshold), len(right))
                    a, b = some[a], start + b
                    keep = a > b if own else np.ones(len(a), bool)
                    if self.copies is None:
                        keep &= (self.label[a] != self.label[b]) if own else (first[a] < 0) | (self.label[first[a]] != self.label[b])
                    a, b = a[keep], b[keep]
                    if self.short:
                        keep = np.einsum("ij,ij->i", queries[a], self.points[b]) >= self.threshold
                        a, b = a[keep], b[keep]
                    if len(a):
                        yield a, b

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        open_ = self.label[a] != self.label[b]
        if open_.any():
            self.links.append((a[open_], b[open_]))
            self.open += int(open_.sum())
        if self.open > OPEN_LINKS:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.links:
            self.label = joined_labels(self.label, *map(np.concatenate, zip(*self.links, strict=True)))
            self.links, self.open = [], 0
        return self.label

    def among(self) -> None:
        for a, b in self.pairs(self.points, None):
            if self.copies is not None:
                np.add.at(self.counts, a, self.copies[b])
                np.add.at(self.counts, b, self.copies[a])
            self.link(a, b)

    def across(self, queries: np.ndarray, copies: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For vectors of another chunk: a held vector that each is linked with, or -1, and its links."""
        first, counts = np.full(len(queries), -1), np.zeros(len(queries), np.int64)
        for a, b in self.pairs(queries, first):
            if copies is not None:
                np.add.at(counts, a, self.copies[b])
                np.add.at(self.counts, b, copies[a])
            new = first[a] < 0
            first[a[new]] = b[new]
            self.link(first[a], b)
        return first, counts


def small_groups(points: np.ndarray, copies: np.ndarray | None, threshold: float, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of one size, each a run of `points`: linked places a, b (a forest) and the counts of all places that have links."""
    a, b = [], []
    step = max(1, SMALL_PRODUCTS // (size * size))
    for at in range(0, len(starts), step):
        place = starts[at : at + step, None] + np.arange(size)
        some = points[place]
        hit = some @ some.transpose(0, 2, 1) >= threshold
        group, i, j = np.nonzero(hit & np.tri(size, size, -1, bool))
        a.append(place[group, i])
        b.append(place[group, j])
    a, b = np.concatenate(a), np.concatenate(b)
    counts = np.zeros(len(points), np.int64)
    if copies is not None:
        np.add.at(counts, a, copies[b])
        np.add.at(counts, b, copies[a])
    label = joined_labels(np.arange(len(points)), a, b)
    met = np.flatnonzero(label != np.arange(len(points)))
    return label[met], met, counts


@dataclass
class Deal:
    """Tasks: the chunks of large groups first, then buckets of small groups."""

    large: np.ndarray  # groups in order
    chunks: np.ndarray
    base: np.ndarray  # the first task of each
    buckets: int

    @property
    def chunked(self) -> int:
        return int(self.chunks.sum())

    @property
    def tasks(self) -> int:
        return self.chunked + self.buckets

    def places(self, groups: np.ndarray, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, their tasks, and whether they come after the vectors that the task holds."""
        at = np.minimum(np.searchsorted(self.large, groups), max(0, len(self.large) - 1))
        big = self.large[at] == groups if len(self.large) else np.zeros(len(groups), bool)
        small = np.flatnonzero(~big)
        rows, tasks, late = [small], [self.chunked + groups[small] % self.buckets], [np.zeros(len(small), bool)]
        big = np.flatnonzero(big)
        at = at[big]
        chunks = self.chunks[at] if len(big) else at
        own = dealt[big] % chunks
        for off in range(int(chunks.max(initial=0)) // 2 + 1):
            to = (own - off) % np.maximum(chunks, 1)
            meets = (2 * off < chunks) | ((2 * off == chunks) & (to < own))
            rows.append(big[meets])
            tasks.append(self.base[at[meets]] + to[meets])
            late.append(np.full(int(meets.sum()), off > 0))
        return np.concatenate(rows), np.concatenate(tasks), np.concatenate(late)


def deal_of(sizes: DataFrame, row_bytes: int, least: int) -> Deal:
    """`sizes` has _group and n; a task holds as many vectors as `HELD_BYTES` allow, fewer where there would be less than `TASKS`."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    wanted = max(TASKS, 2 * sizes.sparkSession.sparkContext.defaultParallelism)
    held = max(1, min(HELD_BYTES // max(1, row_bytes), max(least, math.ceil(total / wanted))))
    large = sorted((r["_group"], r["n"]) for r in sizes.filter(F.col("n") > held).collect())
    chunks = np.array([math.ceil(n / held) for _, n in large], np.int64)
    rest = total - sum(n for _, n in large)
    return Deal(np.array([g for g, _ in large], np.int64), chunks, np.cumsum(chunks) - chunks, max(1, math.ceil(rest / held)))


def names_of(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], f"S{NAME}", len(column), int(offsets[0]))


def names_text(names: np.ndarray) -> pa.Array:
    offsets = np.arange(len(names) + 1, dtype=np.int32) * NAME
    return pa.StringArray.from_buffers(len(names), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(names).tobytes()))


def dealt(members: DataFrame, deal: Deal, sketched: bool) -> DataFrame:
    """Rows of `DEALT`. `members` has _node, _group, _dealt, and either _s0 and so on of sketches, or _v and copies."""
    longs = [f"_s{i}" for i in range(DIMS // 4)]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if sketched:
            yield DIMS, np.arange(batch.num_rows), np.stack([batch[c].to_numpy() for c in longs], axis=1)
            return
        lengths = pc.list_value_length(batch["_v"]).to_numpy()
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            yield length, rows, batch["_v"].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = defaultdict(list)
        filled: dict[tuple, int] = defaultdict(int)
        ready: list[tuple] = []
        held = packed = 0

        def pack(key: tuple) -> int:
            columns = [b"".join(x) for x in zip(*waiting.pop(key), strict=True)]
            ready.append((*key, *columns))
            return filled.pop(key)

        def hand_on() -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4)
            columns = [pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["_task", "_length", "_late", "names", "groups", "copies", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, groups, hashes = names_of(batch["_node"]), batch["_group"].to_numpy(), batch["_dealt"].to_numpy()
            copies = None if sketched else batch["copies"].to_numpy()
            for length, some, values in parts(batch):
                row_bytes = NAME + 16 + values.shape[1] * values.itemsize
                full = max(1, min(BLOB_ROWS, BLOB_BYTES // row_bytes))
                rows, tasks, late = deal.places(groups[some], hashes[some])
                order = np.lexsort((late, tasks))
                rows, tasks, late = rows[order], tasks[order], late[order]
                new = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(late) != 0)) + 1
                bounds = [0, *new.tolist(), len(rows)]
                for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                    key = (int(tasks[first]), length, bool(late[first]))
                    for at in range(first, last, full):
                        place = rows[at : min(at + full, last)]
                        whole = some[place]
                        waiting[key].append((names[whole].tobytes(), groups[whole].tobytes(), b"" if copies is None else copies[whole].tobytes(), values[place].tobytes()))
                        filled[key] += len(place) * row_bytes
                        held += len(place) * row_bytes
                        if filled[key] >= full * row_bytes:
                            packed += (size := pack(key))
                            held -= size
                            if packed >= BUFFER_BYTES // 4:
                                yield hand_on()
                                packed = 0
                    if held >= BUFFER_BYTES:
                        for k in list(waiting):
                            pack(k)
                        held = packed = 0
                        yield hand_on()
        for key in list(waiting):
            pack(key)
        if ready:
            yield hand_on()

    return members.mapInArrow(run, DEALT)


def links(members: DataFrame, deal: Deal, threshold: float, sketched: bool, double: bool = True) -> DataFrame:
    """Rows (a, b, n): n links of vector a that one task counted (b null; not for sketches), or a link a-b of a task's forest (n null)."""
    # Twice as many partitions as tasks, so that fewer of them hold two.
    ordered = dealt(members, deal, sketched).repartition(2 * deal.tasks, "_task").sortWithinPartitions("_task", "_length", "_late")
    chunked = deal.chunked
    kind = "<i2" if sketched else "<f8" if double else "<f4"
    least = threshold - SLACK if sketched else threshold
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + (REACH_SLACK if sketched else 1e-9)

    def unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
        length = rows[0][1]
        names, groups, copies, vectors = (b"".join(r[i] for r in rows) for i in range(3, 7))
        rows.clear()  # whoever handed them on may keep the list
        values = np.frombuffer(vectors, kind).reshape(-1, length)
        points = values.astype(np.float32) / np.float32(UNIT) if sketched else unit_vectors(values.astype(np.float64))
        return np.frombuffer(names, f"S{NAME}"), np.frombuffer(groups, np.int64), None if sketched else np.frombuffer(copies, np.int64), points

    def told(a: list, b: list, counted: list, counts: list) -> pa.RecordBatch:
        a, b, counted = (np.concatenate([np.empty(0, f"S{NAME}"), *x]) for x in (a, b, counted))
        n = np.concatenate([np.empty(0, np.int64), *counts])
        nothing = pa.nulls(len(n), pa.string())
        columns = [pa.concat_arrays([names_text(a), names_text(counted)]), pa.concat_arrays([names_text(b), nothing]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(n)])]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    def results(names: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(counts)
        return told([names[first]], [names[second]], [names[some]], [counts[some]])

    def large(rows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
        names, _, copies, points = unpacked(next(rows))
        held = Held(points, copies, least, reach, sketched)
        del points
        names = names[held.tree.order]
        held.among()
        for more in rows:
            others, _, their, queries = unpacked(more)
            first, counts = held.across(queries, their)
            met, some = np.flatnonzero(first >= 0), np.flatnonzero(counts)
            if len(met):
                yield told([names[first[met]]], [others[met]], [others[some]], [counts[some]])
        label = held.settle()
        met = np.flatnonzero(label != np.arange(len(label)))
        yield results(names, label[met], met, held.counts)

    def small(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names, groups, copies, points = unpacked(rows)
        order = np.argsort(groups, kind="stable")
        names, groups, points = names[order], groups[order], points[order]
        copies = None if copies is None else copies[order]
        starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        sizes = np.diff([*starts.tolist(), len(groups)])
        for size in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]).tolist():
            yield results(names, *small_groups(points, copies, least, starts[sizes == size], size))
        for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
            span = slice(start, start + size)
            held = Held(points[span], None if copies is None else copies[span], least, reach, sketched)
            held.among()
            label = held.settle()
            met = np.flatnonzero(label != np.arange(size))
            yield results(names[span][held.tree.order], label[met], met, held.counts)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Packed rows of one task and length: first all that it holds, then the others, some at a time."""
        key, rows = None, []
        count = size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key or (row[2] and (count >= QUERIES or size >= QUERY_BYTES)):
                    if rows:
                        yield key, rows
                    key, rows, count, size = row[:3], [], 0, 0
                rows.append(row)
                count += len(row[3]) // NAME
                size += len(row[6])
        if rows:
            yield key, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = runs(batches)
        part = next(parts, None)
        while part:
            (task, length, late), rows = part
            if task >= chunked:
                yield from small(rows)
                part = next(parts, None)
                continue
            left: list = []

            def of_task(first: list[tuple] = rows, key: tuple = (task, length), left: list = left) -> Iterator[list[tuple]]:
                yield first
                for (t, n, _), more in parts:
                    if (t, n) != key:
                        left.append(((t, n, _), more))
                        return
                    yield more

            if late:  # nothing is held that they could be near to
                for _ in of_task():
                    pass
            else:
                yield from large(of_task())
            part = left[0] if left else None

    return ordered.mapInArrow(run, FOUND)
