"""Portions: some megabytes of whole documents as one compressed row, and the exchange of packed rows.

Text is the bulk of every corpus, and rows of a few bytes each are the bulk of every exploded one.
Operators that need exact corpus-wide counts of shingles or anchors work on portions. Portions that one task
wrote one after the other make a span of about ``SPAN`` bytes; a span asks for all its keys together, each once
with its number, so a key that all documents share is one entry per span. Buckets of keys add the numbers up
and answer for keys alone that come more than once. No row of text is shuffled uncompressed.

Rows of an exchange stay in proportion to the corpus: up to ``ROUND`` buckets a span has one row for
each. Beyond, keys go in two rounds, as in a grid: a span sends a row to each of about the square
root of the buckets, and nodes that gather so many spans send them on; answers come back in the same way. A
span never has more than 4 rows for each square root (see ``Exchange``).

All exchanges have the form (key, kind, part, blob); ``meet`` brings the rows of a key together, ``meet_spans``
those of a span: first what is for the whole span (kind below 0), then its portions one by one.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, saved

#: Bytes of text in a portion (a longer document is a portion of its own), in a span, and per bucket of keys.
PORTION, SPAN, BUCKET = 1 << 20, 32 << 20, 32 << 20
#: Portions of a span at most, as bits of its number; buckets that a span asks in one round at most.
INSIDE, ROUND = 12, 512
#: Counts of a key beyond this aren't told apart.
MOST = (1 << 16) - 1
SCHEMA = "key long, kind int, part int, blob binary"
_NAMES = ["key", "kind", "part", "blob"]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
Row = tuple[int, int, int, bytes]


def give_back() -> None:
    """Return memory that this worker no longer uses to the system: it waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def packed(*values) -> bytes:
    return zstandard.compress(pickle.dumps(values, protocol=5), 3)


def unpacked(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def batches_of(rows: Iterator[Row], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 32
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _KINDS)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _KINDS)], names=_NAMES)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        columns = [b[n] for n in _NAMES]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


class Numbers:
    """Numbers for rows that a task writes: the partition, the span of about ``most`` (of any measure), the place in it."""

    def __init__(self, most: int):
        self.most, self.span, self.place, self.size = most, 0, 0, 0
        self.base = TaskContext.get().partitionId() << 33

    def next(self, size: int) -> int:
        if self.place and (self.size + size > self.most or self.place == 1 << INSIDE):
            self.span, self.place, self.size = self.span + 1, 0, 0
        number = self.base | self.span << INSIDE | self.place
        self.place, self.size = self.place + 1, self.size + size
        return number


def span_of(key):
    """The span of a portion's number: an integer in Python, a column in Spark."""
    return key >> INSIDE << INSIDE if isinstance(key, int) else key.bitwiseAND(F.lit(-1 << INSIDE))


def portions(docs: DataFrame, most: int = PORTION, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) as saved rows of SCHEMA: key is the portion, part about its bytes, blob its
    (ids, nulls, sizes, text, stream of the columns ``keep``).

    Ids are integers; documents of a portion are in the order of their ids (null last). Null text is empty.
    Columns travel by their place, so their names don't matter.
    """
    kept = [c for c in keep if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(SPAN)

        def row(held: list[pa.RecordBatch], size: int) -> Row:
            return (numbers.next(size), 0, min(size, (1 << 31) - 1), pack_portion(held, bool(keep)))

        def rows() -> Iterator[Row]:
            held, size = [], 0
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False) + 64
                at = 0
                while at < b.num_rows:
                    stop = min(b.num_rows, at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), most - size)))
                    held.append(b.slice(at, stop - at))
                    size += int(sizes[at:stop].sum())
                    at = stop
                    if size >= most:
                        yield row(held, size)
                        held, size = [], 0
            if held:
                yield row(held, size)

        yield from batches_of(rows())
        give_back()

    spark, size = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *(quoted(c).alias(f"kept{k}") for k, c in enumerate(kept)))
    before = spark.conf.get(size)
    spark.conf.set(size, "500")  # whole texts: a batch of the usual size would be large
    try:
        return saved(rows.mapInArrow(run, SCHEMA), "portions")
    finally:
        spark.conf.set(size, before)


def pack_portion(held: list[pa.RecordBatch], keep: bool) -> bytes:
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table["id"]))  # stable, null last
    ids = table["id"]
    data = [(x.as_py() or "").encode() for x in table["text"]]
    sink = pa.BufferOutputStream()
    if keep:
        # The text is in the portion already; only where it is null must be known.
        table = table.append_column("null", pc.is_null(table["text"])).drop_columns(["id", "text"])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
    sizes = np.array([len(x) for x in data], np.int64)
    return packed(pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(), sizes, b"".join(data), sink.getvalue().to_pybytes())


def restored(portion: tuple, names: list[str], gone: np.ndarray | None = None) -> pa.Table:
    """The rows of a portion that kept the columns ``names``; bytes marked ``gone`` are left out of the text."""
    _, _, sizes, text, stream = portion
    table, texts, at = pa.ipc.open_stream(stream).read_all(), [], 0
    for null, size in zip(table["null"].to_pylist(), sizes.tolist()):
        part = text[at : at + size]
        if gone is not None and (g := gone[at : at + size]).any():
            part = np.frombuffer(part, np.uint8)[~g].tobytes()
        texts.append(None if null else part.decode("utf-8", "ignore"))
        at += size
    columns, kept = iter(table.columns), []
    for name in names:
        kept.append(pa.array(texts, pa.string()) if name == "text" else next(columns))
    return pa.Table.from_arrays(kept, names=names)


def measured(rows: DataFrame) -> tuple[int, int]:
    """The sum of ``part`` over saved rows (bytes of portions, tokens of groups), and their spans."""
    size, spans = rows.agg(F.sum(F.col("part").cast("long")), F.count_distinct(span_of(F.col("key")))).first()
    return int(size or 0), int(spans)


def mapped(df: DataFrame, run: Callable[[Iterator[Row]], Iterator[Row]]) -> DataFrame:
    """``run`` over the rows of each partition."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(run(rows_of(batches)))
        give_back()

    return df.mapInArrow(go, SCHEMA)


def meet(*frames: DataFrame) -> DataFrame:
    """The rows of all ``frames``, those of a key next to each other, by kind and part."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return rows.repartition("key").sortWithinPartitions("key", "kind", "part")


def by_key(rows: Iterator[Row]) -> Iterator[tuple[int, Iterator[Row]]]:
    return itertools.groupby(rows, key=lambda r: r[0])


def meet_spans(*frames: DataFrame) -> DataFrame:
    """The rows of all ``frames``, those of a span next to each other: of kinds below 0 first, then by key, kind and part."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    span = span_of(F.col("key"))
    return rows.repartition(span).sortWithinPartitions(span, F.col("kind") >= 0, "key", "kind", "part")


def by_span(rows: Iterator[Row]) -> Iterator[tuple[int, list[Row], Iterator[tuple[int, Iterator[Row]]]]]:
    """Per span: its number, the rows for all of it, and its portions, each with its rows."""
    for span, own in itertools.groupby(rows, key=lambda r: span_of(r[0])):
        whole: list[Row] = []
        rest: Iterator[Row] = iter(())
        for r in own:
            if r[1] >= 0:
                rest = itertools.chain((r,), own)
                break
            whole.append(r)
        yield span, whole, by_key(rest)


def short(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of unsigned integers, in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def long_(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view("<u8").ravel()


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before, in columns that are sorted together."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def tally(keys: np.ndarray, values: np.ndarray | None = None, n: np.ndarray | None = None, most: int = MOST) -> tuple:
    """Distinct keys (with ``values``: pairs), sorted, and how often each comes (``n``: the sum of those), ``most`` at most."""
    order = np.argsort(keys, kind="stable") if values is None else np.lexsort((values, keys))
    keys, values = keys[order], None if values is None else values[order]
    first = runs_of(keys) if values is None else runs_of(keys, values)
    count = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return keys[first], None if values is None else values[first], np.minimum(count, most).astype(np.uint16)


class Exchange:
    """Where keys are counted: ``buckets`` of bounded size, asked by spans in one round or in two.

    In two rounds a bucket is one of ``fan`` below one of ``over``; spans of one of ``groups`` share nodes.
    """

    def __init__(self, size: int, spans: int, bucket: int = BUCKET, most: int = ROUND):
        self.buckets = max(1, -(-size // bucket))
        self.fan = 1 if self.buckets <= most else math.isqrt(self.buckets - 1) + 1
        self.over = -(-self.buckets // self.fan)
        self.groups = max(1, -(-spans // self.fan))

    def rows(self, spans: int) -> int:
        """Rows that travel for so many spans, questions and answers, at most."""
        if self.fan == 1:
            return 2 * spans * self.buckets
        return 2 * (spans * self.over + self.groups * self.over * self.fan)

    def ask(self, span: int, keys: np.ndarray, values: np.ndarray | None, n: np.ndarray) -> Iterator[Row]:
        """Rows for ``counted`` from what ``tally`` gives for a span."""
        bucket = ((keys >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, bucket, n = short(keys[order]), bucket[order], n[order]
        values = None if values is None else short(values[order])
        to = bucket // self.fan
        group = zlib.crc32(span.to_bytes(8, "little")) % self.groups * self.over
        for t in np.unique(to).tolist():
            lo, hi = np.searchsorted(to, (t, t + 1))
            some = (keys[lo:hi], None if values is None else values[lo:hi], n[lo:hi])
            if self.fan == 1:
                yield (t, 0, 0, packed(span, None, *some))
            else:
                yield (group + t, 0, 0, packed(span, (bucket[lo:hi] - t * self.fan).astype(np.uint32), *some))

    def counted(self, asked: DataFrame) -> DataFrame:
        """Rows (span, -1, 0, ...) for ``Answers``: the keys of each span that come more than once in all."""
        if self.fan == 1:
            return mapped(meet(asked), _count)
        return mapped(meet(mapped(meet(mapped(meet(asked), self._forward)), _count)), _back)

    def _forward(self, rows: Iterator[Row]) -> Iterator[Row]:
        """At a node: what its spans asked, a row per bucket; and the spans, for the way back."""
        for node, own in by_key(rows):
            spans, below, keys, values, n = zip(*(unpacked(r[3]) for r in own))
            yield (-1 - node, 0, 0, packed(np.array(spans, np.int64)))
            of = np.repeat(np.arange(len(spans), dtype=np.uint32), [len(k) for k in keys])
            below = np.concatenate(below)
            order = np.argsort(below, kind="stable")
            below, of, keys, n = below[order], of[order], np.concatenate(keys)[order], np.concatenate(n)[order]
            values = None if values[0] is None else np.concatenate(values)[order]
            for b in np.unique(below).tolist():
                lo, hi = np.searchsorted(below, (b, b + 1))
                yield (node % self.over * self.fan + b, 0, 0, packed(node, of[lo:hi], keys[lo:hi], None if values is None else values[lo:hi], n[lo:hi]))


def _count(rows: Iterator[Row]) -> Iterator[Row]:
    """At a bucket: per row of questions an answer, to where it came from. Keys that come once are left out."""
    for bucket, own in by_key(rows):
        if bucket < 0:
            yield from ((-1 - r[0], 0, 0, r[3]) for r in own)
            continue
        back, of, keys, values, n = zip(*(unpacked(r[3]) for r in own))
        sizes = [len(k) for k in keys]
        together = long_(np.concatenate(keys))
        order = np.argsort(together, kind="stable")
        first = runs_of(together[order])
        lengths = np.diff(np.append(first, len(together)))
        sums = np.minimum(np.add.reduceat(np.concatenate(n)[order].astype(np.int64), first), MOST)
        count, alike = np.empty(len(together), np.uint16), np.ones(len(together), bool)
        count[order] = np.repeat(sums, lengths)
        if values[0] is not None:
            value = long_(np.concatenate(values))[order]
            alike[order] = np.repeat(np.minimum.reduceat(value, first) == np.maximum.reduceat(value, first), lengths)
        at = 0
        for to, which, k, size in zip(back, of, keys, sizes):
            often = count[at : at + size] > 1
            if often.any():
                yield (to, -1, 0, packed(None if which is None else which[often], k[often], count[at : at + size][often], np.packbits(alike[at : at + size][often])))
            at += size


def _back(rows: Iterator[Row]) -> Iterator[Row]:
    """At a node: the answers of its buckets, a row per span."""
    for _, own in by_key(rows):
        spans, found = None, []
        for _, kind, _, blob in own:
            if kind == 0:
                (spans,) = unpacked(blob)
            else:
                which, keys, n, alike = unpacked(blob)
                found.append((which, keys, n, np.unpackbits(alike, count=len(n))))
        if not found:
            continue
        which, keys, n, alike = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(which, kind="stable")
        which = which[order]
        for k in np.unique(which).tolist():
            part = order[slice(*np.searchsorted(which, (k, k + 1)))]
            yield (int(spans[k]), -1, 0, packed(None, keys[part], n[part], np.packbits(alike[part])))


class Answers:
    """Counts of a span's keys, from its rows of ``counted``."""

    def __init__(self, rows: list[Row]):
        found = [unpacked(r[3])[1:] for r in rows]
        keys = long_(np.concatenate([k for k, _, _ in found] or [np.zeros((0, 6), np.uint8)]))
        n = np.concatenate([n for _, n, _ in found] or [np.zeros(0, np.uint16)])
        alike = np.concatenate([np.unpackbits(a, count=len(n)) for _, n, a in found] or [np.zeros(0, np.uint8)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        first = runs_of(keys[order])
        self.keys = keys[order][first]
        # Keys that can't be told apart here: what leads to more work, not to less.
        self.n = np.maximum.reduceat(n[order], first) if len(first) else n
        self.alike = np.logical_and.reduceat(alike[order], first) if len(first) else alike

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (1: no answer) and whether all have one value, of each of ``keys``."""
        low = keys & np.uint64((1 << 48) - 1)
        at = np.minimum(np.searchsorted(self.keys, low), max(0, len(self.keys) - 1))
        hit = self.keys[at] == low if len(self.keys) else np.zeros(len(keys), bool)
        n, alike = np.ones(len(keys), np.uint16), np.ones(len(keys), bool)
        n[hit], alike[hit] = self.n[at[hit]], self.alike[at[hit]]
        return n, alike
