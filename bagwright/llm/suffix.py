"""Suffix-array dedup: every byte that lies in a string of ``LENGTH`` bytes which also starts earlier is removed.

1. Windows of ``LENGTH`` bytes are told apart by their anchor, the least hash of their ``ANCHOR``-byte
   strings: equal windows have equal anchors. Runs of neighbouring windows with one anchor are one
   context. Anchors are counted across the corpus; windows whose anchor comes once
   are unique and go no further (exact: no repeated window is lost).
2. Contexts with a repeated anchor go to the shard of their anchor, each different one of a span of portions
   once; their text goes along only if the anchor has different contexts (of equal ones
   the earliest stays, which needs no order of suffixes). Windows of an anchor with ``HOT`` or more
   contexts go one by one, by their own content, so that no anchor's contexts
   meet in one task; up to ``LENGTH`` bytes travel for each such window that differs within its span.
3. A shard brings its different contexts into suffix order by external induced sorting (``induced``). Its texts, the
   queues beyond ``HELD`` bytes, the seeds and the flags are files on the task's disk.
   Windows that have ``LENGTH`` bytes in common are neighbours then; all but the earliest go.
   A context that is equal to an earlier one goes whole.
4. What goes returns to its span and is taken out of the texts.

Order is by doc_id, null last, then by place in the table; rows of equal doc_id are documents of
their own. Strings are judged on the input. Matches never cross documents. Removal is of bytes and can
cut a character, whose rest ``dedup`` drops from the text it returns.

Defined results: doc_id is an integer, or text that holds one (it is cast to long; other text fails or is
null, as the session casts); null or empty text stays as it is, with nothing removed; texts under ``LENGTH``
bytes are kept whole; texts of any length are judged whole; other columns are kept by ``dedup``, whatever their
names, and ignored by ``removed``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import mixed, powers
from .induced import Room, clusters
from .portions import BUCKET, ROUND, Answers, Exchange, Row, by_key, by_span, give_back, mapped, measured, meet, meet_spans, packed, portions, restored, rows_of, runs_of, span_of, tally, unpacked

LENGTH, ANCHOR, RUN, HOT = 100, 32, 128, 8192
#: Bytes of corpus text per shard, and bytes that the sort of a shard keeps in memory.
SHARD, HELD = 16 << 20, 128 << 20


def runs(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: hash, first window, windows, whether the anchor comes twice in it, hash of the context."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none.astype(bool), none.astype(np.uint64)
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = x ^ (x >> np.uint64(29))
    n = 1
    while n < width:
        h = h[:-n] * np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64)) + h[n:]
        n *= 2
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    span, least, n = length - width + 1, h, 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < span:
        least = np.minimum(least[: len(least) - (span - n)], least[span - n :])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    has = sizes >= length
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[has], 1)
    np.add.at(edge, ends[has] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[: len(least)]) > 0)
    if not len(at):
        return none.astype(np.uint64), none, none, none.astype(bool), none.astype(np.uint64)
    own = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    new |= np.isin(at, starts[has]) if has.any() else False
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    new |= place % RUN == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    begins = np.concatenate(([0], np.cumsum(h[at] == own)))
    # The last window of a run may begin with the anchor; an earlier one only if the anchor comes again.
    again = begins[first + n - 1] - begins[first] > 0
    sums = np.zeros(len(data) + 1, np.uint64)
    power, inverse = powers(len(data) + 1)
    np.cumsum(x * power[: len(data)], out=sums[1:])
    start, stop = at[first], at[first] + n + length - 1
    content = mixed((sums[stop] - sums[start]) * inverse[start] + n.astype(np.uint64))
    return own[first], start, n, again, content


def _windows(blob: bytes) -> tuple:
    ids, nulls, sizes, text, _ = unpacked(blob)
    data = np.frombuffer(text, np.uint8)
    return (ids, nulls, sizes, text, *runs(data, sizes))


def _content(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _asked(exchange: Exchange):
    """The anchors of each span with their contents; one that comes again in a portion counts twice there."""

    def run(rows: Iterator[Row]) -> Iterator[Row]:
        for span, own in itertools.groupby(rows, key=lambda r: span_of(r[0])):
            found = []
            for _, _, _, blob in own:
                *_, anchor, _, _, _, content = _windows(blob)
                found.append(tally(anchor, content, most=2))
            yield from exchange.ask(span, *tally(*(np.concatenate(x) for x in zip(*found))))

    return run


def _contexts(shards: int):
    """Per portion: a row (portion, 1, 0, its repeated contexts), and per span rows (-1 - shard, 2, 0, different contexts)."""

    def run(rows: Iterator[Row]) -> Iterator[Row]:
        for span, whole, portions_ in by_span(rows):
            answers, known, more, tables = Answers(whole), {}, [], []
            for portion, own in portions_:
                ids, nulls, sizes, text, anchor, start, n, again, content = _windows(next(own)[3])
                count, alike = answers.of(anchor)
                hits = np.flatnonzero((count > 1) | again)
                if not len(hits):
                    continue
                goes = ~alike[hits] | again[hits]
                plain, hits = hits[~goes], hits[goes]
                at, width, key, entry = [start[plain]], [n[plain]], [anchor[plain]], [np.full(len(plain), -1)]
                rest = []
                for a, m, is_hot, twice, k in zip(start[hits].tolist(), n[hits].tolist(), (count[hits] >= HOT).tolist(), again[hits].tolist(), anchor[hits].tolist()):
                    for a, m in [(a + i, 1) for i in range(m)] if is_hot else [(a, m)]:
                        context = text[a : a + m + LENGTH - 1]
                        e = known.setdefault(context, len(known))
                        if e == len(more):
                            more.append((_content(context) if is_hot else k, twice))
                        rest.append((a, m, e))
                if rest:
                    a, m, e = np.array(rest, np.int64).T
                    at.append(a), width.append(m), entry.append(e), key.append(np.zeros(len(e), np.uint64))
                at, width, key, entry = (np.concatenate(x) for x in (at, width, key, entry))
                ends = np.cumsum(sizes)
                of = np.searchsorted(ends, at, "right")
                tables.append((np.full(len(at), portion), ids[of], nulls[of], of, at - (ends - sizes)[of], at, width, key, entry))
            if not tables:
                continue
            portion, ids, nulls, of, begin, at, width, key, entry = (np.concatenate(x) for x in zip(*tables))
            keys, twice = (np.array([x[k] for x in more], t) for k, t in ((0, np.uint64), (1, bool)))
            plain = entry < 0
            distinct, entry[plain] = np.unique(key[plain], return_inverse=True)
            entry[plain] += len(known)
            # The earliest of equal contexts stands for them.
            order = np.lexsort((begin, of, portion, ids, nulls))
            _, first = np.unique(entry[order], return_index=True)
            first = order[first]
            leads = np.zeros(len(entry), bool)
            leads[first] = True
            for lo, hi in itertools.pairwise([*runs_of(portion).tolist(), len(portion)]):
                yield (int(portion[lo]), 1, 0, packed(at[lo:hi].astype(np.int32), width[lo:hi].astype(np.uint8), entry[lo:hi].astype(np.int32), np.packbits(leads[lo:hi])))
            keys, loop = np.concatenate((keys, distinct)), np.concatenate((twice, np.zeros(len(distinct), bool)))
            pieces = list(known)
            shard = ((keys >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                f = first[part]
                columns = (keys[part], part.astype(np.int32), portion[f], ids[f], nulls[f], of[f].astype(np.int32), begin[f], width[f].astype(np.uint8), loop[part], part >= len(pieces))
                yield (-1 - int(shard[part[0]]), 2, 0, packed(span, columns, b"".join([pieces[i] for i in part.tolist() if i < len(pieces)])))

    return run


def _shard(base: int | None, held: int):
    """From rows (-1 - shard, 2, 0, contexts): rows (span, -1, 0, runs of windows that go, per context). Others pass."""

    def run(rows: Iterator[Row]) -> Iterator[Row]:
        for key, own in by_key(rows):
            if key >= 0:
                yield from own
                continue
            with tempfile.TemporaryDirectory() as folder:
                yield from judged(own, Room(folder, held, base))

    return run


#: A context of a shard: its anchor, where it comes first in its span (in the order of documents), and its windows.
_CONTEXT = np.dtype([("key", "u8"), ("null", "?"), ("id", "i8"), ("portion", "i8"), ("doc", "i8"), ("begin", "i8"), ("span", "i8"), ("entry", "i8"), ("width", "i8"), ("at", "i8"), ("loop", "?"), ("skip", "?")])
_ORDER = ("begin", "doc", "portion", "id", "null")


def judged(rows: Iterator[Row], room: Room) -> Iterator[Row]:
    """Runs of windows that go, from the contexts of one shard. Contexts and texts are in files of ``room``."""
    text, contexts, plain = (open(room.path(), "w+b") for _ in range(3))  # noqa: SIM115
    at = text.write(b"\0")
    for r in rows:
        span, columns, pieces = unpacked(r[3])
        made = np.zeros(len(columns[0]), _CONTEXT)
        for name, c in zip(("key", "entry", "portion", "id", "null", "doc", "begin", "width", "loop"), columns):
            made[name] = c
        made["span"] = span
        is_plain = columns[9]
        plain.write(made[is_plain].tobytes())
        made = made[~is_plain]
        sizes = made["width"] + LENGTH - 1
        made["at"] = at + np.cumsum(sizes + 1) - (sizes + 1)
        contexts.write(made.tobytes())
        # Symbols are one more than bytes; a 0 ends each context.
        out = np.zeros(len(pieces) + len(made), np.uint8)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        out[inside] = np.frombuffer(pieces, np.uint8) + np.uint8(1)
        at += text.write(out.tobytes())
    text.write(bytes(16))
    for f in (text, contexts, plain):
        f.flush()
        os.unlink(f.name)
    yield from _sent(_plain_ones(plain, 0, room))
    if contexts.tell():
        _lonely(contexts, room)
        yield from _sent(_repeated(np.memmap(text, np.uint8, "r"), np.memmap(contexts, _CONTEXT, "r"), room))
    for f in (text, contexts, plain):
        f.close()


def _sent(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[Row]:
    """Rows by span from blocks of (span, entry, first window, windows)."""
    for span, entry, lo, n in found:
        order = np.argsort(span, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(span[order])) + 1):
            if len(part):
                yield (int(span[part[0]]), -1, 0, packed(entry[part], lo[part], n[part]))


def _by_key(file, bits: int, room: Room) -> Iterator[np.ndarray]:
    """The contexts of ``file`` in parts that fit; those of one key are in one part."""
    n = file.seek(0, os.SEEK_END) // _CONTEXT.itemsize
    rows = np.memmap(file, _CONTEXT, "r") if n else np.zeros(0, _CONTEXT)
    if n <= room.block * 8 or bits >= 56:
        yield np.array(rows)
        return
    files = [open(room.path(), "w+b") for _ in range(16)]  # noqa: SIM115
    for part in room.blocks(n):
        own = rows[part]
        to = (own["key"] >> np.uint64(bits + 8)) & np.uint64(15)
        for k, f in enumerate(files):
            f.write(own[to == k].tobytes())
    for f in files:
        f.flush()
        os.unlink(f.name)
        yield from _by_key(f, bits + 4, room)
        f.close()


def _plain_ones(file, bits: int, room: Room) -> Iterator[tuple[np.ndarray, ...]]:
    """Contexts of anchors with one content: all but the earliest of each go whole."""
    for rows in _by_key(file, bits, room):
        rows = rows[np.lexsort([rows[n] for n in (*_ORDER, "key")])]
        goes = rows[1:][rows["key"][1:] == rows["key"][:-1]]
        yield goes["span"], goes["entry"], np.zeros(len(goes), np.int64), goes["width"]


def _lonely(file, room: Room) -> None:
    """Mark contexts that are alone with their anchor and hold it once: they hold nothing repeated."""
    rows = np.memmap(file, _CONTEXT, "r+")
    with open(room.path(), "w+b") as keys:
        for part in room.blocks(len(rows)):
            own = rows[part].copy()
            own["at"] = np.arange(part.start, part.stop)
            keys.write(own.tobytes())
        keys.flush()
        for own in _by_key(keys, 0, room):
            _, of, n = np.unique(own["key"], return_inverse=True, return_counts=True)
            rows["skip"][own["at"][(n[of] == 1) & ~own["loop"]]] = True
        os.unlink(keys.name)


def _repeated(text: np.ndarray, contexts: np.ndarray, room: Room) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that start earlier elsewhere, from the suffix order of the contexts' texts."""
    starts, widths = room.array(len(contexts)), room.array(len(contexts))
    for part in room.blocks(len(contexts)):
        own = contexts[part]
        starts[part], widths[part] = own["at"], np.where(own["skip"], 0, own["width"])
    goes = room.array(len(text), np.bool_)
    held = np.zeros(0, _CONTEXT)  # the earliest of the cluster that goes on in the next block
    for at, of, new in clusters(text, starts, widths, LENGTH, room):
        rows = contexts[of]
        rows["begin"] += at - starts[of]
        rows["at"] = at
        if len(held) and not new[0]:
            rows, new = np.concatenate((held, rows)), np.concatenate(([True], new))
        new[0] = True
        cluster = np.cumsum(new)
        order = np.lexsort((*(rows[n] for n in _ORDER), cluster))
        first = np.ones(len(order), bool)
        first[1:] = cluster[order][1:] != cluster[order][:-1]
        goes[rows["at"][order[~first]]] = True
        held = rows[order[first][-1:]]
    for part in room.blocks(len(contexts)):
        own = contexts[part]
        lo, hi = int(own["at"][0]), int(own["at"][-1] + own["width"][-1])
        out = np.flatnonzero(goes[lo:hi]) + lo
        if not len(out):
            continue
        of = np.searchsorted(own["at"], out, "right") - 1
        first = np.ones(len(out), bool)
        first[1:] = (out[1:] != out[:-1] + 1) | (of[1:] != of[:-1])
        first = np.flatnonzero(first)
        c = of[first]
        yield own["span"][c], own["entry"][c], out[first] - own["at"][c], np.diff(np.append(first, len(out)))


class Gone:
    """What goes of each portion of a span, from the span's rows of ``_shard``."""

    def __init__(self, rows: list[Row]):
        found = [unpacked(r[3]) for r in rows]
        entry, lo, n = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        order = np.argsort(entry, kind="stable")
        self.entry, self.lo, self.n = entry[order], lo[order], n[order]

    def of(self, text: bytes, table: bytes | None) -> np.ndarray | None:
        """Per byte of a portion whether it goes; ``table``: its row of ``_contexts``."""
        if table is None:
            return None
        at, width, entry, leads = unpacked(table)
        leads = np.unpackbits(leads, count=len(at)).astype(bool)
        at, width = at.astype(np.int64), width.astype(np.int64)
        # Where an earlier one of the span stands for a context, it goes whole; else what the shard found.
        own = entry[leads]
        first, stop = np.searchsorted(self.entry, own), np.searchsorted(self.entry, own, "right")
        some = np.repeat(first - np.cumsum(stop - first) + (stop - first), stop - first) + np.arange((stop - first).sum())
        lo = np.concatenate((at[~leads], np.repeat(at[leads], stop - first) + self.lo[some]))
        size = np.concatenate((width[~leads], self.n[some]))
        edge = np.bincount(lo, minlength=len(text) + 1).astype(np.int64) - np.bincount(lo + size + LENGTH - 1, minlength=len(text) + 1)
        return np.cumsum(edge[: len(text)]) > 0


def marked(docs: DataFrame, base: int | None = None, held: int = HELD, keep: tuple[str, ...] = (), bucket: int = BUCKET, most: int = ROUND) -> tuple[DataFrame, DataFrame]:
    """Portions of ``docs``; the repeated contexts of each (kind 1), and per span what of those goes (kind -1)."""
    all_ = portions(docs, keep=keep)
    size, spans = measured(all_)
    exchange, shards = Exchange(size, spans, bucket, most), max(1, -(-size // SHARD))
    counts = exchange.counted(mapped(all_, _asked(exchange)))
    contexts = mapped(meet_spans(all_, counts), _contexts(shards))
    return all_, mapped(meet(contexts), _shard(base, held))


def _judged_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray | None]]:
    for _, whole, portions_ in by_span(rows_of(batches)):
        gone = Gone(whole)
        for _, own in portions_:
            rows = {kind: blob for _, kind, _, blob in own}
            portion = unpacked(rows[0])
            yield portion, gone.of(portion[3], rows.get(1))


def removed(docs: DataFrame, base: int | None = None, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, nulls, sizes, text, _), gone in _judged_portions(batches):
            cut, spans, kept, at = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [], 0
            for i, size in enumerate(sizes.tolist()):
                part = np.frombuffer(text, np.uint8, size, at)
                if gone is not None and size:
                    g = gone[at : at + size]
                    cut[i] = g.sum()
                    if cut[i]:
                        spans[i] = int(g[0]) + (g[1:] & ~g[:-1]).sum()
                        part = part[~g]
                kept.append(hashlib.sha256(part).hexdigest())
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(sizes), pa.array(cut), pa.array(spans), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return meet_spans(*marked(docs, base, held)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, base: int | None = None, held: int = HELD) -> DataFrame:
    """``docs`` (doc_id integer, text, others) with repeated strings taken out of ``text``; all columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, gone in _judged_portions(batches):
            yield from restored(portion, names, gone).to_batches()
        give_back()

    return meet_spans(*marked(docs, base, held, tuple(names))).mapInArrow(run, docs.schema)
