"""N-gram Jaccard join by a token-group matrix: groups of similar documents, opened only where they can link.

A document's set holds its distinct shingles of ``WIDTH`` words; two documents link when
100 * |A and B| >= ``PERCENT`` * |A or B|.

1. Equal sets are one from here on. Of each set the smallest hashes (its prefix) are counted across
   the corpus; a set that could link has enough of them elsewhere. Others are done.
2. The rest is dealt into groups of at most ``MEMBERS`` sets with a small shingle in common. A group is
   stored as its token union and a bit matrix of members and tokens; links inside are found there.
3. The token-group matrix: tokens of all unions are counted across groups. A member with too many
   tokens that no other group has can't link outside. The others post the rarest tokens of theirs,
   as many as are needed for two links to meet, with the sizes that a partner can have (``limit``).
4. Groups that meet are compared: for each member the overlap with the other group's union bounds
   all its overlaps there, and only groups with qualifying members are opened. The first round compares each
   group that posted a token with the token's first group alone, so a family of any size is
   linked by a number of comparisons in proportion to its groups. After components are found, a second
   round compares all groups that still meet in different components, allow each other's sizes and haven't been
   compared. Postings of a token are sorted by component and dealt in blocks; pairs within a component are never
   formed, and families whose members have too much of their own to link (say 80 % in common) form none at all.

Components are found by alternating star contraction; only links between local components travel. Rows meet
what a component, a copied text or a star's centre has by ``met``, so that none of those is a hot key.

Defined results: doc_id is an integer, or text that holds one (it is cast to long); no words (or null text) give an empty set, linked with nothing; under ``WIDTH`` words
the whole sequence is one shingle; rows of equal doc_id are documents of their own; a null doc_id
comes after all others; texts of any length are used whole; ``dedup`` keeps other columns, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, discard, met, saved
from .hashing import mixed, powers
from .portions import BUCKET, ROUND, SCHEMA, Answers, Exchange, Numbers, Row, batches_of, by_key, by_span, give_back, mapped, measured, meet, meet_spans, packed, portions, restored, rows_of, runs_of, span_of, tally, unpacked

WIDTH, PERCENT, MEMBERS, TOKENS, PARTNERS, BLOCK = 5, 75, 64, 64_000, 32, 512
#: Tokens of groups in a span, and per bucket of tokens.
SPAN_TOKENS, BUCKET_TOKENS = 2 << 20, 4 << 20

_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(21).integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES = _BYTES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingles(text: bytes, sizes: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each of the texts that ``text`` holds one after the other."""
    data = np.frombuffer(text, np.uint8)
    borders = np.concatenate(([0], np.cumsum(sizes)))
    word = ~_SPACE[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = borders[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    w = mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, borders)
    n = len(w) - WIDTH + 1
    all_ = mixed(sum(w[k : k + n] * _FACTORS[k] for k in range(WIDTH))) if n > 0 else w[:0]
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= WIDTH:
            out.append(np.unique(all_[lo : hi - WIDTH + 1]))
        elif hi > lo:
            out.append(mixed((w[lo:hi] * _FACTORS[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _FACTORS[WIDTH:] * np.uint64(hi - lo)))
        else:
            out.append(w[:0])
    return out


def needed(n):
    """Tokens that a set of ``n`` shares with any that it links with, at least."""
    return -(-PERCENT * n // 100)


def limit(n, shared):
    """The largest set that a set of ``n`` can link with if at most ``shared`` of its tokens are in any other."""
    return (100 + PERCENT) * shared // PERCENT - n


def _prefix(tokens: np.ndarray) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - needed(n) + max(1, n // 8)] if n else tokens


def _sets(exchange: Exchange):
    """Per portion: (portion, 1, 0, (ids, nulls, sizes of sets, digests)); per span its questions, of kind 0."""

    def run(rows: Iterator[Row]) -> Iterator[Row]:
        for span, own in itertools.groupby(rows, key=lambda r: span_of(r[0])):
            asked = [(np.zeros(0, np.uint64), None, np.zeros(0, np.uint16))]
            for portion, _, _, blob in own:
                ids, nulls, sizes, text, _ = unpacked(blob)
                found = shingles(text, sizes)
                digests = [hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in found]
                yield (portion, 1, 0, packed(ids, nulls, np.array([len(x) for x in found], np.int64), digests))
                if some := [_prefix(x) for x in found if len(x)]:
                    asked.append(tally(np.concatenate(some)))
            keys, n = (np.concatenate([x[k] for x in asked]) for k in (0, 2))
            if len(keys):
                yield from exchange.ask(span, *tally(keys, n=n))

    return run


_SURVIVORS = "digest binary, near long, tokens binary"


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From portions, the places of sets that come first (kind 2) and counts: sets that could link."""
    for _, whole, portions_ in by_span(rows_of(batches)):
        answers = Answers(whole)
        for _, own in portions_:
            own = list(own)
            firsts = np.concatenate([np.frombuffer(r[3], np.int32) for r in own[1:]] or [np.zeros(0, np.int32)])
            if not len(firsts):
                continue
            _, _, sizes, text, _ = unpacked(own[0][3])
            found = shingles(text, sizes)
            out: list[tuple] = []
            for k in np.sort(firsts).tolist():
                mine = _prefix(found[k])
                again = mine[answers.of(mine)[0] > 1]
                if len(again) >= max(1, needed(len(found[k])) // 8):
                    # A small token that others have too brings similar sets together.
                    out.append((hashlib.blake2b(found[k], digest_size=16).digest(), int(again[0] >> np.uint64(1)), found[k].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], names=["digest", "near", "tokens"])


class Group:
    """Members (digests), their token union and bit matrix, sizes, and the local component of each."""

    def __init__(self, digests: list[bytes], sets: list[np.ndarray]):
        self.digests, self.size = digests, np.array([len(x) for x in sets], np.int64)
        self.union, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.bits = np.zeros((len(sets), len(self.union)), bool)
        self.bits[np.repeat(np.arange(len(sets)), self.size), at] = True
        self.part = np.arange(len(sets))
        own = self.bits.astype(np.float32)
        for i, j in np.argwhere(np.triu(linked(own @ own.T, self.size, self.size), 1)).tolist():
            a, b = self.part[i], self.part[j]
            if a != b:
                self.part[self.part == max(a, b)] = min(a, b)

    def pack(self) -> bytes:
        return packed(self.digests, self.size, self.union, np.packbits(self.bits, axis=1), self.part)

    @classmethod
    def read(cls, blob: bytes) -> Group:
        g = cls.__new__(cls)
        g.digests, g.size, g.union, bits, g.part = unpacked(blob)
        g.bits = np.unpackbits(bits, axis=1, count=len(g.union)).astype(bool)
        return g


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    overlap = np.rint(overlap).astype(np.int64)
    return (100 * overlap >= PERCENT * (a[:, None] + b[None, :] - overlap)) & (overlap > 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of neighbouring sets (sorted by what they have in common), numbered in spans."""
    numbers = Numbers(SPAN_TOKENS)

    def row(digests: list, sets: list, size: int) -> Row:
        return (numbers.next(size), 0, size, Group(digests, sets).pack())

    def rows():
        digests, sets, size = [], [], 0
        for b in batches:
            for d, x in zip(b["digest"].to_pylist(), b["tokens"]):
                tokens = np.frombuffer(x.as_py(), np.uint64)
                if sets and (len(sets) >= MEMBERS or size + len(tokens) > TOKENS):
                    yield row(digests, sets, size)
                    digests, sets, size = [], [], 0
                digests.append(d)
                sets.append(tokens)
                size += len(tokens)
        if sets:
            yield row(digests, sets, size)

    yield from batches_of(rows())


def _matrix(exchange: Exchange):
    """In how many groups of a span each token of theirs is."""

    def run(rows: Iterator[Row]) -> Iterator[Row]:
        for span, own in itertools.groupby(rows, key=lambda r: span_of(r[0])):
            yield from exchange.ask(span, *tally(np.concatenate([unpacked(r[3])[2] for r in own])))

    return run


def posted(g: Group, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens that open members post, and their local components, each pair once; the least size and the largest limit there."""
    order = np.lexsort((g.union, count))
    often = count > 1
    tokens, parts, sizes, limits = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
    for k, n in enumerate(g.size.tolist()):
        shared = int((g.bits[k] & often).sum())
        if shared < needed(n):
            continue
        mine = order[g.bits[k, order]][: n - needed(n) + 1]
        mine = mine[often[mine]]
        tokens.append(g.union[mine])
        parts.append(np.full(len(mine), g.part[k]))
        sizes += [n] * len(mine)
        limits += [limit(n, shared)] * len(mine)
    tokens, parts = np.concatenate(tokens), np.concatenate(parts)
    order = np.lexsort((parts, tokens))
    tokens, parts, sizes, limits = tokens[order], parts[order], np.array(sizes, np.int64)[order], np.array(limits, np.int64)[order]
    if not len(tokens):
        return tokens, parts, sizes, limits
    first = runs_of(tokens, parts)
    return tokens[first], parts[first], np.minimum.reduceat(sizes, first), np.maximum.reduceat(limits, first)


_POSTINGS = "token long, grp long, part long, size long, most long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the groups of each span post, given their counts."""
    for _, whole, groups in by_span(rows_of(batches)):
        answers = Answers(whole)
        for group, own in groups:
            g = Group.read(next(own)[3])
            tokens, parts, sizes, most = posted(g, answers.of(g.union)[0])
            columns = (tokens.view(np.int64), np.full(len(tokens), group), parts, sizes, most)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _POSTINGS.split(", ")])


_PAIRS = "a long, b long"


def _columns(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The columns of all rows of each value of ``key``; rows are sorted by it."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[int, dict[str, np.ndarray]]:
        rows = pa.Table.from_batches(held)
        held.clear()
        return rows[key][0].as_py(), {n: rows[n].to_numpy() for n in rows.column_names}

    for b in batches:
        if not b.num_rows:
            continue
        if held and b[key][0].as_py() != held[0][key][0].as_py():
            yield whole()
        for lo, hi in itertools.pairwise([*runs_of(b[key].to_numpy()).tolist(), b.num_rows]):
            if lo:
                yield whole()
            held.append(b.slice(lo, hi - lo))
    if held:
        yield whole()


def _blocks(most: int):
    """Blocks of at most ``most`` postings, sorted by token and label, of the tokens that have several labels.

    A run is what has one token and label; runs of a token are in the order of their least size. A block holds
    for each posting its token's first run, its own run, its group, size and limit. Rows by number
    of the block: kind 0, the block, for the pairs inside; kind 1, the block, if an
    earlier one shares a token with it; kind 2, a block that shares its last token, under another label, with
    the ``part`` blocks from that number on. Blocks without different labels, or whose sizes are beyond all limits, never come together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(itertools.chain.from_iterable(dealt(bucket, c) for bucket, c in _columns(batches, "bucket")))

    def dealt(bucket: int, c: dict[str, np.ndarray]) -> Iterator[Row]:
        order = np.lexsort((c["label"], c["token"]))
        token, group, label, size, limits = (c[n][order] for n in ("token", "grp", "label", "size", "most"))
        # Who is beyond the limits of all others of a token, or allows none of their sizes, has no partner there.
        of = np.repeat(np.arange(len(cuts := runs_of(token))), np.diff(np.append(cuts, len(token))))
        fits = (size <= np.maximum.reduceat(limits, cuts)[of]) & (limits >= np.minimum.reduceat(size, cuts)[of])
        token, group, label, size, limits = (x[fits] for x in (token, group, label, size, limits))
        if not len(token):
            return
        cuts = runs_of(token)
        ends = np.append(cuts[1:], len(token))
        several = np.repeat(label[cuts] != label[ends - 1], ends - cuts)
        token, group, label, size, limits = (x[several] for x in (token, group, label, size, limits))
        if not len(token):
            return
        cuts = runs_of(token, label)
        least = np.repeat(np.minimum.reduceat(size, cuts), np.diff(np.append(cuts, len(token))))
        order = np.lexsort((group, label, least, token))
        token, group, label, size, limits, least = (x[order] for x in (token, group, label, size, limits, least))
        new = np.zeros(len(token), np.int64)
        new[runs_of(token, label)] = 1
        runs, cuts = np.cumsum(new), runs_of(token)
        starts = np.repeat(runs[cuts], np.diff(np.append(cuts, len(token))))
        wanted: set[int] = set()
        for k, lo in enumerate(range(0, len(token), most)):
            hi, id_ = min(lo + most, len(token)), (bucket << 32) + k
            blob = packed(*(x[lo:hi] for x in (starts, runs, group, size, limits)))
            # Postings of the last token under labels after the block's first one for it, as far as a limit reaches.
            own = max(lo, int(np.searchsorted(starts, starts[hi - 1])))
            begin = max(hi, int(np.searchsorted(runs, runs[own], "right")))
            end = int(np.searchsorted(starts, starts[hi - 1], "right"))
            end = begin + int(np.searchsorted(least[begin:end], limits[own:hi].max(), "right"))
            if runs[lo] < runs[hi - 1]:
                yield (id_, 0, 0, blob)
            if k in wanted:
                yield (id_, 1, 0, blob)
            if begin < end:
                wanted.update(range(begin // most, (end - 1) // most + 1))
                yield ((bucket << 32) + begin // most, 2, (end - 1) // most + 1 - begin // most, blob)
            wanted.discard(k)

    return run


def crossing(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of groups, the larger first, that post a token under different labels, in block ``a`` under the earlier, and allow each other's sizes."""
    starts, runs, group, size, limits = b
    lo, hi = np.searchsorted(a[1], starts), np.searchsorted(a[1], runs)
    n = hi - lo
    i, j = np.arange(n.sum()) - np.repeat(n.cumsum() - n - lo, n), np.repeat(np.arange(len(group)), n)
    fits = (size[j] <= a[4][i]) & (a[3][i] <= limits[j])
    x, y = a[2][i[fits]], group[j[fits]]
    found = np.unique(np.stack((np.maximum(x, y), np.minimum(x, y)))[:, x != y], axis=1)
    return found[0], found[1]


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups from blocks that came together."""
    for _, own in by_key(rows_of(batches)):
        later = None
        for _, kind, _, blob in own:
            block = unpacked(blob)
            if kind == 1:
                later = block
            else:
                a, b = crossing(block, block if kind == 0 else later)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def mixing(postings: DataFrame, most: int, buckets: int = 1) -> DataFrame:
    """Saved: distinct pairs (a, b), a the larger, of groups that post a token under different labels and allow each other's sizes.

    ``postings``: token, grp, label, size, most.
    """
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket")
    blocks = saved(rows.mapInArrow(_blocks(most), SCHEMA), "blocks")
    goes = blocks.filter("kind = 2").select(F.explode(F.sequence("key", F.col("key") + F.col("part") - 1)).alias("key"), "kind", "part", "blob")
    made = saved(meet(blocks.filter("kind < 2"), goes).mapInArrow(_crossings, _PAIRS).distinct(), "crossings")
    discard(blocks)
    return made


def oriented(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the group of more partners as b: that one is sent once for PARTNERS of the others."""
    many = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.join(many.withColumnRenamed("n", "m"), "a").join(many.withColumnRenamed("a", "b"), "b")
    swap = F.col("m") > F.col("n")
    return rows.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


_EDGES = "u binary, v binary"


def between(a: Group, b: Group) -> set[tuple[bytes, bytes]]:
    """Links between local components of two groups, by their first members."""
    _, i, j = np.intersect1d(a.union, b.union, assume_unique=True, return_indices=True)
    if not len(i):
        return set()
    x, y = a.bits[:, i], b.bits[:, j]
    # What a member has in common with the other group's union bounds its overlap with each member there.
    p, q = np.flatnonzero(x.sum(1) >= needed(a.size)), np.flatnonzero(y.sum(1) >= needed(b.size))
    if not len(p) or not len(q):
        return set()
    found = np.argwhere(linked(x[p].astype(np.float32) @ y[q].astype(np.float32).T, a.size[p], b.size[q]))
    return {(a.digests[a.part[p[m]]], b.digests[b.part[q[n]]]) for m, n in found.tolist()}


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the rows of a comparison: the common group (kind 1) and its partners (kind 2)."""
    for _, own in by_key(rows_of(batches)):
        common: dict[int, Group] = {}
        edges: set = set()
        for _, kind, _, blob in own:
            b, group = unpacked(blob)
            g = Group.read(group)
            if kind == 1:
                common[b] = g
            else:
                edges |= between(g, common[b])
        if edges:
            u, v = zip(*sorted(edges))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _sent(rows: Iterator[Row]) -> Iterator[Row]:
    """From a group and where it goes (kind 1: (comparison, kind, common group) packed): a row per comparison."""
    for _, own in by_key(rows):
        group = None
        for _, kind, role, blob in own:
            if kind == 0:
                group = blob
            else:
                to, b = np.frombuffer(blob, np.int64).tolist()
                yield (to, role, 0, packed(b, group))


def compare(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between the groups of ``pairs``; a group with many partners is compared in several places."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("places"))
    dealt = pairs.join(many, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), "places")).alias("place"))
    row = lambda key, role: (F.col(key).alias("key"), F.lit(1).alias("kind"), F.lit(role).alias("part"), _swapped("place", "b").alias("blob"))
    goes = dealt.select(*row("a", 2)).unionByName(dealt.select("b", "place").distinct().select(*row("b", 1)))
    return meet(mapped(meet(groups.withColumn("part", F.lit(0)), goes), _sent)).mapInArrow(_compared, _EDGES)


def _swapped(*columns: str):
    """Longs as one binary of little-endian words."""
    half = lambda c: [F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * k, 2) for k in range(8)]
    return F.unhex(F.concat(*[x for c in columns for x in half(c)]))


def components(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes of ``edges`` (u, v): alternating stars."""
    edges = saved(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours go to the smallest neighbour.
        both = edges.union(edges.select("v", "u"))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.lit(1)).alias("n")), "stars")
        large = saved(met(both, low, ["u"], 2 * edges.count(), heavy).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.filter("u != low").select("u", "low")).distinct(), "edges")
        # Small star: smaller neighbours and the node itself go to the smallest one.
        lower = saved(large.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")), "stars")
        small = met(large, lower, ["u"], large.count(), heavy).filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(lower.select("u", "low")).distinct()
        new = saved(small, "edges")
        discard(low, large, lower)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            discard(edges)
            return new.select(F.col("u").alias("node"), F.col("v").alias("label")).union(new.select("v", "v").distinct())
        discard(edges)
        edges = new


def _rows(schema: str, make):
    """A map over exchange rows that gives lists of columns."""
    fields = T._parse_datatype_string(schema)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(make(r), types)], names=fields.names)

    return run


def _documents(r: Row) -> list:
    ids, nulls, sizes, digests = unpacked(r[3])
    return [[r[0]] * len(ids), list(range(len(ids))), [None if n else i for i, n in zip(ids.tolist(), nulls.tolist())], sizes.tolist(), digests]


def _nodes(r: Row) -> list:
    digests, _, _, _, part = unpacked(r[3])
    return [[r[0]] * len(part), part.tolist(), digests, [digests[p] for p in part.tolist()]]


def classes(docs: DataFrame, keep: tuple[str, ...] = (), bucket: int = BUCKET, most: int = ROUND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Portions of ``docs``; per document portion, place, doc_id, n_shingles, digest (null: no words); per digest the first document, n and component (a digest)."""
    all_ = portions(docs, keep=keep)
    exchange = Exchange(*measured(all_), bucket, most)
    asked = saved(mapped(all_, _sets(exchange)), "sets")
    documents = saved(asked.filter("kind = 1").mapInArrow(_rows(s := "portion long, place int, doc_id long, n_shingles long, digest binary", _documents), s), "documents")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "portion", "place")).alias("first")
    distinct = saved(documents.filter("digest IS NOT NULL").groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")), "distinct")
    firsts = distinct.groupBy(F.col("first.portion").alias("key")).agg(F.array_join(F.collect_list(F.hex(_le32(F.col("first.place")))), "").alias("x"))
    firsts = firsts.select("key", F.lit(2).alias("kind"), F.lit(0).alias("part"), F.unhex("x").alias("blob"))
    sets = saved(meet_spans(all_, exchange.counted(asked.filter("kind = 0")), firsts).mapInArrow(_survivors, _SURVIVORS), "survivors")
    discard(asked)
    # A token that very many sets have in common is split, so that no task gets them all.
    much = saved(sets.groupBy("near").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.ceil(F.col("n") / (MEMBERS * 4))), "near")
    dealt = met(sets, much, ["near"], sets.count()).select("digest", "tokens", F.col("near").alias("a"), F.pmod(F.xxhash64("digest"), "split").alias("b"))
    ordered = dealt.repartition("a", "b").sortWithinPartitions("a", "b", "digest").select("digest", "tokens")
    groups = saved(ordered.mapInArrow(_groups, SCHEMA), "groups")
    discard(sets, much)
    matrix = Exchange(*measured(groups), max(1, bucket * BUCKET_TOKENS // BUCKET), most)
    posts = saved(meet_spans(groups, matrix.counted(mapped(groups, _matrix(matrix)))).mapInArrow(_postings, _POSTINGS), "postings")
    nodes = saved(groups.mapInArrow(_rows(s := "grp long, part long, digest binary, node binary", _nodes), s), "nodes")
    # First round: each group that posted a token with the token's first group.
    to = saved(posts.groupBy("token").agg(F.min("grp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "tokens")
    pairs = saved(met(posts.select("token", F.col("grp").alias("a")), to, ["token"], posts.count()).filter("a != b").select("a", "b").distinct(), "pairs")
    edges = saved(compare(groups, pairs), "links")
    labels = saved(components(edges), "labels")
    # Second round: what still meets in different components and hasn't been compared.
    known = nodes.select("grp", "part", "node").distinct().join(labels, "node", "left").select("grp", "part", F.xxhash64(F.coalesce("label", "node")).alias("label"))
    crossings = mixing(posts.join(known, ["grp", "part"]), BLOCK, matrix.buckets)
    more = saved(oriented(crossings.join(pairs, ["a", "b"], "left_anti")), "pairs")
    discard(posts, to, pairs, crossings)
    if not more.isEmpty():
        discard(labels)
        labels = saved(components(edges.union(compare(groups, more))), "labels")
    found = distinct.join(nodes.select("digest", "node"), "digest", "left").join(labels, "node", "left")
    found = saved(found.select("digest", "first", "n", F.coalesce("label", "node", "digest").alias("component")), "components")
    discard(groups, edges, more, distinct, nodes, labels)
    return all_, documents, found


def _le32(c):
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), 7 - 2 * k, 2) for k in range(4)]))


def join(docs: DataFrame, bucket: int = BUCKET, most: int = ROUND, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text)."""
    all_, documents, found = classes(docs, (), bucket, most)
    discard(all_)
    least = saved(found.groupBy("component").agg(F.min("first.doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    # Of each text the least doc_id of its component, and how many rows have the text.
    texts = met(found.select("digest", "component", F.col("n").alias("copies")), least, ["component"], found.count(), heavy)
    texts = saved(texts.select("digest", "component_id", F.col("copies").alias("n")), "texts")
    discard(found, least)
    with_words = met(documents, texts, ["digest"], documents.count(), heavy)
    alone = documents.filter("digest IS NULL").withColumn("component_id", F.col("doc_id"))
    return with_words.unionByName(alone).select("doc_id", "n_shingles", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those linked, directly or not, with one of smaller doc_id; all columns stay."""
    names = docs.columns
    all_, documents, found = classes(docs, tuple(names))
    kept = found.groupBy("component").agg(F.min("first").alias("x")).select("x.portion", "x.place")
    kept = kept.union(documents.filter("digest IS NULL").select("portion", "place"))
    places = kept.groupBy(F.col("portion").alias("key")).agg(F.array_join(F.collect_list(F.hex(_le32(F.col("place")))), "").alias("x"))
    places = places.select("key", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.unhex("x").alias("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_key(rows_of(batches)):
            own = list(own)
            if len(own) > 1:
                rows = np.sort(np.concatenate([np.frombuffer(r[3], np.int32) for r in own[1:]]))
                yield from restored(unpacked(own[0][3]), names).take(pa.array(rows)).to_batches()
        give_back()

    return meet(all_, places).mapInArrow(run, docs.schema)
