"""Best-fit packing: documents' tokens into sequences of fixed length by a grouping genetic algorithm.

``tokenized`` cuts each document's ids into pieces. ``pack`` deals the pieces into shards of about
``SHARD`` pieces. Each shard is worked on by islands, populations of whole packings that begin with best fit
in random order. A child is made by injecting well-filled bins of one parent into the other, removing the bins that
then hold a piece twice and those with most room, and placing the displaced pieces by best fit. An island goes on
until no packing can have fewer bins or ``patience`` children in a row are no better than the best. Between epochs it
sends its best packing to the next island (a shuffle of one row per island). The best packing of a shard wins; its
badly filled bins are opened and their pieces of all shards go through the same again, until they
fit in one shard or opening doesn't help. Shards are of bounded size at any scale, and nothing is collected.

Defined results: null text is empty and is one piece of one token (the end mark); repeated rows are
packed each for itself; control strings of the tokenizer in a text are single tokens, exactly as spelled; other columns
are ignored by ``tokenized`` and kept by ``pack``; an empty table gives no rows; texts of any length
are cut into pieces of ``CAPACITY`` tokens, of which only the last may be shorter; doc_id may be null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, saved, scratch

CAPACITY, END, SHARD, WORDS, PORTION = 2048, 0, 4096, 1_000_000, 8 << 20
MARK = "\x00"

_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases and never joins across white space; words are cached.

    The cache is columnar: an Arrow array of words, and the ids of all of them one after the other.
    Control strings that the tokenizer declares get their own ids, as in the library: as they are spelled, before
    lower-casing. Words that hold one are encoded each for itself.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel already
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # a lower-cased word may look like a control string
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        [self.mark] = self._plain([MARK])
        self.forget()

    @classmethod
    def of(cls, definition: str) -> WordTokenizer:
        """One per worker process and definition."""
        key = f"{len(definition)}:{zlib.crc32(definition.encode())}"
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = cls(definition)
        return _TOKENIZERS[key]

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _holds(self, texts: pa.Array) -> np.ndarray:
        """Which of ``texts`` hold a control string."""
        found = np.zeros(len(texts), bool)
        for x in self.controls:
            found |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return found

    def _controlled(self, words: list[str]) -> list[np.ndarray]:
        """Ids of ``words`` with control strings."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self._plain(words)
        finally:
            self.tokenizer.encode_special_tokens = True

    def learn(self, words: pa.Array) -> None:
        """Put ids of ``words`` (distinct, unknown, no ASCII white space inside) into the cache, many in one call."""
        marked = pc.match_substring(words, MARK) if len(self.mark) == 1 else pa.array(np.ones(len(words), bool))
        alone, plain = words.filter(marked), words.filter(pc.invert(marked))
        ids, sizes = [self.ids], [np.diff(self.ends)]
        if len(plain):
            starts = pa.array([*range(0, len(plain), 4096), len(plain)], pa.int32())
            for joined in pc.binary_join(pa.ListArray.from_arrays(starts, plain), f" {MARK} ").to_pylist():
                [got] = self._plain([joined])
                is_mark = got == self.mark[0]
                ids.append(got[~is_mark])
                sizes.append(np.diff(np.concatenate(([-1], np.flatnonzero(is_mark), [len(got)]))) - 1)
        for got in self._plain(alone.to_pylist()):
            ids.append(got)
            sizes.append(np.array([len(got)]))
        self.known = pa.concat_arrays([self.known, plain, alone])
        self.ids, self.ends = np.concatenate(ids), np.concatenate(([0], np.concatenate(sizes).cumsum()))

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each of ``words`` in the cache; unknown ones are learned."""
        if len(self.known) > WORDS:
            self.forget()
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            unknown, before = words.filter(pc.is_null(at)), len(self.known)
            self.learn(pc.unique(unknown))
            at = pc.replace_with_mask(at, pc.is_null(at), pc.add(pc.index_in(unknown, value_set=self.known.slice(before)), pa.scalar(before, pa.int32())))
        return at.to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and the borders between the texts."""
        texts = pc.fill_null(texts, "")
        special = self._holds(texts).any()
        split = pc.ascii_split_whitespace(texts if special else pc.ascii_lower(texts))
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        coded = split.flatten().dictionary_encode()
        # A single comma or full stop after a letter or digit is a word of its own.
        words = coded.dictionary
        if special:
            held = np.flatnonzero(self._holds(words))
            own = self._controlled(words.take(pa.array(held)).to_pylist())
            words = pc.ascii_lower(words)
        ends = pc.match_substring_regex(words, "[a-z0-9][,.]$")
        stems = pc.if_else(ends, pc.utf8_slice_codeunits(words, 0, -1), words)
        tails = pc.if_else(ends, pc.utf8_slice_codeunits(words, -1), "")
        found = self.find(pa.concat_arrays([stems, tails]))
        size, index = np.diff(self.ends)[found], coded.indices.to_numpy()
        # The ids of each word of the dictionary, one after the other; then those of each word of the texts.
        flat = self.ids[_ranges(self.ends[found].reshape(2, -1).T.ravel(), size.reshape(2, -1).T.ravel())]
        size = size.reshape(2, -1).sum(axis=0)
        if special:
            parts = np.split(flat, size.cumsum()[:-1])
            for k, x in zip(held.tolist(), own):
                parts[k] = x
            flat, size = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        sizes = size[index]
        ids = flat[_ranges((size.cumsum() - size)[index], sizes)]
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.concatenate(([0], sizes.cumsum()))[borders]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of ranges of ``sizes`` from ``starts``, one after the other."""
    ends = sizes.cumsum()
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of ``docs`` (doc_id, text)."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: of fixed size
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(shared.value)
        for b in batches:
            texts, at = b["text"], 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            portion = (np.cumsum(sizes) - sizes) // PORTION
            while at < len(texts):
                stop = int(np.searchsorted(portion, portion[at], "right"))
                ids, borders = tokenizer.encode(texts.slice(at, stop - at))
                rows: list = [[], [], [], [], []]
                for k in range(stop - at):
                    own = np.append(ids[borders[k] : borders[k + 1]], np.uint32(END)).astype("<u4")
                    for p in range(0, len(own), capacity):
                        piece = own[p : p + capacity]
                        for column, value in zip(rows, (at + k, p // capacity, p, len(piece), zlib.crc32(piece.tobytes()))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows[0], pa.int64())), *(pa.array(x, t) for x, t in zip(rows[1:], kinds[1:]))], names=names)
                at = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by room left; finds the fullest bin into which a piece goes."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.mask, self.n = capacity, [[] for _ in range(capacity + 1)], 0, 0

    def add(self, bin_: int, room: int) -> None:
        self.open[room].append(bin_)
        self.mask |= 1 << room

    def place(self, length: int) -> int:
        fits = self.mask >> length
        if not fits:
            bin_, room = self.n, self.capacity
            self.n += 1
        else:
            room = length + ((fits & -fits).bit_length() - 1)
            bin_ = self.open[room].pop()
            if not self.open[room]:
                self.mask &= ~(1 << room)
        self.add(bin_, room - length)
        return bin_


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: Bins, into: np.ndarray) -> None:
    """Place the pieces ``order`` one after the other; ``into`` gets their bins."""
    place, sizes = bins.place, lengths.tolist()
    for i in order.tolist():
        into[i] = place(sizes[i])


def least(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins."""
    return -(-int(lengths.sum()) // capacity)


def fitness(lengths: np.ndarray, packing: np.ndarray, capacity: int) -> float:
    """Mean of squared fill, less the bins: fewer bins come first, then unequal ones (room lies together)."""
    fill = np.bincount(packing, lengths) / capacity
    return float((fill**2).sum() / max(1, len(fill))) - len(fill)


def first(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit in random order."""
    packing = np.empty(len(lengths), np.int64)
    best_fit(lengths, rng.permutation(len(lengths)), Bins(capacity), packing)
    return packing


def crossed(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: some well-filled bins of the father, the mother's bins without a piece of those, and the rest by best fit."""
    fill = np.bincount(father, lengths)
    good = np.flatnonzero(fill >= capacity * rng.choice((1.0, 0.998, 0.98)))
    good = good[rng.random(len(good)) < rng.choice((0.02, 0.1, 0.4))]
    chosen = np.zeros(len(fill), bool)
    chosen[good] = True
    injected = chosen[father]
    # Bins of the mother that hold an injected piece go; so do those with most room, and at random some full ones.
    room = capacity - np.bincount(mother, lengths)
    gone = rng.random(len(room)) < np.where(room > 0, rng.choice((0.1, 0.5)), rng.choice((0.0, 0.01, 0.1)))
    gone |= room >= np.sort(room)[-min(len(room), 3)]
    gone[mother[injected]] = True
    stays = ~gone[mother] & ~injected
    child = np.full(len(lengths), -1, np.int64)
    names = np.cumsum(~gone) - 1
    child[stays] = names[mother[stays]]
    bins = Bins(capacity)
    bins.n = int((~gone).sum())
    fresh = np.cumsum(chosen) - 1 + bins.n
    child[injected] = fresh[father[injected]]
    bins.n += len(good)
    displaced = np.flatnonzero(child < 0)
    smallest = lengths[displaced].min(initial=capacity)
    for own, left in ((names[~gone], room[~gone]), (fresh[good], capacity - fill[good])):
        takes = left >= smallest
        for bin_, space in zip(own[takes].tolist(), left[takes].astype(np.int64).tolist()):
            bins.add(bin_, space)
    # Long pieces first, more or less.
    blur = 1 + rng.choice((0.0, 0.0, 0.05, 0.3)) * rng.random(len(displaced))
    best_fit(lengths, displaced[np.argsort(-lengths[displaced] * blur, kind="stable")], bins, child)
    return child


def evolve(lengths: np.ndarray, people: list[np.ndarray], capacity: int, patience: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``people`` after children that replace the worst where they are better. The best comes first.

    It ends when no packing can have fewer bins, or after ``patience`` children without one that is better than all.
    """
    rated = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    bound, idle, n = least(lengths, capacity), 0, len(people)
    while idle < patience and int(rated[0][2].max(initial=-1)) + 1 > bound:
        a, b = rng.choice(len(rated), 2, replace=len(rated) < 2)
        child = crossed(lengths, rated[a][2], rated[b][2], capacity, rng)
        value = fitness(lengths, child, capacity)
        idle = 0 if value > rated[0][0] else idle + 1
        if value > rated[-1][0] and all(value != r[0] for r in rated):
            rated[-1] = value, n, child
            rated.sort(reverse=True)
            n += 1
    return [p for *_, p in rated]


_ISLAND = "shard long, island int, items binary, lengths binary, people array<binary>, elite binary, fit double"
_KINDS = {"shard": pa.int64(), "island": pa.int32(), "items": pa.binary(), "lengths": pa.binary(), "people": pa.list_(pa.binary()), "elite": pa.binary(), "fit": pa.float64()}


def _ints(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64)


def _bytes(x: np.ndarray, kind: str = "<i4") -> bytes:
    return x.astype(kind).tobytes()


def _island(shard: int, island: int, items: bytes, lengths: bytes, people: list[np.ndarray], capacity: int, patience: int, rng: np.random.Generator) -> pa.RecordBatch:
    sizes = _ints(lengths)
    people = evolve(sizes, people, capacity, patience, rng)
    values = [shard, island, items, lengths, [_bytes(p) for p in people], _bytes(people[0]), fitness(sizes, people[0], capacity)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS.values())], names=list(_KINDS))


def _round(spark, items: DataFrame, n: int, capacity: int, islands: int, epochs: int, people: int, patience: int, seed: int) -> DataFrame:
    """item, length, shard, bin, offset and room (of the bin) for ``items`` (item, length)."""
    shards = max(1, -(-n // SHARD))
    dealt = items.groupBy(F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("x"))
    rows = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.item").alias("items"), F.col("x.length").alias("lengths"))
    spread = max(1, min(shards * islands, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def chance(shard: int, island: int, epoch: int) -> np.random.Generator:
        return np.random.default_rng((seed, epoch, shard, island))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, island = b["shard"][k].as_py(), b["island"][k].as_py()
                own, sizes = (b[c][k].values.to_numpy() for c in ("items", "lengths"))
                rng = chance(shard, island, 0)
                yield _island(shard, island, _bytes(own, "<i8"), _bytes(sizes), [first(sizes, capacity, rng) for _ in range(people)], capacity, patience, rng)

    def continued(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    # The migrant takes the place of the worst.
                    crowd = [_ints(p) for p in [*r["people"][: max(0, people - 1)], r["migrant"]]]
                    yield _island(r["shard"], r["island"], r["items"], r["lengths"], crowd, capacity, patience, chance(r["shard"], r["island"], epoch))

        return run

    rows = rows.repartition(spread, "shard", "island").mapInArrow(settled, _ISLAND)
    for epoch in range(1, epochs):
        done = saved(rows, "islands")
        elite = done.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("migrant"))
        rows = done.select("shard", "island", "items", "lengths", "people").join(elite, ["shard", "island"]).mapInArrow(continued(epoch), _ISLAND)
    best = rows.groupBy("shard").agg(F.max_by(F.struct("items", "lengths", "elite"), F.struct("fit", -F.col("island"))).alias("b")).select("shard", "b.*")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lengths, bins = _ints(r["lengths"]), _ints(r["elite"])
                order = np.argsort(bins, kind="stable")
                ends = lengths[order].cumsum()
                fill = np.bincount(bins, lengths).astype(np.int64)
                offset = np.empty(len(bins), np.int64)
                offset[order] = ends - lengths[order] - (fill.cumsum() - fill)[bins[order]]
                arrays = [_ints(r["items"], "<i8"), lengths, np.full(len(bins), r["shard"]), bins, offset, capacity - fill[bins]]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["item", "length", "shard", "bin", "offset", "room"])

    return best.mapInArrow(laid, "item long, length long, shard long, bin long, offset long, room long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = 2, epochs: int = 3, people: int = 4, patience: int = 40, rounds: int = 16) -> DataFrame:
    """``pieces`` (with a column length, at most ``capacity``) with the columns sequence_id and offset (replaced, if there are such)."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    item, placed_item = fresh(pieces, "item", "placed")
    pieces = saved(pieces.withColumn(item, F.monotonically_increasing_id()), "pieces")
    names = pieces.columns[:-1]
    short = pieces.select(F.col(item).alias("item"), F.col("length").cast("long").alias("length"))
    placed = short.filter(F.col("length") >= capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, used = short.filter(F.col("length") < capacity), []
    for k in range(rounds):
        n = left.count()
        with scratch():
            laid = saved(_round(spark, left, n, capacity, islands, epochs, people, patience, k), "packed")
        used.append(laid)
        # Bins that stay open by more than a hundredth are filled anew together with those of other shards, while that helps.
        opened = laid.filter(F.col("room") * 100 > capacity)
        last = n <= SHARD or k == rounds - 1 or 2 * opened.count() > n
        good = laid if last else laid.filter(F.col("room") * 100 <= capacity)
        placed = placed.union(good.select("item", (F.lit(k << 56) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        left = opened.select("item", "length")
    placed = placed.withColumnRenamed("item", placed_item)
    return pieces.join(placed, pieces[item] == placed[placed_item]).select(*map(quoted, names), "sequence_id", "offset")
