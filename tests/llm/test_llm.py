"""The ten operators against brute force, round trips and held-out data, with the edge cases of each."""

import hashlib
import os
import random
import re
import tempfile
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bagwright.llm import bpe, chat, extraction, induced, jaccard, langid, lines, media, packing, portions, quality, queries, suffix

#: Extra columns with names that the operators use themselves.
CLASHES = [*("1 AS " + n for n in "key kind part id _id _text _null null kept0 of lost kept gone places digest line lines more n item offset sequence_id shard row host".split()), "cast('x' as binary) AS blob", "0 AS n_removed", "1.5D AS score"]
WORDS = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("", "n", "st")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=5):
    """(doc_id, text, source, lang): copies, near copies, shared passages and lines, nulls, empties, a long text."""
    rng = random.Random(seed)
    base, passage, line = prose(rng, 120), prose(rng, 60), "Subscribe to our letter now"
    texts = [base, base, passage + " " + prose(rng, 30), prose(rng, 40) + " " + passage, None, "", "   ", "ab", "one two", "one two", "aaaa" * 200, "ab" * 300, prose(rng, 4000), "ü€𝄞 " * 60]
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    for _ in range(14):
        texts.append("\n".join([prose(rng, 25), line, prose(rng, 12)]))
    rows = [(i, t, f"s{i % 13}", ("en", "fr")[i % 2]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns have names that the operators use themselves.
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string, lang string")
    return df.selectExpr("*", *CLASHES).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|> \\1 \\"), (1, 1, "assistant", "a<|im_start|>b\n"), (1, 1, "assistant", "a<|im_start|>b\n"), (2, 0, None, None), (None, 3, "assistant", "x"), (3, None, "system", "s"), (3, 70, "user", "u\n\nv"), (3, 200, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS turns", "2 AS block")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    for c in (1, 2, 3, None):
        want = sorted(((t is not None, t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: (v[0], v[1] or 0, v[2], v[3]))
        assert [(t.role, t.text) for t in out[c].turns] == [w[2:] for w in want]
        assert out[c].loss_text == "".join(w[3] for w in want if w[2] == "assistant")
        assert "".join(s.text for s in out[c].segments) == out[c].formatted
    assert out[3].valid and not out[1].valid and out[2].end_state == "error"
    assert chat.format_chat(turns.filter("false")).count() == 0


def test_bpe_matches_library(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, tokens = bpe.compiled(ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    hard = ["", " ", "\n\n  x", "don't <|endoftext|>", "x" * 3000, "ab" * 900] + ["".join(rng.choice("aeé \n1𝄞中'.-") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in hard:
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe._decoded(bpe.Utf8Machine(tokens), ids, 3) == text
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, text, *_ in corpus():
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})


def test_utf8_machine():
    rng = random.Random(1)
    parts = ["é".encode(), "€".encode(), "𝄞".encode(), b"a", b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf5", b"\xff", b"\x80"]
    for _ in range(3000):
        data = b"".join(rng.choice(parts)[: rng.choice((1, 2, 3, 4))] for _ in range(rng.randint(0, 8)))
        tokens, at = [], 0
        while at < len(data):
            n = rng.randint(1, 3)
            tokens.append(data[at : at + n])
            at += n
        machine = bpe.Utf8Machine(tokens)
        out = "".join([machine.feed([k]) for k in range(len(tokens))]) + machine.end()
        assert out == data.decode("utf-8", "replace")
        assert machine.feed(list(range(len(tokens)))) + machine.end() == out  # by the moves kept


class Bits:
    """A scan by hand: bits with stuffing."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def bytes(self):
        padded = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("sampling, components, restart", [((1, 1), 1, 0), ((2, 2), 3, 0), ((2, 1), 3, 2), ((1, 1), 3, 1), ((2, 2), 1, 3)])
def test_media_of_other_makers(sampling, components, restart):
    """Baseline files with several components, subsampling, AC values, with and without restarts."""
    rng = random.Random(components + restart)
    # DC: 12 codes of 4 bits; AC: end of block, 16 zeros, and (run, size) symbols, of 4 bits too.
    dc, ac = list(range(12)), [0x00, 0xF0, 0x01, 0x13, 0x52, 0x25, 0x08]
    h, v = sampling if components > 1 else (1, 1)
    across, down, step = 3, 2, 4
    levels, scan, units = {}, b"", 0
    bits, before = Bits(), [0] * components
    for y in range(down):
        for x in range(across):
            if restart and units and units % restart == 0:
                scan += bits.bytes() + bytes([0xFF, 0xD0 + (units // restart - 1) % 8])
                bits, before = Bits(), [0] * components
            units += 1
            for c in range(components):
                for k in range(h * v if c == 0 else 1):
                    value = rng.randint(-200, 200)
                    if c == 0:
                        levels[y * v + k // h, x * h + k % h] = value
                    diff, before[c] = value - before[c], value
                    bits.put(dc.index(abs(diff).bit_length()), 4)
                    bits.number(diff)
                    spot = 0
                    while spot < 63 and rng.random() < 0.7:
                        symbol = rng.choice(ac[1:])
                        if spot + (symbol >> 4) + 1 > 63:
                            break
                        spot += (symbol >> 4) + 1
                        bits.put(ac.index(symbol), 4)
                        bits.put(rng.getrandbits(symbol & 15) if symbol & 15 else 0, symbol & 15)
                    if spot < 63:
                        bits.put(0, 4)
    scan += bits.bytes()
    height, width = down * v * 8 - 3, across * h * 8 - 5
    parts = b"".join(bytes([c + 1, (sampling[0] << 4 | sampling[1]) if c == 0 else 0x11, 0]) for c in range(components))
    table = lambda kind, symbols: bytes([kind, 0, 0, 0, len(symbols), *[0] * 12, *symbols])
    data = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([step] * 64)) + media._segment(0xC0, bytes([8, 0, height, 0, width, components]) + parts)
    data += media._segment(0xC4, table(0, dc) + table(0x10, ac)) + (media._segment(0xDD, bytes([0, restart])) if restart else b"")
    data += media._segment(0xDA, bytes([components]) + b"".join(bytes([c + 1, 0]) for c in range(components)) + bytes([0, 63, 0])) + scan + b"\xff\xd9"
    [[(frame, picture)]] = media.thumbnails([data])
    assert (frame.width, frame.height) == (width, height)
    rows, columns = -(-height // 8), -(-width // 8)
    want = [[min(255, max(0, ((levels[y, x] * step + 4) >> 3) + 128)) for x in range(columns)] for y in range(rows)]
    assert picture.tolist() == want
    assert media.thumbnails([data[: -len(scan) - 2] + b"\xff\xd9"]) == [None]


def test_media_round_trip(docs, empty):
    got = {r.doc_id: r for r in media.features(media.store(docs)).collect()}
    for i, text, *_ in corpus():
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.features(media.store(empty)).count() == 0
    big = bytes(range(256)) * 3000  # several frames
    (frames,) = media.thumbnails(media.encode_many([media.padded(big)], [b"x"]))
    assert len(frames) > 1 and b"".join(p.tobytes() for _, p in frames) == big
    assert media.thumbnails([b"", b"\xff\xd8nonsense"]) == [None, None]


@pytest.mark.parametrize("names", [4096, 2])
def test_suffix_clusters(names, monkeypatch):
    monkeypatch.setattr(induced, "NAMES", names)
    rng = random.Random(names)
    for _ in range(150):
        letters = rng.choice((b"a", b"ab", b"abcdefgh", bytes([0, 1, 254])))
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 20, 60)))) for _ in range(rng.randint(1, 6))]
        depth, text, chosen = rng.choice((3, 8, 10)), [0], []
        for s in strings:
            chosen += range(len(text), max(len(text), len(text) + len(s) - depth + 1))
            text += [b + 1 for b in s] + [0]
        text, number, groups = np.array(text + [0] * 16, np.uint8), -1, defaultdict(set)
        if not chosen:
            continue
        begins = [c for c in chosen if c - 1 not in chosen]
        widths = [next(n for n in range(1, len(chosen) + 1) if c + n not in chosen) for c in begins]
        with tempfile.TemporaryDirectory() as folder:  # recursion to the end, and queues in files
            for at, of, new in induced.clusters(text, np.array(begins), np.array(widths), depth, induced.Room(folder, rng.choice((64, 1 << 20)), rng.choice((1, 3, 1 << 20)))):
                assert all(begins[k] <= a < begins[k] + widths[k] for a, k in zip(at.tolist(), of.tolist()))
                for a, n in zip(at.tolist(), new.tolist()):
                    number += n
                    groups[number].add(a)
        want = defaultdict(set)
        for a in chosen:
            want[text[a : a + depth].tobytes()].add(a)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_suffix_memory_is_bounded():
    """A text several times as large as what the sort may hold, with recursion and repeats."""
    rng = np.random.default_rng(1)
    contexts, size = [], 256
    for k in range(5000):
        own = rng.integers(97, 123, size).astype(np.uint8)
        contexts.append(contexts[rng.integers(0, k)] if k % 3 == 2 else own)
    text = np.concatenate([np.zeros(1, np.uint8), *(x for c in contexts for x in (c, np.zeros(1, np.uint8))), np.zeros(16, np.uint8)])
    starts, width, held = np.arange(len(contexts)) * (size + 1) + 1, size - 99, 1 << 18
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/text"
        text.tofile(path)
        mapped, widths = np.memmap(path, np.uint8, "r"), np.full(len(starts), width)
        tracemalloc.start()
        try:
            n = firsts = 0
            for at, _, new in induced.clusters(mapped, starts, widths, 100, induced.Room(folder, held)):
                n, firsts = n + len(at), firsts + int(new.sum())
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
    assert n == len(starts) * width and firsts == len({bytes(c) for c in contexts}) * width
    assert len(text) > 4 * held and peak < 4 * len(text), peak


def removed_by_hand(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = len(re.findall(b"\1+", gone.tobytes()))
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [8192, 2])
def test_suffix_dedup(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    want = removed_by_hand([r[:2] for r in corpus()])
    got = {r.doc_id: tuple(r)[1:] for r in suffix.removed(docs, base=8, held=1 << 10).collect()}
    assert got == {i: w[:4] for i, w in want.items()} and any(w[1] for w in want.values())
    if hot > 2:
        kept = suffix.dedup(docs)
        assert kept.columns == docs.columns
        texts = {r.doc_id: r.text for r in kept.collect()}
        assert texts == {i: None if t is None else want[i][4].decode("utf-8", "ignore") for i, t, *_ in corpus()}
        assert suffix.removed(empty).count() == 0 and suffix.dedup(empty).count() == 0


def test_suffix_nulls_and_repeated_rows(spark):
    text = prose(random.Random(9), 60)
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (2, text + "!")], "doc_id long, text string")
    n = len(text)
    assert sorted(((r.doc_id, r.n_removed) for r in suffix.removed(df).collect()), key=str) == sorted([(2, 0), (7, n), (7, n), (None, n)], key=str)


def test_lines(docs, empty):
    rows = corpus()
    normal = lambda x: " ".join(re.split(r"[\t-\r ]+", x.lower())).strip()
    spread, keeper = defaultdict(set), {}
    for i, text, source, _ in rows:
        for x in (text or "").split("\n"):
            if normal(x):
                spread[normal(x)].add(source)
                keeper[normal(x)] = min(i, keeper.get(normal(x), i))
    gone = {x for x, s in spread.items() if len(s) >= 10}
    assert gone
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {i: None if t is None else "\n".join(x for x in t.split("\n") if normal(x) not in gone or keeper[normal(x)] == i) for i, t, *_ in rows}
    assert lines.dedup_lines(empty).count() == 0


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("members, bucket, most, heavy", [(64, 32 << 20, 512, 200_000), (2, 1 << 10, 2, 3)])
def test_jaccard(docs, empty, members, bucket, most, heavy, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "PARTNERS", members)
    sets = {i: shingle_set(t) for i, t, *_ in corpus()}
    label = {i: i for i in sets}
    for _ in sets:  # propagate to the end
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, bucket, most, heavy).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    if members > 2:
        kept = jaccard.dedup(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in label if label[i] == i)
        assert jaccard.join(empty).count() == 0 and jaccard.dedup(empty).count() == 0


def postings(rows):
    """A bucket of postings from (group, tokens, labels, sizes, limits)."""
    flat = [(0, t, g, x, n, m) for g, *own in rows for t, x, n, m in zip(*own)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["bucket", "token", "grp", "label", "size", "most"])


@pytest.mark.parametrize("most", [1, 3, 512])
def test_jaccard_meets_across_components_only(spark, most):
    rng = random.Random(most)
    rows = []
    for g in range(40):
        own = {(rng.choice((5, 6, 6, 6, 9)), rng.randint(0, 2)) for _ in range(2)}
        sizes = [rng.randint(5, 12) for _ in own]
        rows.append((g, *zip(*own), sizes, [rng.randint(4, 14) for _ in own]))
    want = set()
    for a, *own in rows:
        for b, *other in rows:
            if a > b and any(t == u and x != y and n <= k and m <= i for t, x, n, i in zip(*own) for u, y, m, k in zip(*other)):
                want.add((a, b))
    frame = spark.createDataFrame(pa.Table.from_batches([postings(rows)]).to_pandas()).drop("bucket")
    made = jaccard.mixing(frame.repartition(3), most)
    assert sorted((r.a, r.b) for r in made.collect()) == sorted(want) and len(want) > 50


def crossed(rows, most=512):
    """Index pairs that blocks of these postings form, the pairs found, and how many blocks come together."""
    out = [r for batch in jaccard._blocks(most)(iter([postings(rows)])) for r in jaccard.rows_of([batch])]
    blocks = [(key, kind, part, jaccard.unpacked(blob)) for key, kind, part, blob in out]
    later = {key: b for key, kind, _, b in blocks if kind == 1}
    together = [(b, b) for _, kind, _, b in blocks if kind == 0] + [(b, later[key + k]) for key, kind, part, b in blocks if kind == 2 for k in range(part)]
    formed, pairs = 0, set()
    for a, b in together:
        x, y = jaccard.crossing(a, b)
        formed += len(x)
        pairs.update(zip(x.tolist(), y.tolist()))
    return formed, pairs, len(together)


def test_jaccard_large_family_and_one_outsider():
    n = 60_000  # all pairs of its groups would be 1.8e9
    formed, pairs, together = crossed([(g, [7], [int(g == 1234)], [100], [110]) for g in range(n)])
    assert formed == n - 1 and pairs == {(max(g, 1234), min(g, 1234)) for g in range(n) if g != 1234}
    assert together <= n // 512 + 1


def test_jaccard_family_that_cannot_link():
    # 80 % in common: nobody reaches another's size, whatever the number.
    groups = [jaccard.Group([bytes([k])], [np.unique(np.concatenate((np.arange(400), np.arange(100) + 1000 + 100 * k)).astype(np.uint64))]) for k in range(50)]
    count = np.bincount(np.concatenate([g.union for g in groups]).astype(np.int64))
    rows = []
    for k, g in enumerate(groups):
        tokens, parts, sizes, most = jaccard.posted(g, count[g.union.astype(np.int64)])
        assert len(tokens) and (sizes > most).all()
        rows.append((k, tokens.tolist(), [k] * len(tokens), sizes.tolist(), most.tolist()))
    assert crossed(rows) == (0, set(), 0)
    # Families whose sizes differ meet only where the sizes allow it.
    rows = [(k, [3], [k], [1000 + k], [1010 + k]) for k in range(20_000)]
    formed, pairs, together = crossed(rows)
    assert formed == len(pairs) == sum(min(10, 19_999 - k) for k in range(20_000)) and together < 100


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_jaccard_family_of_pages(spark, share):
    rng = random.Random(3)
    core, rows = [prose(rng, 9) for _ in range(60)], []
    for k in range(300):
        own = [f"own{k}x{j} " + prose(rng, 8) for j in range(round(60 / share) - 60)]
        lines_ = [*core, *own] if k % 2 else [*own, *core]
        rows.append((k, "\n".join(lines_)))
    got = [r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    sets = [shingle_set(t) for _, t in rows]
    n = len(sets[0] & sets[2])
    links = 100 * n >= 75 * (len(sets[0]) + len(sets[2]) - n)
    assert links == (share == 0.9) and len(set(got)) == (1 if links else 300)


@pytest.mark.parametrize("buckets, most", [(1, 512), (7, 512), (40, 4), (100, 1)])
def test_exchange_counts(spark, buckets, most):
    rng = np.random.default_rng(buckets)
    asked = {span << 12: rng.integers(0, 400, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for span in range(30)}
    values = {s: rng.integers(0, 2, 200).astype(np.uint64) for s in asked}
    exchange = portions.Exchange(buckets, 30, 1, most)
    assert exchange.buckets == buckets and (exchange.fan > 1) == (buckets > most)
    rows = [r for s in asked for r in exchange.ask(s, *portions.tally(asked[s], values[s]))]
    got = defaultdict(list)
    answers = exchange.counted(spark.createDataFrame(rows, portions.SCHEMA).repartition(5)).collect()
    for r in answers:
        got[r.key].append(tuple(r))
    number, kinds = Counter(x for k in asked.values() for x in k.tolist()), defaultdict(set)
    for s in asked:
        for k, v in zip(asked[s].tolist(), values[s].tolist()):
            kinds[k].add(v)
    for s, keys in asked.items():
        n, alike = portions.Answers(got[s]).of(keys)
        assert n.tolist() == [number[k] for k in keys.tolist()]
        assert all(a == (len(kinds[k]) == 1) for k, a in zip(keys.tolist(), alike.tolist()) if number[k] > 1)
    assert len(rows) + len(answers) <= exchange.rows(len(asked))


def test_exchange_rows_stay_in_proportion():
    most = 0
    for size in (1 << 29, 30 << 30, 1 << 40, 100 << 40):
        spans = -(-size // portions.SPAN)
        exchange = portions.Exchange(size, spans)
        each = exchange.rows(spans) / (size / portions.PORTION)
        assert exchange.buckets * portions.BUCKET >= size
        most = max(most, each)
    assert most <= 256  # rows for each portion of 1 MB


def test_jaccard_family_with_outsider(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "MEMBERS", 2)
    rng = random.Random(8)
    base = prose(rng, 160).split()
    texts = []
    for k in range(300):
        words = base[:]
        words[rng.randrange(160)] = f"own{k}"
        texts.append(" ".join(words))
    # Under the limit, and a chain that starts there.
    words = base[:130] + prose(rng, 40).split()
    texts += [" ".join(words), " ".join(words[:-3]), " ".join(prose(rng, 3).split() + words)]
    rows = list(enumerate(texts))
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert 1 < len(set(label)) < 4
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(label))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(20)]
    edges = spark.createDataFrame([(bytes([0, a]), bytes([0, b])) for a, b in pairs], "u binary, v binary")
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(99):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node[1]: r.label[1] for r in jaccard.components(edges).collect()} == label


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, text, *_ in corpus():
        text = text or ""
        words, seen, again = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
        for x in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                again += x in seen
                seen.add(x)
        n = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeat = {k + j for k in range(len(words) - 7) if n[tuple(words[k : k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeat))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeat) > 30 * len(words)) and not (r.kept and r.base_failed)
    assert quality.quality(empty).count() == 0


def test_quality_verdict(spark):
    rng, rows = random.Random(6), []
    for i in range(60):
        host, lines_ = (None, "a", "b")[i % 3], [prose(rng, 12), prose(rng, 12)]
        for line, odds in (("Read  more HERE today", 0.3), (f"all of {host} is one line", 0.9), ("sold everywhere but here seldom", 0.12), ("word " * 12 + str(host), 0.5)):
            if rng.random() < odds:
                lines_ += [line, " " + line.upper()]  # twice in one document, and normalised
        rows.append((i, "\n".join(lines_), host))
    rows += [(60, None, "a"), (60, prose(rng, 30), None)]
    share, least, depleted = 0.2, 3, 0.4
    size = Counter(h for _, _, h in rows)
    spread = Counter((h, x) for _, t, h in rows for x in {" ".join(x.lower().split()) for x in (t or "").split("\n")} - {""})
    common = {k for k, n in spread.items() if n > least and n > share * size[k[0]]}
    want = []
    for i, t, h in rows:
        gone = sum(len(x.split()) for x in (t or "").split("\n") if (h, " ".join(x.lower().split())) in common)
        want.append((i, gone, gone <= depleted * len((t or "").split())))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = quality.quality(df, share=share, least=least, depleted=depleted).collect()
    assert sorted((r.doc_id, r.removed_words) for r in got) == sorted(w[:2] for w in want)
    verdict = {(i, n): ok for i, n, ok in want}
    assert all(r.kept == (verdict[r.doc_id, r.removed_words] and not r.base_failed) for r in got)
    assert any(not r.kept and not r.base_failed for r in got)
    assert any(g and k for _, g, k in want) and any(not k for *_, k in want) and {h for h, _ in common} == {None, "a", "b"}


def test_html():
    model = extraction.trained()
    held = extraction.labelled_pages(150, seed=99)
    right = total = 0
    for found, labels in held:
        evidence = [float(model.weight[list(extraction.features(b, k, len(found)))].sum()) for k, b in enumerate(found)]
        right += sum(a == b for a, b in zip(extraction.decode(evidence, model), labels))
        total += len(labels)
    assert right >= 0.98 * total
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n words, here.<p>Second&nbsp;one.<br>More of it.</article><div class='comments'><p>I like it.</p></div><footer>&copy; me</footer></body>"
    assert extraction.main_text(page, model) == "A & B\n\nFirst bold words, here.\n\nSecond one. More of it."
    assert extraction.main_text("", model) == "" and extraction.main_text("<p", model) == ""


def test_html_pages():
    """All pages whose article holds headings, paragraphs and line breaks alone give exactly its text."""
    import html

    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    model, plain, total = extraction.trained(), 0, 0
    for page in pq.read_table(path).column("html").to_pylist():
        total += 1
        found = re.findall(r"<article[^>]*>(.*?)(?:</article>|\Z)", page or "", re.S)
        if len(found) != 1 or set(re.findall(r"<\s*/?\s*([a-z0-9]+)", found[0])) - {"h1", "p", "b", "br"}:
            continue
        plain += 1
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", found[0])]
        assert extraction.main_text(page, model) == "\n\n".join(filter(None, parts))
    assert total == 2500 and plain >= 2000, plain


def test_html_deep_pages():
    model, times = extraction.trained(), []
    for n in (4000, 40_000):
        began = time.time()
        extraction.main_text("<div class='x'>word " * n + "</i></td>" * n + "<li>item</li>" * n, model)
        times.append(time.time() - began)
    assert times[1] < 40 * times[0] and extraction._bucket.cache_info().maxsize and extraction._few_marks.cache_info().maxsize


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article><p>Some text is here.</p><p>And more, of course.</p></article>", 6)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extraction.extract(df).collect()}
    assert got == {1: ("u", "", 0), 2: (None, "Some text is here.\n\nAnd more, of course.", 40)}
    assert extraction.extract(df.filter("false")).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(3)
    sounds = {"en": "th the ing and of", "fr": "eau oui les ç que", "de": "sch ung ich ein ß"}
    rows = [(i, "".join(rng.choice(sounds[lang].split()) + rng.choice(("", " ")) for _ in range(40)), lang) for i in range(300) for lang in [rng.choice(list(sounds))]]
    df = spark.createDataFrame([*rows, (-1, "12 34", "en"), (-2, None, "fr"), (-3, "the", None)], "doc_id long, text string, lang string").withColumn("score", langid.F.lit("clash"))
    model = langid.fit(df.filter(~langid.held_out("doc_id")))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(test) > 30 and sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.95 * len(test)
    assert (got[-1].lang_pred, got[-1].score, got[-2].lang_pred) == ("und", 0.0, "und")
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_language_sample(spark):
    rows = spark.range(200_000).selectExpr("id AS doc_id", "'x' AS text")
    for n, sample in ((200_000, 2000), (5 * 10**10, 5 * 10**8), (10**15, 10**13)):
        assert 1700 < langid.sampled(rows, n, sample).count() < 2300
    assert (40_000 << 62) // 10**15 > 0 and langid.sampled(rows, 10, 10).count() == 200_000
    model = langid.Model(("a", "b"), np.log([0.5, 0.5]), np.zeros((16, 2), np.float32))
    assert langid.score(["tie"], model) == (["a"], [0.5])


EDGES = [(None, None), (None, "same text of a few words here"), (None, "same text of a few words here"), (1, "same text of a few words here"), (1, "same text of a few words here"), (1, "other text"), (2, ""), (3, "\n \n"), (4, "long " * 30_000), (5, "long " * 30_000)]
PER_DOCUMENT = {
    "bpe": lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "media": lambda d: media.features(media.store(d).drop("text")),
    "suffix": suffix.removed,
    "suffix.dedup": suffix.dedup,
    "lines": lines.dedup_lines,
    "jaccard": jaccard.join,
    "quality": quality.quality,
    "language": lambda d: langid.predict(d, langid.fit(d.filter(~langid.held_out("doc_id")))),
    "packing": lambda d: packing.pack(packing.tokenized(d, public_tokenizers.path("word_bpe_49k.json"))).filter("piece = 0").drop("sequence_id", "offset"),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_edges(spark, name):
    """Nulls in any column, repeated rows, ties, empty and long texts, clashing names: a row per document, equal rows alike."""
    rows = spark.createDataFrame([(i, t, None, None) for i, t in EDGES], "doc_id long, text string, source string, lang string")
    made = PER_DOCUMENT[name](rows.selectExpr("*", *CLASHES).repartition(3)).collect()
    assert sorted((r.doc_id for r in made), key=str) == sorted((i for i, _ in EDGES), key=str)
    if name not in ("suffix", "suffix.dedup"):  # there, the first of equal rows stays
        of = lambda r: str(sorted((k, v) for k, v in r.asDict().items() if k not in ("kept0",)))
        assert len({of(r) for r in made}) <= len(set(EDGES))
    assert PER_DOCUMENT[name](rows.filter("false")).count() == 0
    if name in ("suffix.dedup", "lines", "media", "language"):
        assert {c.split()[-1] for c in CLASHES} <= set(made[0].asDict())


COLUMNS = {
    "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5": "doc_id text",
    "op6": "doc_id n_shingles component_id",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "page_id url text n_chars",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    made = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(made.columns)
    key = "conv_id" if name.startswith("op1_") else "page_id" if name.startswith("op8_") else "doc_id"
    source = spark.read.parquet(f"{folder}/{ {'conv_id': 'conversations', 'page_id': 'pages'}.get(key, 'documents')}.parquet")
    made = made.filter("piece = 0") if name.startswith("op10_") else made
    assert made.count() == source.select(key).distinct().count() + (key == "conv_id")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.tokenized(docs, path)
    got = defaultdict(dict)
    for r in pieces.collect():
        got[r.doc_id][r.piece] = r
    for i, text, *_ in corpus():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), 2048):
            r = got[i][p // 2048]
            assert (r.start, r.length, r.ids_crc32) == (p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes()))
        assert len(got[i]) == -(-len(ids) // 2048)
    bins, n = defaultdict(list), 0
    for r in packing.pack(pieces).collect():
        bins[r.sequence_id].append((r.offset, r.length))
        n += r.length
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-n // 2048) + 1
    assert packing.pack(packing.tokenized(empty, path)).count() == 0


def bins_of(lengths, capacity=2048, how=None, **options):
    """Bins of best fit decreasing, or of ``pack`` in a session."""
    if how is None:
        into = np.empty(len(lengths), np.int64)
        packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), packing.Bins(capacity), into)
        return int(into.max()) + 1
    rows = packing.pack(how.createDataFrame([(int(x), 1, 2, 3) for x in lengths], "length long, item int, offset int, shard int"), capacity, **options).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        assert (r.item, r.shard) == (1, 3)
    assert sorted(r.length for r in rows) == sorted(lengths.tolist())
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    return len(bins)


def test_packing_needs_its_method(spark):
    """Fewer sequences than best fit decreasing; children and epochs are what does it."""
    lengths = np.random.default_rng(1).integers(270, 1366, 250)
    found = {k: bins_of(lengths, how=spark, **o) for k, o in {"all": {}, "no children": {"patience": 0}, "one epoch": {"epochs": 1, "patience": 4}, "epochs": {"epochs": 6, "patience": 4}}.items()}
    assert found["all"] < bins_of(lengths) < found["no children"]
    assert found["epochs"] < found["one epoch"]
    exact = np.concatenate([x := np.random.default_rng(3).integers(30, 50, 8), y := np.random.default_rng(4).integers(25, 35, 8), 100 - x - y])
    assert bins_of(exact, 100, spark, patience=300) <= bins_of(exact, 100)


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    lengths = np.random.default_rng(2).integers(1, 700, 3000)
    assert bins_of(lengths, how=spark) <= 1.02 * int(lengths.sum()) / 2048


def test_packing_control_strings(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["x<|endoftext|>y.", "A <|EndOfText|> b <|endoftext|>", "<|startoftext|><|endoftext|>,", "<|endoftext|>. It's", "don<|endoftext|>'t  a.<|endoftext|>\n", None, "no such text, <|ENDOFTEXT|>."]
    rows = list(enumerate(texts))
    for some in (rows, rows[-2:]):
        got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.tokenized(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), path).collect()}
        for i, text in some:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_pipeline(spark, docs, empty):
    import corpus_pipeline as c

    rows = docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", langid.F.length("text").cast("long"))
    now = rows
    for _, stage in c.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == rows.columns
    # Judge the later stages by hand on what the first ones kept.
    told = c.STAGES[0][1](spark, rows, "")
    lined = c.STAGES[1][1](spark, told, "")
    label = {r.doc_id: r.component_id for r in jaccard.join(lined).collect()}
    kept = [(r.doc_id, r.text) for r in lined.collect() if label[r.doc_id] == r.doc_id]
    want = removed_by_hand(kept)
    out = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    assert {i: t for i, (t, _) in out.items()} == {i: want[i][4].decode("utf-8", "ignore") for i, _ in kept}
    assert all(n == len(t) for t, n in out.values())
    assert {r.doc_id for r in c.STAGES[-1][1](spark, now, "").collect()} == set(out)
    assert len(queries.QUERIES) == 10
