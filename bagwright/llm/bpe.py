"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

**Encoding.** A token sequence is what byte-pair merging gives exactly if every two neighbours are
what merging gives for their joined bytes. Hence each prefix of a piece has one last token, found
from left to right. ``Transducer`` walks the trie of tokens from every position that can still
begin a token; the ordered set of these walks, each with the token before it and the tokens not yet
emitted, is one state of a deterministic machine. States and moves are made when first needed and
kept; a token is emitted as soon as all walks agree on it, so lookahead is bounded by the longest
token. A piece that is itself in the vocabulary is one token, as in the usual encoder.

**Decoding.** ``Utf8Machine`` is a table of states and moves over bytes, fed one token at a time; it
gives out whole characters, and what is open waits for the next token. Ill-formed bytes give U+FFFD,
one for each longest part that could have begun a character.

Defined results: null text is empty and gives no ids; equal rows give equal results; other columns
are ignored; an empty table gives no rows. Texts of any length are cut into pieces by the pattern
and never truncated. Caches are emptied when full (``STATES``, ``PIECES``); that costs time alone.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import regex
from pyspark.sql import DataFrame

STATES, PIECES = 300_000, 400_000
#: Below this code point, letters, numbers and white space are listed for the faster engine.
LISTED = 0x250


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of "base64 rank" lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Plain byte-pair merging down to ``least`` parts: the lowest rank first, the leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class _Node(dict):
    """A node of the trie: children by byte, and the token that ends here. Nodes are told apart by identity."""

    __slots__ = ("token",)
    __hash__, __eq__ = object.__hash__, object.__eq__

    def __init__(self):
        self.token = None


class _State:
    """walks: (trie node, token before, tokens not yet emitted) per open start, the earliest first."""

    __slots__ = ("moves", "rest", "walks")

    def __init__(self, walks):
        self.walks, self.moves, self.rest = walks, {}, walks[-1][2]


def spines(ranks: dict[bytes, int]) -> dict[int, tuple]:
    """How merging builds each token that it can build: per token id, its left and right spine.

    A spine lists the parts that lie at the token's edge, the whole token first, each with its rank
    and the rank of the merge that swallows it (none for the whole).
    """
    split: dict[bytes, tuple[bytes, bytes]] = {}
    for token in ranks:
        if len(token) > 1:
            parts = merged(token, ranks, 2)
            if len(parts) == 2:
                split[token] = parts[0], parts[1]

    def sound(token: bytes) -> bool:
        return len(token) == 1 or token in split and all(p in ranks and (len(p) == 1 or ranks[p] < ranks[token]) and sound(p) for p in split[token])

    def spine(token: bytes, side: int) -> tuple:
        out, death = [], 1 << 60
        while True:
            out.append((token, ranks[token] if len(token) > 1 else -1, death))
            if len(token) == 1:
                return tuple(out)
            death, token = ranks[token], split[token][side]

    return {rank: (spine(token, 0), spine(token, 1)) for token, rank in ranks.items() if sound(token)}


class Transducer:
    """Bytes of one piece to token ids; ``parts`` is what ``spines`` gives."""

    def __init__(self, ranks: dict[bytes, int], parts: dict[int, tuple] | None = None):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.parts = ranks, parts or spines(ranks)
        self.root = _Node()
        for token, rank in ranks.items():
            if rank in self.parts:
                node = self.root
                for byte in token:
                    if (below := node.get(byte)) is None:
                        below = node[byte] = _Node()
                    node = below
                node.token = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; their references to each other go, so that no collector is needed."""
        for state in getattr(self, "known", {}).values():
            state.moves.clear()
        first = ((self.root, -1, ()),)
        self.start = _State(first)
        self.known: dict = {first: self.start}

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b alone.

        At any time a's part at the border comes from its right spine and b's from its left one. A
        merge across the border takes place where two parts live at the same time and their joint
        rank comes before the end of either (of equal ranks the leftmost goes first).
        """
        if a < 0:
            return True
        if (got := self.fits.get((a, b))) is not None:
            return got
        if len(self.fits) > 10 * STATES:
            self.fits.clear()
        x, y, i, j, got, rank = self.parts[a][1], self.parts[b][0], 0, 0, True, self.ranks.get
        while True:
            (u, u_born, u_ends), (v, v_born, v_ends) = x[i], y[j]
            joint = rank(u + v)
            if joint is not None and joint < u_ends and joint <= v_ends:
                got = False
                break
            if u_born >= v_born and i + 1 < len(x):
                i += 1
            elif j + 1 < len(y):
                j += 1
            elif i + 1 < len(x):
                i += 1
            else:
                break
        self.fits[a, b] = got
        return got

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        walks, found = [], None
        for node, before, pending in state.walks:
            if (node := node.get(byte)) is not None:
                if node:  # at a leaf the walk ends
                    walks.append((node, before, pending))
                if found is None and (token := node.token) is not None and self._fit(before, token):
                    found = (self.root, token, (*pending, token))
        if walks:
            walks.append(found)
            n, shortest = 0, min([len(p) for _, _, p in walks])
            while n < shortest and len({p[n] for _, _, p in walks}) == 1:
                n += 1
            out = found[2][:n]
            if n:
                walks = [(node, before, pending[n:]) for node, before, pending in walks]
            walks = tuple(walks)
        else:
            out, walks = found[2], ((self.root, found[1], ()),)
        if (made := self.known.get(walks)) is None:
            if len(self.known) > STATES:
                self.reset()
            made = self.known[walks] = _State(walks)
        state.moves[byte] = made, out
        return made, out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, out = self.start, []
        for byte in piece:
            step = state.moves.get(byte) or self._move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        out += state.rest
        return out


def _fast(pattern: str) -> re.Pattern | None:
    """``pattern`` with its classes listed for code points under LISTED; None if it holds others."""
    chars = [chr(c) for c in range(LISTED)]
    kinds = {k: "".join(re.escape(c) for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(kinds.values()) + "]").replace(r"\p{L}", f"[{kinds[r'\p{L}']}]").replace(r"\p{N}", f"[{kinds[r'\p{N}']}]").replace(r"\S", f"[^{kinds[r'\s']}]").replace(r"\s", f"[{kinds[r'\s']}]")
    return None if r"\p" in out or "(?i" in out else re.compile(out)


class Encoder(dict):
    """Texts to ids; as a dict it holds the packed ids of pieces seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, parts: dict[int, tuple] | None = None):
        super().__init__()
        self.transducer, self.pattern, self.fast = Transducer(ranks, parts), regex.compile(pattern), _fast(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) > PIECES:
            self.clear()
        packed = np.array(self.transducer.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        listed = self.fast is not None and (text.isascii() or max(text) < chr(LISTED))
        pieces = (self.fast if listed else self.pattern).findall(text)
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), dtype="<u4")


# Fixed values of UTF-8: for each state the ranges of bytes that may come, and the state after them.
# GROUND lies between characters; ONE, TWO and THREE wait for so many more bytes of any kind; after
# E0, ED, F0 and F4 the next byte is limited further (no overlong forms, no surrogates, no code points above 10FFFF).
GROUND, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4 = range(8)
UTF8_MOVES = {
    GROUND: ((0x00, 0x7F, GROUND), (0xC2, 0xDF, ONE), (0xE0, 0xE0, AFTER_E0), (0xE1, 0xEC, TWO), (0xED, 0xED, AFTER_ED), (0xEE, 0xEF, TWO), (0xF0, 0xF0, AFTER_F0), (0xF1, 0xF3, THREE), (0xF4, 0xF4, AFTER_F4)),
    ONE: ((0x80, 0xBF, GROUND),),
    TWO: ((0x80, 0xBF, ONE),),
    THREE: ((0x80, 0xBF, TWO),),
    AFTER_E0: ((0xA0, 0xBF, ONE),),
    AFTER_ED: ((0x80, 0x9F, ONE),),
    AFTER_F0: ((0x90, 0xBF, TWO),),
    AFTER_F4: ((0x80, 0x8F, TWO),),
}
#: Bits of a character's first byte that belong to its code point, by the state after that byte.
UTF8_BITS = {GROUND: 0x7F, ONE: 0x1F, TWO: 0x0F, AFTER_E0: 0x0F, AFTER_ED: 0x0F, THREE: 0x07, AFTER_F0: 0x07, AFTER_F4: 0x07}
_TABLE = [[-1] * 256 for _ in UTF8_MOVES]
for _state, _ranges in UTF8_MOVES.items():
    for _low, _high, _next in _ranges:
        _TABLE[_state][_low : _high + 1] = [_next] * (_high + 1 - _low)


class _Between(dict):
    """Where the machine is after a token: the state and the bits of the open character; as a dict, moves by token."""

    __slots__ = ("bits", "state")

    def __init__(self, state: int, bits: int):
        super().__init__()
        self.state, self.bits = state, bits


class Utf8Machine:
    """Token ids to text, one token after the other.

    Bytes go through ``UTF8_MOVES``. A byte that no move allows ends the open character as one U+FFFD and is taken
    again from GROUND; where it is not allowed there either, it is a U+FFFD itself. What a token does
    between two characters, or within an open one, is a move of its own, made when it is first needed and kept.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.ground = self.at = _Between(GROUND, 0)
        self.known = {(GROUND, 0): self.ground}
        self.moves = 0

    def _move(self, at: _Between, token: int) -> tuple[_Between, str]:
        state, bits, out = at.state, at.bits, []
        for byte in self.tokens[token]:
            after = _TABLE[state][byte]
            if after < 0 and state != GROUND:
                out.append("\ufffd")
                state = GROUND
                after = _TABLE[state][byte]
            if after < 0:
                out.append("\ufffd")
                continue
            bits = byte & UTF8_BITS[after] if state == GROUND else bits << 6 | byte & 0x3F
            if after == GROUND:
                out.append(chr(bits))
            state = after
        if state == GROUND:
            bits = 0
        if self.moves > STATES:  # what is open stays open
            self.forget()
        if (to := self.known.get((state, bits))) is None:
            to = self.known[state, bits] = _Between(state, bits)
        at[token] = made = to, "".join(out)
        self.moves += 1
        return made

    def feed(self, ids) -> str:
        """The text of ``ids``, as far as its characters are complete."""
        at, out = self.at, []
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            at, piece = at.get(i) or self._move(at, i)
            out.append(piece)
        self.at = at
        return "".join(out)

    def end(self) -> str:
        """What is open at the end: one U+FFFD or nothing."""
        at, self.at = self.at, self.ground
        return "\ufffd" if at.state != GROUND else ""


#: Compiled vocabularies of this Python worker, by their digest.
_COMPILED: dict[tuple, tuple] = {}


def compiled(ranks: dict[bytes, int], pattern: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and decoding table, made once per worker process."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _COMPILED:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _COMPILED[key] = Encoder(ranks, pattern), tokens
    return _COMPILED[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array column ``ids`` for its column ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # the vocabulary: of fixed size
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = compiled(shared.value, pattern)
        for b in batches:
            with _uncollected():
                arrays = [encoder.encode(x.as_py() or "").astype(np.int64) for x in b[text]]
            keep = [n for n in b.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in keep), pa.array(arrays, type=pa.list_(pa.int64()))], names=[*keep, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", portion: int = 4096) -> DataFrame:
    """``df`` with the string column ``text`` for its array column ``ids`` (null: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Utf8Machine(compiled(shared.value, "")[1])
        for b in batches:
            out = [_decoded(machine, np.array(x.as_py() or [], dtype=np.int64), portion) for x in b[ids]]
            keep = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in keep), pa.array(out, type=pa.string())], names=[*keep, text])

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def _uncollected():
    """Many small lasting objects make Python's cycle collector the main cost; there are no cycles here."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _decoded(machine: Utf8Machine, ids: np.ndarray, portion: int) -> str:
    return "".join([machine.feed(ids[i : i + portion]) for i in range(0, len(ids), portion)]) + machine.end()


def round_trip(df: DataFrame, path: str, pattern: str, portion: int = 4096) -> DataFrame:
    """Per row of ``df`` (doc_id, text): ids made and decoded again, as counts and digests.

    The same Encoder and Utf8Machine as in ``encode`` and ``decode``, in one pass, so that the ids of
    a large table don't travel between Python and the JVM.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = compiled(shared.value, pattern)
        machine, decimal = Utf8Machine(tokens), [str(i) for i in range(len(tokens))]
        for b in batches:
            n, digest, back = [], [], []
            with _uncollected():
                for x in b["text"]:
                    ids = encoder.encode(x.as_py() or "")
                    n.append(len(ids))
                    digest.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    back.append(hashlib.sha256(_decoded(machine, ids, portion).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
