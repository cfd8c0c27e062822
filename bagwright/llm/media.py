"""Media columns: texts stored as baseline JPEG, and DC-only luminance thumbnails of any baseline JPEG.

``store`` writes a payload as grey 8x8 blocks, one byte per block: with a DC step of 8 the level of
a block is exactly the byte, so the DC-only thumbnail of the image *is* the payload. Rows of 64
blocks are restart intervals. Frames hold at most ``MAX_ROWS`` rows (the format's height limit);
longer payloads become several frames one after the other.

``features`` parses the markers of stored bytes, Huffman-decodes all restart intervals of a batch
side by side in numpy, and rebuilds each luminance thumbnail from DC values alone. It reads any
baseline JPEG (several components, subsampling, AC coefficients, with or without restarts).

Defined results: null text is empty; an empty text is stored as 64 zero bytes; equal texts give
equal values; null or malformed media give null in all columns made from them; other columns of the
input are kept, made columns replace columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame

COLUMNS, MAX_ROWS = 64, 8191
#: Payload bytes that are worked on at once, and media bytes in one Arrow batch.
PORTION, BATCH = 1 << 20, 32 << 20

# Fixed values of the format: code counts by length and symbols of the usual luminance DC table.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Blocks here have no AC values: the only AC symbol is "end of block", of one bit.
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, bits)."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = code, bits
            code, k = code + 1, k + 1
        code <<= 1
    return out


@cache
def _levels() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference, from -255 to 255: its code with the end of the block, and the bits of both."""
    table, (end, end_bits) = codes(DC_COUNTS, DC_SYMBOLS), codes(AC_COUNTS, AC_SYMBOLS)[0]
    value, length = [], []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, bits = table[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        value.append((((code << s) | extra) << end_bits) | end)
        length.append(bits + s + end_bits)
    return np.array(value, np.int64), np.array(length, np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int, note: bytes) -> bytes:
    quant = bytes([0, 8]) + bytes([1]) * 63
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS, 0x10, *AC_COUNTS, *AC_SYMBOLS])
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, note),
        _segment(0xDB, quant),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, COLUMNS * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, tables),
        _segment(0xDD, struct.pack(">H", COLUMNS)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def encode_many(payloads: list[bytes], notes: list[bytes]) -> list[bytes]:
    """One JPEG (or run of frames) per padded payload."""
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS).astype(np.int64) - 128
    diff = pixels.copy()
    diff[:, 1:] -= pixels[:, :-1]
    value, length = _levels()
    value, length = value[diff.ravel() + 255], length[diff.ravel() + 255].reshape(diff.shape)
    ends = length.cumsum(axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    row_at = np.concatenate(([0], row_bytes.cumsum()))
    at = (row_at[:-1, None] * 8 + ends - length).ravel()
    shifted = value << (40 - length.ravel() - (at & 7))
    byte = at >> 3
    out = np.zeros(int(row_at[-1]) + 5, np.float64)
    for k in range(4):
        out += np.bincount(byte + k, (shifted >> (32 - 8 * k)) & 0xFF, len(out))
    out[row_at[1:] - 1] += (1 << (-ends[:, -1] & 7)) - 1  # filled up with ones
    raw = out[:-5].astype(np.uint8)
    # The last row of a frame has no restart marker after it.
    rows, frames = [len(p) // COLUMNS for p in payloads], []
    for n in rows:
        frames += [min(MAX_ROWS, n - i) for i in range(0, n, MAX_ROWS)]
    last = np.cumsum(frames) - 1
    marked = np.ones(len(row_bytes), bool)
    marked[last] = False
    size = 1 + (raw == 0xFF)
    size[row_at[1:] - 1] += 2 * marked
    to = np.concatenate(([0], size.cumsum()))
    scan = np.zeros(int(to[-1]), np.uint8)
    scan[to[:-1]] = raw
    number = np.arange(len(row_bytes)) - np.repeat(last + 1 - frames, frames)
    mark = to[row_at[1:]][marked] - 2
    scan[mark], scan[mark + 1] = 0xFF, 0xD0 + number[marked] % 8
    data, media, frame, row = scan.tobytes(), [], iter(frames), 0
    for n, note in zip(rows, notes):
        parts, done = [], 0
        while done < n:
            f = next(frame)
            parts += [_head(f, note), data[to[row_at[row]] : to[row_at[row + f]]], b"\xff\xd9"]
            row, done = row + f, done + f
        media.append(b"".join(parts))
    return media


class Frame:
    """Markers of one baseline frame: size, component layout, tables and the places of its restart intervals."""

    def __init__(self, data: bytes, at: int):
        quant, huff, self.notes, interval = {}, {}, [], 0
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at] != 0xFF or n < 2:
                raise ValueError("no marker")
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # of the DC value alone
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n_symbols = sum(body[1:17])
                    huff[body[0]] = body[1 : 17 + n_symbols]
                    body = body[17 + n_symbols :]
            elif marker == 0xC0 or marker == 0xC1:
                if body[0] != 8:
                    raise ValueError("only 8-bit samples")
                self.height, self.width = struct.unpack(">HH", body[1:5])
                parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.notes.append(body)
            elif marker == 0xDA:
                if body[0] != len(parts):
                    raise ValueError("components must share one scan")
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.h, self.v = (parts[0][1] >> 4, parts[0][1] & 15) if len(parts) > 1 else (1, 1)
        h_max, v_max = (max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)) if len(parts) > 1 else (1, 1)
        if (self.h, self.v) != (h_max, v_max):
            raise ValueError("luminance must have the full resolution")
        self.across, self.down = -(-self.width // (8 * h_max)), -(-self.height // (8 * v_max))
        self.step = quant[parts[0][2]]
        #: For each block of a unit: component, DC table, AC table.
        self.units = tuple((i, huff[chosen[p[0]] >> 4], huff[0x10 | chosen[p[0]] & 15]) for i, p in enumerate(parts) for _ in range((p[1] >> 4) * (p[1] & 15) if len(parts) > 1 else 1))
        total = self.across * self.down
        interval = interval or total
        self.lanes = [min(interval, total - i) * len(self.units) for i in range(0, total, interval)]
        self.at = at


@lru_cache(64)  # 128 KB each
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: symbol * 32 + bits of the code; 0 if no code fits."""
    out, k, code = np.zeros(1 << 16, np.int32), 16, 0
    for bits, n in enumerate(table[:16], 1):
        for _ in range(n):
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = table[k] * 32 + bits
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lanes(stream: np.ndarray, at: np.ndarray, units: tuple, blocks: int) -> np.ndarray:
    """DC values of lanes of ``blocks`` blocks each that begin at the bytes ``at``: one row per lane."""
    b = np.concatenate((stream, np.zeros(8, np.uint8))).astype(np.int64)
    n = len(b) - 4
    window = b[:n] << 32 | b[1 : n + 1] << 24 | b[2 : n + 2] << 16 | b[3 : n + 3] << 8 | b[4 : n + 4]
    pos, out = at.astype(np.int64) * 8, np.empty((blocks, len(at)), np.int32)
    before = np.zeros((1 + max(u[0] for u in units), len(at)), np.int64)
    for k in range(blocks):
        part, dc, ac = units[k % len(units)]
        w, shift = window[pos >> 3], 40 - (pos & 7)
        got = _lookup(dc)[(w >> (shift - 16)) & 0xFFFF].astype(np.int64)
        if not got.all():
            raise ValueError("no such code")
        bits, s = got & 31, got >> 5
        extra = (w >> (shift - bits - s)) & ((1 << s) - 1)
        before[part] += np.where(extra >> np.maximum(s - 1, 0), extra, extra - (1 << s) + 1) * (s > 0)
        out[k] = before[part]
        pos += bits + s
        if pos.max(initial=0) >= 8 * n:
            raise ValueError("the scan ends early")
        open_, spot = None, None  # all lanes at first, then those whose block goes on
        while True:
            p = pos if open_ is None else pos[open_]
            got = _lookup(ac)[(window[p >> 3] >> (24 - (p & 7))) & 0xFFFF].astype(np.int64)
            if not got.all():
                raise ValueError("no such code")
            bits, symbol = got & 31, got >> 5
            p = p + bits + (symbol & 15)
            if p.max(initial=0) >= 8 * n:
                raise ValueError("the scan ends early")
            if open_ is None:
                pos = p
                if not symbol.any():
                    break
                open_, spot = np.arange(len(pos)), np.zeros(len(pos), np.int64)
            else:
                pos[open_] = p
            spot = spot + (symbol >> 4) + 1
            on = (symbol != 0) & (spot < 63)
            open_, spot = open_[on], spot[on]
            if not len(open_):
                break
    return out.T


def thumbnails(media: list[bytes]) -> list[list[tuple[Frame, np.ndarray]] | None]:
    """The frames of each media value with their DC-only luminance thumbnails (uint8); None if malformed."""
    found: list = [[] for _ in media]
    pools: dict[tuple, list] = {}  # lanes that can be decoded side by side
    for i, data in enumerate(media):
        try:
            at, whole = 0, np.frombuffer(data, np.uint8)
            while at < len(data):
                frame = Frame(data, at)
                # The scan goes to the first marker that isn't a restart.
                body = whole[frame.at :]
                spots = np.flatnonzero((body[:-1] == 0xFF) & (body[1:] != 0))
                kinds = body[spots + 1]
                stop = int(np.argmax((kinds < 0xD0) | (kinds > 0xD7)))
                if kinds[stop] != 0xD9 or stop + 1 != len(frame.lanes):
                    raise ValueError("the scan's intervals don't fit its size")
                end = int(spots[stop])
                scan, starts = body[:end], np.concatenate(([0], spots[:stop] + 2))
                gone = np.zeros(end, bool)
                gone[1:] = (scan[:-1] == 0xFF) & (scan[1:] == 0)
                gone[spots[:stop]] = gone[spots[:stop] + 1] = True
                kept = np.concatenate(([0], np.cumsum(~gone)))
                scan, starts = scan[~gone], kept[starts]
                found[i].append([frame, [None] * len(frame.lanes)])
                for blocks in set(frame.lanes):
                    which = np.flatnonzero(np.array(frame.lanes) == blocks)
                    pools.setdefault((frame.units, blocks), []).append((i, len(found[i]) - 1, which, scan, starts[which]))
                at = frame.at + end + 2
            if not data:
                raise ValueError("no bytes")
        except (ValueError, IndexError, KeyError, struct.error, UnboundLocalError, AttributeError):
            found[i] = None
    for (units, blocks), lanes in pools.items():
        lanes = [x for x in lanes if found[x[0]] is not None]
        try:
            _fill(found, units, blocks, lanes)
        except ValueError:
            for one in lanes:  # to find the malformed ones
                try:
                    _fill(found, units, blocks, [one])
                except ValueError:
                    found[one[0]] = None
                    continue
    return [None if x is None else [(f, _picture(f, dc)) for f, dc in x] for x in found]


def _fill(found: list, units: tuple, blocks: int, lanes: list) -> None:
    if lanes:
        shift = np.cumsum([0] + [len(x[3]) for x in lanes])
        dc = _lanes(np.concatenate([x[3] for x in lanes]), np.concatenate([x[4] + s for x, s in zip(lanes, shift)]), units, blocks)
        k = 0
        for i, f, which, _, _ in lanes:
            if found[i] is not None:
                if len(which) == len(found[i][f][1]):
                    found[i][f][1] = [dc[k : k + len(which)]]
                else:
                    for n, lane in enumerate(which):
                        found[i][f][1][lane] = dc[k + n][None]
            k += len(which)


def _picture(frame: Frame, dc: list[np.ndarray]) -> np.ndarray:
    units, n = len(frame.units), frame.h * frame.v
    values = np.concatenate([x.reshape(-1, units)[:, :n] for x in dc])
    grid = values.reshape(frame.down, frame.across, frame.v, frame.h).transpose(0, 2, 1, 3).reshape(frame.down * frame.v, frame.across * frame.h)
    level = (grid[: -(-frame.height // 8), : -(-frame.width // 8)].astype(np.int64) * frame.step + 4 >> 3) + 128
    return np.clip(level, 0, 255).astype(np.uint8)


def hashes(picture: np.ndarray) -> str:
    """Average hash and difference hash of a thumbnail, both of 64 bits, over 8 x 9 means."""
    rows, columns = picture.shape
    sums = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(picture, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])

    def bands(size: int, n: int):
        lo = np.arange(n) * size // n
        return lo, np.maximum(lo + 1, (np.arange(n) + 1) * size // n)

    def means(n: int) -> np.ndarray:
        (top, bottom), (left, right) = bands(rows, 8), bands(columns, n)
        total = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
        return total / ((bottom - top)[:, None] * (right - left)[None, :])

    square, wide = means(8), means(9)
    bits = (square > square.mean(), wide[:, 1:] > wide[:, :-1])
    return ":".join(np.packbits(x.ravel()).tobytes().hex() for x in bits)


def _portions(items: list[bytes], most: int) -> Iterator[slice]:
    start = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > most:
            yield slice(start, i)
            start = i
            size = 0
        size += len(x)
    if start < len(items):
        yield slice(start, len(items))


def _with(schema: T.StructType, *made: T.StructField) -> T.StructType:
    names = {f.name for f in made}
    return T.StructType([f for f in schema.fields if f.name not in names] + list(made))


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with the binary column ``media``: ``text`` as UTF-8, padded, as grey baseline JPEG."""
    schema = _with(df.schema, T.StructField(media, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(x.as_py() or "").encode() for x in b[text]]
            kept = [n for n in b.schema.names if n != media]
            for part in _portions(data, PORTION):
                made = encode_many([padded(x) for x in data[part]], [b"bytes=%d" % len(x) for x in data[part]])
                rows = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows[n] for n in kept), pa.array(made, pa.binary())], names=[*kept, media])

    return df.mapInArrow(run, schema)


FEATURES = (
    ("n_bytes", T.LongType(), pa.int64()),
    ("payload_bytes", T.LongType(), pa.int64()),
    ("payload_sha256", T.StringType(), pa.string()),
    ("tail_crc32", T.LongType(), pa.int64()),
    ("media_bytes", T.LongType(), pa.int64()),
    ("media_sha256", T.StringType(), pa.string()),
    ("width", T.LongType(), pa.int64()),
    ("height", T.LongType(), pa.int64()),
    ("feature", T.StringType(), pa.string()),
)


def describe(media: list[bytes | None]) -> list[tuple]:
    """FEATURES of each media value, all from its stored bytes; width and height are of all frames, one above the other."""
    out = []
    for data, frames in zip(media, thumbnails([x or b"" for x in media])):
        if frames is None:
            out.append((None,) * len(FEATURES))
            continue
        payload = b"".join(p.tobytes() for _, p in frames)
        note = next((n for n in frames[0][0].notes if n.startswith(b"bytes=")), b"bytes=%d" % len(payload))
        width, height = max(f.width for f, _ in frames), sum(f.height for f, _ in frames)
        same = len({p.shape[1] for _, p in frames}) == 1
        picture = np.concatenate([p for _, p in frames]) if same else frames[0][1]
        out.append((int(note[6:]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), width, height, f"{width}x{height}:{hashes(picture)}"))
    return out


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without ``media`` but with FEATURES of its stored bytes."""
    kept = T.StructType([f for f in df.schema.fields if f.name != media])
    schema = _with(kept, *(T.StructField(n, t) for n, t, _ in FEATURES))
    names = [f.name for f in schema.fields[: -len(FEATURES)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b[media].to_pylist()
            for part in _portions([x or b"" for x in data], 2 * PORTION):
                rows, made = b.slice(part.start, part.stop - part.start), zip(*describe(data[part]))
                yield pa.RecordBatch.from_arrays([*(rows[n] for n in names), *(pa.array(x, t) for x, (_, _, t) in zip(made, FEATURES))], names=schema.names)

    return df.mapInArrow(run, schema)
