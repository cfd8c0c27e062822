"""Suffix order and common prefixes of strings on disk, by external induced sorting.

``clusters`` takes strings as one array in which 0 ends each, and gives the suffixes that begin at
chosen places in descending order, with the length of the prefix that each has in common with the
one before it (counted up to ``depth``).

Suffixes that begin a descent after a rise (the usual S* places) are the seeds. Their order comes
from the recursion: names of the pieces between them make a shorter string, whose suffixes are put
in order in the same way, until the seeds are few enough to be sorted at once (or names too many, see ``NAMES``). The order of all
other suffixes is then induced in two scans. Both use a priority queue of (place, common prefix)
tuples by first character; tuples of one character leave in the order in which they came, and all
that exceeds the room waits in a file. A common prefix is one more than the least among the
tuples between the two that induced its neighbours, so it travels through the induction with them.
Only places up to the first seed after the last chosen place of a string are ever induced.

Memory is bounded by ``Room``, whatever the size of the text: places, names, the shorter string and the order of
seeds are mapped files like the text, pieces are put in order by distributing them into files until
a part fits, and queues spill. What is left in memory per symbol of the alphabet (of a shorter
string: per name) is one number and an empty queue.
"""

from __future__ import annotations

import os
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

#: Names up to which the shorter string is put in order by induction.
NAMES = 4096


class Room:
    """A folder for files, and bytes that a sort may hold: in queues, in a block of tuples, in seeds that are sorted at once."""

    def __init__(self, folder: str, held: int, base: int | None = None):
        self.folder, self.held = folder, held
        self.block = max(16, held // 512)
        self.base = max(1, held // 96) if base is None else base
        self.files = 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"sort-{self.files}")

    def array(self, n: int, kind=np.int64) -> np.ndarray:
        """An array of ``n`` zeros in a file of its own, which goes with it."""
        path = self.path()
        with open(path, "wb") as f:
            f.truncate(max(1, n) * np.dtype(kind).itemsize)
        made = np.asarray(np.memmap(path, kind, "r+", shape=(max(1, n),)))[:n]
        os.unlink(path)
        return made

    def blocks(self, n: int) -> Iterator[slice]:
        for i in range(0, n, self.block):
            yield slice(i, min(n, i + self.block))


class Queue:
    """Tuples (place, common prefix) by character, in the order in which they came; beyond ``held`` bytes, in a file."""

    def __init__(self, room: Room):
        self.most, self.block, self.held = max(room.held // 4, 1), room.block, 0
        path = room.path()
        self.file = open(path, "w+b")  # noqa: SIM115
        os.unlink(path)
        self.end = 0
        #: Per character (first tuple, number) in the file, then arrays of tuples; characters that have arrays.
        self.blocks: dict[int, deque] = defaultdict(deque)
        self.fresh: set[int] = set()

    def push(self, char: int, rows: np.ndarray) -> None:
        self.blocks[char].append(rows)
        self.fresh.add(char)
        self.held += rows.nbytes
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        for char in self.fresh:
            blocks, own = self.blocks[char], []
            while blocks and isinstance(blocks[-1], np.ndarray):
                own.append(blocks.pop())
            n = 0
            for b in reversed(own):
                self.file.write(np.ascontiguousarray(b.T).tobytes())
                n += b.shape[1]
            if n:
                blocks.append((self.end, n))
                self.end += n
        self.fresh.clear()
        self.file.flush()
        self.held = 0

    def pop(self, char: int, last: bool = False) -> np.ndarray | None:
        """The oldest tuples of ``char`` (the youngest if ``last``), a block of them at most; None if there are none."""
        blocks = self.blocks.get(char)
        if not blocks:
            return None
        out, n = [], 0
        while blocks and n < self.block:
            b = blocks.pop() if last else blocks.popleft()
            if isinstance(b, np.ndarray):
                self.held -= b.nbytes
            else:
                at, size = b
                k = min(size, self.block - n)
                if k < size and last:
                    blocks.append((at, size - k))
                elif k < size:
                    blocks.appendleft((at + k, size - k))
                at += size - k if last else 0
                b = np.frombuffer(os.pread(self.file.fileno(), 16 * k, 16 * at), np.int64).reshape(-1, 2).T
            n += b.shape[1]
            out.append(b)
        return out[0] if len(out) == 1 else np.concatenate(out[::-1] if last else out, axis=1)

    def close(self) -> None:
        self.file.close()


def falls(text: np.ndarray, room: Room) -> np.ndarray:
    """Places that are smaller than their left neighbour and rise next, in a file; ends (0) after a character count."""
    n = len(text)
    counts, path, rises = [], room.path(), True  # of the last place
    with open(path, "w+b") as f:
        for part in reversed(list(room.blocks(n - 1))):
            x = text[part.start : part.stop + 1].astype(np.int64)
            step = np.sign(x[1:] - x[:-1])
            at = np.where(step != 0, np.arange(len(step)), len(step))
            at = np.minimum.accumulate(at[::-1])[::-1]
            up = np.append(np.append(step > 0, rises)[at], rises)
            found = np.flatnonzero(up[1:] & ~up[:-1]) + part.start + 1
            f.write(found.tobytes())
            counts.append(len(found))
            rises = bool(up[0])
        out, done, total = room.array(sum(counts)), 0, sum(counts)
        f.seek(0)
        for k in counts:  # the last block comes first
            done += k
            out[total - done : total - done + k] = np.frombuffer(f.read(8 * k), np.int64)
    os.unlink(path)
    return out


def words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next symbols of each place, as one integer that sorts as they do; ``text`` is padded."""
    if text.dtype != np.uint8:
        return text[at].astype(np.uint64)
    view = np.ndarray((len(text) - 8,), ">u8", text, strides=(1,))
    return view[at].astype(np.uint64)


def base_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Indices that sort the suffixes at ``at`` to at least ``depth`` symbols (in memory)."""
    wide = 8 if text.dtype == np.uint8 else 1
    order = np.argsort(key := words(text, at), kind="stable")
    key = key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    end = len(text) - 9
    for d in range(wide, depth, wide):
        tied = ~new
        tied[:-1] |= ~new[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        group = np.cumsum(new)[spots]
        key = words(text, np.minimum(at[order[spots]] + d, end))
        sub = np.lexsort((key, group))
        order[spots] = order[spots][sub]
        key, group = key[sub], group[sub]
        new[spots[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return order


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, up to ``depth``."""
    out, left, end = np.full(len(a), depth, np.int64), np.arange(len(a)), len(text) - 9
    wide = 8 if text.dtype == np.uint8 else 1
    for d in range(0, depth, wide):
        x = words(text, np.minimum(a[left] + d, end)) ^ words(text, np.minimum(b[left] + d, end))
        off = x != 0
        if wide == 8:
            top = np.frexp(x[off].astype(np.float64))[1]  # bits up to the highest that differs
            out[left[off]] = np.minimum(depth, d + (64 - np.minimum(top, 64)) // 8)
        else:
            out[left[off]] = d
        left = left[~off]
        if not len(left):
            break
    return out


def pieces(text: np.ndarray, every: np.ndarray, depth: int, room: Room, own: np.ndarray | None = None, d: int = 0, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (numbers of pieces in their order, whether each differs from the one before) of the pieces between falls.

    Pieces are compared over ``depth`` symbols at most. What doesn't fit is dealt into files by its next symbols.
    ``whole``: the suffixes from ``every`` on instead of the pieces.
    """
    n, end = len(every), len(text) - 9
    wide = 6 if text.dtype == np.uint8 else 1

    def key(k: np.ndarray, d: int) -> np.ndarray:
        """The symbols from the d-th on. A piece that has ended holds 0; its last symbol counts as risen."""
        start = np.asarray(every[k])
        size = depth + 1 if whole else np.where(k + 1 < n, every[np.minimum(k + 1, n - 1)], end) - start + 1
        out = np.zeros(len(k), np.int64)
        for j in range(d, d + wide):
            inside = (j < size) & (j < depth)
            symbol = np.where(inside, text[np.minimum(start + j, len(text) - 1)].astype(np.int64) * 2 + (j == size - 1) + 1, 0)
            out = out * 1024 + symbol if wide > 1 else symbol
        return out

    def parts() -> Iterator[np.ndarray]:
        for part in room.blocks(n if own is None else len(own)):
            yield np.arange(part.start, part.stop) if own is None else own[part]

    size = n if own is None else len(own)
    while size > room.base:
        sample = key(np.sort(np.random.default_rng(size).integers(0, size, 256)) if own is None else own[np.random.default_rng(size).integers(0, size, 256)], d)
        some = np.unique(sample)[:: max(1, len(np.unique(sample)) // 15)]
        splits = np.unique(np.concatenate((some, some + 1)))
        files = [open(room.path(), "w+b") for _ in range(len(splits) + 1)]  # noqa: SIM115
        bounds = [[1 << 62, -1] for _ in files]
        for k in parts():
            x = key(k, d)
            to = np.searchsorted(splits, x, "right")
            for p in np.unique(to).tolist():
                mine = to == p
                files[p].write(k[mine].tobytes())
                bounds[p] = [min(bounds[p][0], int(x[mine].min())), max(bounds[p][1], int(x[mine].max()))]
        filled = [(f, b) for f, b in zip(files, bounds) if b[1] >= 0]
        for f in files:
            f.flush()
            os.unlink(f.name)
        if len(filled) == 1 and filled[0][1][0] == filled[0][1][1]:
            # All are alike so far: on to the next symbols, or they are one.
            d += wide
            files[0].close()
            if filled[0][1][0] % (1024 if wide > 1 else 1 << 62) == 0 or d >= depth:
                for k in parts():
                    new = np.zeros(len(k), bool)
                    new[0], size = size > 0, 0
                    yield k, new
                return
            continue
        for f, _ in filled:
            yield from pieces(text, every, depth, room, np.asarray(np.memmap(f, np.int64, "r")), d, whole)
            f.close()
        return
    order = np.concatenate([np.zeros(0, np.int64), *parts()])
    new = np.zeros(len(order), bool)
    new[:1] = True
    while d < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        x, group = key(order[spots], d), np.cumsum(new)[spots]
        if not x.any():
            break
        sub = np.lexsort((x, group))
        order[spots] = order[spots][sub]
        x, group = x[sub], group[sub]
        new[spots[1:]] |= (x[1:] != x[:-1]) | (group[1:] != group[:-1])
        d += wide
    if len(order):
        yield order, new


def seeds_order(text: np.ndarray, every: np.ndarray, seeds: np.ndarray, depth: int, room: Room) -> np.ndarray:
    """``seeds`` (some of the places ``every``) in the order of their suffixes: by recursion if they are many.

    Recursion goes on while names are few; a string of more than ``NAMES`` different ones differs within a few
    symbols nearly everywhere, and is dealt into order like pieces.
    """
    if len(seeds) <= room.base:
        return seeds[base_order(text, np.array(seeds), depth)]
    # The pieces between falls get names in their order; the names make the shorter string.
    shorter, name = room.array(len(every) + 11), 0
    for own, new in pieces(text, every, depth, room):
        names = name + np.cumsum(new)
        shorter[own + 1] = names
        name = int(names[-1])
    out, left = room.array(len(seeds)), len(seeds)
    if name > NAMES:
        places = room.array(len(every))
        for part in room.blocks(len(every)):
            places[part] = np.arange(part.start + 1, part.stop + 1)
        done = 0
        for own, _ in pieces(shorter, places, depth, room, whole=True):
            at = np.asarray(every[own])
            at = at[seeds[np.minimum(np.searchsorted(seeds, at), len(seeds) - 1)] == at]
            out[done : done + len(at)] = at
            done += len(at)
        return out
    for at, _ in suffixes(shorter, np.array([1]), np.array([len(every)]), depth, room):
        at = np.asarray(every[at[at <= len(every)] - 1])
        found = np.minimum(np.searchsorted(seeds, at), len(seeds) - 1)
        at = at[seeds[found] == at]
        out[left - len(at) : left] = at[::-1]
        left -= len(at)
    return out


def _scan(text: np.ndarray, rows: np.ndarray, goes, latest: dict, depth: int, queue: Queue) -> None:
    """Push what ``rows`` induce. latest: per character, the place that was pushed last."""
    at, prefix = rows
    before = text[at - 1].astype(np.int64)
    chosen = np.flatnonzero(goes(before) & (before > 0))
    if not len(chosen):
        return
    kind = before[chosen]
    order = np.argsort(kind, kind="stable")
    kind, chosen = kind[order], chosen[order]
    place, heads = at[chosen] - 1, np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    # One more than the least common prefix since the tuple before; between blocks the two are compared.
    begin = np.append(0, chosen[:-1] + 1)
    begin[heads] = chosen[heads]
    made = np.minimum(np.minimum.reduceat(np.append(prefix, depth), np.stack((begin, chosen + 1), axis=1).ravel())[::2] + 1, depth)
    kinds = kind[heads].tolist()
    ago = np.array([latest.get(x, -1) for x in kinds])
    seen = ago >= 0
    made[heads] = 0
    made[heads[seen]] = common(text, ago[seen], place[heads[seen]], depth)
    rows, cuts = np.stack((place, made)), [*heads.tolist(), len(place)]
    for x, lo, hi in zip(kinds, cuts, cuts[1:]):
        queue.push(x, rows[:, lo:hi])
        latest[x] = int(place[hi - 1])


def _wanted(every: np.ndarray, starts: np.ndarray, widths: np.ndarray, room: Room) -> np.ndarray:
    """The falls at chosen places and the first after each, in a file. ``widths`` places from each of ``starts`` are chosen."""
    path, n = room.path(), 0
    with open(path, "w+b") as f:
        for part in room.blocks(len(starts)):
            start = np.asarray(starts[part])
            lo = np.searchsorted(every, start)
            hi = np.minimum(np.searchsorted(every, start + widths[part] - 1, "right") + 1, len(every))
            for i in range(len(lo)) if (hi - lo).sum() > 4 * room.block else ():
                for j in range(lo[i], hi[i], room.block):
                    f.write(every[j : min(hi[i], j + room.block)].tobytes())
            if (hi - lo).sum() <= 4 * room.block:
                size = hi - lo
                f.write(every[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes())
            n += int((hi - lo).sum())
    made = np.asarray(np.memmap(path, np.int64, "r")) if n else np.zeros(0, np.int64)
    os.unlink(path)
    return made


def _alphabet(text: np.ndarray, room: Room) -> list[int]:
    if text.dtype == np.uint8:
        counts = np.zeros(256, np.int64)
        for part in room.blocks(len(text)):
            counts += np.bincount(text[part], minlength=256)
        return np.flatnonzero(counts).tolist()
    return list(range(max([int(text[part].max()) for part in room.blocks(len(text))]) + 1))


def _stop(text: np.ndarray, seeds: np.ndarray, lo: int, char: int) -> int:
    """Where the seeds from ``lo`` on that begin with ``char`` end."""
    step = 1
    while lo + step <= len(seeds) and int(text[seeds[lo + step - 1]]) == char:
        step *= 2
    low, high = lo + step // 2, min(len(seeds), lo + step)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if int(text[seeds[middle]]) == char else (low, middle)
    return low


def suffixes(text: np.ndarray, starts: np.ndarray, widths: np.ndarray, depth: int, room: Room) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, common prefix with the one before), in descending order.

    ``text`` begins with 0, ends each string with 0 and is padded by at least 9 zeros; ``widths`` places from each
    of the sorted ``starts`` are chosen. Places up to the next seed come out, so more than the chosen ones.
    """
    text = np.asarray(text)
    every = falls(text[: len(text) - 8], room)
    seeds = seeds_order(text, every, _wanted(every, starts, widths, room), depth, room)
    alphabet = _alphabet(text, room)
    rising, falling, down = Queue(room), Queue(room), Queue(room)
    latest: dict[int, int] = {}
    hi = 0
    for c in alphabet:
        last = None
        while (rows := rising.pop(c)) is not None:
            down.push(c, rows)
            last = rows[0, -1:]
            _scan(text, rows, lambda before: before >= c, latest, depth, rising)
        lo, hi = hi, _stop(text, seeds, hi, c)
        for i in range(lo, hi, room.block):
            own = np.array(seeds[i : min(hi, i + room.block)])
            prefix = np.zeros(len(own), np.int64)
            prefix[1:] = common(text, own[1:], own[:-1], depth)
            if i > lo:
                prefix[0] = common(text, own[:1], np.array(seeds[i - 1 : i]), depth)[0]
            elif last is not None:
                prefix[0] = common(text, last, own[:1], depth)[0]
            _scan(text, np.stack((own, prefix)), lambda before: before > c, latest, depth, rising)
    rising.close()
    latest = {}
    for c in reversed(alphabet):
        last = None
        while (rows := falling.pop(c)) is not None:
            yield rows[0], rows[1]
            last = rows[0, -1:]
            _scan(text, rows, lambda before: before <= c, latest, depth, falling)
        link = None
        while (rows := down.pop(c, last=True)) is not None:
            at = rows[0, ::-1]
            shifted = np.empty(len(at), np.int64)
            shifted[1:] = rows[1, :0:-1]
            if link is None:
                link = int(common(text, at[:1], last, depth)[0]) if last is not None else 0
            shifted[0], link = link, int(rows[1, 0])
            rows = np.stack((at, shifted))
            yield rows[0], rows[1]
            _scan(text, rows, lambda before: before < c, latest, depth, falling)
    falling.close()
    down.close()


def clusters(text: np.ndarray, starts: np.ndarray, widths: np.ndarray, depth: int, room: Room) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (place, which of ``starts`` it belongs to, starts a cluster): all chosen places, those equal over ``depth`` symbols together."""
    carried = depth
    for at, prefix in suffixes(text, starts, widths, depth, room):
        of = np.searchsorted(starts, at, "right") - 1
        own = np.flatnonzero((of >= 0) & (at < starts[of] + widths[of]))
        if not len(own):
            carried = min(carried, int(prefix.min(initial=depth)))
            continue
        least = np.minimum.reduceat(prefix[: own[-1] + 1], np.concatenate(([0], own[:-1] + 1)))
        least[0] = min(int(least[0]), carried)
        carried = int(prefix[own[-1] + 1 :].min(initial=depth))
        yield at[own], of[own], least < depth
