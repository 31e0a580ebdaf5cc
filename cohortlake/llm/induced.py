"""External induced suffix sorting with common-prefix values.

Suffix types split the text at its S* positions (a smaller-than-next suffix
after a larger-than-next one). The substrings between them are named in order,
the string of names is sorted by the same procedure, and from the sorted S*
suffixes one ascending scan induces all larger-than-next suffixes and one
descending scan all others. On every level both scans work through a priority
queue of tuples (symbol, suffix, common prefix with the tuple before it in
characters of the text); an induced tuple's common prefix is that of its
inducers and what its symbol spans.

Induced tuples leave a scan in order, so tuples of one symbol are first in,
first out, and a queue only has to tell symbols apart: it keeps them by zones
of symbols and moves its fullest zones to disk whenever it holds more tuples
than allowed. A scan takes a whole range of symbols at once if nothing that
the range induces falls into it. Texts, types, names and places are files
mapped into memory, and names are ranked range by range, so a shard may be many
times larger than a task's memory.

Only the order of the first ``depth`` characters is wanted: common prefixes
are cut off there, suffixes that agree so far come in any order, and the
recursion ends when names span ``depth`` characters or are all different.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Tuples = tuple[np.ndarray, np.ndarray, np.ndarray]  # symbols, suffixes, common prefixes

CHUNK = 1 << 18
_KINDS = (np.dtype(np.int32), np.dtype(np.int32), np.dtype(np.uint8))


def _mapped(n: int, kind, least: int = 1 << 16) -> np.ndarray:
    """An array of zeros in a file mapped into memory (in memory, if it is small); the file goes with the array."""
    kind = np.dtype(kind)
    if n * kind.itemsize < least:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * kind.itemsize)
        return np.frombuffer(mmap.mmap(file.fileno(), n * kind.itemsize), kind)


def _joined(runs: list[Tuples]) -> Tuples:
    return runs[0] if len(runs) == 1 else tuple(np.concatenate(c) for c in zip(*runs, strict=True))


class TupleStore:
    """Tuples by zone of symbols, in the order in which they come; beyond ``most`` tuples the fullest zone moves to disk."""

    def __init__(self, symbols: int, most: int):
        self.shift = max(0, (symbols - 1).bit_length() - 8)
        zones = ((symbols - 1) >> self.shift) + 1
        self.runs: list[list[Tuples]] = [[] for _ in range(zones)]
        self.stored: list[list[tuple[int, int]]] = [[] for _ in range(zones)]
        self.sizes = [0] * zones
        self.most, self.held, self.file, self.written = most, 0, None, 0

    def push(self, tuples: Tuples) -> None:
        """Add tuples whose zones ascend or descend."""
        symbols, suffixes, common = tuples
        n = len(symbols)
        if not n:
            return
        zone = symbols >> self.shift
        if zone[0] == zone[-1]:
            at = int(zone[0])
            self.runs[at].append(tuples)
            self.sizes[at] += n
        else:
            edges = [0, *(np.flatnonzero(zone[1:] != zone[:-1]) + 1).tolist(), n]
            for a, z in zip(edges, edges[1:], strict=False):
                at = int(zone[a])
                self.runs[at].append((symbols[a:z], suffixes[a:z], common[a:z]))
                self.sizes[at] += z - a
        self.held += n
        while self.held > self.most:
            self._store(max(range(len(self.sizes)), key=self.sizes.__getitem__))

    def _store(self, zone: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.stored[zone].append((self.written, self.sizes[zone]))
        self.file.seek(self.written)
        for column, kind in zip(self._memory(zone), _KINDS, strict=True):
            self.written += self.file.write(np.ascontiguousarray(column, kind).data)

    def _memory(self, zone: int) -> Tuples:
        out = _joined(self.runs[zone])
        self.held -= self.sizes[zone]
        self.runs[zone], self.sizes[zone] = [], 0
        return out

    def _read(self, at: int, n: int) -> Tuples:
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in _KINDS)

    def chunks(self, zone: int, reverse: bool = False) -> Iterator[Tuples]:
        """The zone's tuples, which stay, in parts of about ``CHUNK``."""
        parts: list = list(self.stored[zone])
        if self.runs[zone]:
            parts.append(None)
        held, n = [], 0
        for p in parts[::-1] if reverse else parts:
            run = _joined(self.runs[zone]) if p is None else self._read(*p)
            held.append(run)
            n += len(run[0])
            if n >= CHUNK:
                yield _joined(held[::-1] if reverse else held)
                held, n = [], 0
        if held:
            yield _joined(held[::-1] if reverse else held)

    def pop(self, zone: int) -> Iterator[Tuples]:
        """The zone's tuples in parts of about ``CHUNK``; they are gone when read, and later ones are not waited for."""
        stored, self.stored[zone] = self.stored[zone], []
        memory = self._memory(zone) if self.runs[zone] else None
        held, n = [], 0
        for p in [*stored, None]:
            run = memory if p is None else self._read(*p)
            if run is None:
                continue
            held.append(run)
            n += len(run[0])
            if n >= CHUNK:
                yield _joined(held)
                held, n = [], 0
        if held:
            yield _joined(held)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class TupleQueue(TupleStore):
    """A priority queue of tuples by symbol, read in one direction."""

    def __init__(self, symbols: int, most: int):
        super().__init__(symbols, most)
        self.current, self.again = -1, []

    def push(self, tuples: Tuples) -> None:
        if self.current >= 0:
            own = tuples[0] == self.current
            if own.any():
                self.again.append(tuple(c[own] for c in tuples))
                tuples = tuple(c[~own] for c in tuples)
        super().push(tuples)

    def rounds(self, symbol: int) -> Iterator[Tuples]:
        """All tuples of one symbol, then what they induce for the symbol itself, and so on."""
        first = (self.take(symbol, symbol + 1, False),) if self.shift else self.pop(symbol)
        self.current = symbol
        yield from first
        while self.again:
            now, self.again = self.again, []
            yield from now
        self.current = -1

    def take(self, lo: int, hi: int, falling: bool) -> Tuples:
        """All tuples of symbols from ``lo`` to below ``hi`` by symbol; a symbol's tuples as they came."""
        got = []
        for zone in range(lo >> self.shift, ((hi - 1) >> self.shift) + 1):
            runs = list(self.pop(zone))
            if not runs:
                continue
            tuples = _joined(runs)
            own = (tuples[0] >= lo) & (tuples[0] < hi)
            if not own.all():
                self.push(tuple(c[~own] for c in tuples))
                tuples = tuple(c[own] for c in tuples)
            got.append(tuples)
        tuples = _joined(got) if got else tuple(np.empty(0, k) for k in _KINDS)
        order = np.argsort(-tuples[0] if falling else tuples[0], kind="stable")
        return tuple(c[order] for c in tuples)


@dataclass
class Level:
    """A string of symbols, its suffixes' types and places in the text, and what a symbol spans there."""

    symbols: np.ndarray
    count: int
    is_s: np.ndarray
    starts: np.ndarray | None
    spans: np.ndarray
    text: np.ndarray  # followed by ``depth`` + 8 characters of padding
    depth: int

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs by comparison in the text."""
        if self.starts is not None:
            a, b = self.starts[a], self.starts[b]
        return common_prefixes(self.text, a, b, self.depth)


class _Order:
    """Mends the common prefixes of tuples where symbol or kind change: there they are compared in the text."""

    def __init__(self, level: Level):
        self.level, self.key, self.last = level, -1, -1

    def mend(self, key: np.ndarray, suffixes: np.ndarray, common: np.ndarray) -> np.ndarray:
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        if key[0] != self.key:
            change = np.append(0, change)
        if len(change):
            common = common.copy()
            before = suffixes[change - 1]
            if not change[0]:
                before[0] = self.last
            if before[0] < 0:
                common[0], change, before = 0, change[1:], before[1:]
            if len(change):
                common[change] = self.level.common(before, suffixes[change])
        self.key, self.last = int(key[-1]), int(suffixes[-1])
        return common


class _Scan:
    """Induces tuples from blocks of tuples in sorted order, with their common prefixes.

    For every symbol it is known in which block its last tuple was induced and
    the least common prefix behind that in the block; ``lows[k]`` is the least
    common prefix of the blocks from number k on.
    """

    def __init__(self, level: Level, wanted_s: bool, queue: TupleQueue):
        self.level, self.wanted_s, self.queue = level, wanted_s, queue
        self.block, self.behind = np.full(level.count, -1, np.int32), np.zeros(level.count, np.uint8)
        self.lows, self.blocks = np.full(1024, 255, np.uint8), 0

    def feed(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """``common[i]`` is the common prefix of tuple i and the tuple fed before it."""
        before = suffixes - 1
        use = np.flatnonzero((suffixes > 0) & (self.level.is_s[before] == self.wanted_s))
        if len(use):
            self._induce(before, common, use)
        if self.blocks + 2 > len(self.lows):
            self.lows = np.r_[self.lows, np.full(len(self.lows), 255, np.uint8)]
        now = self.lows[: self.blocks + 1]
        np.minimum(now, common.min(), out=now)
        self.blocks += 1

    def _induce(self, before: np.ndarray, common: np.ndarray, use: np.ndarray) -> None:
        symbols = self.level.symbols[before[use]]
        order = np.argsort(symbols, kind="stable")
        at, symbols = use[order], symbols[order]
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        least, own = np.empty(len(at), np.uint8), symbols[heads]
        since = np.minimum(self.behind[own], self.lows[self.block[own] + 1])
        least[heads] = np.minimum(since, np.minimum.accumulate(common)[at[heads]])
        if len(heads) < len(at):
            rest = np.flatnonzero(~new)
            least[rest] = _Minima(common).of(at[rest - 1] + 1, at[rest])
        tails = at[np.append(heads[1:], len(at)) - 1]
        ending = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
        self.behind[own], self.block[own] = ending[tails + 1], self.blocks
        least = np.minimum(least.astype(np.int16) + self.level.spans[symbols], self.level.depth).astype(np.uint8)
        self.queue.push((symbols.astype(np.int32), before[at], least))


class _Minima:
    """Range minima by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels, width = [values], 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float32))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        order = np.argsort(level.astype(np.uint8), kind="stable")
        edges = np.searchsorted(level[order], np.arange(len(self.levels) + 1))
        for k in range(len(self.levels)):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k) + 1])
        return out


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, at most ``depth``; ``text`` must be followed by ``depth`` characters of padding."""
    n = len(text)
    words = np.ndarray((n - 7,), "<u8", text.data, 0, (1,))
    out = np.full(len(a), depth, np.int64)
    todo = np.arange(len(a))
    for k in range(0, depth, 8):
        x = words[a[todo] + k] ^ words[b[todo] + k]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[todo[differ]] = k + (np.bitwise_count(low - np.uint64(1)) >> 3)
        todo = todo[~differ]
        if not len(todo):
            break
    return np.minimum(out, depth).astype(np.uint8)


def _types(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last one counts as such), from right to left in chunks."""
    n, out, after = len(symbols), _mapped(len(symbols), bool), True
    for z in range(n, 0, -CHUNK):
        a = max(0, z - CHUNK)
        own = symbols[a : min(n, z + 1)].astype(np.int64)
        step = np.diff(own)
        if z == n:
            step = np.r_[step, 1]
        turn = np.where(step != 0, np.arange(len(step)), len(step))
        turn = np.minimum.accumulate(turn[::-1])[::-1]
        out[a:z] = np.where(turn < len(step), step[np.minimum(turn, len(step) - 1)] > 0, after)
        after = bool(out[a])
    return out


def _stars(is_s: np.ndarray) -> np.ndarray:
    """The S suffixes behind an L suffix."""
    n = len(is_s)
    found = [a + 1 + np.flatnonzero(is_s[a + 1 : min(n, a + CHUNK + 1)] & ~is_s[a : min(n - 1, a + CHUNK)]) for a in range(0, n - 1, CHUNK)]
    out, at = _mapped(sum(map(len, found)), np.int32), 0
    for f in found:
        out[at : at + len(f)] = f
        at += len(f)
    return out


def _names(level: Level, stars: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each S* suffix to the next, both included (equal symbols rank by type, L first), and their number.

    Substrings are dealt to ranges by their first symbols and ranked range by
    range; substrings that agree in these are in one range.
    """
    bits = next(b for b in (8, 16, 32) if 2 * level.count < 1 << b)
    each, n = 64 // bits, len(stars)

    def sizes(own: np.ndarray) -> np.ndarray:
        following = stars[np.minimum(own + 1, n - 1)]
        return np.where(own + 1 < n, following - stars[own] + 1, 1)

    def key(own: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(own), np.uint64)
        for j in range(at, at + each):
            has = size > j
            place = stars[own] + np.minimum(j, size - 1)
            value = np.where(has, level.symbols[place].astype(np.uint64) * np.uint64(2) + level.is_s[place], np.uint64(0))
            out = out << np.uint64(bits) | value
        return out

    def rank(own: np.ndarray) -> np.ndarray:
        size, out, todo, at = sizes(own), np.zeros(len(own), np.int64), np.arange(len(own)), 0
        while len(todo):
            sub = key(own[todo], size[todo], at)
            order = np.lexsort((sub, out[todo]))
            r, s = out[todo][order], sub[order]
            other = np.r_[True, r[1:] != r[:-1]]
            new = other | np.r_[True, s[1:] != s[:-1]]
            place = np.arange(len(order))
            out[todo[order]] = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(other, place, 0))
            heads = np.flatnonzero(new)
            many = np.repeat(np.diff(np.r_[heads, len(order)]) > 1, np.diff(np.r_[heads, len(order)]))
            at += each
            todo = todo[order][many & (size[todo[order]] > at)]
        return np.unique(out, return_inverse=True)[1]

    ranges = -(-n // most)
    some = np.unique(np.linspace(0, n - 1, min(n, 64 * ranges)).astype(np.int64))
    bounds = np.unique(np.sort(key(some, sizes(some), 0))[:: max(1, len(some) // ranges)][1:])
    store, names, base = TupleStore(len(bounds) + 1, most), _mapped(n, np.int32), 0
    for a in range(0, n, CHUNK):
        own = np.arange(a, min(n, a + CHUNK))
        to = np.searchsorted(bounds, key(own, sizes(own), 0), side="right")
        order = np.argsort(to, kind="stable")
        store.push((to[order].astype(np.int32), own[order].astype(np.int32), np.zeros(len(own), np.uint8)))
    for zone in range(len(store.runs)):
        parts = list(store.pop(zone))
        if not parts:
            continue
        to, own, _ = _joined(parts)
        for r in np.unique(to).tolist():
            part = own[to == r].astype(np.int64)
            found = rank(part)
            names[part] = base + found
            base += int(found.max()) + 1
    store.close()
    return names, base


def _ranges(level: Level, wanted_s: bool, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of symbols, one after the other in the direction of the scan, that induce nothing into themselves.

    A symbol that is repeated may induce itself; it is a range of its own. A
    range has about ``most`` suffixes, if it has more than one symbol.
    """
    k = level.count
    flip = (lambda x: k - 1 - x) if wanted_s else (lambda x: x)
    nearest, sizes = np.full(k, k, np.int64), np.zeros(k, np.int64)
    for a in range(0, len(level.symbols), CHUNK):
        own = flip(level.symbols[a : a + CHUNK + 1].astype(np.int64))
        sizes += np.bincount(own[:CHUNK], minlength=k)
        induced = level.is_s[a : a + CHUNK][: len(own) - 1] == wanted_s
        np.minimum.at(nearest, own[1:][induced], own[:-1][induced])
    ends, total, lo = np.minimum.accumulate(nearest[::-1])[::-1], np.cumsum(sizes), 0
    while lo < k:
        full = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right"))
        hi = max(lo + 1, min(int(ends[lo]), full))
        yield (k - hi, k - lo) if wanted_s else (lo, hi)
        lo = hi


class _Seeds:
    """Sorted S* suffixes as they come, taken by symbol."""

    def __init__(self, blocks: Iterator[Tuples]):
        self.blocks, self.rest = blocks, None

    def below(self, hi: int) -> Iterator[Tuples]:
        while True:
            block = self.rest if self.rest is not None else next(self.blocks, None)
            self.rest = None
            if block is None:
                return
            n = int(np.searchsorted(block[0], hi))
            if n:
                yield tuple(c[:n] for c in block)
            if n < len(block[0]):
                self.rest = tuple(c[n:] for c in block)
                return


def _ascending(level: Level, seeds: _Seeds, most: int) -> TupleStore:
    """All L suffixes in order, induced from the sorted S* suffixes."""
    queue, larger = TupleQueue(level.count, most), TupleStore(level.count, most)
    scan, order = _Scan(level, False, queue), _Order(level)
    for lo, hi in _ranges(level, False, most):
        if hi - lo == 1:
            for symbols, suffixes, common in queue.rounds(lo):
                if len(symbols):
                    common = order.mend(symbols * 2, suffixes, common)
                    larger.push((symbols, suffixes, common))
                    scan.feed(suffixes, common)
            for symbols, suffixes, common in seeds.below(hi):
                scan.feed(suffixes, order.mend(symbols * 2 + 1, suffixes, common))
            continue
        found = queue.take(lo, hi, False)
        own = [found, *seeds.below(hi)]
        symbols, suffixes, common = _joined(own)
        if not len(symbols):
            continue
        key = symbols.astype(np.int64) * 2
        key[len(found[0]) :] += 1
        by = np.argsort(key, kind="stable")
        common = order.mend(key[by], suffixes[by], common[by])
        is_l = key[by] % 2 == 0
        if is_l.any():
            larger.push((symbols[by][is_l], suffixes[by][is_l], common[is_l]))
        scan.feed(suffixes[by], common)
    queue.close()
    return larger


def _descending(level: Level, larger: TupleStore, most: int) -> TupleStore:
    """All S suffixes, the largest first, induced from the sorted L suffixes."""
    queue, smaller = TupleQueue(level.count, most), TupleStore(level.count, most)
    scan, order = _Scan(level, True, queue), _Order(level)
    zone, held = -1, None

    def l_suffixes(lo: int, hi: int) -> Iterator[Tuples]:
        """The L suffixes of these symbols, the largest first, each with its common prefix with the one before."""
        nonlocal zone, held
        for z in range((hi - 1) >> larger.shift, (lo >> larger.shift) - 1, -1):
            if not larger.shift:
                parts = larger.chunks(z, reverse=True)
            else:
                if z != zone:
                    zone, held = z, list(larger.chunks(z))
                    held = _joined(held) if held else None
                if held is None:
                    continue
                a, b = np.searchsorted(held[0], [lo, hi])
                parts = [tuple(c[a:b] for c in held)] if a < b else []
            after = 0  # the common prefix of the tuple fed last and the next one
            for symbols, suffixes, common in parts:
                yield symbols[::-1], suffixes[::-1], np.r_[np.uint8(after), common[:0:-1]]
                after = int(common[0])

    for lo, hi in _ranges(level, True, most):
        if hi - lo == 1:
            for symbols, suffixes, common in queue.rounds(lo):
                if len(symbols):
                    common = order.mend(symbols * 2 + 1, suffixes, common)
                    smaller.push((symbols, suffixes, common))
                    scan.feed(suffixes, common)
            for symbols, suffixes, common in l_suffixes(lo, hi):
                scan.feed(suffixes, order.mend(symbols * 2, suffixes, common))
            continue
        found = queue.take(lo, hi, True)
        symbols, suffixes, common = _joined([found, *l_suffixes(lo, hi)])
        if not len(symbols):
            continue
        key = symbols.astype(np.int64) * 2
        key[: len(found[0])] += 1
        by = np.argsort(-key, kind="stable")
        common = order.mend(key[by], suffixes[by], common[by])
        is_s = key[by] % 2 == 1
        if is_s.any():
            smaller.push((symbols[by][is_s], suffixes[by][is_s], common[is_s]))
        scan.feed(suffixes[by], common)
    queue.close()
    return smaller


def _in_order(level: Level, larger: TupleStore, smaller: TupleStore) -> Iterator[Tuples]:
    """All suffixes in ascending order: of each symbol the L suffixes, then the S suffixes."""
    order = _Order(level)
    for zone in range(len(larger.runs)):
        low = larger.chunks(zone)
        high = _upwards(smaller.chunks(zone, reverse=True))
        if larger.shift:
            parts = [(0, t) for t in low] + [(1, t) for t in high]
            if not parts:
                continue
            symbols, suffixes, common = _joined([t for _, t in parts])
            key = symbols.astype(np.int64) * 2 + np.repeat([kind for kind, _ in parts], [len(t[0]) for _, t in parts])
            by = np.argsort(key, kind="stable")
            yield symbols[by], suffixes[by], order.mend(key[by], suffixes[by], common[by])
            continue
        for kind, parts in ((0, low), (1, high)):
            for symbols, suffixes, common in parts:
                yield symbols, suffixes, order.mend(symbols * 2 + kind, suffixes, common)
    larger.close()
    smaller.close()


def _upwards(parts: Iterator[Tuples]) -> Iterator[Tuples]:
    """Tuples stored from the largest down, read from the smallest up: each common prefix moves to the larger of its pair."""
    after = 0
    for symbols, suffixes, common in parts:
        yield symbols[::-1], suffixes[::-1], np.r_[np.uint8(after), common[:0:-1]]
        after = int(common[0])


def _sorted(level: Level, most: int) -> Iterator[Tuples]:
    """All suffixes of the level's string but the last, in order."""
    level.is_s = _types(level.symbols)
    stars = _stars(level.is_s)
    if not len(stars):
        return
    names, count = _names(level, stars, most)
    starts = stars if level.starts is None else level.starts[stars]
    if count == len(stars) or len(stars) > 1 and int(np.min(starts[1:] - starts[:-1])) >= level.depth:
        below = _by_name(level, stars, names)
    else:
        spans = np.ones(count, np.uint8)
        spans[names[:-1]] = np.minimum(starts[1:] - starts[:-1], level.depth)
        inner = Level(names, count, None, starts, spans, level.text, level.depth)
        below = _last_first(inner, most)
    seeds = _Seeds((level.symbols[stars[i]].astype(np.int32), stars[i], c) for _, i, c in below)
    larger = _ascending(level, seeds, most)
    yield from _in_order(level, larger, _descending(level, larger, most))


def _last_first(level: Level, most: int) -> Iterator[Tuples]:
    """All suffixes of the level's string: the last one, which is the smallest, and the others."""
    last = np.array([len(level.symbols) - 1], np.int32)
    yield level.symbols[last], last, np.zeros(1, np.uint8)
    for symbols, suffixes, common in _sorted(level, most):
        if last is not None:
            common = common.copy()
            common[:1], last = level.common(last, suffixes[:1]), None
        yield symbols, suffixes, common


def _by_name(level: Level, stars: np.ndarray, names: np.ndarray) -> Iterator[Tuples]:
    """S* suffixes by their names alone."""
    by, last = np.argsort(names, kind="stable").astype(np.int32), -1
    for a in range(0, len(by), CHUNK):
        own = by[a : a + CHUNK]
        before = np.r_[own[:1] if last < 0 else last, own[:-1]]
        common = level.common(stars[before], stars[own])
        if last < 0:
            common[0] = 0
        last = own[-1]
        yield names[own], own, common


def sort_suffixes(text: np.ndarray, depth: int, queue_tuples: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` but the last in order of their first ``depth`` characters, with the common prefix of each and the one before.

    ``text`` is uint8 and ends with the only kind of character 0 it may hold
    elsewhere as a separator. Yields blocks (suffixes, common prefixes). No
    queue holds more than ``queue_tuples`` tuples in memory but for the one
    chunk or zone that is read.
    """
    n = len(text)
    padded = _mapped(n + depth + 8, np.uint8)
    padded[:n] = text
    level = Level(padded[:n], int(text.max()) + 1, None, None, np.ones(256, np.uint8), padded, depth)
    for _, suffixes, common in _sorted(level, queue_tuples):
        yield suffixes, common


def repeats(text: np.ndarray, length: int, queue_tuples: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes that agree in their first ``length`` characters with others, class by class: blocks of suffixes, and where classes start."""
    held: list[np.ndarray] = []
    for suffixes, common in sort_suffixes(text, length, queue_tuples):
        starts = np.flatnonzero(common < length)
        if not len(starts):
            held.append(suffixes)
            continue
        own = np.concatenate([*held, suffixes[: starts[-1]]])
        heads = np.append(0, starts[:-1] + len(own) - starts[-1]) if held else starts[:-1]
        held = [suffixes[starts[-1] :]]
        if len(own):
            yield from _classes(own, np.unique(heads))
    if held:
        yield from _classes(np.concatenate(held), np.zeros(1, np.int64))


def _classes(suffixes: np.ndarray, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of two suffixes or more."""
    sizes = np.diff(np.append(heads, len(suffixes)))
    many = sizes > 1
    if many.any():
        kept = sizes[many]
        yield suffixes[np.repeat(many, sizes)], np.cumsum(kept) - kept
