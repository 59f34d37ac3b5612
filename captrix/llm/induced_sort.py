"""Repeated strings of a byte text by external induced sorting of its suffixes.

The suffixes that begin at a local minimum of character classes (S* suffixes) are ordered first: the substrings between them
are named in lexicographic order and the string of names is sorted by recursion, or in memory once it is short. Two scans
induce the rest. The first pops suffixes in ascending order and pushes the preceding suffix where it is larger (L
type); the second pops in descending order and pushes the preceding suffix where it is smaller (S type). The queues hold
tuples (first character, position, common prefix with the tuple pushed before it under that character). Tuples under one
character arrive in order, so a queue is a bucket of runs a character; runs beyond ``memory`` bytes go to a scratch file, and
so do the text, the ranks and the marks of large shards. A pushed tuple's common prefix is one more than the least one
among the suffixes popped since the last push under its character. Common prefixes saturate above the length asked for,
and suffixes equal that far may be in any order.

Scratch files belong to one task, are unlinked when opened and are made again if the task is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 17
#: Strings of names up to this length are sorted in memory.
BASE = 1 << 22
MEMORY = 64 << 20


def scratch(n: int, dtype, memory: int = MEMORY) -> np.ndarray:
    """An array of zeros, on disk beyond ``memory`` bytes."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


class RunQueue:
    """Runs of (position, common prefix) under keys; oldest first, or newest first with ``pop(..., back=True)``."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file = memory, 0, None
        self.runs: dict[int, list] = {}

    def push(self, key: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.runs.setdefault(key, []).append((positions, common))
        self.held += positions.nbytes + common.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for i, run in enumerate(runs):
                if len(run) == 2:
                    at = self.file.tell()
                    self.file.write(np.ascontiguousarray(run[0], np.int64).tobytes())
                    self.file.write(np.ascontiguousarray(run[1], np.int32).tobytes())
                    runs[i] = (at, len(run[0]), None)
        self.held = 0

    def _load(self, run) -> tuple[np.ndarray, np.ndarray]:
        if len(run) == 2:
            self.held -= run[0].nbytes + run[1].nbytes
            return run
        self.file.seek(run[0])
        data = self.file.read(12 * run[1])
        return np.frombuffer(data, np.int64, run[1]), np.frombuffer(data, np.int32, run[1], 8 * run[1])

    def pop(self, key: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs under a key, also those pushed meanwhile; small neighbours are joined."""
        while runs := self.runs.get(key):
            some = []
            while runs and sum(len(s[0]) for s in some) < CHUNK:
                some.append(self._load(runs.pop(-1 if back else 0)))
            if not self.runs[key]:
                del self.runs[key]
            if back:
                some = [(p[::-1], c[::-1]) for p, c in some]
            if len(some) == 1:
                yield some[0]
            else:
                yield np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])


class Minima:
    """Range minima of an array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of values[lo..hi], hi included."""
        size = hi - lo + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.levels[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << int(k)) + 1])
        return out


class _Scan:
    """One scan's queue: pushes predecessors and works out their common prefixes."""

    def __init__(self, text: np.ndarray, limit: int, memory: int):
        self.text, self.limit, self.queue = text, limit, RunQueue(memory)
        self.carry: dict[int, int] = {}
        self.floor = limit  # least common prefix since the carries were last brought up to date

    def push(self, positions: np.ndarray, common: np.ndarray, want) -> None:
        """Push the predecessors that ``want(characters)`` takes, of suffixes popped in this order.

        ``common[k]`` is the common prefix of suffix k with the one popped before it.
        """
        has = np.flatnonzero(positions > 0)
        before = self.text[positions[has] - 1]
        take = want(before)
        at, chars = has[take], before[take].astype(np.int64)
        least = int(common.min())
        if len(at):
            order = np.argsort(chars.astype(np.uint8) if self.text.dtype == np.uint8 else chars, kind="stable")
            at, chars = at[order], chars[order]
            new = np.concatenate([[True], chars[1:] != chars[:-1]])
            lo = np.where(new, 0, np.concatenate([[0], at[:-1] + 1]))
            minima = Minima(common)
            value = minima.over(lo, at)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            keys = chars[first].tolist()
            tails = at[last]
            inner = tails + 1 < len(common)
            rest = np.full(len(tails), self.limit, common.dtype)
            if inner.any():
                rest[inner] = minima.over(tails[inner] + 1, np.full(int(inner.sum()), len(common) - 1))
            starts = np.minimum(value[first], [min(self.carry.get(c, 0), self.floor) for c in keys])
            value[first] = starts
            value = np.minimum(value + 1, self.limit).astype(np.int32)
        if least == 0:
            self.carry.clear()  # a carry that is missing is 0
        elif least < self.floor:
            self.carry = {c: min(v, least) for c, v in self.carry.items()}
        if len(at):
            moved = positions[at] - 1
            for c, a, b, r in zip(keys, first.tolist(), (last + 1).tolist(), rest.tolist(), strict=True):
                self.carry[c] = r
                self.queue.push(c, moved[a:b], value[a:b])


def _classes(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of S type (smaller than its successor)."""
    n = len(text)
    out = np.zeros(n, bool)
    follows = False
    size = 1 << 20
    for end in range(n, 0, -size):
        start = max(0, end - size)
        part = np.asarray(text[start : min(end + 1, n)]).astype(np.int64)
        step = np.zeros(end - start, np.int8)
        d = np.sign(part[1:] - part[:-1]).astype(np.int8)
        step[: len(d)] = d
        if end == n:
            step[-1] = -1
        known = np.flatnonzero(step)
        nxt = np.searchsorted(known, np.arange(len(step)))
        s = np.full(len(step), follows)
        inside = nxt < len(known)
        s[inside] = step[known[nxt[inside]]] > 0
        out[start:end] = s
        follows = bool(s[0])
    return out


def _names(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Dense ranks of the substrings at ``starts``; of two that begin alike, the shorter one is larger, but the last, which
    the end of the text cuts off, is smaller."""
    final = len(starts) - 1
    if text.dtype == np.uint8:
        width = 8
        padded = np.concatenate([np.asarray(text), np.full(8, 255, np.uint8)])
        view = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), shape=(len(text) + 1,), strides=(1,))

        def chunk(who: np.ndarray, done: int) -> np.ndarray:
            at, left = starts[who] + done, sizes[who] - done
            keys = view[np.minimum(at, len(text))].astype(np.uint64)
            free = np.clip(8 - left, 0, 8)
            mask = np.where(free >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * free.clip(0, 7)).astype(np.uint64)) - np.uint64(1))
            return np.where(who == final, keys & ~mask, keys | mask)
    else:
        width = 1
        top = np.int64(np.iinfo(np.int64).max)

        def chunk(who: np.ndarray, done: int) -> np.ndarray:
            return np.where(sizes[who] > done, text[np.minimum(starts[who] + done, len(text) - 1)], np.where(who == final, -1, top))

    keys = chunk(np.arange(len(starts)), 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    done = width
    while True:
        group = np.cumsum(new) - 1
        longest = np.maximum.reduceat(sizes[order], np.flatnonzero(new))
        many = np.diff(np.concatenate([np.flatnonzero(new), [len(new)]])) > 1
        slots = np.flatnonzero((many & (longest > done))[group])
        if not len(slots):
            break
        who = order[slots]
        keys = chunk(who, done)
        inner = np.lexsort((keys, group[slots]))
        order[slots] = who[inner]
        keys, g = keys[inner], group[slots]
        new[slots] = np.concatenate([[True], (keys[1:] != keys[:-1]) | (g[1:] != g[:-1])])
        done += width
    group = np.cumsum(new) - 1
    at = int(np.flatnonzero(order == final)[0])
    first = int(np.searchsorted(group, group[at]))
    if first + 1 < len(group) and group[first + 1] == group[at]:  # what is equal up to the end and goes on is larger
        order[first], order[at] = order[at], order[first]
        new[first + 1] = True
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _sort_in_memory(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` names, by prefix doubling of what is equal."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    new = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    rank = np.full(m + 1, -1, np.int64)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.concatenate([starts, [m]])))
    sizes = np.repeat(np.diff(np.concatenate([starts, [m]])), np.diff(np.concatenate([starts, [m]])))
    open_ = order[sizes > 1]
    h = 1
    while len(open_) and h < depth:
        key = rank[open_] * np.int64(m + 1) + rank[np.minimum(open_ + h, m)] + 1
        inner = np.argsort(key, kind="stable")
        open_, key = open_[inner], key[inner]
        r = rank[open_]
        head = np.concatenate([[True], r[1:] != r[:-1]])
        at = np.arange(len(open_))
        slot = r + at - np.maximum.accumulate(np.where(head, at, 0))
        order[slot] = open_
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(open_)]]))
        rank[open_] = np.repeat(slot[first], count)
        open_ = open_[np.repeat(count > 1, count)]
        h *= 2
    return order


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, eight bytes at a time, saturating at ``limit``."""
    n = len(text)
    padded = np.concatenate([np.asarray(text), np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), shape=(n + 1,), strides=(1,))
    out = np.zeros(len(a), np.int32)
    live, depth = np.arange(len(a)), 0
    while len(live) and depth < limit:
        pa, pb = a[live] + depth, b[live] + depth
        x = view[np.minimum(pa, n)] ^ view[np.minimum(pb, n)]
        x = x.astype(np.uint64)
        same = x == 0
        high = np.where(x > 0, np.frexp((x | np.uint64(1)).astype(np.float64))[1], 0)
        # frexp may round a value just below a power of two up: then the bit found is one too high, which the clip mends
        lead = np.clip((64 - high) // 8, 0, 7)
        exact = (x >> (np.uint64(56) - (8 * lead).astype(np.uint64))) > 0
        lead = np.where(exact, lead, np.minimum(lead + 1, 7))
        room = n - np.maximum(pa, pb)
        gain = np.where(same, 8, lead)
        out[live] = depth + np.minimum(gain, np.maximum(room, 0))
        live = live[same & (room > 8)]
        depth += 8
    return np.minimum(out, limit)


def _run(text: np.ndarray, at: int, limit: int) -> int:
    """Length of the run of one character that begins at a place, saturating at ``limit``."""
    part = np.asarray(text[at : at + limit])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def minima_order(text: np.ndarray, limit: int, base: int = BASE, memory: int = MEMORY) -> np.ndarray:
    """Positions of the S* suffixes in order of their first ``limit`` characters at least."""
    s = _classes(text)
    starts = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    del s
    if not len(starts):
        return starts
    sizes = np.concatenate([np.diff(starts) + 1, [len(text) - starts[-1]]])
    names = _names(text, starts, sizes)
    if len(starts) <= base:
        return starts[_sort_in_memory(names, limit)]
    held = scratch(len(names), np.int64, memory)
    held[:] = names
    out = scratch(len(names), np.int64, memory)
    at = len(names)
    for positions, _ in descending(held, limit, base, memory, prefixes=False):
        out[at - len(positions) : at] = positions[::-1]
        at -= len(positions)
    return starts[out]


def descending(text: np.ndarray, limit: int, base: int = BASE, memory: int = MEMORY, prefixes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order as (positions, common prefixes with the suffix yielded before)."""
    n = len(text)
    if n == 0:
        return
    limit = limit + 8
    seeds = minima_order(text, limit, base, memory)
    seed_chars = text[seeds]
    seed_common = np.zeros(len(seeds), np.int32)
    if prefixes and len(seeds) > 1:
        for at in range(1, len(seeds), CHUNK):
            end = min(at + CHUNK, len(seeds))
            seed_common[at:end] = _common(text, seeds[at - 1 : end - 1], seeds[at:end], limit)
        seed_common[1:][seed_chars[1:] != seed_chars[:-1]] = 0
    bounds = np.flatnonzero(np.concatenate([[True], seed_chars[1:] != seed_chars[:-1]])) if len(seeds) else np.zeros(0, np.int64)
    of_seed = {int(seed_chars[b]): (int(b), int(e)) for b, e in zip(bounds, [*bounds[1:], len(seeds)][: len(bounds)], strict=True)}
    large, order = _Scan(text, limit, memory), RunQueue(memory)
    large.push(np.array([n]), np.zeros(1, np.int32), lambda c: np.ones(len(c), bool))
    pending = sorted(of_seed, reverse=True)
    last_char = -1
    while True:
        keys = [k for k in large.queue.runs if k > last_char]
        c = min([*keys, *([pending[-1]] if pending else [])], default=None)
        if c is None:
            break
        last_char, tail = c, -1
        first = True
        for positions, common in large.queue.pop(c):
            if first:
                common = common.copy()
                common[0] = 0
                first = False
            order.push(c, positions, common)
            large.push(positions, common, lambda x, c=c: x >= c)
            tail = int(positions[-1])
        if pending and pending[-1] == c:
            pending.pop()
            b, e = of_seed[c]
            for at in range(b, e, CHUNK):
                end = min(at + CHUNK, e)
                common = seed_common[at:end].copy()
                if at == b:
                    common[0] = min(_run(text, tail, limit), _run(text, int(seeds[b]), limit)) if tail >= 0 and prefixes else 0
                large.push(seeds[at:end], common, lambda x, c=c: x > c)
    small = _Scan(text, limit, memory)
    before = None
    while True:
        keys = [*(k for k in small.queue.runs), *order.runs]
        c = max(keys, default=None)
        if c is None:
            break
        tail, first = -1, True
        for positions, common in small.queue.pop(c):
            if first:
                common = common.copy()
                common[0] = 0
                first = False
            yield positions, common
            small.push(positions, common, lambda x, c=c: x <= c)
            tail = int(positions[-1])
        before = min(_run(text, tail, limit), limit) if tail >= 0 else None
        for positions, lower in order.pop(c, back=True):
            if before is None:
                before = 0
            elif tail >= 0:
                before = min(before, _run(text, int(positions[0]), limit)) if prefixes else 0
            tail = -1
            common = np.concatenate([[before], lower[:-1]]).astype(np.int32)
            before = int(lower[-1])
            yield positions, common
            small.push(positions, common, lambda x, c=c: x < c)


def repeated(text: np.ndarray, length: int, base: int = BASE, memory: int = MEMORY) -> np.ndarray:
    """True at positions whose first ``length`` bytes begin elsewhere too. 0 separates pieces; strings that hold it count as well."""
    marks = scratch(len(text), bool, memory)
    last = -1
    for positions, common in descending(text, length, base, memory):
        same = np.flatnonzero(common >= length)
        marks[positions[same]] = True
        above = same - 1
        marks[positions[above[above >= 0]]] = True
        if len(same) and same[0] == 0 and last >= 0:
            marks[last] = True
        last = int(positions[-1])
    return marks
