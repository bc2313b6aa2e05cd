"""Suffix arrays with common prefixes by induced sorting, whose queues of suffixes lie on disk.

A suffix is of type S if it is smaller than the one behind it, else of type L; the first S of a row of them is a corner.
Corners are sorted by recursion: the pieces of text between them get names in their order, and the suffixes of the text of
names are sorted first. All others follow from them in two sweeps, upwards for L and downwards for S: a suffix that is met
puts the one before it into a priority queue, where it waits for its turn, by its first symbol and then by arrival. Tuples
carry the place of a suffix and what it has in common with the suffix before it in its sweep.

The text itself is held, a byte a symbol; tuples, eight bytes each and several for a symbol, wait in files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues of one sweep, or one tape, hold before they are written out; symbols of a text that is sorted in memory.
MEMORY = 1 << 20
#: Tuples that are worked on together.
STEP = 1 << 17


class Scratch:
    """Files of one task in the folder that all machines share; made when first written to, gone when closed."""

    def __init__(self, folder: str):
        self.folder, self.files, self.written = f"{folder}/scratch-{uuid.uuid4().hex}", None, 0

    def write(self, parts: list[np.ndarray]) -> str:
        from pyarrow import fs

        if self.files is None:
            self.files, self.path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
            self.files.create_dir(self.path)
        self.written += 1
        name = f"{self.path}/{self.written}"
        with self.files.open_output_stream(name) as out:
            for part in parts:
                out.write(np.ascontiguousarray(part).data)
        return name

    def open(self, name: str):
        return self.files.open_input_file(name)

    def delete(self, name: str) -> None:
        self.files.delete_file(name)

    def close(self) -> None:
        if self.files is not None:
            self.files.delete_dir(self.path)
            self.files = None


def _read(file, at: int, n: int) -> np.ndarray:
    return np.frombuffer(file.read_at(8 * n, 8 * at), np.int64)


class Tape:
    """Numbers in the order they were put in, read block by block from either end."""

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.held, self.n, self.blocks = scratch, memory, [], 0, []

    def put(self, numbers: np.ndarray) -> None:
        self.held.append(numbers)
        self.n += len(numbers)
        if self.n > self.memory:
            self.blocks.append((self.scratch.write(self.held), self.n))
            self.held, self.n = [], 0

    def read(self, backward: bool = False) -> Iterator[np.ndarray]:
        rest = self.held[::-1] if backward else self.held
        if backward:
            for block in rest:
                yield from (block[max(i - STEP, 0) : i] for i in range(len(block), 0, -STEP))
        for name, n in self.blocks[::-1] if backward else self.blocks:
            with self.scratch.open(name) as file:
                for i in range(n, 0, -STEP) if backward else range(0, n, STEP):
                    begin, end = (max(i - STEP, 0), i) if backward else (i, min(i + STEP, n))
                    yield _read(file, begin, end - begin)
            self.scratch.delete(name)
        if not backward:
            for block in rest:
                yield from (block[i : i + STEP] for i in range(0, len(block), STEP))


class Queue:
    """A priority queue for rising keys: tuples wait in ranges of keys, each in order of arrival.

    What is held beyond `memory` tuples goes to a file, range by range, and comes back as its range's turn comes.
    """

    def __init__(self, ranges: int, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.n = scratch, memory, 0
        self.held: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.spilled: list[tuple] = []  # open file, where each range begins

    def put(self, ranges: np.ndarray, tuples: np.ndarray) -> None:
        """Adds tuples, which are sorted by their range."""
        if not len(tuples):
            return
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)])).tolist()
        for a, b, r in zip(cuts[:-1], cuts[1:], ranges[cuts[:-1]].tolist(), strict=True):
            self.held[r].append(tuples[a:b])
        self.n += len(tuples)
        if self.n > self.memory:
            sizes = np.array([sum(map(len, x)) for x in self.held], np.int64)
            name = self.scratch.write([p for x in self.held for p in x])
            self.spilled.append((self.scratch.open(name), np.concatenate(([0], np.cumsum(sizes)))))
            self.held, self.n = [[] for _ in self.held], 0

    def take(self, r: int) -> Iterator[np.ndarray]:
        """The range's tuples, also those that are put in while it is read."""
        done = 0
        while done < len(self.spilled) or self.held[r]:
            if done < len(self.spilled):
                file, begins = self.spilled[done]
                done += 1
                for i in range(int(begins[r]), int(begins[r + 1]), STEP):
                    yield _read(file, i, min(STEP, int(begins[r + 1]) - i))
            else:
                block, self.held[r] = np.concatenate(self.held[r]), []
                self.n -= len(block)
                yield from (block[i : i + STEP] for i in range(0, len(block), STEP))

    def close(self) -> None:
        for file, _ in self.spilled:
            file.close()


def is_small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol is the only one of the smallest kind."""
    small = np.ones(len(text), bool)
    differ = np.append(text[:-1] != text[1:], True)
    at = np.where(differ, np.arange(len(text), dtype=np.int32 if len(text) < 1 << 31 else np.int64), len(text))
    small[:-1] = text[:-1] < text[1:]
    return small[np.minimum.accumulate(at[::-1])[::-1]]


def _refine(rank: np.ndarray, among: np.ndarray, by: np.ndarray) -> None:
    """Tells ties apart: rank is the number of smaller elements; `among` holds whole groups of ties, `by` what decides."""
    order = np.lexsort((by, rank[among]))
    among, by = among[order], by[order]
    old = rank[among]
    at, new = np.arange(len(old)), np.append(True, old[1:] != old[:-1])
    group = np.maximum.accumulate(np.where(new, at, 0))
    first = np.maximum.accumulate(np.where(new | np.append(True, by[1:] != by[:-1]), at, 0))
    rank[among] = old + first - group


def _ranks(values: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[inverse]


def _in_memory(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by ranks of 1, 2, 4, ... symbols; only ties are sorted again."""
    rank, step = _ranks(text), 1
    while True:
        among = np.flatnonzero(np.bincount(rank, minlength=len(text))[rank] > 1)
        if not len(among):
            break
        ahead = among + step
        _refine(rank, among, np.where(ahead < len(text), rank[np.minimum(ahead, len(text) - 1)] + 1, 0))
        step *= 2
    order = np.empty(len(text), np.int64)
    order[rank] = np.arange(len(text))
    return order


def _names(text: np.ndarray, kinds: int, corners: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of the text from each corner to the next, equal for equal texts, without gaps; and how many there are.

    Where a text ends, a symbol larger than all others follows: of two that begin alike, the one that turns upwards
    there is larger. Texts are compared several symbols at a time.
    """
    lengths = np.append(np.diff(corners) + 1, 1)
    bits = int(kinds).bit_length()
    in_bytes = text.dtype == np.uint8 and int(text.max(initial=0)) < 255
    wide = 8 if in_bytes else 63 // bits
    eight = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8) if in_bytes else None

    def word(which: np.ndarray, done: int) -> np.ndarray:
        if in_bytes:
            left = np.clip(lengths[which] - done, 0, 8)
            found = eight[np.minimum(corners[which] + done, len(text))].copy().view(">u8")[:, 0].astype(np.uint64)
            return np.where(left == 8, found, found | np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(left, 7)).astype(np.uint64))
        found = np.zeros(len(which), np.int64)
        for i in range(done, done + wide):
            inside = i < lengths[which]
            found = found << bits | np.where(inside, text[np.where(inside, corners[which] + i, 0)], np.int64(kinds))
        return found

    rank, done = _ranks(word(np.arange(len(corners)), 0)), wide
    while True:
        longer = np.zeros(len(corners), bool)
        longer[rank[lengths > done]] = True
        among = np.flatnonzero((longer & (np.bincount(rank, minlength=len(rank)) > 1))[rank])
        if not len(among):
            break
        _refine(rank, among, word(among, done))
        done += wide
    used = np.zeros(len(corners), np.int64)
    used[rank] = 1
    return np.cumsum(used)[rank] - 1, int(used.sum())


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, `most` at most; eight are compared at once, so text goes on for as many more."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    found, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for done in range(0, most, 8):
        differ = words[a[left] + done].copy().view("<u8")[:, 0] ^ words[b[left] + done].copy().view("<u8")[:, 0]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        found[left] += same
        left = left[differ == 0]
    return np.minimum(found, most)


class _Carried:
    """What suffixes that arrive in a queue have in common with the one of their symbol that arrived before.

    It is one more than the least of what was met in between, since the suffix behind that one. Values are cut at `most`,
    so the last places where each value or a smaller one was met tell the least of any stretch that ends now.
    """

    def __init__(self, kinds: int, most: int):
        self.most, self.met = most, 0
        self.last = np.full(kinds, -1, np.int64)  # where the suffix was met that put in the last one of a symbol
        self.low = np.full(most + 1, -1, np.int64)

    def arrive(self, shared: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For suffixes put in by the ones met at `at` of a block, sorted by key and then by place; shared: the block's own values."""
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        least = np.minimum.accumulate(shared)[at].astype(np.int64)
        before = self.last[keys]
        least = np.where(new, np.minimum(least, np.searchsorted(self.low, before, "right")), least)
        inner = np.flatnonzero(~new)
        if len(inner):
            begin, size = at[inner - 1] + 1, at[inner] - at[inner - 1]
            level = np.frexp(size)[1] - 1
            row, wide = shared, 1
            for k in range(int(level.max()) + 1):
                now = np.flatnonzero(level == k)
                least[inner[now]] = np.minimum(row[begin[now]], row[begin[now] + size[now] - wide])
                if len(row) > wide:
                    row = np.minimum(row[:-wide], row[wide:])
                wide *= 2
        found = np.where(new & (before < 0), 0, np.minimum(least + 1, self.most))
        final = np.append(new[1:], True) if len(keys) else new
        self.last[keys[final]] = self.met + at[final]
        falling = -np.minimum.accumulate(shared[::-1]).astype(np.int64)
        back = np.searchsorted(falling, -np.arange(self.most + 1))
        self.low = np.where(back < len(shared), self.met + len(shared) - 1 - back, self.low)
        self.met += len(shared)
        return found


def sweep(text: np.ndarray, padded: np.ndarray, kinds: int, seeds: Iterator[np.ndarray], up: bool, scratch: Scratch, memory: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all suffixes that are met, in order, as (tuples, whether they are seeds).

    A tuple is place * 256 + what it has in common with the one met before, `most` at most (0: not wanted). Upwards, seeds
    are corners and all of type L are met before the seeds of their symbol; downwards, seeds are of type L and all of type S
    are met. Keys, not symbols, are compared, so that both sweeps rise.

    A block is worked on at once as far as nothing that its own suffixes put in comes before its last; ranges of keys are
    small enough that this is most of the time a whole range.
    """
    counts = np.bincount(text, minlength=kinds)
    counts = counts if up else counts[::-1]
    limit = max(1024, int(len(text) ** 0.5))
    heavy, part = counts > limit, (np.cumsum(counts) - counts) // limit
    breaks = np.append(False, heavy[1:] | heavy[:-1] | (part[1:] != part[:-1]))
    range_of = np.cumsum(breaks)
    ends = np.append(np.flatnonzero(breaks) - 1, kinds - 1)
    queue, carried = Queue(len(ends), scratch, memory), _Carried(kinds, most) if most else None
    last = [-1, -1, 0]  # place, key and kind of the suffix met last
    short = np.uint8 if kinds <= 1 << 8 else np.uint16 if kinds <= 1 << 16 else np.int64  # short keys are sorted faster

    def keys_of(places: np.ndarray) -> np.ndarray:
        found = text[places].astype(np.int64)
        return found if up else kinds - 1 - found

    def work(tuples: np.ndarray, keys: np.ndarray, seed: np.ndarray, current: int) -> tuple[np.ndarray, np.ndarray]:
        """The tuples with what they have in common; and, sorted, those that they put into the current range (-1: all are queued)."""
        places = tuples >> 8
        shared = (tuples & 255).astype(np.uint8)
        if carried:
            before = np.append(last[0], places[:-1]), np.append(last[1], keys[:-1]), np.append(last[2], seed[:-1])
            shared[before[1] != keys] = 0
            seam = np.flatnonzero((before[1] == keys) & (before[2] == 0) & (seed == 1))
            if len(seam):
                shared[seam] = common(padded, before[0][seam], places[seam], most)
            last[:] = places[-1], keys[-1], seed[-1]
        ahead = places - 1
        wanted = keys_of(np.maximum(ahead, 0))
        at = np.flatnonzero((ahead >= 0) & (wanted >= keys + seed))
        order = np.argsort(wanted[at].astype(short), kind="stable")
        at = at[order]
        target = wanted[at]
        found = ahead[at] << 8
        if carried:
            found |= carried.arrive(shared, at, target)
        ranges = range_of[target]
        here = ranges == current
        queue.put(ranges[~here], found[~here])
        return places << 8 | shared, found[here]

    feed, rest = iter(seeds), np.zeros(0, np.int64)

    def seeds_up_to(end: int) -> Iterator[np.ndarray]:
        nonlocal rest
        while rest is not None:
            if not len(rest):
                rest = next(feed, None)
                continue
            inside = int(np.searchsorted(keys_of(rest >> 8), end, "right"))
            if inside:
                yield rest[:inside]
            rest = rest[inside:]
            if len(rest):
                return

    for r, end in enumerate(ends.tolist()):
        if heavy[end]:  # a range of one key: first come, first served
            for block in queue.take(r):
                yield work(block, keys_of(block >> 8), np.zeros(len(block), np.int64), -1)[0], np.zeros(len(block), bool)
            for block in seeds_up_to(end):
                yield work(block, keys_of(block >> 8), np.ones(len(block), np.int64), -1)[0], np.ones(len(block), bool)
            continue
        waiting, own = list(queue.take(r)), list(seeds_up_to(end))
        tuples = np.concatenate([*waiting, *own]) if waiting or own else np.zeros(0, np.int64)
        seed = np.repeat([0, 1], [sum(map(len, waiting)), sum(map(len, own))])
        while len(tuples):
            keys = keys_of(tuples >> 8)
            order = np.argsort(2 * keys + seed, kind="stable")
            tuples, keys, seed = tuples[order], keys[order], seed[order]
            ahead = (tuples >> 8) - 1
            wanted = keys_of(np.maximum(ahead, 0))
            puts = np.where((ahead >= 0) & (wanted >= keys + seed), 2 * wanted, 2 * kinds)
            least = np.minimum.accumulate(puts)
            late = np.flatnonzero(2 * keys[1:] + seed[1:] > least[:-1])
            n = int(late[0]) + 1 if len(late) else len(tuples)
            met, more = work(tuples[:n], keys[:n], seed[:n], r)
            yield met, seed[:n].astype(bool)
            seed = np.append(seed[n:], np.zeros(len(more), np.int64))
            tuples = np.append(tuples[n:], more)
    queue.close()


def _reversed(tape: Tape) -> Iterator[np.ndarray]:
    """The tape's tuples from the end, each with what it has in common with the one behind it."""
    shared = 0
    for block in tape.read(backward=True):
        own = block & 255
        yield ((block >> 8 << 8) | np.append(own[1:], shared))[::-1]
        shared = own[0]


def descending(text: np.ndarray, kinds: int, scratch: Scratch, *, memory: int = MEMORY, most: int = 0) -> Iterator[np.ndarray]:
    """Blocks of tuples of all suffixes but the last symbol's, from the largest down.

    text: symbols below `kinds`, its last one 0, which occurs nowhere else; bytes, if common prefixes are wanted (most > 0).
    """
    small = is_small(text)
    corners = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    del small
    names, n = _names(text, kinds, corners)
    if n == len(corners):
        order = np.empty(n, np.int64)
        order[names] = np.arange(n)
    else:
        order = ascending(names, n, scratch, memory=memory)
    del names
    sorted_corners = corners[order]
    del order, corners
    padded = np.append(text, np.zeros(most + 8, text.dtype)) if most else text
    text = padded[: len(text)]

    def seeds() -> Iterator[np.ndarray]:
        for i in range(0, len(sorted_corners), STEP):
            block = sorted_corners[i : i + STEP]
            shared = np.zeros(len(block), np.int64)
            if most and len(block):
                before = sorted_corners[max(i - 1, 0) : i - 1 + len(block)] if i else np.append(block[:1], block[:-1])
                shared = common(padded, before, block, most)
                if i == 0:
                    shared[0] = 0
            yield block << 8 | shared

    large = Tape(scratch, memory)
    for tuples, seed in sweep(text, padded, kinds, seeds(), True, scratch, memory, most):
        large.put(tuples[~seed])
    for tuples, _ in sweep(text, padded, kinds, _reversed(large), False, scratch, memory, most):
        yield tuples


def ascending(text: np.ndarray, kinds: int, scratch: Scratch, *, memory: int = MEMORY) -> np.ndarray:
    """All suffixes in order; texts of up to `memory` symbols are sorted at once."""
    if len(text) <= memory:
        return _in_memory(text)
    order, at = np.empty(len(text), np.int64), len(text)
    for tuples in descending(text, kinds, scratch, memory=memory):
        order[at - len(tuples) : at] = (tuples >> 8)[::-1]
        at -= len(tuples)
    order[0] = len(text) - 1
    return order
