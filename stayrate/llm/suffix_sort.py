"""External induced suffix sorting of one shard, with common-prefix values.

Suffixes whose first byte is smaller than their successor's order (S) and greater ones (L) are
told apart; the leftmost S suffixes are named, ranked, and seed the rest. Induction scans the
suffixes in order: each scanned one puts its predecessor into the queue of its first byte, with
the common prefix it shares with the one put there before, which is one more than the least
common prefix scanned in between. A queue gives its tuples back in the order they came, so the
next byte's suffixes come out sorted. Queues, text and orders go to files beyond a fixed memory.

Common prefixes are counted up to LIMIT.
"""

from __future__ import annotations

import os

import numpy as np

LIMIT = 200
#: Ends every string of the shard, and is not a byte of UTF-8 text. PAD sorts after it.
END, PAD = 0xFE, 0xFF
#: Tuples that the queues hold in memory, and entries of an array that stays in memory.
QUEUE_TUPLES, IN_MEMORY = 1 << 23, 1 << 26
#: Leftmost S suffixes that are sorted together, unless more of them open with the same two bytes.
SEEDS_AT_ONCE = 1 << 18
_BLOCK = 1 << 16
_LEVEL = np.frexp(np.arange(_BLOCK + 1))[1].astype(np.int64) - 1  # floor of the binary logarithm


class Scratch:
    """Arrays and queues in a folder of the task, which its owner removes."""

    def __init__(self, folder: str):
        self.folder, self.number = folder, 0

    def path(self) -> str:
        self.number += 1
        return os.path.join(self.folder, f"{self.number}.bin")

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= IN_MEMORY:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))


class Queues:
    """One first-in-first-out queue of (position, common prefix) per byte; full ones go to disk."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held = scratch, 0
        self.parts: dict[int, list] = {}
        self.files: dict[int, str] = {}

    def put(self, byte: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self.parts.setdefault(byte, []).append((positions, shared))
        self.held += len(positions)
        if self.held > QUEUE_TUPLES:
            for each in list(self.parts):
                with open(self.files.setdefault(each, self.scratch.path()), "ab") as file:
                    for positions, shared in self.parts.pop(each):
                        rows = np.empty(len(positions), [("at", np.int64), ("lcp", np.uint8)])
                        rows["at"], rows["lcp"] = positions, shared
                        rows.tofile(file)
            self.held = 0

    def take(self, byte: int):
        """The queue's tuples in pieces, in the order they were put; it is empty then."""
        # Both at once: what is put meanwhile may move parts to files.
        file, parts = self.files.pop(byte, None), self.parts.pop(byte, [])
        self.held -= sum(len(positions) for positions, _ in parts)
        if file is not None:
            rows = np.memmap(file, [("at", np.int64), ("lcp", np.uint8)], "r")
            for first in range(0, len(rows), QUEUE_TUPLES):
                part = rows[first : first + QUEUE_TUPLES]
                yield np.array(part["at"]), np.array(part["lcp"])
            del rows
            os.remove(file)
        yield from joined(parts)


def joined(parts: list):
    """Stretches of (position, common prefix) as few arrays of bounded length."""
    some, size = [], 0
    for part in parts:
        some.append(part)
        size += len(part[0])
        if size >= QUEUE_TUPLES or part is parts[-1]:
            yield tuple(np.concatenate(columns) for columns in zip(*some))
            some, size = [], 0


def _order(group: np.ndarray) -> np.ndarray:
    """A stable order by ``group``, numbers below 2 ** 31 of fewer than 2 ** 32 items: plain numbers sort faster."""
    packed = (group << 32) | np.arange(len(group))
    packed.sort()
    return packed & 0xFFFFFFFF


def seeds(padded: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leftmost S suffixes in order up to LIMIT bytes, and the common prefix of each with the one before.

    They are dealt by their first two bytes, and about SEEDS_AT_ONCE are sorted together, so that what
    sorting holds does not grow with the shard. The end of the text sorts before everything.
    ``padded`` is the text and LIMIT + 8 bytes of PAD.
    """
    n = len(small)
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    kind = position_type(n)
    leftmost = small[1:] & ~small[:-1]
    found = [np.zeros(0, kind)]
    for a in range(0, len(leftmost), _BLOCK):
        found.append((np.flatnonzero(leftmost[a : a + _BLOCK]) + (a + 1)).astype(kind))
    unsorted = np.concatenate(found)
    del leftmost, found
    opening, counts = np.empty(len(unsorted), np.uint16), np.zeros(1 << 16, np.int64)
    for a in range(0, len(unsorted), _BLOCK):
        part = opening[a : a + _BLOCK] = words[unsorted[a : a + _BLOCK]] >> np.uint64(48)
        counts += np.bincount(part.astype(np.int64), minlength=1 << 16)
    ends = np.cumsum(counts)
    order, shared = np.empty(len(unsorted), kind), np.empty(len(unsorted), np.uint8)
    first, done = 0, 0
    while done < len(order):
        last = max(first, int(np.searchsorted(ends, done + SEEDS_AT_ONCE, "right")) - 1)
        end = int(ends[last])
        if end > done:
            some = unsorted[(opening >= first) & (opening <= last)].astype(np.int64)
            shared[done:end] = _sort_seeds(words, n, some)
            order[done:end] = some
            if done:
                shared[done] = padded[order[done]] == padded[order[done - 1]]  # the second byte differs
        first, done = last + 1, end
    return order, shared


def _sort_seeds(words: np.ndarray, n: int, order: np.ndarray) -> np.ndarray:
    """Sort the suffixes ``order`` in place; returns the common prefix of each with the one before.

    Eight bytes are compared at a time, and of the suffixes only those that still tie; two that tie
    with no other are compared with each other. ``words`` are the eight bytes from each position of a
    text of ``n`` bytes.
    """
    shared = np.full(len(order), LIMIT, np.uint8)
    shared[:1] = 0

    def keys(at: np.ndarray) -> np.ndarray:
        found = words[at].astype(np.uint64)
        beyond = np.flatnonzero(at > n - 8)
        # the bytes of the text, then zeros; a shift by 64 bits is two
        half = (8 - np.clip(n - at[beyond], 0, 8)).astype(np.uint64) * np.uint64(4)
        found[beyond] = found[beyond] >> half >> half << half << half
        return found

    def settle(slot: np.ndarray, offset: int) -> None:
        """Order pairs that tie up to ``offset`` and stand at ``slot`` and after it."""
        x, y = order[slot], order[slot + 1]
        for offset in range(offset, LIMIT, 8):
            if not len(slot):
                break
            key, other = keys(x + offset), keys(y + offset)
            differ = key ^ other
            ended = np.flatnonzero(differ)
            shared[slot[ended] + 1] = np.minimum(offset + _equal_bytes(differ[ended]), LIMIT)
            turned = np.flatnonzero(key > other)
            order[slot[turned]], order[slot[turned] + 1] = y[turned], x[turned]
            going = np.flatnonzero(differ == 0)
            slot, x, y = slot[going], x[going], y[going]

    tied, group = np.arange(len(order)), np.zeros(len(order), np.int64)
    for offset in range(0, LIMIT, 8):
        if not len(tied):
            break
        at = order[tied]
        key = keys(at + offset)
        new = np.argsort(key)
        if offset:
            new = new[_order(group[new])]
        order[tied], key = at[new], key[new]
        differ = key[1:] ^ key[:-1]
        same_group = group[1:] == group[:-1]  # groups stay where they are
        ended = np.flatnonzero((differ != 0) & same_group)
        shared[tied[ended + 1]] = np.minimum(offset + _equal_bytes(differ[ended]), LIMIT)
        heads = np.flatnonzero(np.concatenate(([True], (differ != 0) | ~same_group)))
        sizes = np.diff(np.append(heads, len(tied)))
        settle(tied[heads[sizes == 2]], offset + 8)
        going = np.repeat(sizes > 2, sizes)
        tied, group = tied[going], np.repeat(np.arange(len(heads)), sizes)[going]
    shared[1:] = np.minimum(shared[1:], n - np.maximum(order[1:], order[:-1]))
    return shared


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many bytes of two words of eight are equal before the first that differs, which their XOR says."""
    same = np.zeros(len(differ), np.int64)
    for bits in range(8, 64, 8):
        same += differ < np.uint64(1 << (64 - bits))
    return same


def _least(values: np.ndarray):
    """A function for the least of ``values[a : b]``, for arrays of a < b."""
    levels = [values]
    while 2 << len(levels) <= 2 * len(values):
        below, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(below[:-half], below[half:]))
    table = np.zeros((len(levels), len(values)), values.dtype)
    for i, level in enumerate(levels):
        table[i, : len(level)] = level

    def query(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = _LEVEL[b - a]
        return np.minimum(table[k, a], table[k, b - (1 << k)])

    return query


def induce(
    text: np.ndarray,
    scan: range,
    wanted: np.ndarray,
    start: np.ndarray,
    start_shared: np.ndarray,
    scratch: Scratch,
    opening: int | None = None,
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Sort the ``wanted`` suffixes by induction from the sorted suffixes ``start``.

    ``scan`` gives the bytes in the order of the pass; of one byte the wanted suffixes are
    scanned before the start suffixes. ``opening`` is put into its queue before all. Returns the
    wanted positions in scanning order, the common prefix of each with the one scanned before (0
    for the first of a byte), and the pairs of a wanted and a start suffix that meet with LIMIT.
    """
    total = int(np.count_nonzero(wanted))
    kind = position_type(len(text))
    found, found_shared = scratch.array(total, kind), scratch.array(total, np.uint8)
    queues, done, meetings = Queues(scratch), 0, []
    if opening is not None:
        queues.put(int(text[opening]), np.array([opening], kind), np.zeros(1, np.uint8))
    firsts, bytes_ = np.empty(len(start), np.uint8), np.arange(256)
    for a in range(0, len(start), _BLOCK):  # numpy widens the positions it is given
        firsts[a : a + _BLOCK] = text[start[a : a + _BLOCK]]
    if scan.step > 0:
        begins, ends = np.searchsorted(firsts, bytes_), np.searchsorted(firsts, bytes_, "right")
    else:
        begins = len(start) - np.searchsorted(firsts[::-1], bytes_, "right")
        ends = len(start) - np.searchsorted(firsts[::-1], bytes_)
    del firsts
    running = np.zeros(256, np.uint8)  # least common prefix scanned since the last put, per byte

    def put_all(positions, shared, byte):
        """Put the predecessors of a stretch of scanned suffixes; returns those of the same byte."""
        same = []
        for a in range(0, len(positions), _BLOCK):
            p, g = positions[a : a + _BLOCK], shared[a : a + _BLOCK]
            index = np.flatnonzero(p > 0)
            index = index[wanted[p[index] - 1]]
            before = text[p[index] - 1]
            order = np.argsort(before, kind="stable")
            index, before = index[order], before[order]
            if len(index):
                head = np.append(True, before[1:] != before[:-1])
                came = np.where(head, -1, np.append(-1, index[:-1]))
                low = _least(g)(came + 1, index + 1)
                low[head] = np.minimum(low[head], running[before[head]])
                value = np.minimum(low, LIMIT - 1) + np.uint8(1)
            np.minimum(running, g.min(), out=running)
            if not len(index):
                continue
            cuts = np.flatnonzero(head).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(index)]):
                own, last = int(before[i]), int(index[j - 1])
                running[own] = g[last + 1 :].min() if last + 1 < len(g) else 255
                item = (p[index[i:j]] - 1).astype(kind), value[i:j]
                if own == byte:
                    same.append(item)
                else:
                    queues.put(own, *item)
        return same

    for byte in scan:
        last = None  # the suffix of this byte scanned before
        wave = queues.take(byte)
        while wave:
            following, head = [], True
            for positions, shared in wave:
                shared = shared.copy()
                if head:  # the first of the byte, or of a wave of one more equal byte
                    shared[0] = 0 if last is None else common_prefix(text, last, int(positions[0]))
                    head = False
                found[done : done + len(positions)] = positions
                found_shared[done : done + len(positions)] = shared
                done += len(positions)
                last = int(positions[-1])
                following += put_all(positions, shared, byte)
            wave = list(joined(following))
        a, b = int(begins[byte]), int(ends[byte])
        if b > a:
            shared = np.array(start_shared[a:b])
            shared[0] = 0 if last is None else common_prefix(text, last, int(start[a]))
            if shared[0] >= LIMIT:
                meetings.append((last, int(start[a])))
            put_all(np.array(start[a:b]), shared, byte)
    return found, found_shared, meetings


def position_type(n: int):
    return np.int32 if n < 1 << 31 else np.int64


def common_prefix(text: np.ndarray, x: int, y: int) -> int:
    n = min(LIMIT, len(text) - max(x, y))
    differ = np.flatnonzero(text[x : x + n] != text[y : y + n])
    return int(differ[0]) if len(differ) else n


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for the suffixes that are smaller than their successor; the last one is not."""
    n = len(text)
    small = np.zeros(n, bool)
    later = False
    for end in range(n - 1, 0, -_BLOCK):
        begin = max(0, end - _BLOCK)
        part = text[begin : end + 1].astype(np.int16)
        step = np.append(np.sign(part[1:] - part[:-1]), 1 if later else -1)
        at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
        small[begin:end] = (step[np.minimum.accumulate(at[::-1])[::-1]] > 0)[:-1]
        later = bool(small[begin])
    return small


def repeated_starts(padded: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True where LIMIT bytes start that also start elsewhere in the text.

    The text is strings that END follows, one after the other; LIMIT + 8 bytes of PAD follow it.
    """
    text = padded[: len(padded) - LIMIT - 8]
    repeated = np.zeros(len(text), bool)
    if len(text) < 2:
        return repeated
    small = suffix_types(text)
    order, shared = seeds(padded, small)
    large, large_shared, _ = induce(text, range(256), ~small, order, shared, scratch, opening=len(text) - 1)
    del order, shared
    _mark(repeated, large, large_shared)
    down_shared = np.append(np.zeros(1, np.uint8), large_shared[1:][::-1])
    tiny, tiny_shared, meetings = induce(text, range(255, -1, -1), small, large[::-1], down_shared, scratch)
    _mark(repeated, tiny, tiny_shared)
    for pair in meetings:
        repeated[list(pair)] = True
    return repeated


def _mark(repeated: np.ndarray, positions: np.ndarray, shared: np.ndarray) -> None:
    same = np.flatnonzero(shared >= LIMIT)
    repeated[positions[same]] = True
    repeated[positions[same - 1]] = True
