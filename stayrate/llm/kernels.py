"""Vectorised work on the bytes of a batch of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece by itself.
PIECE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    plain = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = plain.buffers()
    starts = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    if not len(plain):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size, "right")) - 1)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, min(2 * n, PIECE + 1)), base, np.uint64)  # kept, so no larger than texts need
        steps[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(steps)
    return known[:n]


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span of ``body``."""
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body), _BASE), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the spans from ``first`` up to ``last``, wherever they stand."""
    raw = (sums[last] - sums[first]) * powers(len(sums), _UNDO)[first]
    return mixed(raw + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(body: np.ndarray, starts: np.ndarray, part_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the text each belongs to; words end with their text."""
    inside = part_of_word[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) + 1, np.searchsorted(starts, first, "right") - 1


def shingle_sets(body: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different ``k``-word shingle hashes of every text, and where each text's begin.

    A-Z are lower-cased and words are runs of other than ASCII white space. A text with fewer
    words is one shingle of all of them; a text without words has none.
    """
    n_texts = len(starts) - 1
    low = _LOWER[body]
    first, last, text = word_spans(low, starts, ~_SPACE)
    hashes = span_hashes(prefix_hashes(low), first, last)
    counts = np.bincount(text, minlength=n_texts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    each: list[np.ndarray] = []
    full = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        full = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            full = mixed(full * np.uint64(3) + hashes[j : len(hashes) - k + 1 + j])
    sizes = np.zeros(n_texts, np.int64)
    for i in range(n_texts):
        a, n = begin[i], counts[i]
        if n >= k:
            found = np.unique(full[a : a + n - k + 1])
        elif n:
            value = np.full(1, n, np.uint64)
            for j in range(n):
                value = mixed(value * np.uint64(3) + hashes[a + j : a + j + 1])
            found = value
        else:
            continue
        sizes[i] = len(found)
        each.append(found)
    sets = np.concatenate(each) if each else np.zeros(0, np.uint64)
    return sets, np.concatenate(([0], np.cumsum(sizes)))


def features_of_words(body: np.ndarray, starts: np.ndarray, prefixes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every text: its different words and the openings of its words.

    Words are runs of letters and digits, A-Z lower-cased. Returns feature numbers below
    ``2 ** bits``, different within a text, and the text of each, sorted by text.
    """
    low = _LOWER[body]
    first, last, text = word_spans(low, starts, _WORD)
    sums = prefix_hashes(low)
    hashes, owners = [span_hashes(sums, first, last)], [text]
    for length in prefixes:
        long = last - first > length
        hashes.append(span_hashes(sums, first[long], first[long] + length) ^ np.uint64(length))
        owners.append(text[long])
    number = np.concatenate(hashes) >> np.uint64(64 - bits)
    both = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(bits)) | number)
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), (both >> np.uint64(bits)).astype(np.int64)
