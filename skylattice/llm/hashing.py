"""Vectorised hashes of many texts at once: words, word shingles, byte shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
ELEMENT_BITS = 48
ELEMENT = np.uint64((1 << ELEMENT_BITS) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = np.random.default_rng(20240601).integers(0, 1 << 64, 256, np.uint64)
#: Bytes of words: letters, digits, the underscore and all bytes beyond ASCII.
IS_WORD = np.array([bytes([b]).isalnum() or b == 95 or b >= 128 for b in range(256)])
#: Odd factors for the values of a band.
ODDS = np.random.default_rng(20240602).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        held = _powers[base] = np.multiply.accumulate(grown)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input sways every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as one array of bytes, with a space before each and one at the end, and where each begins."""
    low = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8) if len(low) else np.zeros(0, np.uint8)
    ends = np.frombuffer(low.buffers()[1], np.int64)[: len(low) + 1] if len(low) else np.zeros(1, np.int64)
    out = np.full(len(data) + len(texts) + 1, 32, np.uint8)
    at = np.ones(len(out), bool)
    starts = ends + np.arange(len(ends))
    at[starts] = False
    out[at] = data[: ends[-1]]
    return out, starts


class Rolling:
    """Hashes of any slices of an array of bytes, from running sums."""

    def __init__(self, data: np.ndarray) -> None:
        sums = np.cumsum(BYTE[data] * powers(BASE, len(data)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first])


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, in order, and the number of words of each text."""
    data, starts = joined(texts)
    inside = IS_WORD[data]
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    last = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    edges = np.searchsorted(first, starts)
    return Rolling(data).of(first, last), np.diff(edges)


def word_shingles(hashes: np.ndarray, counts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hash of every shingle of n words and the text it is of; a text of fewer words is one shingle of them all."""
    of = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n if len(total) else 0):
        total += mix(hashes[i : len(hashes) - n + 1 + i] + np.uint64(i + 1)) * np.uint64(2 * i + 1)
    whole = of[: len(total)] == of[n - 1 :] if len(total) else np.zeros(0, bool)
    found, owner = mix(total[whole]), of[: len(total)][whole]
    ends = np.cumsum(counts)
    few = np.flatnonzero((counts > 0) & (counts < n))
    short = np.array([mix(np.sum(mix(hashes[ends[d] - counts[d] : ends[d]] + np.arange(1, counts[d] + 1, dtype=np.uint64)), dtype=np.uint64, keepdims=True))[0] for d in few], np.uint64)
    return np.concatenate([found, short]) & ELEMENT, np.concatenate([owner, few])


def multiset(elements: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text (sorted by text, then element), the text, and how often each occurs. At most 65,536 texts."""
    both = np.sort(elements | (of.astype(np.uint64) << np.uint64(48)))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(both)))
    return both[new] & ELEMENT, (both[new] >> np.uint64(48)).astype(np.int64), count


def banded(signature: np.ndarray, rows: int) -> np.ndarray:
    """Keys of the bands of each signature: rows of 64-bit values to (texts, bands) as int64."""
    n, m = signature.shape
    # values are hashes, so a sum with random odd factors keeps different bands apart
    total = signature.reshape(-1, rows) @ ODDS[:rows]
    return mix(total.reshape(n, m // rows) + np.arange(1, m // rows + 1, dtype=np.uint64) * np.uint64(BASE)).view(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about `most` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(n) + 64
    if a < batch.num_rows:
        yield batch.slice(a)
