"""Hashed words and n-grams of whole batches of texts.

A step takes the bytes of a slice of texts as one array: A-Z are folded and words are cut and
hashed by arithmetic on it, and so are runs of words. No text is walked in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts of one step, and bytes of text after which a step ends before that.
ROWS, BYTES = 1000, 2 << 20
#: Bytes beyond which a word is hashed by itself.
LONG = 48

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A word's hash is the sum of its bytes' values times rising powers of an odd number, mixed.
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_VALUE = np.random.default_rng(20).integers(1, 2**64, 256, np.uint64)
_VALUE[_IS_SPACE] = 0
_UP = _DOWN = np.empty(0, np.uint64)


def steps(batch: pa.RecordBatch, column: int, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text in ``column``; one longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) if batch.num_rows else np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + most, "right")) - 1
        end = max(at + 1, min(end, at + rows, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, offsets): text i has words offsets[i] to offsets[i + 1].

    Words and folding are the contract's: runs of anything but space, tab, LF, VT, FF and CR, with
    A-Z lower-cased. Null texts have no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = _LOWER[np.frombuffer(raw, np.uint8)[places[0] : places[-1]]] if raw is not None else np.empty(0, np.uint8)
    places = places - places[0]
    space = _IS_SPACE[data]
    begins = ~space
    first = np.zeros(len(data) + 1, bool)
    first[places] = True
    begins[1:] &= space[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    offsets = np.searchsorted(starts, places)
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    global _UP, _DOWN
    if len(data) > len(_UP):
        _UP, _DOWN = _powers(len(data), _BASE), _powers(len(data), pow(_BASE, -1, 1 << 64))
    values = _VALUE[data]
    values *= _UP[: len(data)]
    made = np.add.reduceat(values, starts) * _DOWN[starts]
    if len(data) > BYTES:  # one very long text: its tables go with it
        _UP, _DOWN = _UP[:BYTES].copy(), _DOWN[:BYTES].copy()
    made ^= made >> np.uint64(31)
    made *= _MIX
    made ^= made >> np.uint64(29)
    # Long words could be made to collide under a sum of powers.
    spans = np.append(starts[1:], len(data)) - starts
    for w in np.flatnonzero(spans > LONG).tolist():
        at = int(starts[w])
        word = data[at : at + int(spans[w])].tobytes().split()[0]
        if len(word) > LONG:
            made[w] = xxhash.xxh64_intdigest(word)
    return made, offsets


def run_hashes(items: np.ndarray, offsets: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of n items, offsets), in text order.

    A text with fewer items has one run of them all if ``whole``, else none; an empty text has none.
    """
    sizes = np.diff(offsets)
    runs = np.where(sizes >= n, sizes - n + 1, ((sizes > 0) & whole).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(runs)])
    total = np.zeros(max(0, len(items) - n + 1), np.uint64)
    for i in range(n):
        total = (total ^ items[i : len(items) - n + 1 + i]) * _MIX if len(total) else total
        total ^= total >> np.uint64(29)
    inside = np.repeat(offsets[:-1] - starts[:-1], runs) + np.arange(starts[-1])
    short = np.flatnonzero((sizes > 0) & (sizes < n)) if whole else np.empty(0, np.int64)
    if len(short):
        inside[starts[short]] = 0
        total = total if len(total) else np.zeros(1, np.uint64)
    found = total[inside]
    for i in short.tolist():
        one = np.zeros(1, np.uint64)
        for item in items[offsets[i] : offsets[i + 1]]:
            one = (one ^ item) * _MIX
            one ^= one >> np.uint64(29)
        found[starts[i]] = one[0]
    return found, starts


def sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted as signed numbers, and the offsets."""
    values = values.view(np.int64).copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets]


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, and the offsets."""
    return sets(*run_hashes(*word_hashes(texts), n))
