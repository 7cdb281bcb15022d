"""Shingles of an Arrow batch of texts: hashes of runs of words, sketches of the sets, and keys of their bands.

A text is lower case already; words are maximal runs of anything but ASCII white space. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BINS = 128
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in reading order, and each text's number of words."""
    rows = pc.ascii_split_whitespace(texts)
    flat, sizes = rows.flatten(), np.diff(rows.offsets.to_numpy())
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    code = flat.dictionary_encode()
    hashes = pd.util.hash_array(np.array(code.dictionary.to_pylist(), dtype=object), categorize=False)[code.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.uint64)
    if not full.all():  # white space at either end of a text leaves empty words
        before = np.concatenate([[0], np.cumsum(full)])
        stop = np.cumsum(sizes)
        hashes, sizes = hashes[full], before[stop] - before[stop - sizes]
    return hashes, sizes.astype(np.int64)


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of at most `most` bytes together; a longer text is a run of its own."""
    size, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def sets(texts: pa.Array, k: int, most: int = 1 << 21) -> Iterator[list[np.ndarray]]:
    """By runs of texts: the sorted distinct hashes of each text's runs of k words, or of all its words if these are fewer."""
    for some in _slices(texts, most):
        words, sizes = _words(some)
        n = max(0, len(words) - k + 1)
        runs = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            runs = _mixed(runs + words[j : j + n])
        stops, out = np.cumsum(sizes).tolist(), []
        for size, stop in zip(sizes.tolist(), stops):
            if size >= k:
                out.append(np.unique(runs[stop - size : stop - k + 1]))
            else:
                all_of = np.full(min(size, 1), size, dtype=np.uint64)
                for w in words[stop - size : stop]:
                    all_of = _mixed(all_of + w)
                out.append(all_of)
        yield out


def listed(texts: pa.Array, k: int) -> pa.Array:
    """The sets themselves, as lists of longs in the order of unsigned ones."""
    every = [s for part in sets(texts, k) for s in part]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in every])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *every]).view(np.int64)))


def _minima(flat: np.ndarray, starts: np.ndarray, seeds: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """For each set, which begins at its start, and each seed the least of the hashes of its members. Sets are taken in
    blocks, and one buffer holds the hashes, so that they stay near the processor."""
    out = np.empty((len(starts), len(seeds)), dtype=np.uint64)
    edges, at = np.append(starts, len(flat)), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + block, side="right")) - 1)
        some, begins = flat[edges[at] : edges[to]], starts[at:to] - starts[at]
        x, y = np.empty_like(some), np.empty_like(some)
        for i, seed in enumerate(seeds):
            np.bitwise_xor(some, seed, out=x)  # members are mixed already: one more round sets the order of each seed
            np.multiply(x, _A, out=x)
            np.right_shift(x, np.uint64(32), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _B, out=x)
            out[at:to, i] = np.minimum.reduceat(x, begins)
        at = to
    return out


def sketched(texts: pa.Array, k: int, bands: int, rows: int) -> pa.Array:
    """struct(h, n, keys, bins): a hash of the set, its size, for each band a key of its minima, and how many members have
    the same first bits; no keys and bins for an empty set."""
    seeds, h, n, keys, bins = _seeds(bands * rows), [], [], [], []
    for part in sets(texts, k):
        size = np.array([len(s) for s in part], dtype=np.int64)
        n.append(size)
        full = np.flatnonzero(size)
        h.append(np.zeros(len(part), dtype=np.uint64))
        if not len(full):
            continue
        flat, starts = np.concatenate(part), (np.cumsum(size) - size)[full]
        h[-1][full] = np.add.reduceat(_mixed(flat + _A), starts)
        least = _minima(flat, starts, seeds).reshape(len(full), bands, rows)
        key = np.tile(np.arange(bands, dtype=np.uint64), (len(full), 1))
        for r in range(rows):
            key = _mixed(key + least[:, :, r])
        keys.append(key.ravel())
        own = np.repeat(np.arange(len(full)) * BINS, size[full]) + (flat >> np.uint64(57)).astype(np.int64)
        bins.append(np.bincount(own, minlength=len(full) * BINS).astype(np.int32))
    h, n, keys, bins = (np.concatenate([np.zeros(0, dtype=kind), *x]) for x, kind in ((h, np.uint64), (n, np.int64), (keys, np.uint64), (bins, np.int32)))
    offsets = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets * each), pa.array(x)) for x, each in ((keys.view(np.int64), np.int32(bands)), (bins, np.int32(BINS)))]
    return pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), *lists], ["h", "n", "keys", "bins"])
