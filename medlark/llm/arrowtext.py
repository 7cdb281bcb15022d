"""Words of an Arrow batch of texts, folded to distinct ones; for operators that run Python on the executors."""

from __future__ import annotations


def folded(texts, lower: bool = True):
    """Arrow strings without nulls -> (distinct words as an Arrow array, code of each word in reading order,
    number of words of each text). Words are maximal runs of anything but ASCII white space."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    flat, sizes = rows.flatten(), np.diff(rows.offsets.to_numpy())
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end of a text leaves empty words
        before = np.concatenate([[0], np.cumsum(full)])
        stop = np.cumsum(sizes)
        sizes = before[stop] - before[stop - sizes]
        flat = flat.filter(pa.array(full))
    code = flat.dictionary_encode()
    return code.dictionary, code.indices.to_numpy(), sizes.astype(np.int64)


def sums(values, sizes):
    """Sum of consecutive runs of the given sizes, 0 for empty ones."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(sizes)
    return total[stop] - total[stop - sizes]


def hashes(words):
    """64-bit hashes of an Arrow array of strings."""
    import numpy as np
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def slices(batch, column: str, limit: int):
    """Runs of rows of a batch whose texts have at most `limit` bytes together; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
