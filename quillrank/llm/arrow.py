"""Arrow batches to NumPy and back, shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def clean_terms(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of a column of string lists, trimmed and lower-cased, without NULL and blank ones: row number of each, and the terms."""
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    terms = pc.utf8_lower(pc.utf8_trim_whitespace(flat.cast(pa.string())))
    keep = pc.fill_null(pc.not_equal(terms, ""), False)
    return pc.filter(rows, keep).to_numpy(zero_copy_only=False).astype(np.int64), pc.filter(terms, keep)


def term_counts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """How often each term is in each row: row numbers, term codes, counts, and the terms by code."""
    rows, terms = clean_terms(lists)
    coded = terms.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    size = max(1, len(coded.dictionary))
    pairs, counts = np.unique(rows * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return pairs // size, pairs % size, counts.astype(np.int64), coded.dictionary


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dim`` from a column of lists: which rows are usable (right length, no NULL element, finite, not all zero), and their float32 matrix."""
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    whole = lengths == dim
    if not whole.any():
        return np.zeros(len(lengths), bool), np.zeros((0, dim), np.float32)
    flat = pc.list_flatten(pc.filter(lists, pa.array(whole)))
    values = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    good = np.isfinite(values).all(1) & values.any(1)
    usable = whole.copy()
    usable[whole] = good
    return usable, values[good]


def lists_of(values: np.ndarray) -> pa.Array:
    """A column of lists from the rows of a matrix."""
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(values).reshape(-1)))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of the given columns, cast to the schema."""
    arrays = [(c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the half-open ranges, with the number of the range of each."""
    lengths = np.maximum(ends - starts, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def table_of(batches, *, limit: int | None = None):
    """Arrow batches joined to tables of at least ``limit`` rows each (all of them at once where it is None)."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if limit is not None and rows >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
