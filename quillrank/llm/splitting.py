"""Cutting oversized texts and id sequences into overlapping pieces, by pointer doubling over the boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow import batch

_SENTENCE = re.compile(r"[.!?…]+[\"')\]»”]*\s+|\n+")
_SPACE = re.compile(r"\s+")
_EDGE = " \r\n"


def cut_points(strong: np.ndarray, weak: np.ndarray, hard: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """All ends of pieces of many items that lie one after another on one axis (``starts`` to ``ends``, with gaps between items).

    After a piece that ends at p the next one starts at p - ``overlap`` and so may reach to p + ``limit`` - ``overlap``. The
    successor of every boundary is the farthest strong boundary in that reach, else the farthest weak one, else the farthest hard one. The successor table is squared until nothing new is reached: after k rounds all cuts within 2^k pieces
    of a start are known, for all items at once.

    ``hard`` must hold all points and leave no gap over ``limit`` - ``overlap`` within an item; ``strong`` must hold the ends.
    """
    reach = limit - overlap
    nodes = np.unique(np.concatenate([hard, starts + overlap]))

    def farthest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = points[np.maximum(np.searchsorted(points, at + reach, side="right") - 1, 0)]
        return np.where((found > at) & (found <= at + reach), found, -1)

    best = farthest(strong, nodes)
    for points in (weak, hard):
        if len(points) and (lost := best < 0).any():
            best[lost] = farthest(points, nodes[lost])
    owner_end = ends[np.clip(np.searchsorted(starts, nodes, side="right") - 1, 0, len(ends) - 1)]
    stop = (nodes >= owner_end) | (best < 0)
    successor = np.searchsorted(nodes, np.where(stop, nodes, np.minimum(best, owner_end)))
    virtual = np.searchsorted(nodes, starts + overlap)  # as if a piece had ended there: the first may then reach to start + limit
    reached = np.zeros(len(nodes), bool)
    front = successor[virtual]
    reached[front] = True
    while True:
        before = reached.sum()
        reached[successor[reached]] = True
        successor = successor[successor]
        if reached.sum() == before:
            return nodes[reached]


def _grid(points: np.ndarray, step: int) -> np.ndarray:
    """Further points where neighbours lie more than ``step`` apart."""
    gaps = np.diff(points)
    wide = np.nonzero(gaps > step)[0]
    return np.concatenate([np.arange(points[i] + step, points[i + 1], step) for i in wide]) if len(wide) else np.zeros(0, np.int64)


def _pieces(items: list[tuple[int, np.ndarray, np.ndarray]], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of items (length, strong, weak): item number, piece number, start and end of each piece."""
    if not items:
        return (np.zeros(0, np.int64),) * 4
    lengths = np.array([n for n, _, _ in items], np.int64)
    starts = np.cumsum(lengths + 2 * limit) - lengths - 2 * limit
    strong = [np.append(s[(s > 0) & (s < n)], n) for n, s, _ in items]
    weak = [w[(w > 0) & (w < n)] for n, _, w in items]
    hard = []
    for s, w in zip(strong, weak):
        points = np.unique(np.concatenate([[0], s, w])).astype(np.int64)
        hard.append(np.concatenate([points[1:], _grid(points, limit - overlap), [limit]]))
    laid = [np.unique(np.concatenate([p + a for p, a in zip(points, starts)])) for points in (strong, weak, hard)]
    cuts = cut_points(*laid, starts, starts + lengths, limit, overlap)
    owner = np.searchsorted(starts, cuts, side="left") - 1
    ends = cuts - starts[owner]
    first = np.searchsorted(owner, np.arange(len(items)))
    number = np.arange(len(cuts)) - first[owner]
    begins = np.where(number == 0, 0, np.roll(ends, 1) - overlap)
    return owner, number, begins, ends


def _text_item(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    return len(text), np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64), np.array([m.end() for m in _SPACE.finditer(text)], np.int64)


def split_texts(df: DataFrame, key: str, text: str, *, limit: int = 1000, overlap: int = 100, with_text: bool = True) -> DataFrame:
    """``id, piece, n_pieces, start, end`` and ``content``: every text in pieces of at most ``limit`` characters.

    Spaces and line breaks at either end of a text don't count and belong to no piece; ``start`` and ``end`` count from
    the first other character. A text within the limit is one piece. Longer ones are cut after sentences and lines, else after
    white space, else hard; each piece starts exactly ``overlap`` characters before the end of the one before. Joining the
    pieces without their overlaps gives the trimmed text again. NULL, empty and blank texts give one piece of length 0. Repeated rows are
    cut each by itself. Only ``key`` and ``text`` are read, whatever other columns are called.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int64()), ("end", pa.int64())] + [("content", pa.string())] * with_text)

    def cut(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            trimmed = pc.fill_null(pc.utf8_trim(texts, characters=_EDGE), "")
            lengths = pc.utf8_length(trimmed).to_numpy(zero_copy_only=False).astype(np.int64)
            large = np.nonzero(lengths > limit)[0]
            whole = np.nonzero(lengths <= limit)[0]
            zeros, ones = np.zeros(len(whole), np.int32), np.ones(len(whole), np.int32)
            columns = [ids.take(pa.array(whole)), zeros, ones, zeros, lengths[whole]]
            yield batch(schema, *columns, *([trimmed.take(pa.array(whole))] if with_text else []))
            bodies = trimmed.take(pa.array(large)).to_pylist()
            owner, number, start, end = _pieces([_text_item(t) for t in bodies], limit, overlap)
            if len(owner):
                counts = np.bincount(owner, minlength=len(bodies))
                content = [pa.array([bodies[o][s:e] for o, s, e in zip(owner.tolist(), start.tolist(), end.tolist())], pa.string())] if with_text else []
                yield batch(schema, ids.take(pa.array(large[owner])), number, counts[owner], start, end, *content)

    return df.selectExpr(f"cast(`{key}` as long)", f"cast(`{text}` as string)").mapInArrow(cut, "id long, piece int, n_pieces int, start long, end long" + ", content string" * with_text)


def split_sequences(df: DataFrame, key: str, ids: str, *, limit: int = 128, overlap: int = 16, padding: int = 103, after: tuple[int, ...] = (1012, 102), before: tuple[int, ...] = (101,)) -> DataFrame:
    """``id, piece, n_pieces, start, end, content``: every id sequence in pieces of at most ``limit`` ids.

    The unbroken run of ``padding`` at the end doesn't count. Cuts fall after the ids of ``after`` or before those of
    ``before`` where the reach holds any, else hard, with exactly ``overlap`` ids in common. NULL and empty sequences, and those of
    padding alone, give one piece of length 0.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.list_(pa.int64()))])

    def cut(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            keys, rows = b.column(0).to_pylist(), []
            flat = pc.fill_null(b.column(1).flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            stops = np.cumsum(sizes)
            for a, e in zip((stops - sizes).tolist(), stops.tolist()):
                real = np.nonzero(flat[a:e] != padding)[0]
                rows.append(flat[a : a + (real[-1] + 1 if len(real) else 0)])
            large = [i for i, r in enumerate(rows) if len(r) > limit]
            items = []
            for i in large:
                r = rows[i]
                items.append((len(r), np.unique(np.concatenate([np.nonzero(np.isin(r, after))[0] + 1, np.nonzero(np.isin(r, before))[0]])), none))
            owner, number, start, end = _pieces(items, limit, overlap)
            counts = np.bincount(owner, minlength=len(large)) if large else none
            out = [(keys[i], 0, 1, 0, len(r), r.tolist()) for i, r in enumerate(rows) if len(r) <= limit]
            out += [(keys[large[o]], n, int(counts[o]), s, e, rows[large[o]][s:e].tolist()) for o, n, s, e in zip(owner.tolist(), number.tolist(), start.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return df.selectExpr(f"cast(`{key}` as long)", f"cast(`{ids}` as array<long>)").mapInArrow(cut, "id long, piece int, n_pieces int, start long, end long, content array<long>")
