"""Evaluation texts inside a corpus: CGK embedding, bit sampling, exact edit verification."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch, mix64, ranges

WORD = re.compile(r"[^\W_]+")
ITEM_BLOCK = 4096
WINDOW_BLOCK = 2048


def words_of(text: str | None) -> list[str]:
    """The words of a text: maximal runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower()) if text else []


class Walk:
    """One random walk of the CGK embedding over windows of ``width`` symbols, and the positions it samples.

    At step j the walk writes the symbol it stands on and moves on by a random bit of (j, symbol); past the end it writes 0. Two
    windows at edit distance d so become strings at Hamming distance O(d^2), equal windows equal strings.
    """

    def __init__(self, number: int, width: int, symbols: int, sampled: int):
        rng = np.random.default_rng(7919 + number)
        self.steps = 3 * width
        self.bits = rng.integers(0, 2, (self.steps, symbols), dtype=np.int8)
        self.picked = np.sort(rng.choice(2 * width, sampled, replace=False))
        self.factor = rng.integers(1, 2**63, self.steps, dtype=np.int64).astype(np.uint64)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        n, width = windows.shape
        padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1)
        at, key, rows = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.arange(n)
        picked = set(self.picked.tolist())
        for j in range(int(self.picked[-1]) + 1):
            symbol = padded[rows, at]
            if j in picked:
                key = mix64(key + symbol.astype(np.uint64) * self.factor[j] + np.uint64(j + 1))
            at = np.minimum(at + self.bits[j, symbol], width)
        return key


def edit_distance_at_most(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the rows of two matrices of symbols lie within an edit distance of each other. The matrices may differ in width."""
    if most == 0:
        return (a == b).all(1) if a.shape[1] == b.shape[1] else np.zeros(len(a), bool)
    n, far = len(a), a.shape[1] + b.shape[1]
    if abs(a.shape[1] - b.shape[1]) > most:
        return np.zeros(n, bool)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    row = {j: np.full(n, j, np.int8) for j in range(min(most, len(b)) + 1)}
    beyond = np.full(n, far, np.int8)
    for i in range(1, len(a) + 1):  # only cells that lie within ``most`` of the diagonal can count
        new = {0: np.full(n, i, np.int8)} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cell = np.minimum(row.get(j, beyond), new.get(j - 1, beyond)) + np.int8(1)
            new[j] = np.minimum(cell, row.get(j - 1, beyond) + (a[i - 1] != b[j - 1]))
        row = new
    return row[len(b)] <= most


def repetitions(width: int, edits: int, sampled: int, recall: float) -> int:
    """Walks needed so that windows within ``edits`` edits share a key with probability ``recall``; one where none is allowed, as equal windows always share theirs."""
    if edits == 0:
        return 1
    far = min(1.0, 2 * edits * edits / (2 * width) + edits / width)
    once = 0.5 * (1 - min(far, 0.95)) ** sampled
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _run_keys(codes: np.ndarray, run: int) -> np.ndarray:
    """The key of every ``run`` symbols in a row."""
    n = len(codes) - run + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(run if n > 0 else 0):
        key = mix64(key * np.uint64(31) + codes[i : i + n].astype(np.uint64) + np.uint64(1))
    return key


class Index:
    """The windows of up to ``ITEM_BLOCK`` items and their keys, small enough to be broadcast."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, edits: int, sampled: int, recall: float):
        texts = [(i, words_of(t)) for i, t in items]
        self.code = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        windows, owner = [], []
        for i, ws in texts:
            c = np.array([self.code[w] for w in ws], np.int32)
            if len(c) >= width:
                view = np.lib.stride_tricks.sliding_window_view(c, width)
                windows.append(view)
                owner.append(np.full(len(view), i, np.int64))
        self.width, self.edits = width, edits
        # ``edits`` edits leave at least one run of so many words of a window whole
        self.run = max(1, math.ceil((width - edits) / (edits + 1)))
        self.runs = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [_run_keys(v.reshape(-1), self.run) if v.size else v for v in (np.array([self.code[w] for w in ws], np.int32) for _, ws in texts if len(ws) >= width)]))
        self.windows = np.concatenate(windows) if windows else np.zeros((0, width), np.int32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.tables = []
        for k in range(repetitions(width, edits, sampled, recall)):
            walk = Walk(k, width, len(self.code) + 1, sampled)
            keys = walk.keys(self.windows)
            order = np.argsort(keys, kind="stable")
            self.tables.append((walk, keys[order], order))

    def matches(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a given window and an item within the edit distance. The windows may be narrower or wider than the items', as words were left out or put in."""
        if not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        distinct, copy = np.unique(windows, axis=0, return_inverse=True)
        parts = [self._matches(distinct[lo : lo + WINDOW_BLOCK]) for lo in range(0, len(distinct), WINDOW_BLOCK)]
        mine, item = np.concatenate([m + n * WINDOW_BLOCK for n, (m, _) in enumerate(parts)]), np.concatenate([i for _, i in parts])
        order = np.argsort(mine, kind="stable")
        mine, item = mine[order], item[order]
        hit, at = ranges(np.searchsorted(mine, copy.reshape(-1), "left"), np.searchsorted(mine, copy.reshape(-1), "right"))
        return hit, item[at]

    def _matches(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = []
        for walk, keys, order in self.tables:
            own = walk.keys(windows)
            hit, at = ranges(np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right"))
            pairs.append(hit * max(1, len(self.owner)) + order[at])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        size = max(1, len(self.owner))
        mine, theirs = both // size, both % size
        good = edit_distance_at_most(windows[mine], self.windows[theirs], self.edits)
        return mine[good], self.owner[theirs[good]]


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, *, width: int = 12, edits: int = 0, sampled: int = 6, recall: float = 0.95) -> DataFrame:
    """``id, item_id, windows, first_word``: every row of the corpus that holds ``width`` consecutive words of an item, with at most ``edits`` word edits.

    A word put in, left out or replaced is one edit, so that windows of ``width`` - ``edits`` to ``width`` + ``edits`` words are compared with the
    items' windows of ``width``. ``windows`` is the number of words of the text at which a matching window begins, ``first_word`` the position of the first. What stands
    between words doesn't matter. All windows of all texts are embedded, hashed and looked up; the only ones left out beforehand hold more than ``edits`` words that no
    item has, or, with ``edits`` above 0, no run of ceil((``width`` - ``edits``) / (``edits`` + 1)) words that an item has: at least one such run stays whole under the allowed edits, so that neither loses a window. With ``edits`` = 0 nothing is lost; else the number of walks
    follows from ``recall`` and ``sampled``. Items shorter than ``width`` words and NULL or empty texts match nothing. A
    key that comes twice gives a row for each of its texts.

    Items are taken in blocks of ``ITEM_BLOCK``, so that what is broadcast is bounded whatever their number.
    """
    listed = items.select(F.col(item_key).cast("long"), F.col(item_text).cast("string"))
    n_blocks = max(1, -(-listed.count() // ITEM_BLOCK))
    found = None
    for k in range(n_blocks):
        block = listed if n_blocks == 1 else listed.where(F.pmod(F.xxhash64(listed.columns[0], listed.columns[1]), F.lit(n_blocks)) == k)
        held = [(r[0], r[1]) for r in block.collect() if r[0] is not None]
        part = _scan(corpus, key, text, Index(held, width, edits, sampled, recall))
        found = part if found is None else found.unionByName(part)
    return found


def _scan(corpus: DataFrame, key: str, text: str, index: Index) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int64()), ("first_word", pa.int64())])
    shared = corpus.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        held = shared.value
        narrow, wide, code = max(1, held.width - held.edits), held.width + held.edits, held.code
        for b in batches:
            codes, doc, start = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                c = [code.get(w, 0) for w in words_of(t)]
                if len(c) >= narrow:
                    codes.extend(c)
                    doc.append(np.full(len(c), i, np.int64))
                    start.append(np.arange(len(c)))
            if not codes:
                continue
            c, d, s = np.array(codes, np.int32), np.concatenate(doc), np.concatenate(start)
            unknown = np.concatenate([[0], np.cumsum(c == 0)])
            keys = _run_keys(c, held.run) if held.edits else np.zeros(0, np.uint64)
            place = np.minimum(np.searchsorted(held.runs, keys), max(len(held.runs) - 1, 0))
            whole = np.concatenate([[0], np.cumsum(held.runs[place] == keys) if len(held.runs) else np.zeros(len(keys), np.int64)])
            found = []
            for width in range(narrow, min(wide, len(c)) + 1):
                first = np.arange(len(c) - width + 1)
                good = (unknown[first + width] - unknown[first] <= held.edits) & (d[first] == d[first + width - 1])
                if held.edits:
                    good &= whole[first + width - held.run + 1] > whole[first]
                first = first[good]
                mine, item = held.matches(np.lib.stride_tricks.sliding_window_view(c, width)[first])
                found.append((first[mine], item))
            at, item = (np.concatenate(x) for x in zip(*found))
            if not len(at):
                continue
            seen = pd.DataFrame({"row": d[at], "item": item, "at": s[at]}).drop_duplicates()
            got = seen.groupby(["row", "item"], sort=True)["at"].agg(["size", "min"]).reset_index()
            yield batch(schema, b.column(0).take(pa.array(got["row"].to_numpy())), got["item"].to_numpy(), got["size"].to_numpy(), got["min"].to_numpy())

    return corpus.selectExpr(f"cast(`{key}` as long)", f"cast(`{text}` as string)").mapInArrow(scan, "id long, item_id long, windows long, first_word long")
