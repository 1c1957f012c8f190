"""One ranking from several differently-scaled scores: empirical percentiles, inverse normal, weighted mean."""

from __future__ import annotations

from copy import copy
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from .arrow import batch, clean_terms, matrix, ranges

QUERY_BLOCK, BINS, DOC_BLOCK, HOT_PASSAGES = 512, 1024, 1024, 4096
# tails: queries at a time, queries and documents of a tile, least number of documents, documents of the sample, rank in it and least size of a tail that it aims at, rows of a query in a task
TAIL_QUERIES, TILE, TILE_DOCS, TAIL_DOCS, SAMPLE, SAMPLE_RANK, LEAST_TAIL, MOST_TAIL = 32768, 256, 10000, 4096, 65536, 4, 64, 4096
LAYERS, LATE_BLOCK, DENSE_BLOCK, EXACT_ROWS = 64, 512, 1024, 1 << 19
# below the tails: shares of the sample that lie above a step, and one document in how many is counted for dense and late scores
# to which step the limits go down in a second and a third reading
WIDER = (3, 1)
STEPS, STEP_SHARE = (0.1, 0.03, 0.01, 0.003, 0.001), 4
_NORMAL = NormalDist()
K1, B = 1.2, 0.75
DIGITS = (14, 12, 12)  # scores that agree to so many are level, as in the SQL: the last bits depend on where a row lies and what else is asked
COLUMNS = ("id", "vec", "terms", "late", "hot")


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The inverse normal distribution (Wichura's rational approximations, good to 16 digits, as in the standard library)."""
    unique, back = np.unique(p, return_inverse=True)
    return np.array([_NORMAL.inv_cdf(x) for x in unique.tolist()])[back].reshape(p.shape)


def percentile(below: np.ndarray, equal: np.ndarray, n: int) -> np.ndarray:
    """The empirical percentile with averaged ties: the mean rank of the tied less a half, by the number of items."""
    return (below + equal / 2) / n


class Queries:
    """A block of queries, small enough to be broadcast: at most ``QUERY_BLOCK``."""

    def __init__(self, rows: list, dense_dim: int, late_dim: int):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.dense = np.zeros((len(rows), dense_dim))
        for i, r in enumerate(rows):
            v = np.array(r[1] if r[1] is not None and len(r[1]) == dense_dim else [0.0] * dense_dim, np.float64)
            length = np.linalg.norm(v)
            self.dense[i] = v / length if length else 0
        self.terms = [sorted({t.strip().lower() for t in (r[2] or []) if t and t.strip()}) for r in rows]
        vectors = [[v for v in (r[3] or []) if v is not None and len(v) == late_dim] for r in rows]
        self.late = np.array([v for vs in vectors for v in vs], np.float64).reshape(-1, late_dim)
        self.late_owner = np.repeat(np.arange(len(rows)), [len(v) for v in vectors])
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for ts in self.terms for t in ts}))}
        pairs = [(self.vocabulary[t], i) for i, ts in enumerate(self.terms) for t in ts]
        self.uses = np.zeros((len(self.vocabulary), len(rows)), np.float32)
        for t, i in pairs:
            self.uses[t, i] = 1
        self.idf = np.zeros(len(self.vocabulary))
        self.mean_length, self.n = 1.0, 0


def _statistics(docs: DataFrame, shared, late_dim: int) -> tuple[int, float, np.ndarray, np.ndarray, np.ndarray]:
    """In one reading: the number of records with a non-NULL array of terms, their mean length, in how many each wanted term is, and the least and largest late score of each query."""
    held = shared.value
    names, count = sorted(held.vocabulary), len(held.ids)
    schema = pa.schema([("what", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def read(batches):
        index, found, n, length = pa.array(names, pa.string()), np.zeros(len(names) + 1, np.int64), 0, 0
        low, high = np.full(count, np.inf), np.full(count, -np.inf)
        for whole in batches:
            for b in (whole.slice(i, DOC_BLOCK) for i in range(0, whole.num_rows, DOC_BLOCK)):
                lists = b.column("terms")
                n += len(lists) - lists.null_count
                rows, terms = clean_terms(lists)
                length += len(rows)
                at = pc.fill_null(pc.index_in(terms, value_set=index), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.unique(rows[at >= 0] * len(found) + at[at >= 0])
                found += np.bincount(pairs % len(found), minlength=len(found))
                best = _document_scores(shared.value, b, late_dim)
                if best is not None:
                    low, high = np.minimum(low, np.where(np.isneginf(best), np.inf, best).min(axis=1)), np.maximum(high, best.max(axis=1))
        none = np.zeros(len(found))
        yield batch(schema, np.zeros(len(found), np.int32), np.arange(len(found)), found, none, none)
        yield batch(schema, np.ones(2, np.int32), np.arange(2), np.array([n, length]), np.zeros(2), np.zeros(2))
        good = np.nonzero(high >= low)[0]
        yield batch(schema, np.full(len(good), 2), good, np.zeros(len(good), np.int64), low[good], high[good])

    got = docs.select("terms", "late", "hot").mapInArrow(read, "what int, at int, n long, low double, high double").groupBy("what", "at").agg(F.sum("n"), F.min("low"), F.max("high")).collect()
    number = {(r[0], r[1]): r[2] for r in got}
    low, high = np.zeros(count), np.ones(count)
    for r in got:
        if r[0] == 2:
            low[r[1]], high[r[1]] = r[3], r[4]
    n = number.get((1, 0), 0)
    return n, number.get((1, 1), 0) / max(n, 1), np.array([number.get((0, i), 0) for i in range(len(names))], np.float64), low, high


def _document_scores(q: Queries, b: pa.RecordBatch, late_dim: int) -> np.ndarray | None:
    """The best passage's MaxSim of each query and document of a batch, from the passages' vectors in ``late`` or, for documents with very many, from ``hot``; None where there is none."""
    out = np.full((len(q.ids), b.num_rows), -np.inf)
    passages = pc.list_flatten(b.column("late"))
    if len(passages):
        doc = pc.list_parent_indices(b.column("late")).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors, owner = _passage_vectors(passages, late_dim)
        scores = _late_scores(q, vectors, owner, len(passages))
        first = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
        out[:, doc[first]] = np.maximum.reduceat(scores, first, axis=1)
    sizes = pc.fill_null(pc.list_value_length(b.column("hot")), 0).to_numpy(zero_copy_only=False)
    if (sizes > 0).any():
        out[:, sizes > 0] = pc.list_flatten(b.column("hot")).to_numpy(zero_copy_only=False).reshape(-1, len(q.ids)).T
    return out if (out > -np.inf).any() else None


def _late_scores(q: Queries, vectors: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """MaxSim of each query to each of ``n`` passages, whose vectors ``owner`` numbers in order; -inf for those without any."""
    out = np.full((len(q.ids), n), -np.inf)
    if not len(vectors) or not len(q.late):
        return out
    first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    for lo in range(0, len(q.ids), 64):
        mine = np.nonzero((q.late_owner >= lo) & (q.late_owner < lo + 64))[0]
        if not len(mine):
            continue
        best = np.maximum.reduceat(q.late[mine] @ vectors.T, first, axis=1)
        own = q.late_owner[mine]
        begin = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
        out[own[begin][:, None], owner[first][None, :]] = np.add.reduceat(best, begin, axis=0)
    return out


def _passage_vectors(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a column of arrays of vectors, and the row of each."""
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = pc.list_flatten(lists)
    if not len(inner):
        return np.zeros((0, dim)), row
    usable, x = matrix(inner, dim)
    return x.astype(np.float64), row[usable]


class Scorer:
    """The three scores of a block of documents for a block of queries, as arrays of (score, query, document); -inf where there is none."""

    def __init__(self, queries: Queries, dense_dim: int, late_dim: int):
        self.q, self.dense_dim, self.late_dim = queries, dense_dim, late_dim
        self.index = pa.array(sorted(queries.vocabulary), pa.string())

    def blocks(self, tables):
        for t in tables:
            for lo in range(0, t.num_rows, DOC_BLOCK):
                yield self.block(t.slice(lo, DOC_BLOCK))

    def block(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        q, n = self.q, b.num_rows
        scores = np.full((3, len(q.ids), n), -np.inf)
        usable, x = matrix(b.column("vec"), self.dense_dim)
        if len(x):
            unit = x.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            scores[0][:, usable] = q.dense @ unit.T
            scores[0][~q.dense.any(axis=1)] = -np.inf
        lists = b.column("terms")
        rows, terms = clean_terms(lists)
        length = np.bincount(rows, minlength=n)
        at = pc.fill_null(pc.index_in(terms, value_set=self.index), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = at >= 0
        if hit.any():
            size = len(self.index)
            pairs, tf = np.unique(rows[hit] * size + at[hit], return_counts=True)
            d, t = pairs // size, pairs % size
            weight = q.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(length[d], 1) / max(q.mean_length, 1)))
            table = np.zeros((size, n))
            table[t, d] = weight
            lexical = q.uses.T.astype(np.float64) @ table
            scores[1] = np.where(lexical > 0, lexical, -np.inf)
        best = _document_scores(q, b, self.late_dim)
        if best is not None:
            scores[2] = best
        for i, digits in enumerate(DIGITS):
            np.round(scores[i], digits, out=scores[i])
        return b.column("id").to_numpy(zero_copy_only=False), scores


def _bin(scores: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bin of each score: 0 where there is none, 1 to ``BINS`` in equal steps between bounds."""
    with np.errstate(invalid="ignore"):
        b = (scores - low) * (BINS / np.maximum(high - low, 1e-12))
        return np.where(np.isneginf(scores), 0, 1 + np.clip(np.nan_to_num(b, neginf=0), 0, BINS - 1).astype(np.int64))


def _first_of_each(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep so that of those with the same query and scores only the ``k`` smallest ids stay: they are level, and ids decide."""
    order = np.lexsort((ids, *scores.T, query))
    same = np.concatenate([[False], (query[order][1:] == query[order][:-1]) & (scores[order][1:] == scores[order][:-1]).all(axis=1)])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order[np.arange(len(order)) - start < k]


class Asked:
    """A block of at most ``TAIL_QUERIES`` queries, in order of their number of late vectors; ``limits`` are where the tails of the three scores begin, ``steps`` marks below them."""

    def __init__(self, rows: list, dense_dim: int, late_dim: int):
        vectors = [[v for v in (r[3] or []) if v is not None and len(v) == late_dim] for r in rows]
        order = sorted(range(len(rows)), key=lambda i: len(vectors[i]))
        rows, vectors = [rows[i] for i in order], [vectors[i] for i in order]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.dense = np.zeros((len(rows), dense_dim))
        for i, r in enumerate(rows):
            if r[1] is not None and len(r[1]) == dense_dim:
                v = np.array(r[1], np.float64)
                length = np.linalg.norm(v)
                self.dense[i] = v / length if length else 0
        self.width = np.array([len(v) for v in vectors], np.int64)
        self.late = np.array([v for vs in vectors for v in vs], np.float64).reshape(-1, late_dim)
        self.late_start = np.cumsum(self.width) - self.width
        terms = [sorted({t.strip().lower() for t in (r[2] or []) if t and t.strip()}) for r in rows]
        self.names = sorted({t for ts in terms for t in ts})
        code = {t: i for i, t in enumerate(self.names)}
        self.term = np.array([code[t] for ts in terms for t in ts], np.int64)
        self.term_start = np.cumsum([0, *map(len, terms)])
        self.idf, self.mean_length = np.zeros(len(self.names)), 1.0
        self.limits, self.steps = np.full((3, len(rows)), np.inf), np.full((3, len(STEPS), len(rows)), np.inf)

    def among(self, which: np.ndarray, limits: np.ndarray) -> Asked:
        """Some of the queries, with other limits."""
        out = copy(self)
        out.ids, out.dense, out.width, out.late_start, out.steps, out.limits = self.ids[which], self.dense[which], self.width[which], self.late_start[which], self.steps[:, :, which], limits
        own, at = ranges(self.term_start[which], self.term_start[which + 1])
        out.term, out.term_start = self.term[at], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(which)))])
        return out


class Tile:
    """Some queries of a block, as the single-precision products need them."""

    def __init__(self, asked: Asked, lo: int, hi: int):
        self.lo, self.hi, self.n = lo, hi, hi - lo
        self.dense = asked.dense[lo:hi].astype(np.float32)
        self.most = int(asked.width[lo:hi].max(initial=0))
        late = np.zeros((self.most, self.n, asked.late.shape[1]))
        for j in range(self.most):
            have = np.nonzero(asked.width[lo:hi] > j)[0]
            late[j, have] = asked.late[asked.late_start[lo + have] + j]
        self.reach = np.linalg.norm(late, axis=2).sum(axis=0)
        self.late = late.astype(np.float32)
        start = asked.term_start[lo : hi + 1]
        self.term, self.term_query = asked.term[start[0] : start[-1]], np.repeat(np.arange(self.n), np.diff(start))


def _tiles(asked: Asked) -> list[Tile]:
    return [Tile(asked, lo, min(lo + TILE, len(asked.ids))) for lo in range(0, len(asked.ids), TILE)]


class Chunk:
    """A block of documents with what its scores are made of. Products are in single precision, for the choice of pairs; ``exact`` has the scores themselves."""

    def __init__(self, b: pa.RecordBatch, asked: Asked, index: pa.Array, dense_dim: int, late_dim: int):
        self.asked, self.n = asked, b.num_rows
        self.ids = b.column("id").to_numpy(zero_copy_only=False)
        usable, x = matrix(b.column("vec"), dense_dim)
        self.with_vector = np.nonzero(usable)[0]
        self.row = np.cumsum(usable) - 1
        self.usable = usable
        self.unit = x.astype(np.float64)
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)
        self.columns = np.ascontiguousarray(self.unit.T, np.float32)
        self._passages(b.column("late"), late_dim)
        rows, terms = clean_terms(b.column("terms"))
        length = np.bincount(rows, minlength=self.n)
        at = pc.fill_null(pc.index_in(terms, value_set=index), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(at[at >= 0] * self.n + rows[at >= 0], return_counts=True)
        term, self.posting = pairs // self.n, pairs % self.n
        self.weight = asked.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(length[self.posting], 1) / max(asked.mean_length, 1)))
        self.posting_start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(asked.idf)))])

    def _passages(self, lists: pa.Array, late_dim: int) -> None:
        """Passages in order of their number of vectors, most first; ``layers`` has the first, second, ... vector of each, ``rest`` what is beyond ``LAYERS``."""
        passages = pc.list_flatten(lists)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.vectors, owner = _passage_vectors(passages, late_dim) if len(passages) else (np.zeros((0, late_dim)), np.zeros(0, np.int64))
        sizes = np.bincount(owner, minlength=len(passages))
        held = np.nonzero(sizes)[0]
        held = held[np.argsort(-sizes[held], kind="stable")]
        self.doc, self.size, self.start = doc[held], sizes[held], (np.cumsum(sizes) - sizes)[held]
        single = self.vectors.astype(np.float32)
        self.layers = [np.ascontiguousarray(single[self.start[self.size > j] + j].T) for j in range(min(LAYERS, self.size.max(initial=0)))]
        long = np.nonzero(self.size > LAYERS)[0]
        self.rest_owner, rest = ranges(self.start[long] + LAYERS, self.start[long] + self.size[long])
        self.rest, self.long = single[rest], len(long)
        self.longest = np.sqrt((self.vectors**2).sum(axis=1).max(initial=0))
        self.by_doc = np.argsort(self.doc, kind="stable")
        self.doc_start = np.searchsorted(self.doc[self.by_doc], np.arange(self.n + 1))
        self.one_each = self.by_doc[self.doc_start[:-1][np.diff(self.doc_start) > 0]]

    def dense(self, tile: Tile) -> np.ndarray:
        return tile.dense @ self.columns

    def late(self, tile: Tile) -> np.ndarray:
        """MaxSim of each query of a tile to each passage."""
        total = np.zeros((tile.n, len(self.doc)), np.float32)
        for lo in range(0, len(self.doc), LATE_BLOCK):  # small enough for the cache
            hi = min(lo + LATE_BLOCK, len(self.doc))
            for query in tile.late:
                best = query @ self.layers[0][:, lo:hi]
                for x in self.layers[1:]:
                    if x.shape[1] <= lo:
                        break
                    part = best[:, : min(hi, x.shape[1]) - lo]
                    np.maximum(part, query @ x[:, lo:hi], out=part)
                for at in range(0, len(self.rest) if lo < self.long else 0, TILE_DOCS):
                    own = self.rest_owner[at : at + TILE_DOCS]
                    first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]) & (own >= lo) & (own < hi))[0]
                    if len(first):
                        more = query @ self.rest[at + first[0] : at + np.searchsorted(own, hi)].T
                        best[:, own[first] - lo] = np.maximum(best[:, own[first] - lo], np.maximum.reduceat(more, first - first[0], axis=1))
                total[:, lo:hi] += best
        return total

    def lexical(self, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        """The pairs with a term in common, as sorted numbers query * documents + document, and their BM25 scores."""
        own, at = ranges(self.posting_start[tile.term], self.posting_start[tile.term + 1])
        keys = tile.term_query[own] * self.n + self.posting[at]
        if not len(keys):
            return keys, np.zeros(0)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        return keys[first], np.round(np.add.reduceat(self.weight[at][order], first), DIGITS[1])

    def tails(self, tile: Tile, keys: np.ndarray, lexical: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of which a score is in its tail: query of the block, document of the chunk, scores. The margins are some ten times what single precision can err by; what is no number counts as above.

        Adds to ``above`` some of the documents that are surely at a step or above it: (score, step, query); of a document one passage is asked.
        """
        limits, steps = self.asked.limits[:, tile.lo : tile.hi], self.asked.steps[:, :, tile.lo : tile.hi]
        found = [keys[lexical >= limits[1][keys // self.n]]]
        for kind, at, margin in ((0, self.with_vector, np.full(tile.n, 2e-5)), (2, self.doc, 1e-5 * tile.reach * self.longest)):
            if not len(at) or kind and not tile.most:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                floor = (limits[kind] - margin).astype(np.float32)[:, None]
                over = (steps[kind] + margin).astype(np.float32)[:, :, None]
                for lo in range(0, len(at), len(at) if kind else DENSE_BLOCK):
                    scores = self.late(tile) if kind else tile.dense @ self.columns[:, lo : lo + DENSE_BLOCK]
                    hit = np.flatnonzero(~(scores < floor))
                    query, hit = np.divmod(hit, scores.shape[1])
                    found.append(query * self.n + at[lo + hit])
                    if lo // DENSE_BLOCK % STEP_SHARE == 0:
                        scores = scores[:, self.one_each[::STEP_SHARE]] if kind else scores
                        for total, step in zip(above[kind], over):
                            total[tile.lo : tile.hi] += [np.count_nonzero(x) for x in scores > step]
        pairs = np.unique(np.concatenate(found))
        q, d = pairs // self.n, pairs % self.n
        scores = np.full((3, len(pairs)), -np.inf)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            scores[1] = np.where(keys[at] == pairs, lexical[at], -np.inf)
        self.exact(scores, tile.lo + q, d)
        kept = (scores >= limits[:, q]).any(axis=0)
        return tile.lo + q[kept], d[kept], scores[:, kept]

    def exact(self, scores: np.ndarray, q: np.ndarray, d: np.ndarray) -> None:
        """Dense and late scores of pairs, in double precision, each by itself, so that copies are level wherever they lie; rounded."""
        asked = self.asked
        good = np.nonzero(self.usable[d] & asked.dense[q].any(axis=1))[0]
        for lo in range(0, len(good), EXACT_ROWS // 32):
            at = good[lo : lo + EXACT_ROWS // 32]
            scores[0, at] = np.round((asked.dense[q[at]] * self.unit[self.row[d[at]]]).sum(axis=1), DIGITS[0])
        good = np.nonzero((self.doc_start[d + 1] > self.doc_start[d]) & (asked.width[q] > 0))[0]
        if not len(good):
            return
        total = np.concatenate([[0], np.cumsum(self.size[self.by_doc])])
        part = np.cumsum(total[self.doc_start[d[good] + 1]] - total[self.doc_start[d[good]]]) // (EXACT_ROWS // 16)
        for at in np.split(good, np.nonzero(np.diff(part))[0] + 1):
            pair, passage = ranges(self.doc_start[d[at]], self.doc_start[d[at] + 1])
            passage = self.by_doc[passage]
            one, row = ranges(self.start[passage], self.start[passage] + self.size[passage])
            x, query = self.vectors[row], q[at][pair]
            first = np.cumsum(self.size[passage]) - self.size[passage]
            summed = np.zeros(len(passage))
            for j in range(int(asked.width[query].max())):
                have = asked.width[query] > j
                a = asked.late[np.where(have, asked.late_start[query] + j, 0)]
                summed += np.where(have, np.maximum.reduceat((x * a[one]).sum(axis=1), first), 0)
            scores[2, at] = np.round(np.maximum.reduceat(summed, np.searchsorted(pair, np.arange(len(at)))), DIGITS[2])


def _chunks(batches, asked: Asked, dense_dim: int, late_dim: int):
    index = pa.array(asked.names, pa.string())
    for b in batches:
        for lo in range(0, b.num_rows, TILE_DOCS):
            yield Chunk(b.slice(lo, TILE_DOCS), asked, index, dense_dim, late_dim)


def _frequencies(docs: DataFrame, asked: Asked) -> tuple[float, np.ndarray]:
    """The mean length of the records with a non-NULL array of terms, and the inverse document frequency of each wanted term."""
    names = asked.names
    schema = pa.schema([("at", pa.int64()), ("n", pa.int64())])

    def read(batches):
        index, found = pa.array(names, pa.string()), np.zeros(len(names) + 2, np.int64)
        for b in batches:
            lists = b.column("terms")
            rows, terms = clean_terms(lists)
            at = pc.fill_null(pc.index_in(terms, value_set=index), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = np.unique(rows[at >= 0] * len(found) + at[at >= 0])
            found += np.bincount(pairs % len(found), minlength=len(found))
            found[-2:] += len(lists) - lists.null_count, len(rows)
        used = np.nonzero(found)[0]
        yield batch(schema, used, found[used])

    got = docs.select("terms").mapInArrow(read, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(names) + 2)
    found[got.column("at").to_numpy()] = got.column("n").to_numpy()
    n, df = found[-2], found[:-2]
    return found[-1] / max(n, 1), np.log(1 + (n - df + 0.5) / (df + 0.5))


def _limits(docs: DataFrame, asked: Asked, n: int, dense_dim: int, late_dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the tails begin and the steps below them, judged by a sample: (score, query) and (score, step, query). Any limits give right rows; they decide how many pairs go on."""
    context = docs.sparkSession.sparkContext
    files, size = sorted(docs.inputFiles()), min(SAMPLE, max(SAMPLE // 8, n // 16))
    some = files[: -(-len(files) * size // n) + 1]  # the rows lie in the files by a hash of their ids
    sample = docs.sparkSession.read.schema(docs.schema).parquet(*some).select("id", "vec", "terms", "late").limit(size).toArrow()
    rank = max(SAMPLE_RANK, -(-LEAST_TAIL * sample.num_rows // n))
    ranks = [rank, *(max(rank, round(x * sample.num_rows)) for x in STEPS)]
    tiles = -(-len(asked.ids) // TILE)
    held = context.broadcast((asked, sample))
    schema = pa.schema([("q", pa.int64()), *((f"t{i}", pa.float64()) for i in range(3 * len(ranks)))])

    def judge(batches):
        asked, sample = held.value
        mine = [Tile(asked, lo, min(lo + TILE, len(asked.ids))) for b in batches for lo in (b.column("id").to_numpy(zero_copy_only=False) * TILE).tolist()]
        chunks = list(_chunks(sample.to_batches() if mine else [], asked, dense_dim, late_dim))
        for t in mine:
            limits = np.full((3, len(ranks), t.n), np.inf)
            for kind in range(3):
                sizes = [(len(c.with_vector), c.n, len(c.one_each) if t.most else 0)[kind] for c in chunks]
                scores = np.empty((t.n, sum(sizes)), np.float32)
                if not scores.shape[1]:
                    limits[kind] = -np.inf
                    continue
                for chunk, size, end in zip(chunks, sizes, np.cumsum(sizes)):
                    part = scores[:, end - size : end]
                    if kind == 1:
                        keys, lexical = chunk.lexical(t)
                        table = np.zeros((t.n, chunk.n), np.float32)
                        table.reshape(-1)[keys] = lexical
                        part[:] = table
                    elif size:
                        with np.errstate(over="ignore", invalid="ignore"):
                            part[:] = chunk.late(t)[:, chunk.one_each] if kind else chunk.dense(t)
                within = [scores.shape[1] - min(r, scores.shape[1]) for r in ranks]
                scores.partition(sorted({*within}), axis=1)
                limits[kind] = scores[:, within].T
            limits = np.clip(limits, -1e300, 1e300)  # infinity stands for queries without the part
            limits[0][:, ~asked.dense[t.lo : t.hi].any(axis=1)] = np.inf
            limits[1] = np.maximum(limits[1], 1e-12)
            limits[2][:, asked.width[t.lo : t.hi] == 0] = np.inf
            yield batch(schema, np.arange(t.lo, t.hi), *limits.reshape(-1, t.n))

    got = docs.sparkSession.range(0, tiles, 1, min(tiles, 4 * context.defaultParallelism)).mapInArrow(judge, "q long, " + ", ".join(f"t{i} double" for i in range(3 * len(ranks)))).toArrow()
    held.unpersist()
    limits = np.empty((3 * len(ranks), len(asked.ids)))
    limits[:, got.column("q").to_numpy()] = np.stack([got.column(f"t{i}").to_numpy() for i in range(3 * len(ranks))])
    limits = limits.reshape(3, len(ranks), -1)
    return limits[:, 0], limits[:, 1:]


def _rank_by_tails(docs: DataFrame, asked: Asked, n: int, dense_dim: int, late_dim: int, weights: np.ndarray, k: int) -> tuple[DataFrame, list[int]]:
    """The first ``k`` documents of the queries for which the tails of the scores prove them, and the ids of the queries that are open.

    One reading gives every pair of which a score is in its tail, with all three scores, and how many documents have a score. So the place of a score in
    a tail is exact, that of a missing score too, and any other is below the tail and below as many documents as were counted above the next step. Pairs in no tail are bounded by the tails' ends. A query is
    proved if its first ``k`` are known exactly and no other pair's upper bound reaches them. For those that are not, further readings lower the tails to the scores that matter.
    """
    asked.mean_length, asked.idf = _frequencies(docs, asked)
    asked.limits, asked.steps = _limits(docs, asked, n, dense_dim, late_dim)
    found, rest, which, block, most = None, [], np.arange(len(asked.ids)), asked, MOST_TAIL
    for down in (*WIDER, None):
        part, left, needs = _by_tails(docs, block, n, dense_dim, late_dim, weights, k, most, down)
        found, which, most = part if found is None else found.unionByName(part), which[left], 16 * most
        again = np.zeros(len(left), bool) if down is None else ~np.isneginf(needs).any(axis=0)
        again[np.nonzero(again)[0][round(4 / 3 / STEPS[down or 0]) :]] = False  # what a further reading gives is some times the documents at most
        rest.append(which[~again])
        which = which[again]
        if not len(which):
            break
        block = asked.among(which, needs[:, again])
    rest = np.concatenate(rest)
    ids, times = np.unique(asked.ids, return_counts=True)
    twice = np.intersect1d(ids[times > 1], asked.ids[rest]).tolist()  # all rows of such an id are open
    return found.where(~F.col("query_id").isin(twice)) if twice else found, asked.ids[rest].tolist()


def _by_tails(docs: DataFrame, asked: Asked, n: int, dense_dim: int, late_dim: int, weights: np.ndarray, k: int, most: int, down: int | None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """One reading of ``_rank_by_tails``: rows, which queries are open, and the limits that those need, down to a step."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(asked)
    columns = pa.schema([("q", pa.int32()), ("id", pa.int64()), ("s0", pa.float64()), ("s1", pa.float64()), ("s2", pa.float64()), ("counts", pa.list_(pa.float64()))])
    wide = 3 * (1 + len(STEPS))

    def tails(batches):
        asked = shared.value
        tiles, held, rows = _tiles(asked), [], np.zeros(len(asked.ids), np.int64)
        above = np.zeros((3, 1 + len(STEPS), len(asked.ids)))  # documents with a score, and at each step
        for chunk in _chunks(batches, asked, dense_dim, late_dim):
            above[0, 0] += len(chunk.with_vector)
            above[2, 0] += len(chunk.one_each)
            for t in tiles:
                keys, lexical = chunk.lexical(t)
                query = keys // chunk.n
                above[1, 0, t.lo : t.hi] += np.bincount(query, minlength=t.n)
                for j in range(len(STEPS)):
                    above[1, 1 + j, t.lo : t.hi] += np.bincount(query[lexical >= asked.steps[1, j, t.lo + query]], minlength=t.n)
                q, d, scores = chunk.tails(t, keys, lexical, above[:, 1:])
                rows[t.lo : t.hi] += np.bincount(q - t.lo, minlength=t.n)
                good = rows[q] <= most  # beyond that the query stays open
                held.append((q[good], chunk.ids[d[good]], scores[:, good]))
            if sum(len(h[0]) for h in held) > 1 << 18:
                q, ids, scores = (np.concatenate(x, axis=-1) for x in zip(*held))
                yield batch(columns, q, ids, *scores, pa.nulls(len(q), columns.field("counts").type))
                held = []
        above[:, :, rows > most] = np.nan
        if held:
            q, ids, scores = (np.concatenate(x, axis=-1) for x in zip(*held))
            yield batch(columns, q, ids, *scores, pa.nulls(len(q), columns.field("counts").type))
        none, counts = np.zeros(len(asked.ids)), above.reshape(wide, -1).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * wide), pa.array(np.ascontiguousarray(counts).reshape(-1)))
        yield batch(columns, np.arange(len(counts)), pa.nulls(len(counts), pa.int64()), none, none, none, lists)

    names = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("z_dense", pa.float64()), ("z_lexical", pa.float64()), ("z_late", pa.float64())])
    place = lambda p: normal_quantile(np.clip(p, 1e-300, 1 - 1e-16))

    def prove(limits: np.ndarray, steps: np.ndarray, above: np.ndarray, ids: np.ndarray, s: np.ndarray):
        """``ids, score, z`` of the first ``k`` of a query; for an open one the limits that it needs, -inf if that is not known."""
        if np.isnan(above).any() or len(ids) < k:
            return np.full(3, -np.inf)
        low, high, edge = np.empty(s.shape), np.empty(s.shape), np.empty(3)
        for i in range(3):
            has_it = 0 if limits[i] == np.inf else above[i, 0]
            lack, within = n - has_it, s[i] >= limits[i]
            tail = np.sort(s[i][within])
            edge[i] = (n - len(tail) - 0.5) / n if has_it > len(tail) else lack / 2 / n
            below, level = np.searchsorted(tail, s[i], "left"), np.searchsorted(tail, s[i], "right")
            inside = (n - len(tail) + (below + level) / 2) / n
            missing = np.isneginf(s[i])
            low[i] = np.where(within, inside, np.where(missing, lack / 2 / n, (lack + 0.5) / n))
            under = np.full(s.shape[1], edge[i])
            for step, more in zip(steps[i], above[i, 1:]):
                under = np.where(s[i] < step, np.minimum(under, (n - more - 0.5) / n), under)
            high[i] = np.where(within, inside, np.where(missing, lack / 2 / n, under))
        low, high = place(low), place(high)
        lower, upper = weights @ low, weights @ high
        bar = np.partition(lower, len(lower) - k)[len(lower) - k]
        if weights @ place(edge) >= bar - 1e-9:
            return np.minimum(limits, steps[:, down or 0])
        left = np.nonzero(upper >= bar - 1e-9)[0]
        unknown = low[:, left] != high[:, left]
        if unknown.any():
            return np.minimum(limits, np.maximum(steps[:, down or 0], np.where(unknown, s[:, left], np.inf).min(axis=1)))
        score = lower[left] / weights.sum()
        first = left[np.lexsort((ids[left], -np.round(score, 12)))[:k]]
        return ids[first], lower[first] / weights.sum(), low[:, first]

    def resolve(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        asked = shared.value
        q = rows.column("q").to_numpy()
        counted = rows.filter(rows.column("id").is_null())
        above = np.zeros((len(asked.ids), wide))
        np.add.at(above, counted.column("q").to_numpy(), counted.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, wide))
        above = above.reshape(-1, 3, 1 + len(STEPS))
        order = np.argsort(q, kind="stable")
        q, rest = q[order], rows.column("id").is_valid().to_numpy()[order]
        ids, s = rows.column("id").fill_null(0).to_numpy()[order], np.stack([rows.column(f"s{i}").to_numpy()[order] for i in range(3)])
        start = np.nonzero(np.concatenate([[True], q[1:] != q[:-1]]))[0]
        out = []
        for lo, hi in zip(start, [*start[1:], len(q)]):
            pairs, i = np.nonzero(rest[lo:hi])[0] + lo, q[lo]
            got = prove(asked.limits[:, i], asked.steps[:, :, i], above[i], ids[pairs], s[:, pairs])
            if not isinstance(got, tuple):
                out.append(batch(names, asked.ids[i : i + 1], pa.nulls(1, pa.int64()), np.array([i]), np.zeros(1), *got[:, None]))
            else:
                out.append(batch(names, np.full(len(got[0]), asked.ids[i]), got[0], np.arange(1, len(got[0]) + 1), got[1], *got[2]))
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    pairs = docs.select("id", "vec", "terms", "late").coalesce(16 * context.defaultParallelism).mapInArrow(tails, "q int, id long, s0 double, s1 double, s2 double, counts array<double>")
    kind = "query_id long, id long, rank int, score double, z_dense double, z_lexical double, z_late double"
    found = stage_table(pairs.repartition("q").mapInArrow(resolve, kind), "proved")
    shared.unpersist()
    left = found.where("id is null").select("rank", "z_dense", "z_lexical", "z_late").toArrow()
    return found.where("id is not null"), left.column("rank").to_numpy().astype(np.int64), np.stack([left.column(c).to_numpy() for c in ("z_dense", "z_lexical", "z_late")])


def rank_documents(docs: DataFrame, passages: DataFrame, queries: DataFrame, *, dense_dim: int, late_dim: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), k: int = 5) -> DataFrame:
    """``query_id, id, rank, score, z_dense, z_lexical, z_late``: the first ``k`` documents of each query in one ranking of all.

    ``docs``: ``id, vec, terms``; ``passages``: ``document_id, late``; ``queries``: ``query_id, vec, terms, late``. Each document has a cosine,
    a BM25 score of the distinct query terms and its best passage's MaxSim. Each of the three becomes its empirical percentile among all documents
    for that query, ties averaged, and that its normal quantile; the ranking is by the weighted mean of the quantiles, ties by the smaller id. A score that a document lacks (no
    usable vector, no term in common, no passage) is below all others, and all that lack it are tied. A query without a part has all documents
    tied in it. Documents with a NULL id and passages of no document are left out; ids must be unique. An empty table gives no rows.

    Passages are brought to their documents once, as vectors, so that what moves does not depend on the number of queries; documents with more than
    ``HOT_PASSAGES`` of them have theirs scored where they lie, and only the maxima move. Exact. Where there are no such documents and at least ``TAIL_DOCS`` in all, ``_rank_by_tails`` goes first; queries that
    it leaves open, and else all, take three readings for each block of at most ``QUERY_BLOCK``: 1. a histogram of every score; it bounds every percentile
    from both sides. 2. documents whose upper bound reaches the ``k``-th largest lower bound seen by their task are candidates: no document of the first ``k`` can be missing.
    3. the numbers of documents below and level with each candidate are counted, which gives its exact percentiles.
    """
    whole = docs.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), "terms").where("id is not null")
    late = passages.select(F.col("document_id").cast("long").alias("id"), F.col("late").cast("array<array<float>>").alias("late")).where("id is not null and size(late) > 0")
    many = late.groupBy("id").count().where(F.col("count") > HOT_PASSAGES).select("id")
    many = stage_table(many, "many")
    any_hot = not many.isEmpty()
    few = late.join(many, "id", "left_anti") if any_hot else late
    whole = whole.join(few.groupBy("id").agg(F.collect_list("late").alias("late")), "id", "left")
    whole = stage_table(whole, "docs")
    hot = stage_table(late.join(many, "id"), "passages") if any_hot else None
    n = whole.count()
    listed = queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>"), "terms", F.col("late").cast("array<array<double>>")).where("query_id is not null")
    weighed = np.array(weights, np.float64)
    found = None
    if not any_hot and n >= TAIL_DOCS and (weighed >= 0).all():
        ids = []
        for block in _query_blocks(listed, TAIL_QUERIES):
            rows = [r for b in block.toArrow().to_batches(1024) for r in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                part, left = _rank_by_tails(whole, Asked(rows, dense_dim, late_dim), n, dense_dim, late_dim, weighed, k)
                found = part if found is None else found.unionByName(part)
                ids += left
        listed = listed.where(F.col("query_id").isin(ids)) if len(ids) <= QUERY_BLOCK else listed.join(F.broadcast(whole.sparkSession.createDataFrame(pa.table({"query_id": ids}))), "query_id", "left_semi")
    for block in _query_blocks(listed, QUERY_BLOCK):
        rows = [tuple(r) for r in block.collect()]
        if not rows or not n:
            continue
        part = _rank(whole, hot, Queries(rows, dense_dim, late_dim), n, dense_dim, late_dim, weighed, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return whole.sparkSession.createDataFrame([], "query_id long, id long, rank int, score double, z_dense double, z_lexical double, z_late double")
    return found


def _query_blocks(listed: DataFrame, most: int):
    blocks = max(1, -(-listed.count() // most))
    for i in range(blocks):
        yield listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def _best_passages(late: DataFrame, q: Queries, late_dim: int, shared) -> DataFrame:
    """``id, late``: the best MaxSim of a document's passages for each query. Each task keeps one row of maxima for a document, so that one with very many passages sends few rows."""
    schema = pa.schema([("id", pa.int64()), ("late", pa.list_(pa.float64()))])

    def lists(ids: np.ndarray, scores: np.ndarray):
        yield batch(schema, ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * scores.shape[1]), pa.array(np.ascontiguousarray(scores).reshape(-1))))

    def reduce(ids: np.ndarray, scores: np.ndarray):
        order = np.argsort(ids, kind="stable")
        first = np.nonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))[0]
        return ids[order][first], np.maximum.reduceat(scores[order], first, axis=0)

    def score(batches):
        for b in batches:
            for part in (b.slice(a, HOT_PASSAGES) for a in range(0, b.num_rows, HOT_PASSAGES)):
                vectors, owner = _passage_vectors(part.column(1), late_dim)
                s = _late_scores(shared.value, vectors, owner, part.num_rows).T
                held = ~np.isneginf(s).all(axis=1)
                if held.any():
                    yield from lists(*reduce(part.column(0).to_numpy(zero_copy_only=False)[held], s[held]))

    partial = late.mapInArrow(score, "id long, late array<double>")

    def fold(batches):
        held_id, held = None, None
        for b in batches:
            ids, s = b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            ids, s = reduce(ids, s)
            if held_id is not None:
                if ids[0] == held_id:
                    s[0] = np.maximum(s[0], held)
                else:
                    yield from lists(np.array([held_id]), held[None, :])
            held_id, held = ids[-1], s[-1].copy()
            if len(ids) > 1:
                yield from lists(ids[:-1], s[:-1])
        if held_id is not None:
            yield from lists(np.array([held_id]), held[None, :])

    return partial.repartition("id").sortWithinPartitions("id").mapInArrow(fold, "id long, late array<double>")


def _rank(docs: DataFrame, hot: DataFrame | None, q: Queries, n: int, dense_dim: int, late_dim: int, weights: np.ndarray, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    first = context.broadcast(q)
    if hot is None:
        routed = docs.withColumn("hot", F.lit(None).cast("array<double>"))
    else:
        routed = stage_table(docs.join(_best_passages(hot, q, late_dim, first).withColumnRenamed("late", "hot"), "id", "left"), "scored")
    q.n, q.mean_length, df, late_low, late_high = _statistics(routed, first, late_dim)
    q.idf = np.log(1 + (q.n - df + 0.5) / (df + 0.5))
    shared = context.broadcast(q)
    count = len(q.ids)
    lexical = (q.idf * (K1 + 1)) @ q.uses
    low = np.stack([np.full(count, -1.0), np.zeros(count), late_low])
    high = np.stack([np.ones(count), np.maximum(lexical, 1e-9), late_high])
    slots = np.arange(3 * count).reshape(3, count, 1)
    wide = BINS + 1

    def histogram(batches):
        scorer, total = Scorer(shared.value, dense_dim, late_dim), np.zeros(3 * count * wide, np.int64)
        for _, scores in scorer.blocks(batches):
            total += np.bincount((slots * wide + _bin(scores, low[:, :, None], high[:, :, None])).reshape(-1), minlength=len(total))
        used = np.nonzero(total)[0]
        yield batch(pa.schema([("cell", pa.int64()), ("n", pa.int64())]), used, total[used])

    cells = routed.select(*COLUMNS).mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(3 * count * wide, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    table = table.reshape(3, count, wide)
    below = np.cumsum(table, axis=2) - table
    tied = table / 2
    tied[:, :, 1:] = 0.5
    least = weights[:, None, None] * normal_quantile(np.clip(percentile(below, 2 * tied, n), 1e-300, 1 - 1e-16))
    top = below + np.maximum(table, 1) - 0.5
    top[:, :, 0] = below[:, :, 0] + table[:, :, 0] / 2
    most = weights[:, None, None] * normal_quantile(np.clip(top / n, 1e-300, 1 - 1e-16))
    bounds = context.broadcast((least.reshape(-1), most.reshape(-1)))
    names = pa.schema([("q", pa.int32()), ("id", pa.int64()), ("s0", pa.float64()), ("s1", pa.float64()), ("s2", pa.float64())])

    def candidates(batches):
        scorer, (floor, ceiling) = Scorer(shared.value, dense_dim, late_dim), bounds.value
        best = np.full((count, k), -np.inf)
        held: list[tuple] = []
        for ids, scores in scorer.blocks(batches):
            at = slots * wide + _bin(scores, low[:, :, None], high[:, :, None])
            lower, upper = floor[at].sum(axis=0), ceiling[at].sum(axis=0)
            best = -np.sort(-np.concatenate([best, lower], axis=1), axis=1)[:, :k] if lower.shape[1] <= k else -np.sort(np.partition(-np.concatenate([best, lower], axis=1), k - 1, axis=1)[:, :k], axis=1)
            row, col = np.nonzero(upper >= best[:, -1:] - 1e-12)
            kept = _first_of_each(row, ids[col], scores[:, row, col].T, k)
            row, col = row[kept], col[kept]
            held.append((row, ids[col], upper[row, col], scores[:, row, col].T))
        if held:
            row, ids, upper, s = (np.concatenate(x) for x in zip(*held))
            good = np.nonzero(upper >= best[row, -1] - 1e-12)[0]
            good = good[_first_of_each(row[good], ids[good], s[good], k)]
            yield batch(names, row[good], ids[good], *s[good].T)

    chosen = stage_table(routed.select(*COLUMNS).mapInArrow(candidates, "q int, id long, s0 double, s1 double, s2 double"), "candidates")
    return _exact(routed, chosen, shared, q, n, dense_dim, late_dim, weights, k, low, high, below, table, bounds)


def _exact(routed, chosen, shared, q, n, dense_dim, late_dim, weights, k, low, high, below, table, bounds) -> DataFrame:
    count, wide = len(q.ids), BINS + 1
    # the tasks' candidates once more under the bound over all tasks; what is left is a few for each query
    schema = pa.schema([("q", pa.int32()), ("id", pa.int64()), ("s0", pa.float64()), ("s1", pa.float64()), ("s2", pa.float64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def bounded(batches):
        floor, ceiling = bounds.value
        for b in batches:
            row = b.column("q").to_numpy(zero_copy_only=False).astype(np.int64)
            s = np.stack([b.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(3)])
            at = np.empty((3, len(row)), np.int64)
            for i in range(3):
                at[i] = (i * count + row) * wide + _bin(s[i], low[i][row], high[i][row])
            yield batch(schema, row, b.column("id"), *s, floor[at].sum(axis=0), ceiling[at].sum(axis=0))

    with_bounds = chosen.mapInArrow(bounded, "q int, id long, s0 double, s1 double, s2 double, lower double, upper double")
    kth = with_bounds.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))).where(F.col("r") == k).select("q", F.col("lower").alias("bar"))
    level = F.row_number().over(Window.partitionBy("q", "s0", "s1", "s2").orderBy("id"))
    left = with_bounds.join(kth, "q", "left").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar") - 1e-12)).withColumn("level", level).where(F.col("level") <= k).select("q", "id", "s0", "s1", "s2")
    left = stage_table(left, "left")
    got = left.toArrow()
    row = got.column("q").to_numpy().astype(np.int64)
    s = np.stack([got.column(f"s{i}").to_numpy() for i in range(3)])
    points = []  # for each kind of score and query, the distinct scores of its candidates in order
    for i in range(3):
        order = np.lexsort((s[i], row))
        points.append((np.searchsorted(row[order], np.arange(count + 1)), s[i][order]))
    offsets = np.cumsum([0, *(len(p) for _, p in points)])
    kept = routed.sparkSession.sparkContext.broadcast(points)

    def ranks(batches):
        scorer = Scorer(shared.value, dense_dim, late_dim)
        lower, equal = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
        for _, scores in scorer.blocks(batches):
            for i, (start, values) in enumerate(kept.value):
                for r in range(count):
                    v = values[start[r] : start[r + 1]]
                    if len(v):
                        ordered = np.sort(scores[i, r])
                        left_, right_ = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
                        lower[offsets[i] + start[r] : offsets[i] + start[r + 1]] += left_
                        equal[offsets[i] + start[r] : offsets[i] + start[r + 1]] += right_ - left_
        used = np.nonzero(lower + equal)[0]
        yield batch(pa.schema([("at", pa.int64()), ("lower", pa.int64()), ("equal", pa.int64())]), used, lower[used], equal[used])

    counted = routed.select(*COLUMNS).mapInArrow(ranks, "at long, lower long, equal long").groupBy("at").agg(F.sum("lower").alias("lower"), F.sum("equal").alias("equal")).toArrow()
    lower, equal = np.zeros(offsets[-1]), np.zeros(offsets[-1])
    lower[counted.column("at").to_numpy()], equal[counted.column("at").to_numpy()] = counted.column("lower").to_numpy(), counted.column("equal").to_numpy()
    z = np.empty((3, len(row)))
    for i in range(3):
        order = np.lexsort((s[i], row))
        z[i][order] = normal_quantile(np.clip(percentile(lower[offsets[i] : offsets[i + 1]], equal[offsets[i] : offsets[i + 1]], n), 1e-300, 1 - 1e-16))
    score = weights @ z / weights.sum()
    ids = got.column("id").to_numpy()
    order = np.lexsort((ids, -np.round(score, 12), row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
    first = order[place < k]
    rank = place[place < k] + 1
    out = pa.table({"query_id": q.ids[row[first]], "id": ids[first], "rank": rank.astype(np.int32), "score": score[first], "z_dense": z[0][first], "z_lexical": z[1][first], "z_late": z[2][first]})
    for held in (kept, bounds, shared):  # all that was asked of them has come out
        held.unpersist()
    return routed.sparkSession.createDataFrame(out)
