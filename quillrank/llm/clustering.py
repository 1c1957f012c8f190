"""Similarity clusters: MinHash banding, exact Jaccard, stars around the highest-degree medoids, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from .arrow import batch, lists_of, matrix, mix64, ranges
from .components import connected_components

FEATURES, BANDS, BAND_ROWS = 24, 24, 2
SAMPLE_ROWS, SEEN_ROWS, BUCKET_ROWS, CHUNK_ROWS, CENTRE_BLOCK, SUM_ROWS = 20_000, 64, 50_000, 100_000, 2048, 50_000
#: Buckets of up to ``SMALL_ROWS`` rows are compared together, ``PAIR_BLOCK`` pairs at a time, those of up to ``MIDDLE_ROWS`` with others of about their size, larger ones by tiles. The side of a row where its bucket is whole.
SMALL_ROWS, MIDDLE_ROWS, PAIR_BLOCK, TILE, WHOLE = 24, 256, 200_000, 512, -1
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


class Sets:
    """Vectors as sets, and the sets as MinHash bands.

    Each of ``FEATURES`` random rotations gives a set one element: the axis that the rotated vector lies nearest to, with its
    side. Two sets agree the more, the smaller the angle. A band is the pair of two MinHash values.
    """

    def __init__(self, dim: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = dim
        self.turns = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(FEATURES)], axis=1).astype(np.float32)
        self.hashes = rng.integers(1, 2**63, (BANDS * BAND_ROWS, FEATURES * 2 * dim), dtype=np.int64).astype(np.uint64)

    def elements(self, x: np.ndarray) -> np.ndarray:
        y = (x @ self.turns).reshape(len(x), FEATURES, self.dim)
        axis = np.abs(y).argmax(axis=2)
        side = np.take_along_axis(y, axis[:, :, None], 2)[:, :, 0] > 0
        return (2 * axis + side).astype(np.uint8)

    def buckets(self, elements: np.ndarray) -> np.ndarray:
        """The bucket of each row in each band, one of 65,536."""
        at = elements.astype(np.int64) + np.arange(FEATURES)[None, :] * 2 * self.dim
        out = np.empty((len(at), BANDS), np.uint16)
        for band in range(BANDS):
            key = np.full(len(at), band + 1, np.uint64)
            for k in range(BAND_ROWS):
                key = mix64(key * np.uint64(31) + self.hashes[band * BAND_ROWS + k][at].min(axis=1))
            out[:, band] = key >> np.uint64(48)
        return out


def agreements(jaccard: float) -> int:
    """How many of the ``FEATURES`` elements must agree for that Jaccard similarity of the sets."""
    return math.ceil(2 * FEATURES * jaccard / (1 + jaccard) - 1e-9)


def _agree(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (elements or bands, by column, and by bucket where there are several) agree in at least ``least`` columns, each with each."""
    total = np.zeros((*a.shape[1:], b.shape[-1]), np.uint8)
    same = np.empty(total.shape, bool)
    for x, y in zip(a, b):
        np.equal(x[..., :, None], y[..., None, :], out=same)
        np.add(total, same.view(np.uint8), out=total)
    return total >= least


def linked_rows(bucket: np.ndarray, side: np.ndarray, elements: np.ndarray, bands: np.ndarray | None, least: int):
    """Every two rows of a bucket that agree in at least ``least`` elements: row numbers ``i, j`` of the pairs, or those of the rows and columns of a mask and the mask.

    Rows come by ``bucket``. Where one holds both sides 0 and 1, two parts of a split bucket meet in it, and only rows of different sides are compared. With ``bands``, a pair comes out in the first
    band alone that the two share: once, whatever number of buckets they meet in.
    """
    start = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
    size = np.diff(np.append(start, len(bucket)))
    small = np.repeat(np.where(size <= SMALL_ROWS, start + size, 0), size)
    owner, other = ranges(np.arange(1, len(bucket) + 1), small)

    words = np.ascontiguousarray(elements.view(np.uint64).T)  # eight elements in each

    def own(i: np.ndarray, j: np.ndarray):
        good = (side[i] != side[j]) | (side[i] == WHOLE)
        i, j = i[good], j[good]
        if bands is not None:
            first = ((bands[i] == bands[j]).argmax(axis=1)) == bucket_band(bucket[i])
            i, j = i[first], j[first]
        return i, j, None

    for lo in range(0, len(owner), PAIR_BLOCK):
        i, j = owner[lo : lo + PAIR_BLOCK], other[lo : lo + PAIR_BLOCK]
        differ = np.zeros(len(i), np.uint8)
        for word in words:  # the high bit of each byte that is not zero
            x = word[i] ^ word[j]
            differ += np.bitwise_count(((x & LOW) + LOW | x) & ~LOW)
        good = differ <= FEATURES - least
        yield own(i[good], j[good])
    middle, large = (size > SMALL_ROWS) & (size <= MIDDLE_ROWS), size > max(SMALL_ROWS, MIDDLE_ROWS)
    for lo, n in _alike(start[middle], size[middle]):
        place = np.arange(n.max())
        at = lo[:, None] + np.minimum(place, n[:, None] - 1)  # the last row again where a bucket has fewer
        e = np.ascontiguousarray(elements[at].transpose(2, 0, 1))
        mask = _agree(e, e, least)
        mask &= (place[:, None] < place) & (place < n[:, None])[:, None, :]
        k, i, j = np.unravel_index(np.flatnonzero(mask), mask.shape)
        yield own(at[k, i], at[k, j])
    for lo, n in zip(start[large].tolist(), size[large].tolist()):
        at = np.arange(lo, lo + n)
        band = int(bucket_band(bucket[lo]))
        e = np.ascontiguousarray(elements[at].T)
        k = None if bands is None else np.ascontiguousarray(bands[at, :band].T)
        parts = [np.nonzero(side[at] == v)[0] for v in (0, 1)] if side[lo] != WHOLE else None
        for x, y, own in _tiles(n) if parts is None else _across(*parts):
            mask = _agree(e[:, x], e[:, y], least)
            if own:
                mask &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
            if k is not None and band:
                mask &= ~_agree(k[:, x], k[:, y], 1)
            yield at[x], at[y], mask


def bucket_band(bucket):
    return (bucket >> 16) & 31


def _alike(start: np.ndarray, size: np.ndarray):
    """Buckets of about one size (by an eighth at most), as many at a time as have the cells of a tile: their starts and sizes."""
    order = np.argsort(size, kind="stable")
    start, size = start[order], size[order]
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(size, size[lo] * 9 // 8, "right"))
        hi = min(hi, lo + max(1, TILE * TILE // int(size[hi - 1]) ** 2))
        yield start[lo:hi], size[lo:hi]
        lo = hi


def _tiles(n: int):
    """Blocks of rows and columns of the upper triangle, and whether they are the same rows."""
    cuts = [np.arange(lo, min(lo + TILE, n)) for lo in range(0, n, TILE)]
    for i, x in enumerate(cuts):
        for j in range(i, len(cuts)):
            yield x, cuts[j], i == j


def _across(a: np.ndarray, b: np.ndarray):
    for lo in range(0, len(a), TILE):
        for low in range(0, len(b), TILE):
            yield a[lo : lo + TILE], b[low : low + TILE], False


def _met(rows: DataFrame, dim: int, reduce, schema: str, *, bands: bool = True, degrees: bool = False) -> DataFrame:
    """What ``reduce`` gives of the rows of whole buckets, ``rows`` being ``id, vec`` (and ``degree``): it gets bucket, side, id, elements, bands and degrees as arrays.

    A record is sent to one bucket in each band. Buckets that a sample shows to hold more than ``BUCKET_ROWS`` rows are split into parts of which every two meet in a bucket of their own, so that no task gets more, and no pair is lost.
    """
    sets = Sets(dim)
    n = rows.count()
    step = max(1, min(BUCKET_ROWS // SEEN_ROWS, n // SAMPLE_ROWS))

    def own(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = sets.buckets(elements)
        return key, ((np.arange(BANDS)[None, :] << 16) + key).astype(np.int64).reshape(-1)

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(own(sets.elements(matrix(b.column(0), dim)[1]))[1])], names=["bucket"])

    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("vec").mapInArrow(seen, "bucket long")
    found = sampled.groupBy("bucket").count().where(F.col("count") * step > BUCKET_ROWS).orderBy("bucket").toArrow()
    hot, parts = found.column("bucket").to_numpy(), np.ceil(found.column("count").to_numpy() * step / BUCKET_ROWS).astype(np.int64)
    routed = pa.schema([("bucket", pa.int64()), ("side", pa.int8()), ("id", pa.int64()), ("elements", pa.binary()), ("degree", pa.int64())])
    width = FEATURES + 2 * BANDS * bands

    def route(batches):
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                usable, x = matrix(b.column(1), dim)
                ids = b.column(0).to_numpy(zero_copy_only=False)[usable]
                degree = b.column(2).to_numpy(zero_copy_only=False)[usable]
                elements = sets.elements(x)
                key, bucket = own(elements)
                again, side = np.repeat(np.arange(len(ids)), BANDS), np.full(len(bucket), WHOLE, np.int8)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
                    split = np.where(hot[at] == bucket, parts[at], 1)
                    mine = (mix64(ids[again]) % split.astype(np.uint64)).astype(np.int64)
                    copy, other = ranges(np.zeros(len(bucket), np.int64), split)
                    mine = mine[copy]
                    low, high = np.minimum(mine, other), np.maximum(mine, other)
                    again, side = again[copy], np.where(low == high, WHOLE, mine == high).astype(np.int8)
                    bucket = bucket[copy] + ((low << 21 << 20) + (high << 21))  # parts above the band and its bucket
                held = np.concatenate([elements, key.view(np.uint8)], axis=1) if bands else elements
                flat = pa.Array.from_buffers(pa.binary(width), len(ids), [None, pa.py_buffer(np.ascontiguousarray(held))])
                yield batch(routed, bucket, side, ids[again], flat.take(pa.array(again)).cast(pa.binary()), degree[again])

    def arrays(t: pa.Table):
        t = t.combine_chunks()
        flat = t.column("elements").combine_chunks()
        held = np.frombuffer(flat.buffers()[2], np.uint8)[: (flat.offset + len(flat)) * width].reshape(-1, width)[flat.offset :]
        b, side, ids, degree = (t.column(c).to_numpy() for c in ("bucket", "side", "id", "degree"))
        first = np.concatenate([[True], b[1:] != b[:-1]])
        company = ~(first & np.concatenate([first[1:], [True]]))
        held = held[company]
        return b[company], side[company], ids[company], np.ascontiguousarray(held[:, :FEATURES]), np.ascontiguousarray(held[:, FEATURES:]).view(np.uint16) if bands else None, degree[company]

    def scan(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            bucket = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut:  # the last bucket may go on, and is taken as a whole
                yield from reduce(*arrays(t.slice(0, cut)))
                t = t.slice(cut)
            held, size = t.to_batches(), 0 if not cut else t.num_rows
        if held:
            yield from reduce(*arrays(pa.Table.from_batches(held)))

    sent = rows.select("id", "vec", F.col("degree").cast("long") if degrees else F.lit(0).cast("long").alias("degree"))
    dealt = sent.mapInArrow(route, "bucket long, side byte, id long, elements binary, degree long").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(scan, schema)


def links(rows: DataFrame, dim: int, *, jaccard: float) -> DataFrame:
    """``a, b`` of every two records of ``id, vec`` that share a bucket and have at least that Jaccard similarity, each pair once, the smaller id first."""
    least, schema = agreements(jaccard), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(bucket, side, ids, elements, bands, degree):
        for i, j, mask in linked_rows(bucket, side, elements, bands, least):
            if mask is not None:
                row, column = np.nonzero(mask)
                i, j = i[row], j[column]
            x, y = ids[i], ids[j]
            if len(x):
                yield batch(schema, np.minimum(x, y), np.maximum(x, y))

    return _met(rows, dim, pairs, "a long, b long")


def degrees(rows: DataFrame, dim: int, *, jaccard: float) -> DataFrame:
    """``id, degree``: how many links each record has, for records with any. The links are counted where they are found and not listed, as a dense place has the square of its size of them."""
    least, schema = agreements(jaccard), pa.schema([("id", pa.int64()), ("degree", pa.int64())])

    def count(bucket, side, ids, elements, bands, degree):
        total = np.zeros(len(ids), np.int64)
        for i, j, mask in linked_rows(bucket, side, elements, bands, least):
            if mask is None:
                total += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            else:
                total[i] += np.count_nonzero(mask, axis=1)
                total[j] += np.count_nonzero(mask, axis=0)
        names, at = np.unique(ids, return_inverse=True)
        held = np.bincount(at, total, len(names)).astype(np.int64)
        yield batch(schema, names[held > 0], held[held > 0])

    return _met(rows, dim, count, "id long, degree long").groupBy("id").agg(F.sum("degree").alias("degree"))


def stars(rows: DataFrame, dim: int, *, jaccard: float) -> DataFrame:
    """``id, star`` of every record with a link: of the record itself and all that it is linked to, the one with the most links, the larger id where several have as many."""
    least, schema = agreements(jaccard), pa.schema([("id", pa.int64()), ("degree", pa.int64()), ("star", pa.int64())])

    def best(bucket, side, ids, elements, bands, degree):
        order = np.lexsort((-ids, -degree))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        sort = np.lexsort((rank, bucket))  # the first of a row or column of a mask is the best
        bucket, side, ids, elements, degree, rank = bucket[sort], side[sort], ids[sort], elements[sort], degree[sort], rank[sort]
        top = rank.copy()
        for i, j, mask in linked_rows(bucket, side, elements, None, least):
            if mask is None:
                np.minimum.at(top, j, rank[i])
                np.minimum.at(top, i, rank[j])
            else:
                row, column = mask.any(axis=1), mask.any(axis=0)
                top[i[row]] = np.minimum(top[i[row]], rank[j[mask[row].argmax(axis=1)]])
                top[j[column]] = np.minimum(top[j[column]], rank[i[mask[:, column].argmax(axis=0)]])
        back = np.empty(len(ids), np.int64)
        back[rank] = np.arange(len(ids))
        names, at = np.unique(ids, return_inverse=True)
        first = np.full(len(names), len(ids))
        np.minimum.at(first, at, top)
        if len(names):
            yield batch(schema, names, degree[back[first]], ids[back[first]])

    counted = stage_table(degrees(rows, dim, jaccard=jaccard), "degrees")
    found = _met(rows.join(counted, "id"), dim, best, "id long, degree long, star long", bands=False, degrees=True)
    return found.groupBy("id").agg(F.max(F.struct("degree", "star")).alias("b")).select("id", F.col("b.star").alias("star"))


def _mean(rows: DataFrame, key: str, dim: int, weight: str = "1", **counts) -> DataFrame:
    """``key, n, vec`` and ``counts``: the weighted mean of the vectors of each key, and the sum of the weights. Sums are taken on the map side first."""
    sums = [F.sum(F.col("vec")[i].cast("double") * F.expr(weight)).alias(f"s{i}") for i in range(dim)]
    total = rows.groupBy(key).agg(F.sum(F.expr(weight)).alias("n"), *sums, *[c.alias(n) for n, c in counts.items()])
    return total.select(key, "n", *counts, F.array(*[(F.col(f"s{i}") / F.greatest("n", F.lit(1))).cast("float") for i in range(dim)]).alias("vec"))


def _length(column: str = "vec"):
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _unit(rows: DataFrame, dim: int) -> DataFrame:
    """``id, vec`` with vectors of length one, without NULL, zero and non-finite vectors and those of another length."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32()))])

    def scale(batches):
        for b in batches:
            usable, x = matrix(b.column(1), dim)
            if not len(x):
                continue
            x = x.astype(np.float64)
            square = np.zeros(len(x))
            for v in x.T:
                square += v * v
            yield batch(schema, b.column(0).filter(pa.array(usable)), lists_of((x / np.sqrt(square)[:, None]).astype(np.float32)))

    return rows.select("id", "vec").mapInArrow(scale, "id long, vec array<float>")


def _scored(lists: pa.Array, dim: int, c: np.ndarray, each=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors are usable, their matrix, the centre nearest to each and the cosine to it. Centres are taken by blocks; ``each`` gets the first of a block and its cosines."""
    usable, v = matrix(lists, dim)
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    best, value, row = np.zeros(len(x), np.int64), np.full(len(x), -np.inf, np.float32), np.arange(len(x))
    for lo in range(0, len(c), CENTRE_BLOCK):
        s = x @ c[lo : lo + CENTRE_BLOCK].T
        top = s.argmax(axis=1)
        most = s[row, top]
        better = most > value
        best[better], value[better] = lo + top[better], most[better]
        if each:
            each(lo, s)
    return usable, v, best, value.astype(np.float64)


def nearest_centre(rows: DataFrame, dim: int, names: np.ndarray, centres: np.ndarray, *, least: float) -> DataFrame:
    """``id, cluster, cosine``: the centre nearest to each record, for records with a cosine of at least ``least``."""
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("cosine", pa.float64())])
    c = centres.astype(np.float32)

    def find(batches):
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                usable, _, best, value = _scored(b.column(1), dim, c)
                good = value >= least
                if good.any():
                    yield batch(schema, b.column(0).filter(pa.array(usable)).filter(pa.array(good)), names[best[good]], value[good])

    return rows.select("id", "vec").mapInArrow(find, "id long, cluster long, cosine double")


def around(rows: DataFrame, dim: int, names: np.ndarray, centres: np.ndarray, *, inner: float, outer: float, least: float | None = None) -> DataFrame:
    """``cluster, core, rim, n, vec``, in one reading: how many of all records lie at ``inner`` or more from each centre, and between ``outer`` and ``inner``, whichever centre they are nearest to; number and mean of those that are nearest to
    it, at ``least`` (by default ``inner``) or more. Each task sends one row for a centre, and one for each that is the nearest in ``SUM_ROWS`` records."""
    schema = pa.schema([("cluster", pa.int64()), ("core", pa.int64()), ("wide", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])
    c, least = centres.astype(np.float32), inner if least is None else least

    def totals(held):
        best, v = (np.concatenate(x) for x in zip(*held))
        if len(best):
            order = np.argsort(best, kind="stable")
            start = np.nonzero(np.diff(best[order], prepend=-1))[0]
            none = np.zeros(len(start), np.int64)
            yield batch(schema, names[best[order[start]]], none, none, np.diff(start, append=len(best)), lists_of(np.add.reduceat(v[order].astype(np.float64), start, axis=0)))

    def count(batches):
        core, wide = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)

        def see(lo: int, s: np.ndarray) -> None:
            near = np.flatnonzero(s >= outer)
            centre = lo + near % s.shape[1]
            np.add.at(wide, centre, 1)
            np.add.at(core, centre[s.reshape(-1)[near] >= inner], 1)

        held, size = [], 0
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                _, v, best, value = _scored(b.column(0), dim, c, see)
                good = value >= least
                held.append((best[good], v[good]))
                size += len(v)
                if size >= SUM_ROWS:
                    yield from totals(held)
                    held, size = [], 0
        if held:
            yield from totals(held)
        yield batch(schema, names, core, wide, np.zeros(len(c), np.int64), pa.nulls(len(c), pa.list_(pa.float64())))

    sent = rows.select("vec").mapInArrow(count, "cluster long, core long, wide long, n long, total array<double>")
    added = sent.groupBy("cluster").agg(*[F.sum(k).alias(k) for k in ("core", "wide", "n")], *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)])
    return added.select("cluster", "core", (F.col("wide") - F.col("core")).alias("rim"), "n", F.array(*[(F.col(f"s{i}") / F.greatest("n", F.lit(1))).cast("float") for i in range(dim)]).alias("vec"))


def _collect(centres: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, middles as unit vectors, and sizes."""
    got = centres.select("cluster", "vec", F.col("n").cast("double").alias("n")).orderBy("cluster").toArrow()
    x = np.array(got.column("vec").to_pylist(), np.float64).reshape(got.num_rows, -1 if got.num_rows else 0)
    return got.column("cluster").to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x, got.column("n").to_numpy()


def _merge(names: np.ndarray, centres: np.ndarray, sizes: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """From the largest on, middles within a cosine of ``same`` become one, the mean by size."""
    order = np.lexsort((names, -sizes))
    names, centres, sizes = names[order], centres[order], sizes[order]
    free, kept, out = np.ones(len(names), bool), [], []
    for lo in range(0, len(names), 256):
        near = centres[lo : lo + 256] @ centres.T >= same
        for i in range(lo, min(lo + 256, len(names))):
            if not free[i]:
                continue
            joined = near[i - lo] & free
            joined[i] = True
            mean = (centres[joined] * sizes[joined, None]).sum(axis=0)
            free[joined] = False
            kept.append(names[i])
            out.append(mean / max(np.linalg.norm(mean), 1e-12))
    return np.array(kept, np.int64), np.array(out).reshape(len(kept), centres.shape[1])


def rim_share(dim: int, inner: float, outer: float) -> float:
    """How many of evenly spread directions lie at a cosine of ``inner`` or more for each one between ``outer`` and ``inner``."""
    def cap(c: float) -> float:
        t = np.linspace(c, 1, 20_001)
        return float(np.trapezoid((1 - t * t) ** ((dim - 3) / 2), t))

    return cap(inner) / max(cap(outer) - cap(inner), 1e-300)


def _apart(dim: int, inner: float, outer: float, sure: float, least: int = 0):
    """Whether a group's ``core`` stands out: more than the density of its ``rim`` makes likely, by ``sure`` standard deviations and ``least``."""
    expected = F.col("rim") * F.lit(rim_share(dim, inner, outer))
    return F.col("core") >= expected + sure * F.sqrt(expected) + least


class Clusters:
    """``members``: ``id, cluster, cosine`` (to the middle of the cluster); ``names`` and ``centres``: the middles, unit vectors."""

    def __init__(self, members: DataFrame, names: np.ndarray, centres: np.ndarray):
        self.members, self.names, self.centres = members, names, centres

    def summary(self, typical: int = 5) -> DataFrame:
        """``cluster, size, typical``: the size of each cluster and its members nearest to the middle, in that order."""
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("cosine"), "id"))
        top = self.members.withColumn("r", rank).where(F.col("r") <= typical).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
        sizes = self.members.groupBy("cluster").agg(F.count("*").alias("size"))
        return sizes.join(top, "cluster").select("cluster", "size", F.transform("t", lambda x: x["id"]).alias("typical"))


def cluster(df: DataFrame, key: str, vector: str, dim: int, *, link: float = 0.15, tight: float = 0.25, same: float = 0.7, rounds: int = 3, spread: float = 0.74, pair: float = 0.9, member: float = 0.625, inner: float = 0.65, outer: float = 0.6, least: int = 4) -> Clusters:
    """Divide vectors into clusters of mutually similar ones; many records may belong to none.

    1. MinHash banding gives candidates, an exact Jaccard of at least ``link`` makes a link; all pairs of a bucket are compared. 2. Each record joins the record of
    highest degree among those it is linked to and itself: loose groups fall apart into stars around their highest-degree medoids. Stars of one record, and those whose mean vector is
    shorter than ``spread`` (``pair`` for two records), go. 3. The stars' means are banded in the same way; a Jaccard of at least ``tight`` links two of them, and connected
    components of these links are the groups. 4. Every record goes to the group whose middle it lies nearest to, if the cosine is at least
    ``member``; middles are taken again from their members, those within a cosine of ``same`` become one, and the records go to them once more, ``rounds`` times; groups that hold no more records at ``inner`` or more than the density between ``outer`` and ``inner`` makes likely go. 5. A cluster stays if it has ``least`` members
    at ``inner`` or more, beyond what evenly spread records of the density between ``outer`` and ``inner`` would give and five standard deviations of that: a few unrelated records around it don't take it away, however small it is. Middles that stand
    beside a cluster, so that most of the records around them lie nearer to another one, go in each round.

    Ids must be unique. NULL, zero, non-finite vectors and those of another length belong to no cluster. Rows with one and the same vector
    always share one. An empty table gives no clusters. Only the middles of groups come to the driver, at most one for two records of a dense
    place, and they are sent out again; a task compares them by blocks of ``CENTRE_BLOCK``.
    """
    rows = stage_table(_unit(df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where("id is not null"), dim), "unit")
    means = stage_table(_mean(rows.join(stars(rows, dim, jaccard=link), "id"), "star", dim).where(_length() >= F.when(F.col("n") >= 3, spread).when(F.col("n") == 2, pair).otherwise(2.0)).withColumnRenamed("star", "id"), "stars")
    groups = connected_components(links(means, dim, jaccard=tight), "a", "b").select(F.col("node").alias("id"), "component")
    named = means.join(groups, "id", "left").select(F.coalesce("component", "id").alias("cluster"), "n", "vec")
    names, centres = _merge(*_collect(_mean(named.withColumnRenamed("n", "w"), "cluster", dim, "w")), same)
    for turn in range(rounds):
        if not len(centres):
            break
        means = around(rows, dim, names, centres, inner=inner, outer=outer, least=member).where(F.col("n") >= least)
        if turn:  # a first middle may lie far from where its records are
            means = means.where(_apart(dim, inner, outer, 2)).where("2 * n >= core")
        names, centres = _merge(*_collect(means), same)
    if not len(centres):
        return Clusters(rows.limit(0).select("id", F.col("id").alias("cluster"), F.lit(0.0).alias("cosine")), names, np.zeros((0, dim)))
    stands = around(rows, dim, names, centres, inner=inner, outer=outer).where(_apart(dim, inner, outer, 5, least))
    kept = stands.where("2 * n >= core").select("cluster").toArrow().column("cluster").to_numpy()
    stays = np.isin(names, kept)
    if not stays.any():
        return Clusters(rows.limit(0).select("id", F.col("id").alias("cluster"), F.lit(0.0).alias("cosine")), names[stays], centres[stays])
    members = nearest_centre(rows, dim, names[stays], centres[stays], least=member)
    return Clusters(members, names[stays], centres[stays])


def match(clusters: Clusters, samples: DataFrame, dim: int, *, least: float = 0.625) -> DataFrame:
    """``id, cluster`` of each of the samples ``id, vec``: that of the nearest middle, if the cosine is at least ``least``."""
    if not len(clusters.centres):
        return samples.select("id", F.col("id").alias("cluster")).limit(0)
    return nearest_centre(samples, dim, clusters.names, clusters.centres, least=least).select("id", "cluster")
