"""Most similar vectors for every vector: multiprobe p-stable hashing with exact distance reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from .arrow import batch, lists_of, matrix

GROUP_ROWS, LEAST_GROUP_ROWS, FEW_GROUPS, CELL_ROWS, MOST_LOW_BITS = 250_000, 12_500, 3, 48, 11
SAMPLE_ROWS, SAMPLE_CELLS, BLOCK_CELLS = 20_000, 1024, 1 << 23

#: Below this share of the cells a table, recall among vectors without any structure falls under 0.9. A caller with structured data can pass less.
LEAST_PROBED = 0.06
#: A vector without NULL, NaN and infinite elements that is not all zero.
USABLE = "exists(vec, x -> x != 0) and not exists(vec, x -> x is null or isnan(x) or abs(x) = float('infinity'))"


class Plan:
    """One hash table: its functions, which groups of cells a vector is sent to, and which cells there it probes.

    Each of ``hashes`` p-stable functions is floor((a.x + b) / w) with orthonormal Gaussian directions a, offsets b that put a
    boundary on the middle of a bounded sample, and a width w beyond the reach of a unit vector, so that each splits the space
    in two. A cell is one combination of them, a group the cells that agree in the first ``group_bits``. The squared gaps to the
    boundaries that lie between a query and a cell sum to a lower bound of its squared distance; the smaller it is, the likelier the cell holds a near vector.
    """

    def __init__(self, dim: int, rows: int, sample: np.ndarray, group_bits: int, visits: int, share: float, seed: int):
        self.group_bits = min(group_bits, dim)
        self.low = min(dim - self.group_bits, MOST_LOW_BITS, max(0, round(math.log2(max(rows / (CELL_ROWS << self.group_bits), 1)))))
        self.hashes, self.groups = self.group_bits + self.low, 1 << self.group_bits
        self.visits, self.share = min(visits, self.groups), share
        rng = np.random.default_rng(seed)
        self.directions = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : self.hashes].astype(np.float32)
        self.offsets = np.median(sample @ self.directions, axis=0).astype(np.float32) if len(sample) else np.zeros(self.hashes, np.float32)
        cells = 1 << self.hashes
        self.sampled = np.arange(cells) if cells <= SAMPLE_CELLS else rng.choice(cells, SAMPLE_CELLS, replace=False)

    def gaps(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions - self.offsets

    @staticmethod
    def number(gaps: np.ndarray) -> np.ndarray:
        """The cell of each row, or its group, from all or from the first gaps."""
        return ((gaps > 0) @ (1 << np.arange(gaps.shape[1])[::-1])).astype(np.int64)

    @staticmethod
    def costs(gaps: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The lower bound of the squared distance from each row to each cell."""
        width = gaps.shape[1]
        bits = ((cells[:, None] >> np.arange(width)[None, ::-1]) & 1).astype(np.float32)
        squared = gaps * gaps
        to_one, to_zero = np.where(gaps > 0, 0, squared), np.where(gaps > 0, squared, 0)
        return to_zero.sum(1)[:, None] + (to_one - to_zero) @ bits.T

    def visited(self, gaps: np.ndarray) -> np.ndarray:
        """The likeliest groups of each row, its own first."""
        near = self.costs(gaps[:, : self.group_bits], np.arange(self.groups))
        near[np.arange(len(near)), self.number(gaps[:, : self.group_bits])] = -1
        return np.argsort(near, axis=1, kind="stable")[:, : self.visits]

    def reach(self, gaps: np.ndarray) -> np.ndarray:
        """The bound up to which a row probes cells: the quantile ``share`` of its bounds to a sample of all cells."""
        place = math.ceil(self.share * len(self.sampled)) - 1
        if self.share >= 1:
            return np.full(len(gaps), np.inf, np.float32)
        return np.concatenate([np.partition(self.costs(gaps[a : a + 1024], self.sampled), max(place, 0), axis=1)[:, max(place, 0)] for a in range(0, len(gaps), 1024)]) + 1e-6


def share_probed(rows: int, dim: int) -> float:
    """The share of the cells that a query probes in each table: all of them up to 2,000 rows, less as the nearest lie nearer, and less in fewer dimensions, but never under ``LEAST_PROBED`` times the square of dim / 32."""
    return min(1.0, max(LEAST_PROBED * (dim / 32) ** 2, (max(rows, 1) / 2000) ** (-0.64 * (32 / dim) ** 0.7)))


def layout(rows: int) -> tuple[int, int, int]:
    """``group_bits, tables, visits`` for so many rows: what a vector is sent to is ``tables`` x ``visits`` groups, whatever the number of rows in them.

    Groups hold ``LEAST_GROUP_ROWS`` rows or more; from eight groups on they grow to ``GROUP_ROWS``, and only then become more. Two groups of two tables are enough up to eight
    groups, then two, three and four of four tables.
    """
    few = min(FEW_GROUPS, max(0, round(math.log2(max(rows / LEAST_GROUP_ROWS, 1)))))
    bits = max(few, math.ceil(math.log2(max(rows / GROUP_ROWS, 1))))
    if bits <= 1:
        return bits, 1, 2
    return bits, 2 if bits <= FEW_GROUPS else 4, 2 if bits <= 5 else 3 if bits == 6 else 4


def _unit(x: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64)
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def _route(plans: list[Plan], dim: int):
    """Each vector, in every table, to the group of cells it lies in, as a member, and to the next likely ones, as a visitor."""
    schema = pa.schema([("grp", pa.int32()), ("key", pa.int64()), ("own", pa.int64()), ("member", pa.bool_()), ("vec", pa.list_(pa.float32()))])

    def route(batches):
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                usable, x = matrix(b.column(2), dim)
                if not len(x):
                    continue
                keys, own = (b.column(k).to_numpy(zero_copy_only=False)[usable] for k in (0, 1))
                unit = _unit(x)
                for n, plan in enumerate(plans):
                    visited = plan.visited(plan.gaps(unit))
                    for v in range(visited.shape[1]):
                        yield batch(schema, visited[:, v] + n * plan.groups, keys, own, np.full(len(x), v == 0), lists_of(x))

    return route


class _Best:
    """The ``width`` best of each row so far: cosines, who, and the least of them."""

    def __init__(self, rows: int, width: int):
        self.width = width
        self.value, self.who, self.floor = np.full((rows, width), -2.0, np.float32), np.full((rows, width), -1, np.int32), np.full(rows, -2.0, np.float32)

    def offer(self, rows: np.ndarray, new: np.ndarray, names: np.ndarray, floor: np.ndarray) -> None:
        """``new``: the cosine of each of ``rows`` to each of ``names``; what is not above ``floor`` doesn't count. A row with one better name swaps it for its worst, the others are sorted out together."""
        width, hits = self.width, new > floor[:, None]
        count = np.count_nonzero(hits, axis=1)
        one = np.nonzero(count == 1)[0]
        if len(one):
            r, c = rows[one], hits[one].argmax(axis=1)
            held = self.value[r]
            at = held.argmin(axis=1)
            held[np.arange(len(one)), at] = new[one, c]
            self.value[r], self.who[r, at], self.floor[r] = held, names[c], held.min(axis=1)
        more = np.nonzero(count > 1)[0]
        if not len(more):
            return
        rows = rows[more]
        both = np.concatenate([self.value[rows], new[more]], axis=1)
        top = np.argpartition(both, both.shape[1] - width, axis=1)[:, -width:]
        value = both.reshape(-1)[top + (np.arange(len(rows)) * both.shape[1])[:, None]]
        known = self.who[rows].reshape(-1)[np.minimum(top, width - 1) + (np.arange(len(rows)) * width)[:, None]]
        who = np.where(top < width, known, names[np.maximum(top - width, 0)])
        self.value[rows], self.who[rows], self.floor[rows] = value, np.where(value > -2.0, who, -1), value.min(1)


def _meet(u: np.ndarray, own: np.ndarray, qs: np.ndarray, held: np.ndarray, asked: _Best, told: _Best) -> None:
    """Compare queries with the members of a cell: each may be among the best of the other."""
    s = u[held] @ u[qs].T
    floor = np.maximum(asked.floor[qs], told.floor[qs])
    better = np.nonzero(s.max(0) > floor)[0]
    if len(better):
        new = s[:, better].T
        new[own[qs[better]][:, None] == own[held][None, :]] = -2.0
        asked.offer(qs[better], new, held, floor[better])
    floor = np.maximum(asked.floor[held], told.floor[held])
    better = np.nonzero(s.max(1) > floor)[0]
    if len(better):
        new, floor = s[better], floor[better]
        worth = np.nonzero((new > floor[:, None]).any(0))[0]
        new, qs = new[:, worth], qs[worth]
        new[own[held[better]][:, None] == own[qs][None, :]] = -2.0
        told.offer(held[better], new, qs, floor)


def _search(plans: list[Plan], dim: int, k: int, width: int):
    """Within a group of cells: the best of every row that lies or visits there, from the cells it probes and from those that probe its own."""
    schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])

    def search(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        keys, own = t.column("key").to_numpy(), t.column("own").to_numpy()
        member = t.column("member").to_numpy(zero_copy_only=False)
        plan = plans[int(t.column("grp")[0].as_py()) // plans[0].groups]
        group = int(t.column("grp")[0].as_py()) % plan.groups
        u = _unit(x)
        gaps = plan.gaps(u)
        low = gaps[:, plan.group_bits :]
        mine = np.nonzero(member)[0]
        at = plan.number(low[mine])
        order = np.argsort(at, kind="stable")
        mine, at = mine[order], at[order]
        cells = np.unique(at)
        starts, ends = np.searchsorted(at, cells, "left"), np.searchsorted(at, cells, "right")
        reach = plan.reach(gaps)
        asked, told = _Best(len(x), width), _Best(len(x), width)
        rows = np.lexsort((plan.number(low), ~member))
        step = max(512, BLOCK_CELLS // max(len(cells), 1))
        for block in (rows[a : a + step] for a in range(0, len(rows), step)):
            costs = np.ascontiguousarray(plan.costs(gaps[block], cells + (group << plan.low)).T)
            turn = costs.mean(1).argsort(kind="stable").tolist()
            done = np.float32(-1)
            for part in (0.4, 1.0):  # every query's likeliest cells first, then the rest of those it probes
                bound = reach[block] * part
                for n in turn:
                    # a cell farther off than the worst of the best so far cannot hold a better one
                    qs = block[(costs[n] > done) & (costs[n] <= np.minimum(bound, 2.00001 - 2 * asked.floor[block]))]
                    if len(qs):
                        for a in range(starts[n], ends[n], 4096):
                            _meet(u, own, qs, mine[a : min(a + 4096, ends[n])], asked, told)
                done = bound
        names = np.concatenate([asked.who, told.who], axis=1)
        q, p = np.nonzero(names >= 0)
        # a pair that both sides have probed stands there twice
        pairs = np.unique(q * len(x) + names[q, p])
        q, o = pairs // len(x), pairs % len(x)
        cosine = np.empty(len(q))
        for a in range(0, len(q), 1 << 18):
            l, r = x[q[a : a + (1 << 18)]].astype(np.float64), x[o[a : a + (1 << 18)]].astype(np.float64)
            cosine[a : a + (1 << 18)] = np.einsum("ij,ij->i", l, r) / np.sqrt(np.einsum("ij,ij->i", l, l) * np.einsum("ij,ij->i", r, r))
        order = np.lexsort((keys[o], -cosine, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
        first = order[place < k]
        return pa.Table.from_batches([batch(schema, keys[q[first]], keys[o[first]], cosine[first])])

    return search


def nearest(df: DataFrame, key: str, vector: str, dim: int, *, k: int = 5, own: str | None = None, probes: float | None = None, seed: int = 1) -> DataFrame:
    """``key, other, cosine, rank``: the ``k`` nearest rows of every row by cosine.

    ``key`` is a unique long; rows with the same ``own`` (by default the key) are no fellows. NULL, zero, non-finite vectors and those
    of another length are neither queries nor answers. Equal cosines are ordered by the smaller key; lists have room for two more than ``k``, and for 2 ``k`` where
    any vector stands in more than ``k`` rows, so that all indexed copies of one find room. Of still more equals at the end of a list any may stay. An empty table gives no rows.

    Every row is indexed and every row is a query. Each hash table sends a row as a member to one group of cells and as a visitor to
    the likeliest others (``layout``), so that a row moves a few times whatever the size of the table; nothing is copied to all groups. In a group, each row probes the cells in the order of
    their bound up to ``probes`` of all (by default ``share_probed`` of the number of rows), in blocks; what it meets there may take it among its own best as well. The candidates
    get their exact cosine in double precision, and the best ``k`` of all groups and tables are merged by row. The offsets of the hash functions come from at most
    ``SAMPLE_ROWS`` rows. Of the rows with one and the same vector, the first ``k`` of each ``own`` are indexed, and of these the first 2 ``k``, so that
    the first ``k`` copies of other owns are always among them. The further rows get, by a join, what the indexed row of their vector and own
    has found, or the first ``k`` copies where there is none, as all copies indexed are then of other owns.
    """
    own = own or key
    picked = df.selectExpr(f"cast(`{key}` as long) as key", f"cast(`{own}` as long) as own", f"cast(`{vector}` as array<float>) as vec").where(f"key is not null and size(vec) = {dim} and {USABLE}")
    base = stage_table(picked, "vectors")
    rows = base.count()
    many = base.groupBy(F.xxhash64("vec").alias("h")).count().where(F.col("count") > k).select("h")
    many = stage_table(many, "many")
    kept, hot = base, None
    if not many.isEmpty():
        hashed = base.withColumn("h", F.xxhash64("vec"))
        rest = hashed.join(many, "h", "left_semi").drop("h")
        hot = rest.withColumn("nth_own", F.row_number().over(Window.partitionBy("vec", "own").orderBy("key"))).where(F.col("nth_own") <= k)
        hot = stage_table(hot.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("key"))).where(F.col("nth") <= 2 * k), "copies")
        kept = stage_table(hashed.join(many, "h", "left_anti").drop("h").unionByName(hot.select("key", "own", "vec")), "indexed")
        rows = kept.count()
    few = kept.where(F.pmod(F.xxhash64("key"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0).select("vec").limit(SAMPLE_ROWS).toArrow().column("vec").combine_chunks()
    sample = matrix(few, dim)[1]
    sample = _unit(sample) if len(sample) else sample
    bits, tables, visits = layout(rows)
    share = share_probed(rows, dim) if probes is None else probes
    plans = [Plan(dim, rows, sample, bits, visits, share, seed + n) for n in range(tables)]
    routed = kept.select("key", "own", "vec").mapInArrow(_route(plans, dim), "grp int, key long, own long, member boolean, vec array<float>")
    found = routed.groupBy("grp").applyInArrow(_search(plans, dim, k, k + 2 if hot is None else 2 * k), "key long, other long, cosine double")
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))  # a pair that came from several groups has one rank
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["key", "rank"]).select("key", "other", "cosine", "rank")
    if hot is None:
        return best
    best = stage_table(best, "nearest")
    return best.unionByName(_excess(hot, base.withColumn("h", F.xxhash64("vec")).join(many, "h", "left_semi").drop("h"), best, k))


def _excess(hot: DataFrame, rest: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The nearest of the rows that are not indexed: those of the indexed row of the same vector and own, else the first copies, which are all of other owns."""
    first = hot.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("key", "own"))).alias("copies"))  # 2 k at most
    further = rest.join(first, "vec").where(~F.exists("copies", lambda c: c["key"] == F.col("key")))
    further = further.select("key", "copies", F.get(F.filter("copies", lambda c: c["own"] == F.col("own")), F.lit(0))["key"].alias("like"))
    same = further.where("like is not null").select(F.col("key").alias("further"), F.col("like").alias("key")).join(best, "key").select(F.col("further").alias("key"), "other", "cosine", "rank")
    picked = further.where("like is null").select("key", F.posexplode(F.slice("copies", 1, k)).alias("at", "c"))
    return same.unionByName(picked.select("key", F.col("c.key").alias("other"), F.lit(1.0).alias("cosine"), (F.col("at") + 1).alias("rank")))
