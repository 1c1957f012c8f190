"""Near-duplicates with small edits: BK-trees over bit codes, in shards that keep every qualifying pair together."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from . import bktree
from .arrow import batch, matrix, mix64, ranges
from .components import connected_components
from .neighbours import USABLE

SAMPLE_ROWS, SAMPLE_WORDS, COMMON_ROWS, BLOCK_ROWS, CHUNK_ROWS = 20_000, 1024, 300, 20_000, 50_000
#: A shard of ``BLOCK_ROWS`` rows has so many in the sample that finds the large ones.
SEEN_ROWS = 64
SMALL_ROWS, PAIR_BLOCK = 32, 200_000
TABLE_BITS, TABLE_ROWS, CODE_BITS, MISSED = 16, 1 << 20, 128, 2e-4
_ROWS = "shard long, id long, reach float, c0 long, c1 long"
_SCHEMA = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("reach", pa.float32()), ("c0", pa.int64()), ("c1", pa.int64())])


def sampling_step(rows: int) -> int:
    """One row in so many is looked at for large shards: more rows as the table grows, so that a shard of ``BLOCK_ROWS`` rows always shows."""
    return max(1, min(BLOCK_ROWS // SEEN_ROWS, rows // SAMPLE_ROWS))


def large_shards(sampled: DataFrame, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that hold over ``BLOCK_ROWS`` rows, judged by the shards of one row in ``step`` (column ``shard``), and into how many blocks each is split. There is at most one for ``BLOCK_ROWS`` rows sent to shards."""
    got = sampled.groupBy("shard").count().where(F.col("count") * step > BLOCK_ROWS).orderBy("shard").toArrow()
    return got.column("shard").to_numpy(), np.ceil(got.column("count").to_numpy() * step / BLOCK_ROWS).astype(np.int64)


def in_blocks(rows: np.ndarray, shard: np.ndarray, ids: np.ndarray, hot: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and shard, large shards split into blocks by a hash of the id: every two blocks of a shard meet in a shard of their own, and so do the rows of each block."""
    if not len(hot):
        return rows, shard
    at = np.minimum(np.searchsorted(hot, shard), len(hot) - 1)
    n = np.where(hot[at] == shard, blocks[at], 1)
    mine = (mix64(ids[rows]) % n.astype(np.uint64)).astype(np.int64)
    again, other = ranges(np.zeros(len(rows), np.int64), n)
    low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
    return rows[again], np.where(n[again] > 1, mix64(shard[again].view(np.uint64) * np.uint64(5) + mix64(low * 1_000_003 + high + 1)).view(np.int64), shard[again])


def code_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` of ids in one shard whose codes lie within the sum of their ``reach`` in Hamming distance, the smaller reach being at least 3/4 of the larger.

    The rows of a shard come to one task in a row, and its BK-tree lives only there (``bktree.close_pairs``).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            shard = t.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1], "left"))
            if cut:
                yield from near(t.slice(0, cut))
            t = t.slice(cut)
            held, size = t.to_batches(), 0 if not cut else t.num_rows
        if held:
            yield from near(pa.Table.from_batches(held).combine_chunks())

    def near(t: pa.Table):
        shard, ids, reach = (t.column(c).to_numpy() for c in ("shard", "id", "reach"))
        first = np.concatenate([[True], shard[1:] != shard[:-1]])
        last = np.concatenate([first[1:], [True]])
        company = ~(first & last)
        if not company.any():
            return
        shard, ids, reach = shard[company], ids[company], reach[company]
        codes = np.stack([t.column(c).to_numpy()[company] for c in ("c0", "c1")], axis=1).view(np.uint64)
        order = np.lexsort((reach, shard))
        shard, ids, reach, codes = shard[order], ids[order], reach[order], codes[order]
        start = np.nonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))[0]
        size = np.diff(np.append(start, len(shard)))
        found = [np.zeros((0, 2), np.int64)]

        def add(x: np.ndarray, y: np.ndarray) -> None:
            x, y = ids[x], ids[y]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y])

        one, two = ranges(np.arange(1, len(shard) + 1), np.repeat(np.where(size <= SMALL_ROWS, start + size, 0), size))
        for lo in range(0, len(one), PAIR_BLOCK):  # small shards all at once
            x, y = one[lo : lo + PAIR_BLOCK], two[lo : lo + PAIR_BLOCK]
            fit = bktree.fits(bktree.hamming(codes[x], codes[y]), reach[x], reach[y], 0.75)
            add(x[fit], y[fit])
        for lo, n in zip(start[size > SMALL_ROWS].tolist(), size[size > SMALL_ROWS].tolist()):
            for x, y in bktree.close_pairs(codes, reach, np.arange(lo, lo + n)):
                add(x, y)
        both = np.unique(np.concatenate(found), axis=0)
        if len(both):
            yield batch(schema, both[:, 0], both[:, 1])

    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


# ---- texts


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, words``: the distinct words (runs of letters and digits, lower-cased) of every text that has any, as sorted 48-bit hashes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    hashed = F.array_sort(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 16)))
    return df.select(F.col(key).cast("long").alias("id"), hashed.alias("words")).where("id is not null and size(words) > 0")


class _Router:
    """Which shards a word set belongs to.

    In one order of all words, rarest first, two qualifying sets share one of their first p = size - ceil(share * size) + 1 words,
    and two of their first p + 1. A word that is not common has a shard of its own for the sets that have it among their first p; where the
    first shared word is a common one, so is the second, and the two have a shard together. Shards of over ``BLOCK_ROWS`` rows are split (``in_blocks``).

    The sample (``SAMPLE_ROWS`` sets of up to ``SAMPLE_WORDS`` words) only orders the words; any order keeps every pair.
    """

    def __init__(self, sample: pa.Array, step: int, share: float):
        self.share, self.step = share, step
        self.known, self.counts = np.unique(pc.list_flatten(sample).to_numpy(zero_copy_only=False), return_counts=True)
        several = self.counts > 1
        self.known, self.counts = self.known[several], self.counts[several]
        self.hot, self.blocks = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row number and shard, before large shards are split."""
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        mixed = mix64(words)
        at = np.minimum(np.searchsorted(self.known, words), max(len(self.known) - 1, 0))
        seen = np.where(self.known[at] == words, self.counts[at], 1) if len(self.known) else np.ones(len(words), np.int64)
        order = np.lexsort((mixed, seen, doc))
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = (sizes - np.ceil(self.share * sizes - 1e-9).astype(np.int64) + 1)[doc]
        common = (seen * self.step > COMMON_ROWS)[order] & (seen[order] > 1)
        single = ~common & (place < first)
        start = np.nonzero(common & (place < first))[0]
        end = np.minimum((np.cumsum(sizes) - sizes + first[np.minimum(np.cumsum(sizes) - sizes, max(len(words) - 1, 0))] + 1)[doc], np.cumsum(sizes)[doc])[start] if len(start) else start
        one, two = ranges(start + 1, end)
        a, b = mixed[order[start[one]]], mixed[order[two]]
        rows = np.concatenate([doc[single], doc[start[one]]])
        return rows, np.concatenate([mixed[order[single]], mix64(a * np.uint64(3) + b)]).view(np.int64)

    def shards(self, lists: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return in_blocks(*self.plain(lists), ids, self.hot, self.blocks)


def _shards_of(df: DataFrame, name, step: int) -> DataFrame:
    """``shard`` of one row of ``df`` (``id`` and content) in ``step``, by ``name``: an array of contents to their shards."""

    def shards(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(name(b.column(1)))], names=["shard"])

    return df.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(step)) == 0).mapInArrow(shards, "shard long")


def text_pairs(sets: DataFrame, *, share: float = 0.75) -> DataFrame:
    """``a, b`` of every two ids whose word sets have at least ``share`` of their words in common. Ids must be unique.

    Code: every word flips one of 128 bits. Two sets that differ in d words have codes at Hamming distance d at most, and qualifying sets differ in no more than
    (1 - share) / (1 + share) of the sum of their sizes: the radius loses nothing. Shards: see ``_Router``. The exact share is computed last.
    """
    if not 0.75 <= share <= 1:
        raise ValueError("share must be from 0.75 to 1")
    rows = sets.count()
    step = max(1, rows // SAMPLE_ROWS)
    sample = sets.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select(F.slice("words", 1, SAMPLE_WORDS).alias("words")).limit(2 * SAMPLE_ROWS).toArrow().column("words").combine_chunks()
    router, part = _Router(sample, step, share), (1 - share) / (1 + share)
    looked = sampling_step(rows)
    router.hot, router.blocks = large_shards(_shards_of(sets.select("id", "words"), lambda lists: router.plain(lists)[1], looked), looked)
    shared = sets.sparkSession.sparkContext.broadcast(router)

    def route(batches):
        for b in batches:
            lists, ids = b.column(1), b.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            bit = (mix64(pc.list_flatten(lists).to_numpy(zero_copy_only=False)) >> np.uint64(20)) & np.uint64(CODE_BITS - 1)
            cell = np.repeat(np.arange(len(sizes)), sizes) * CODE_BITS + bit.astype(np.int64)
            odd = np.bincount(cell, minlength=len(sizes) * CODE_BITS).reshape(-1, CODE_BITS).astype(np.uint8) & 1
            codes = np.packbits(odd, axis=1).view(np.int64)
            d, shard = shared.value.shards(lists, ids)
            yield batch(_SCHEMA, shard, ids[d], (sizes[d] * part).astype(np.float32), codes[d, 0], codes[d, 1])

    candidates = stage_table(code_pairs(sets.select("id", "words").mapInArrow(route, _ROWS)), "pairs")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = sets.join(ends, "id", "left_semi")
    joined = candidates.join(wanted.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(wanted.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return joined.withColumn("n", common).where(F.col("n") >= F.lit(share) * (F.size("wa") + F.size("wb") - F.col("n")) - 1e-9).select("a", "b")


# ---- vectors


def vector_pairs(vectors: DataFrame, dim: int, *, cosine: float = 0.98, seed: int = 5) -> DataFrame:
    """``a, b`` of every two ids of ``id, vec`` whose vectors have at least that cosine, in double precision. Ids must be unique, vectors usable.

    Code: the sides of 128 random hyperplanes. At the threshold, each bit differs with probability angle / pi; the radius lies five standard
    deviations above the mean. Shards: tables of further hyperplanes, ``TABLE_BITS`` each and one more whenever the rows double beyond ``TABLE_ROWS``; there are as many tables as
    let a pair at the threshold share a shard with a probability of 1 - ``MISSED``, closer ones with more. Large shards, as of a dense cluster, are split (``in_blocks``).
    """
    flip = math.acos(cosine) / math.pi
    reach = math.floor(CODE_BITS * flip + 5 * math.sqrt(CODE_BITS * flip * (1 - flip))) / 2
    rows = vectors.count()
    bits = min(40, TABLE_BITS + max(0, math.ceil(math.log2(max(rows, 1) / TABLE_ROWS))))
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - flip) ** bits))
    planes = np.random.default_rng(seed).normal(size=(dim, CODE_BITS + tables * bits)).astype(np.float32)

    def sides(x: np.ndarray) -> np.ndarray:
        return (x / np.abs(x).max(axis=1, keepdims=True)) @ planes > 0

    def named(side: np.ndarray) -> np.ndarray:
        return (side[:, CODE_BITS:].reshape(len(side), tables, bits) @ (1 << np.arange(bits)) + (np.arange(tables)[None, :] << bits)).reshape(-1)

    looked = sampling_step(rows)
    hot, blocks = large_shards(_shards_of(vectors.select("id", "vec"), lambda lists: named(sides(matrix(lists, dim)[1])), looked), looked)

    def route(batches):
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                usable, x = matrix(b.column(1), dim)
                ids = b.column(0).to_numpy(zero_copy_only=False)[usable]
                side = sides(x)
                codes = np.packbits(side[:, :CODE_BITS], axis=1).view(np.int64)
                again, shard = in_blocks(np.repeat(np.arange(len(x)), tables), named(side), ids, hot, blocks)
                yield batch(_SCHEMA, shard, ids[again], np.full(len(again), reach, np.float32), codes[again, 0], codes[again, 1])

    candidates = code_pairs(vectors.select("id", "vec").mapInArrow(route, _ROWS))
    joined = candidates.join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return joined.where(dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb")) >= cosine).select("a", "b")


# ---- both


class Duplicates:
    """Records by class of exact copies (``members``: ``id, class_id``, the class named by its least id) and ``links``: pairs ``a, b`` of class names that qualify."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """``id_a, id_b`` of every two records that qualify, copies included."""
        m = self.members
        a, b = m.select(F.col("class_id").alias("a"), F.col("id").alias("x")), m.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
        across = self.links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        copied = m.where("id != class_id").select("class_id").distinct()
        same = m.join(copied, "class_id", "left_semi")
        within = same.select("class_id", F.col("id").alias("id_a")).join(same.select("class_id", F.col("id").alias("id_b")), "class_id").where("id_a < id_b")
        return across.unionByName(within.select("id_a", "id_b"))

    def groups(self) -> DataFrame:
        """``id, class_id, copies, links, group_id``: one row for each record. ``copies`` is the size of its class, ``links`` the number of other classes that qualify with it, ``group_id`` names the connected group."""
        copies = self.members.groupBy("class_id").agg(F.count("*").alias("copies"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
        groups = connected_components(self.links, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
        named = copies.join(degree, "class_id", "left").join(groups, "class_id", "left")
        named = named.select("class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
        return self.members.join(named, "class_id").select("id", "class_id", "copies", "links", "group_id")


def _classes(rows: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """Members by class of equal content, and one row for each class under its least id. Every map task sends one row for each content.

    The rows of classes that have several are found again by a 128-bit hash of their content, so that the contents move once.
    """
    key = [F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(17), content).alias("k2")]
    least = rows.groupBy(content).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    classes = stage_table(least, "classes")
    several = classes.where("n > 1").select(*key, "class_id")
    copies = rows.select(*key, "id").join(several, ["k1", "k2"]).select("id", "class_id")
    single = classes.where("n = 1").select(F.col("class_id").alias("id"), "class_id")
    return stage_table(copies.unionByName(single), "members"), classes.select(F.col("class_id").alias("id"), content)


def near_texts(df: DataFrame, key: str, text: str, *, share: float = 0.75) -> Duplicates:
    """Texts with at least ``share`` of their distinct words in common. Texts without words (NULL, blank, punctuation alone) are in no class. Ids must be unique; a repeated row is a copy only under another id."""
    members, sets = _classes(word_sets(df, key, text), "words")
    return Duplicates(members, text_pairs(sets, share=share))


def near_vectors(df: DataFrame, key: str, vector: str, dim: int, *, cosine: float = 0.98) -> Duplicates:
    """Vectors with at least that cosine. NULL, zero, non-finite ones and those of another length are in no class."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where(f"id is not null and size(vec) = {dim} and {USABLE}")
    members, vectors = _classes(rows, "vec")
    return Duplicates(members, vector_pairs(vectors, dim, cosine=cosine))


