"""A search: the branches of a query, their fusion, and the first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import vectors
from quillrank.plans.query import HybridQuery

from . import branches, fusion
from .corpus import Corpus

COLUMNS = ("id", "rank", "fused", "dense_dist", "dense_rank", "bm25_score", "bm25_rank", "maxsim", "late_rank")


def bind(corpus: Corpus, query: HybridQuery) -> None:
    """Refuse a query that the corpus cannot answer."""
    if query.vector is not None and not corpus.vector:
        raise ValueError("the corpus has no vectors")
    if query.multivector is not None and not corpus.multivector:
        raise ValueError("the corpus has no multivectors")
    if query.text is not None and not corpus.tokens:
        raise ValueError("the corpus has no tokens")
    if query.vector is not None and query.multivector is not None and query.fusion != "rrf":
        raise ValueError("a vector and a multivector together are fused by rank only")


def search(corpus: Corpus, query: HybridQuery, limit: int | None = None, where: Column | None = None, *, rescore: bool = False, strict_not: bool = False, robust: bool = False) -> DataFrame:
    """The ranked rows, with the values and ranks of each branch.

    ``where`` filters before the lists are cut. ``limit`` sets the number of rows and shortens defaulted budgets; without it ``final_k`` or 10 come out. ``rescore``
    gives rows that only BM25 found their dense distance, and a rank as if it stood in the list.
    """
    bind(corpus, query)
    dense_k, bm25_k, late_k = query.budgets(limit)
    lists = []
    if dense_k:
        lists.append(branches.dense(corpus, query.vector, dense_k, where))
    if bm25_k:
        lists.append(branches.lexical(corpus, query.text, bm25_k, where, strict_not=strict_not))
    if late_k:
        lists.append(branches.late(corpus, query.multivector, query.weights(), late_k, where))
    if not lists:
        empty = corpus.rows.select(F.lit(0).alias("qid"), F.col(corpus.id).alias("id")).limit(0)
        return fusion.merge([empty]).withColumn("fused", F.lit(0.0)).withColumn("rank", F.lit(0)).select(*COLUMNS)
    merged = fusion.merge(lists)
    if query.require_bm25_match:
        merged = merged.where(F.col("bm25_rank").isNotNull())
    if rescore and query.vector is not None:
        q = vectors.literal(query.vector)
        distance = corpus.rows.select(F.col(corpus.id).alias("id"), vectors.RANKING[corpus.metric](F.col(corpus.vector), q).alias("__d"))
        ahead = F.sum(F.when(F.col("dense_rank").isNotNull(), 1).otherwise(0)).over(fusion._each().orderBy(F.coalesce("dense_dist", "__d"), "id"))
        merged = merged.join(distance, "id", "left").withColumn("dense_rank", F.coalesce("dense_rank", (ahead + 1).cast("int")))
        merged = merged.withColumn("dense_dist", F.coalesce("dense_dist", "__d")).withColumn("dense_sim", -F.col("dense_dist")).drop("__d")
    alpha = query.alpha
    if _by_shape(query):
        alpha = fusion.SHAPE_ALPHA[fusion.shape(branches.signals(corpus, query.text))]
    scored = fusion.fused_score(merged, query.fusion, dense_weight=query.dense_weight, bm25_weight=query.bm25_weight, late_weight=query.multivector_weight, alpha=alpha, rrf_k=query.rrf_k, robust=robust)
    return branches.top(scored, fusion.order(), query.size(limit), "rank").select(*COLUMNS)


def _by_shape(query: HybridQuery) -> bool:
    """Whether the dense share follows from the shape of the text: only where there is a text and something to weigh it against; else the default holds."""
    return query.fusion == "calibrated" and query.alpha is None and query.text is not None and (query.vector is not None or query.multivector is not None)


def search_batch(corpus: Corpus, queries: Sequence[tuple[int, HybridQuery]], limit: int | None = None) -> DataFrame:
    """``qid`` and the columns of a search for many queries, each with its own branches and options, as if searched by itself.

    Queries that share fusion, weights, budgets and filters have one plan, with one reading for each branch and block of queries. Query numbers must be unique.
    """
    for _, q in queries:
        bind(corpus, q)
    shaped = [(i, q) for i, q in queries if _by_shape(q)]
    alphas = {i: fusion.SHAPE_ALPHA[fusion.shape(s)] for (i, _), s in zip(shaped, branches.signals_batch(corpus, [q.text for _, q in shaped]))} if shaped else {}
    alike: dict[tuple, list[tuple[int, HybridQuery]]] = {}
    for i, q in queries:
        options = (q.fusion, q.dense_weight, q.bm25_weight, q.multivector_weight, alphas.get(i, q.alpha), q.rrf_k, q.require_bm25_match, q.size(limit), q.budgets(limit))
        alike.setdefault(options, []).append((i, q))
    out = None
    for (name, dense_weight, bm25_weight, late_weight, alpha, rrf_k, must_match, size, (dense_k, bm25_k, late_k)), some in alike.items():
        lists = []
        if dense_k:
            lists.append(branches.dense_batch(corpus, [(i, q.vector) for i, q in some], dense_k))
        if bm25_k:
            lists.append(branches.lexical_batch(corpus, [(i, q.text) for i, q in some], bm25_k))
        if late_k:
            lists.append(branches.late_batch(corpus, [(i, q.multivector, q.weights()) for i, q in some], late_k))
        if not lists:
            continue
        merged = fusion.merge(lists)
        if must_match:
            merged = merged.where(F.col("bm25_rank").isNotNull())
        scored = fusion.fused_score(merged, name, dense_weight=dense_weight, bm25_weight=bm25_weight, late_weight=late_weight, alpha=alpha, rrf_k=rrf_k)
        part = branches.top(scored, fusion.order(), size, "rank", by="qid").select(F.col("qid").cast("long").alias("qid"), *COLUMNS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = corpus.rows.select(F.lit(0).cast("long").alias("qid"), F.col(corpus.id).alias("id")).limit(0)
        return fusion.merge([empty]).withColumn("fused", F.lit(0.0)).withColumn("rank", F.lit(0)).select("qid", *COLUMNS)
    return out
