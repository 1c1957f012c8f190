"""Merging ranked lists by identity, and their fused scores. All is by ``qid``, so that one plan serves many queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BONUS = 0.06
LEAST_CANDIDATES, SIGMAS = 10, 3
SHAPE_ALPHA = {"rare": 0.35, "mixed": 0.5, "broad": 0.7}
_COLUMNS = {"dense_dist": "double", "dense_sim": "double", "dense_rank": "int", "bm25_score": "double", "bm25_rank": "int", "maxsim": "double", "late_sim": "double", "late_rank": "int"}


def merge(lists: list[DataFrame]) -> DataFrame:
    """The full outer union of the lists by query and id; a branch that has not found a row leaves NULLs. The lists hold at most k rows for each query."""
    joined = reduce(lambda a, b: a.join(b, ["qid", "id"], "full_outer"), lists)
    for name, kind in _COLUMNS.items():
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    return joined


def _each() -> Window:
    return Window.partitionBy("qid")


def min_max(value: Column) -> Column:
    """To 0..1 by the least and largest of the query's candidates; where they are level, 1 for values above 0, else 0."""
    low, high = F.min(value).over(_each()), F.max(value).over(_each())
    return F.when(value.isNull(), 0.0).when(high <= low, F.when(value > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def sigmoid(value: Column) -> Column:
    return F.coalesce(1 / (1 + F.exp(-value)), F.lit(0.0))


def saturate(score: Column) -> Column:
    return F.when(score > 0, score / (score + 1)).otherwise(0.0)


def by_distribution(value: Column, *, robust: bool = False) -> Column:
    """To 0..1 between three deviations about the middle of the query's candidates; 0.5 for fewer than ten of them or no deviation.

    The middle and deviation are mean and sample deviation, or median and 1.4826 times the median distance from it.
    """
    n = F.count(value).over(_each())
    if robust:
        middle = F.median(value).over(_each())
        spread = 1.4826 * F.col("__mad")
    else:
        middle, spread = F.avg(value).over(_each()), F.stddev_samp(value).over(_each())
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - (middle - SIGMAS * spread)) / (2 * SIGMAS * spread)))
    return F.when(value.isNull(), 0.0).when((n < LEAST_CANDIDATES) | spread.isNull() | (spread == 0), 0.5).otherwise(scaled)


def shape(signals: dict) -> str:
    """``rare``, ``broad`` or ``mixed``: how telling the terms of a query are."""
    n = signals["n"]
    if signals["identifier"] or signals["max_idf"] >= 2.8 or 0 < signals["min_df"] <= max(4, n // 20):
        return "rare"
    if signals["terms"] >= 2 and (signals["max_idf"] < 1.5 or signals["min_df"] >= max(1, n // 2)):
        return "broad"
    return "mixed"


def fused_score(df: DataFrame, fusion: str, *, dense_weight: float = 1.0, bm25_weight: float = 1.0, late_weight: float = 1.0, alpha: float | None = None, rrf_k: float | None = None, robust: bool = False) -> DataFrame:
    """With ``fused``. A late list takes the dense place where there is no dense one."""
    is_late = F.col("dense_rank").isNull() & F.col("late_rank").isNotNull()
    close, lexical = F.coalesce("dense_sim", "late_sim"), F.col("bm25_score")
    if fusion == "rrf":
        k = 60 if rrf_k is None else rrf_k
        parts = [F.coalesce(F.lit(float(w)) / (k + F.col(c)), F.lit(0.0)) for w, c in ((dense_weight, "dense_rank"), (bm25_weight, "bm25_rank"), (late_weight, "late_rank"))]
        return df.withColumn("fused", reduce(lambda a, b: a + b, parts))
    a = 0.5 if alpha is None else alpha
    if fusion == "weighted":
        return df.withColumn("fused", a * min_max(close) + (1 - a) * min_max(lexical))
    if fusion in ("fast_weighted", "calibrated"):
        both = F.when(close.isNotNull() & lexical.isNotNull(), BONUS).otherwise(0.0) if fusion == "calibrated" else F.lit(0.0)
        return df.withColumn("fused", a * sigmoid(close) + (1 - a) * saturate(lexical) + both)
    if robust:
        return _robust(df, dense_weight, bm25_weight, late_weight)
    weight = F.when(is_late, float(late_weight)).otherwise(float(dense_weight))
    return df.withColumn("fused", weight * by_distribution(close) + float(bm25_weight) * by_distribution(lexical))


def _robust(df: DataFrame, dense_weight: float, bm25_weight: float, late_weight: float) -> DataFrame:
    late = F.col("dense_rank").isNull() & F.col("late_rank").isNotNull()
    weight = F.when(late, float(late_weight)).otherwise(float(dense_weight))
    out = df.withColumn("__close", F.coalesce("dense_sim", "late_sim"))
    total = F.lit(0.0)
    for i, (name, w) in enumerate((("__close", weight), ("bm25_score", F.lit(float(bm25_weight))))):
        out = out.withColumn(f"__off{i}", F.abs(F.col(name) - F.median(name).over(_each()))).withColumn("__mad", F.median(f"__off{i}").over(_each()))
        out = out.withColumn(f"__part{i}", by_distribution(F.col(name), robust=True)).drop("__mad")
        total = total + w * F.col(f"__part{i}")
    return out.withColumn("fused", total).drop("__close", "__off0", "__off1", "__part0", "__part1")


def order() -> list[Column]:
    """Fused score; rows of both kinds of branch first; then dense, late and BM25 rank, and the id."""
    both = F.coalesce("dense_rank", "late_rank").isNotNull() & F.col("bm25_rank").isNotNull()
    return [F.desc("fused"), F.desc(both), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("late_rank"), F.asc_nulls_last("bm25_rank"), F.col("id")]


def diversify(pool: DataFrame, group: str, k: int, share: float = 0.7) -> DataFrame:
    """The first k of each query's pool, chosen one by one by ``share`` times the relevance (min-max of ``fused``) less the rest where the group was chosen before. The pool holds a few hundred rows a query."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fused", "id"], ascending=[False, True]).reset_index(drop=True)
        low, high = pdf["fused"].min(), pdf["fused"].max()
        relevance = (pdf["fused"] - low) / (high - low) if high > low else pdf["fused"] * 0 + 1.0
        seen, picked, left = set(), [], list(range(len(pdf)))
        while left and len(picked) < k:
            best = max(left, key=lambda i: (share * relevance[i] - (1 - share) * (pdf[group][i] in seen), -i))
            picked.append(best)
            seen.add(pdf[group][best])
            left.remove(best)
        out = pdf.iloc[picked][["qid", "id", group, "fused"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    types = dict(pool.dtypes)
    return pool.select("qid", "id", group, "fused").groupBy("qid").applyInPandas(choose, f"qid {types['qid']}, id {types['id']}, `{group}` {types[group]}, fused double, rank int")
