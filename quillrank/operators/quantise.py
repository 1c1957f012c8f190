"""Low-bit codes of vectors for a coarse first list, and the per-dimension corrections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import vectors

from .branches import top
from .corpus import Corpus


def corrections(df: DataFrame, vector: str) -> DataFrame:
    """``i, shift, scale`` of each dimension: minus its mean, and one over its sample deviation."""
    flat = df.select(F.posexplode(vector).alias("i", "e"))
    return flat.groupBy("i").agg((-F.avg(F.col("e").cast("double"))).alias("shift"), (1 / F.stddev_samp(F.col("e").cast("double"))).alias("scale"))


def levels(bits: int) -> np.ndarray:
    """The best reconstruction levels of a standard normal value for 1, 2 or 4 bits, by Lloyd's iteration; even steps for 8."""
    if bits == 8:
        return np.linspace(-4, 4, 256)
    if bits not in (1, 2, 4):
        raise ValueError("codes have 1, 2, 4 or 8 bits")
    x = np.linspace(-6, 6, 40_001)
    density, points = np.exp(-x * x / 2), np.linspace(-2, 2, 2**bits)
    for _ in range(200):
        own = np.searchsorted((points[1:] + points[:-1]) / 2, x)
        points = np.bincount(own, density * x, 2**bits) / np.bincount(own, density, 2**bits)
    return points


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def encode(x: np.ndarray, turn: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths: each vector rotated, scaled to deviation 1, and each element put to its nearest level."""
    length = np.linalg.norm(x, axis=1)
    y = x @ turn * (np.sqrt(x.shape[1]) / np.where(length > 0, length, 1))[:, None]
    return np.searchsorted((points[1:] + points[:-1]) / 2, y).astype(np.uint8), length


def coarse_then_exact(corpus: Corpus, vector: Sequence[float], k: int, *, bits: int = 4, oversample: int = 4) -> DataFrame:
    """The k nearest of the k * ``oversample`` rows whose codes look nearest by cosine; their distances are exact, the list may miss rows."""
    q = np.asarray(vector, np.float64)
    turn, points = rotation(len(q)), levels(bits)
    aim = q / (np.linalg.norm(q) or 1) @ turn / np.sqrt(len(q))
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("coarse", pa.float64())])

    def score(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            codes, _ = encode(x, turn, points)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(points[codes] @ aim)], schema=schema)

    coded = corpus.rows.selectExpr(f"cast(`{corpus.id}` as long) as id", f"cast(`{corpus.vector}` as array<double>) as v").mapInArrow(score, "id long, v array<double>, coarse double")
    first = coded.orderBy(F.desc("coarse"), "id").limit(k * oversample)
    exact = first.select(F.lit(0).alias("qid"), "id", vectors.RANKING[corpus.metric](F.col("v"), vectors.literal(vector)).alias("dense_dist"))
    return top(exact, [F.col("dense_dist"), F.col("id")], k, "dense_rank")
