"""Multivectors (arrays of token vectors): construction, MaxSim, fixed-size encodings, pooling, text and binary forms."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import inner_product

MOST_VECTORS = 4096


@dataclass(frozen=True)
class Multivector:
    """A driver-side multivector; ``contexts`` are rising start offsets from 0, ``fields`` a number for each context."""

    values: tuple[tuple[float, ...], ...]
    contexts: tuple[int, ...] | None = None
    fields: tuple[int, ...] | None = None

    def __post_init__(self):
        if not 1 <= len(self.values) <= MOST_VECTORS:
            raise ValueError(f"a multivector has 1 to {MOST_VECTORS} vectors")
        if len({len(v) for v in self.values}) != 1 or not self.values[0]:
            raise ValueError("the vectors of a multivector share one dimension")
        if not all(math.isfinite(x) for v in self.values for x in v):
            raise ValueError("the elements of a multivector must be finite")
        c = self.contexts
        if c is not None and (not c or c[0] != 0 or any(a >= b for a, b in zip(c, c[1:])) or c[-1] >= len(self.values)):
            raise ValueError("contexts rise strictly from 0 within the vectors")
        if self.fields is not None and (c is None or len(self.fields) != len(c) or min(self.fields) < 0):
            raise ValueError("there is one non-negative field for each context")

    @classmethod
    def of(cls, vectors: Sequence[Sequence[float]], **more) -> Multivector:
        return cls(tuple(tuple(float(x) for x in v) for v in vectors), **more)

    @classmethod
    def from_floats(cls, flat: Sequence[float], dim: int) -> Multivector:
        if dim < 1 or not flat or len(flat) % dim:
            raise ValueError("the number of elements must be a multiple of the dimension")
        return cls.of([flat[i : i + dim] for i in range(0, len(flat), dim)])

    @property
    def dim(self) -> int:
        return len(self.values[0])

    def __len__(self) -> int:
        return len(self.values)

    def subvector(self, ordinal: int) -> tuple[float, ...]:
        """The vector at an ordinal, counted from 1."""
        if not 1 <= ordinal <= len(self):
            raise IndexError("ordinal out of range")
        return self.values[ordinal - 1]

    def literal(self) -> Column:
        return F.array(*[F.array(*map(F.lit, v)) for v in self.values])


_TEXT = re.compile(r"\s*(?:\w+_)?multivector\(\s*dim=(\d+)\s*,\s*count=(\d+)\s*,\s*values=(\[\[.*?\]\])\s*(?:,\s*contexts=(\[[^\]]*\])\s*(?:,\s*fields=(\[[^\]]*\])\s*)?)?\)\s*", re.S)


def parse(text: str) -> Multivector:
    """The multivector of its text form."""
    m = _TEXT.fullmatch(text)
    if not m:
        raise ValueError("malformed multivector")
    values, contexts, fields = (json.loads(x) if x else None for x in m.group(3, 4, 5))
    out = Multivector.of(values, contexts=tuple(contexts) if contexts else None, fields=tuple(fields) if fields else None)
    if (out.dim, len(out)) != (int(m[1]), int(m[2])):
        raise ValueError("dim or count does not match the values")
    return out


def render(mv: Multivector) -> str:
    """The text form."""
    number = lambda x: np.format_float_positional(np.float32(x), trim="-")
    rows = ",".join("[" + ",".join(map(number, v)) + "]" for v in mv.values)
    more = "".join(f",{name}=[{','.join(map(str, x))}]" for name, x in (("contexts", mv.contexts), ("fields", mv.fields)) if x is not None)
    return f"multivector(dim={mv.dim},count={len(mv)},values=[{rows}]{more})"


def to_bytes(mv: Multivector) -> bytes:
    """The binary form: big-endian version (1, or 2 with contexts), dim, count and flags, then the floats, contexts and fields."""
    flags = (mv.contexts is not None) + 2 * (mv.fields is not None)
    head = struct.pack(">iiii", 2 if flags else 1, mv.dim, len(mv), flags)
    body = struct.pack(f">{mv.dim * len(mv)}f", *[x for v in mv.values for x in v])
    if mv.contexts is not None:
        body += struct.pack(f">{1 + len(mv.contexts)}i", len(mv.contexts), *mv.contexts)
    if mv.fields is not None:
        body += struct.pack(f">{len(mv.fields)}i", *mv.fields)
    return head + body


def from_bytes(data: bytes) -> Multivector:
    """The multivector of its binary form; malformed, short and over-long input is refused."""
    try:
        version, dim, count, flags = struct.unpack_from(">iiii", data)
        if version not in (1, 2) or dim < 1 or not 1 <= count <= MOST_VECTORS or (version == 1 and flags) or flags not in (0, 1, 3):
            raise ValueError("unsupported multivector header")
        flat, at = struct.unpack_from(f">{dim * count}f", data, 16), 16 + 4 * dim * count
        contexts = fields = None
        if flags:
            (n,) = struct.unpack_from(">i", data, at)
            if not 1 <= n <= count:
                raise ValueError("bad number of contexts")
            contexts, at = struct.unpack_from(f">{n}i", data, at + 4), at + 4 + 4 * n
            if flags == 3:
                fields, at = struct.unpack_from(f">{n}i", data, at), at + 4 * n
    except struct.error as e:
        raise ValueError("short multivector") from e
    if at != len(data):
        raise ValueError("trailing bytes")
    return Multivector.of([flat[i : i + dim] for i in range(0, len(flat), dim)], contexts=contexts, fields=fields)


# ---- Columns


def from_floats(flat: Column, dim: int) -> Column:
    """Split a flat float array into vectors of ``dim``; an error where its length is no multiple of it."""
    parts = F.transform(F.sequence(F.lit(0), (F.size(flat) / dim).cast("int") - 1), lambda i: F.slice(flat, i * dim + 1, dim))
    return F.when((F.size(flat) > 0) & (F.size(flat) % dim == 0), parts).when(flat.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("length is no multiple of the dimension")))


def dims(mv: Column) -> Column:
    return F.size(mv[0])


def count(mv: Column) -> Column:
    return F.size(mv)


def subvector(mv: Column, ordinal: Column | int) -> Column:
    """The vector at an ordinal, counted from 1; an error outside the range."""
    n = F.lit(ordinal) if isinstance(ordinal, int) else ordinal
    return F.when((n >= 1) & (n <= F.size(mv)), F.element_at(mv, n)).otherwise(F.raise_error(F.lit("ordinal out of range")))


def best(query_vector: Column, mv: Column) -> Column:
    """The largest inner product of one vector with those of a multivector."""
    return F.array_max(F.transform(mv, lambda d: inner_product(query_vector, d)))


def maxsim(query: Column, mv: Column) -> Column:
    """The sum over the query's vectors of the largest inner product with the document's."""
    return F.aggregate(F.transform(query, lambda q: best(q, mv)), F.lit(0.0), lambda s, x: s + x)


def weighted_maxsim(query: Column, mv: Column, weights: Sequence[float] | None = None, skip: Sequence[bool] | None = None, size: int | None = None) -> Column:
    """MaxSim with a weight for each query vector; those of weight 0 or with ``skip`` true are left out."""
    n = size or len(weights or skip or ())
    w = [0.0 if skip and skip[i] else float(weights[i]) if weights else 1.0 for i in range(n)]
    return F.aggregate(F.zip_with(query, F.array(*map(F.lit, w)), lambda q, x: F.when(x > 0, x * best(q, mv)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def context_maxsim(query: Column, mv: Column, contexts: Column) -> Column:
    """The largest MaxSim with the vectors of one context; plain MaxSim where there are no contexts."""
    return F.when(F.size(contexts) > 0, F.array_max(_by_context(query, mv, contexts))).otherwise(maxsim(query, mv))


def _by_context(query: Column, mv: Column, contexts: Column) -> Column:
    ends = F.concat(F.slice(contexts, 2, F.greatest(F.size(contexts) - 1, F.lit(0))), F.array(F.size(mv)))
    return F.zip_with(contexts, ends, lambda a, b: maxsim(query, F.slice(mv, a + 1, b - a)))


def field_maxsim(query: Column, mv: Column, contexts: Column, fields: Column, weights: dict[int, float]) -> Column:
    """The weighted sum over fields of the largest MaxSim with a context of the field; without contexts all is field 0."""
    scored = F.zip_with(fields, _by_context(query, mv, contexts), lambda f, s: F.struct(f.alias("f"), s.alias("s")))
    total = F.lit(0.0)
    for name, weight in sorted(weights.items()):
        total = total + F.lit(float(weight)) * F.coalesce(F.array_max(F.transform(_of_field(scored, name), lambda x: x["s"])), F.lit(0.0))
    return F.when(F.size(contexts) > 0, total).otherwise(F.lit(float(weights.get(0, 0.0))) * maxsim(query, mv))


def _of_field(scored: Column, name: int) -> Column:
    return F.filter(scored, lambda x: x["f"] == name)


def symmetric_maxsim(a: Column, b: Column) -> Column:
    """Half the sum of the mean best of each vector of ``a`` in ``b`` and the mean best of each of ``b`` in ``a``."""
    return 0.5 * (maxsim(a, b) / F.size(a) + maxsim(b, a) / F.size(b))


def _by_dimension(mv: Column, dim: int, one) -> Column:
    return F.array(*[one(_component(mv, i)) for i in range(dim)])


def _component(mv: Column, i: int) -> Column:
    return F.transform(mv, lambda v: v[i].cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(mv: Column, dim: int) -> Column:
    return _by_dimension(mv, dim, lambda x: _sum(x) / F.size(mv))


def normalised_mean(mv: Column, dim: int) -> Column:
    m = mean(mv, dim)
    length = F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, m).otherwise(F.transform(m, lambda x: x / length))


def first_vector(mv: Column) -> Column:
    return mv[0]


def max_pool(mv: Column, dim: int) -> Column:
    return _by_dimension(mv, dim, F.array_max)


def max_abs(mv: Column, dim: int) -> Column:
    """In each dimension the element of largest size, the positive one of two as large."""
    return _by_dimension(mv, dim, lambda x: F.array_max(F.transform(x, lambda v: F.struct(F.abs(v).alias("size"), v.alias("value"))))["value"])


def centroid_mean(mv: Column) -> Column:
    """The mean of the centroids (``centroid_count`` of them, by ``pool``) of a multivector."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        def one(m):
            if m is None or len(m) == 0:
                return None
            x = np.stack([np.asarray(v, np.float64) for v in m])
            return pool(x, centroid_count(len(x)), 4).mean(axis=0).tolist()

        return values.map(one)

    return run(mv)


def centroid_count(n: int) -> int:
    """How many centroids a document of ``n`` vectors gets."""
    return n if n <= 4 else max(4, min(64, math.ceil(math.sqrt(n))))


def pool(vectors: np.ndarray, target: int, rounds: int) -> np.ndarray:
    """The vectors as they are where there are no more than ``target``; else ``target`` centroids of them.

    Seeds are taken farthest first by cosine from vector 0 on; in each round a vector goes to the centroid of largest inner product, and each centroid becomes the
    unit mean of its vectors, or its seed again where it has none.
    """
    x = np.asarray(vectors, np.float64)
    if len(x) <= max(target, 1):
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(length > 0, length, 1)
    seeds = [0]
    nearest = unit @ unit[0]
    for _ in range(target - 1):
        nearest[seeds[-1]] = np.inf
        seeds.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[seeds[-1]])
    centres = x[seeds].copy()
    for _ in range(rounds):
        member = np.eye(target)[(x @ centres.T).argmax(axis=1)]
        held = member.sum(axis=0)
        mean = member.T @ x / np.maximum(held, 1)[:, None]
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        centres = np.where(held[:, None] > 0, mean / np.where(size > 0, size, 1), x[seeds])
    return centres


def pooled(ratio: float, method: str = "kmeans", *, least: int = 2):
    """A pandas UDF that pools a multivector to ceil(n * ratio) vectors; ``kmeans`` takes 4 rounds, ``greedy_cosine`` one. Multivectors of under ``least`` vectors stay as they are, and so do all with a ratio of 1."""
    if not 0 < ratio <= 1 or method not in ("kmeans", "greedy_cosine"):
        raise ValueError("ratio must be above 0 and at most 1, method kmeans or greedy_cosine")
    rounds = 4 if method == "kmeans" else 1

    @F.pandas_udf("array<array<float>>")
    def run(mv: pd.Series) -> pd.Series:
        def one(m):
            if m is None or len(m) == 0:
                return None
            x = np.stack([np.asarray(v, np.float64) for v in m])
            return pool(x, math.ceil(len(x) * ratio) if len(x) >= least else len(x), rounds).astype(np.float32).tolist()

        return mv.map(one)

    return run


def residual(vectors: np.ndarray, centres: np.ndarray) -> float:
    """The mean squared distance of the vectors to their best centroid."""
    d = ((np.asarray(vectors)[:, None, :] - np.asarray(centres)[None, :, :]) ** 2).sum(axis=2)
    return float(d.min(axis=1).mean())
