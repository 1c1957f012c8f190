"""Text encoders as pandas UDFs: a protocol, option and output checks, and a deterministic stub."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F

POOLINGS = ("model", "none", "mean", "cls", "last", "rank")
ROLES = ("query", "doc", "generic")


@dataclass(frozen=True)
class Options:
    """``mode`` dense gives one pooled vector, tokens one for each retained token."""

    mode: str = "dense"
    pooling: str | None = None
    prefix: str = ""
    max_vectors: int = 4096
    expected_dim: int | None = None
    normalize: bool = True

    def __post_init__(self):
        if self.mode not in ("dense", "tokens"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.pooling is None:
            object.__setattr__(self, "pooling", "model" if self.mode == "dense" else "none")
        if self.pooling not in POOLINGS:
            raise ValueError(f"unknown pooling {self.pooling!r}")
        if (self.mode == "tokens") != (self.pooling == "none"):
            raise ValueError("tokens need pooling none, dense vectors another one")
        if not 1 <= self.max_vectors <= 4096:
            raise ValueError("max_vectors is from 1 to 4096")
        if self.expected_dim is not None and not 1 <= self.expected_dim <= 16_000:
            raise ValueError("expected_dim is from 1 to 16000")


def alias(name: str, allowed: Sequence[str] | None = None) -> tuple[str, str]:
    """Model alias and role of ``alias`` or ``alias:role``. Aliases are of letters, digits, ``_``, ``.`` and ``-``, without a leading dot or ``..``."""
    model, _, role = name.partition(":")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", model) or model.startswith(".") or ".." in model:
        raise ValueError(f"bad model alias {model!r}")
    if role and role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    if allowed is not None and model not in allowed:
        raise PermissionError(f"model {model!r} is not allowed")
    return model, role or "generic"


class Encoder(Protocol):
    """What turns a text into vectors. It must be picklable; heavy state is to be loaded on first use in the worker."""

    dim: int

    def encode(self, text: str, role: str, options: Options) -> list[list[float]]: ...

    def info(self) -> dict: ...


@dataclass(frozen=True)
class StubEncoder:
    """Deterministic vectors of 4 dimensions, whatever the text: one (dense), two (query) or three; one-hot by position, or position plus index plus 1 where not normalised."""

    dim: int = 4

    def encode(self, text: str, role: str, options: Options) -> list[list[float]]:
        n = 1 if options.mode == "dense" else 2 if role == "query" else 3
        n = min(n, options.max_vectors)
        if options.normalize:
            return [[1.0 if j == i % self.dim else 0.0 for j in range(self.dim)] for i in range(n)]
        return [[float(i + j + 1) for j in range(self.dim)] for i in range(n)]

    def info(self) -> dict:
        return {"engine": "stub", "dim": self.dim}


def checked(vectors: list[list[float]], options: Options) -> list[list[float]]:
    """The vectors, or an error: there must be some but not too many, of the expected dimension, finite, and of unit length where normalised."""
    if not 1 <= len(vectors) <= options.max_vectors:
        raise ValueError("wrong number of vectors")
    for v in vectors:
        if options.expected_dim is not None and len(v) != options.expected_dim:
            raise ValueError("wrong dimension")
        if not all(map(math.isfinite, v)):
            raise ValueError("vectors must be finite")
        if options.normalize and abs(math.sqrt(sum(x * x for x in v)) - 1) > 1e-3:
            raise ValueError("vectors must have unit length")
    return vectors


def dense_udf(encoder: Encoder, role: str = "generic", options: Options | None = None):
    """text -> vector; NULL for NULL."""
    o = options or Options()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else checked(encoder.encode(o.prefix + t, role, o), o)[0])

    return run


def tokens_udf(encoder: Encoder, role: str = "generic", options: Options | None = None):
    """text -> multivector; NULL for NULL."""
    o = options or Options(mode="tokens")

    @F.pandas_udf("array<array<float>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else checked(encoder.encode(o.prefix + t, role, o), o))

    return run


def retained(ids: Sequence[int], attention: Sequence[int] | None, role: str, *, padding: int = 103, dropped: Sequence[int] = (1012,)) -> list[int]:
    """1 for the tokens of a plan that give a vector: a query keeps all, its mask padding too; a document those attended to that are no padding and no punctuation."""
    if role.lower() == "query":
        return [1] * len(ids)
    held = attention if attention is not None else [int(i != padding) for i in ids]
    return [int(bool(a) and i not in dropped) for i, a in zip(ids, held)]
