"""A retrieval request: its branches, fusion, weights and budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from quillrank.functions import analyzer
from quillrank.functions.multivector import Multivector

FUSIONS = ("rrf", "weighted", "fast_weighted", "calibrated", "dbsf")
DEFAULT_K, DEFAULT_RRF_K, DEFAULT_FINAL_K, MOST_LATE = 100, 60, 10, 100
#: What a defaulted budget shrinks to where the limit is known: 8 times the limit, within these bounds.
AUTO_TIMES, AUTO_LEAST, AUTO_MOST = 8, 32, 400


@dataclass(frozen=True)
class HybridQuery:
    """At least one of ``vector``, ``text`` (in ``& | ! <-> ( )`` form, or a tree) and ``multivector``.

    ``dense_k``, ``bm25_k`` and ``multivector_k`` are the lengths of the branches' lists; 0 turns a branch off. ``token_skip`` true leaves a query
    token out. ``alpha`` is the dense share of the weighted fusions; the weights act in ``rrf`` and ``dbsf``. A late list holds at most ``MOST_LATE`` rows, a fixed bound of the request format.
    """

    vector: Sequence[float] | None = None
    text: object = None
    fusion: str = "rrf"
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    alpha: float | None = None
    rrf_k: float | None = None
    dense_k: int | None = None
    bm25_k: int | None = None
    final_k: int | None = None
    require_bm25_match: bool = False
    multivector: Multivector | None = None
    token_weights: Sequence[float] | None = None
    token_skip: Sequence[bool] | None = None
    multivector_weight: float = 1.0
    multivector_k: int | None = None

    def __post_init__(self):
        if self.vector is None and self.text is None and self.multivector is None:
            raise ValueError("a query needs a vector, a text or a multivector")
        if self.fusion.lower() not in FUSIONS:
            raise ValueError(f"unknown fusion {self.fusion!r}")
        object.__setattr__(self, "fusion", self.fusion.lower())
        if isinstance(self.text, str):
            object.__setattr__(self, "text", analyzer.parse(self.text))
        if self.multivector is not None and not isinstance(self.multivector, Multivector):
            object.__setattr__(self, "multivector", Multivector.of(self.multivector))
        if self.vector is not None and not all(math.isfinite(x) for x in self.vector):
            raise ValueError("the elements of a vector must be finite")
        for name in ("dense_weight", "bm25_weight", "multivector_weight"):
            w = getattr(self, name)
            if w is None or not math.isfinite(w) or w < 0:
                raise ValueError(f"{name} must be finite and not negative")
        if self.alpha is not None and not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be from 0 to 1")
        if self.rrf_k is not None and not (math.isfinite(self.rrf_k) and self.rrf_k > 0):
            raise ValueError("rrf_k must be above 0")
        for name in ("dense_k", "bm25_k", "multivector_k"):
            if getattr(self, name) is not None and getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.final_k is not None and self.final_k <= 0:
            raise ValueError("final_k must be above 0")
        if self.require_bm25_match is None:
            raise ValueError("require_bm25_match must be true or false")
        for name in ("token_weights", "token_skip"):
            x = getattr(self, name)
            if x is None:
                continue
            if self.multivector is None:
                raise ValueError(f"{name} needs a multivector")
            if len(x) != len(self.multivector) or any(v is None for v in x):
                raise ValueError(f"{name} needs one value for each query token")
            if name == "token_weights" and not all(math.isfinite(v) and v >= 0 for v in x):
                raise ValueError("token weights must be finite and not negative")

    @classmethod
    def dense(cls, vector, final_k=None, dense_k=None) -> HybridQuery:
        return cls(vector=vector, final_k=final_k, dense_k=dense_k)

    @classmethod
    def hybrid(cls, vector, text, final_k=None, dense_k=None, bm25_k=None) -> HybridQuery:
        return cls(vector=vector, text=text, final_k=final_k, dense_k=dense_k, bm25_k=bm25_k)

    @classmethod
    def late(cls, multivector, final_k=None, multivector_k=None) -> HybridQuery:
        return cls(multivector=multivector, final_k=final_k, multivector_k=multivector_k)

    def weights(self) -> list[float]:
        """The weight of each query token, 0 for those left out."""
        n = len(self.multivector) if self.multivector else 0
        return [0.0 if self.token_skip and self.token_skip[i] else float(self.token_weights[i]) if self.token_weights else 1.0 for i in range(n)]

    def budgets(self, limit: int | None = None) -> tuple[int, int, int]:
        """The lengths of the dense, BM25 and late lists. Only defaulted ones shrink with a known limit."""
        auto = DEFAULT_K if limit is None else min(DEFAULT_K, min(AUTO_MOST, max(AUTO_TIMES * limit, AUTO_LEAST)))
        dense = auto if self.dense_k is None else self.dense_k
        lexical = auto if self.bm25_k is None else self.bm25_k
        late = dense if self.multivector_k is None else self.multivector_k
        return dense if self.vector is not None else 0, lexical if self.text is not None else 0, min(late, MOST_LATE) if self.multivector is not None else 0

    def size(self, limit: int | None = None) -> int:
        """How many rows come out: the limit where there is one, else ``final_k`` or 10."""
        return limit if limit is not None else self.final_k or DEFAULT_FINAL_K

    def __str__(self) -> str:
        parts = [f"vector_dims={len(self.vector)}"] if self.vector is not None else []
        parts += [f"terms={len(analyzer.positive_terms(self.text))}"] if self.text is not None else []
        parts += [f"multivector={len(self.multivector)}x{self.multivector.dim}"] if self.multivector else []
        parts += [f"{n}={getattr(self, n)}" for n in ("fusion", "dense_weight", "bm25_weight", "multivector_weight", "alpha", "rrf_k", "dense_k", "bm25_k", "multivector_k", "final_k", "require_bm25_match")]
        return f"hybrid_query({', '.join(parts)})"
