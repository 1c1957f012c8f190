"""Filling containers of a fixed capacity with texts: large-item matching, best fit for the rest."""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_ROWS = 20_000
#: Fixed value: the pre-tokenizer pattern that belongs to the byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, read once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of each row; NULL texts have none."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            yield batch(schema, b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64()))

    return df.selectExpr(f"cast(`{key}` as long)", f"cast(`{text}` as string)").mapInArrow(count, "id long, n_tokens long")


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size (all from 1 to ``capacity``), counted from 0.

    Items above a third of the capacity go at most two to a container: from the largest on, each takes the largest
    one left that fits beside it. The others follow in falling order, each into the fullest container that still
    holds it, a new one where none does. Ties fall by position.
    """
    container = np.full(len(sizes), -1, np.int64)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    large, small = order[3 * sizes[order] > capacity], order[3 * sizes[order] <= capacity]
    left = sorted((int(sizes[i]), -int(i)) for i in large)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    while left:
        size, i = left.pop()
        container[-i] = filled
        room = capacity - size
        at = bisect.bisect_right(left, (room, 1)) - 1
        if at >= 0:
            other, j = left.pop(at)
            container[-j] = filled
            room -= other
        gaps[room].append(filled)
        filled += 1
    open_gaps = [g for g in range(1, capacity + 1) if gaps[g]]
    for i in small.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(open_gaps, size)
        if at < len(open_gaps):
            gap = open_gaps[at]
            chosen = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
        else:
            gap, chosen = capacity, filled
            filled += 1
        container[i] = chosen
        rest = gap - size
        if rest:
            if not gaps[rest]:
                bisect.insort(open_gaps, rest)
            gaps[rest].append(chosen)
    return container


def pack(df: DataFrame, key: str, text: str, *, capacity: int = 4096, tokenizer: str = TOKENIZER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id, piece, n_pieces, n_tokens, shard, container, fill``: every text's place in containers of ``capacity`` tokens.

    A text longer than a container is cut into pieces of ``capacity`` tokens and a rest; nothing else is cut.
    A container is named by ``shard`` and ``container``; ``fill`` is what it holds. Rows are dealt by a hash of key and
    size to shards of about ``shard_rows`` rows, each packed by itself: the last, open container of a shard is
    all that dealing costs. Texts without tokens (NULL, empty) keep a row with container NULL. Repeated rows are items of their own.
    """
    shards = max(1, -(-df.count() // shard_rows))
    sizes = token_sizes(df, key, text, tokenizer)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n_tokens"], kind="stable", na_position="first")
        n = pdf["n_tokens"].to_numpy()
        pieces = np.maximum(-(-n // capacity), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - number * capacity, capacity)
        full = size > 0
        place = np.full(len(row), -1, np.int64)
        place[full] = pack_sizes(size[full], capacity)
        held = np.bincount(place[full], size[full]).astype(np.int64) if full.any() else np.zeros(1, np.int64)
        out = pd.DataFrame({"id": pdf["id"].to_numpy()[row], "piece": number.astype(np.int32), "n_pieces": pieces[row].astype(np.int32), "n_tokens": size, "shard": pdf["shard"].to_numpy()[row]})
        out["container"] = pd.array(place, dtype="Int64")
        out["fill"] = pd.array(held[np.maximum(place, 0)], dtype="Int64")
        out.loc[place < 0, ["container", "fill"]] = pd.NA
        return out

    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(fill, "id long, piece int, n_pieces int, n_tokens long, shard int, container long, fill long")
