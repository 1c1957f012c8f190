"""Frequency of every term: heavy terms in exact local counters, the rest through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from .arrow import batch, term_counts

_OUT = "term string, occurrences long, records long"


def heavy_terms(df: DataFrame, terms: str, *, most: int = 2048, one_in: int = 64) -> list[str]:
    """The ``most`` commonest terms of one record in ``one_in``. They only choose the route of a term, never its count; the list is bounded by ``most``."""
    found = (
        df.where(F.pmod(F.xxhash64(terms), F.lit(one_in)) == 0)
        .select(F.explode(terms).alias("t"))
        .select(F.lower(F.trim("t")).alias("t"))
        .where("t is not null and t != ''")
        .groupBy("t")
        .count()
        .where("count > 1")
        .orderBy(F.desc("count"), "t")
        .limit(most)
    )
    return [r.t for r in found.collect()]


def term_frequencies(df: DataFrame, terms: str, *, rare_below: int = 3, common_above: float = 0.2, heavy: list[str] | None = None) -> DataFrame:
    """``term, occurrences, records, mark`` for every distinct term of the string-array column ``terms``.

    A term is an entry trimmed and lower-cased; NULL and blank entries are no terms. Every row is a record; a row whose
    array is NULL is none, an empty array counts as a record. ``mark`` is ``rare`` for terms in fewer than
    ``rare_below`` records, ``common`` for those in more than ``common_above`` of all records, else NULL; where both
    hold (tiny collections), ``rare`` stands. Repeated rows count each. An empty table gives no rows.

    Heavy-light aggregation: the broadcast heavy terms are counted in one pair of counter arrays per task, which
    leaves a task once; all other terms leave a batch as partial counts. The union of both is summed by term, so that no
    key has more rows than there are tasks and batches.
    """
    known = heavy_terms(df, terms) if heavy is None else heavy
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def count(batches):
        index = pa.array(known, pa.string())
        occurrences, records, seen = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), 0
        for b in batches:
            lists = b.column(0)
            seen += len(lists) - lists.null_count
            rows, codes, counts, words = term_counts(lists)
            if not len(words):
                continue
            total = np.bincount(codes, counts, len(words)).astype(np.int64)
            within = np.bincount(codes, minlength=len(words)).astype(np.int64)
            at = pc.fill_null(pc.index_in(words, value_set=index), -1).to_numpy(zero_copy_only=False)
            is_heavy = at >= 0
            occurrences[at[is_heavy]] += total[is_heavy]
            records[at[is_heavy]] += within[is_heavy]
            yield batch(schema, pc.filter(words, pa.array(~is_heavy)), total[~is_heavy], within[~is_heavy])
        used = records > 0
        yield batch(schema, pc.filter(index, pa.array(used)), occurrences[used], records[used])
        yield batch(schema, pa.array([None], pa.string()), [0], [seen])  # the number of records

    counted = df.select(terms).mapInArrow(count, _OUT).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    counted = stage_table(counted, "terms")
    everything = counted.where("term is null").select(F.col("records").alias("__all"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("__all") * F.lit(common_above), "common")
    return counted.where("term is not null").join(F.broadcast(everything)).withColumn("mark", mark).drop("__all")
