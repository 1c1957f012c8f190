"""How distinctive a term is of a record: a two-Poisson mixture per term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from .arrow import batch, table_of, term_counts

HOT_SHARE = 50


def occurrences(df: DataFrame, key: str, terms: str) -> DataFrame:
    """``id, term, tf`` of every record and term."""
    schema = pa.schema([("id", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])

    def count(batches):
        for b in batches:
            rows, codes, counts, words = term_counts(b.column(1))
            yield batch(schema, b.column(0).take(pa.array(rows)), words.take(pa.array(codes)), counts)

    return df.selectExpr(f"cast(`{key}` as long)", f"`{terms}`").mapInArrow(count, "id long, term string, tf long")


def two_poisson(owner: np.ndarray, tf: np.ndarray, records: np.ndarray, total: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures fitted by expectation-maximisation on the frequency histograms of many terms at once.

    ``owner`` says which term a histogram bar belongs to, ``tf`` and ``records`` are its count and its height; ``total`` is
    the number of records for each term, of which those without the term count as frequency 0. Gives the share of the elite
    component, its rate, and the rate of the other one.
    """
    n = len(total)
    sums = lambda x: np.bincount(owner, x, n)
    df, mass = sums(records), sums(records * tf)
    none = np.maximum(total - df, 0.0)
    top = np.zeros(n)
    np.maximum.at(top, owner, tf)
    share = np.clip(0.5 * df / np.maximum(total, 1), 1e-12, 0.5)
    elite, rest = np.maximum(0.5 * (mass / np.maximum(df, 1) + top), 1e-9), np.clip(0.5 * mass / np.maximum(total, 1), 1e-12, None)
    for _ in range(rounds):
        p = _posterior(tf, share[owner], elite[owner], rest[owner])
        p0 = _posterior(0.0, share, elite, rest)
        weight = sums(records * p) + none * p0
        taken = sums(records * p * tf)
        share = np.clip(weight / np.maximum(total, 1), 1e-12, 1 - 1e-12)
        elite = np.clip(taken / np.maximum(weight, 1e-300), 1e-12, None)
        rest = np.clip((mass - taken) / np.maximum(total - weight, 1e-12), 1e-12, None)
        swapped = elite < rest
        share = np.where(swapped, 1 - share, share)
        elite, rest = np.where(swapped, rest, elite), np.where(swapped, elite, rest)
    return share, elite, rest


def _posterior(tf, share, elite, rest):
    """The probability that a record with ``tf`` occurrences is of the elite component."""
    odds = np.log(share) - np.log1p(-share) + tf * (np.log(elite) - np.log(rest)) - elite + rest
    return 1 / (1 + np.exp(np.clip(-odds, -700, 700)))


def term_models(df: DataFrame, key: str, terms: str, *, at_least: int = 1) -> DataFrame:
    """``term, df, n, share, elite, rest`` of every term that some record has ``at_least`` times. All records with a non-NULL array count."""
    tfs = occurrences(df, key, terms)
    bars = tfs.groupBy("term", "tf").agg(F.count("*").alias("records"))
    histograms = bars.groupBy("term").agg(F.collect_list(F.struct("tf", "records")).alias("bars"), F.sum("records").alias("df"), F.max("tf").alias("top"))
    everything = df.agg(F.count(terms).alias("n"))
    wanted = histograms.where(F.col("top") >= at_least).drop("top").join(F.broadcast(everything))
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("n", pa.int64()), ("share", pa.float64()), ("elite", pa.float64()), ("rest", pa.float64())])

    def fit(batches):
        for t in table_of(batches, limit=50_000):
            bars = t.column("bars").combine_chunks()
            flat = bars.flatten()
            owner = pc.list_parent_indices(bars).to_numpy(zero_copy_only=False).astype(np.int64)
            tf, records = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("tf", "records"))
            total = t.column("n").to_numpy().astype(float)
            share, elite, rest = two_poisson(owner, tf, records, total)
            yield batch(schema, t.column("term").combine_chunks(), t.column("df").combine_chunks(), t.column("n").combine_chunks(), share, elite, rest)

    return wanted.mapInArrow(fit, "term string, df long, n long, share double, elite double, rest double")


def distinctive_terms(df: DataFrame, key: str, terms: str, *, min_tf: int = 1, max_df: int | None = None) -> DataFrame:
    """``id, term, tf, df, elite, score`` of every record and term: how much the term sets the record apart.

    ``elite`` is the posterior probability that ``tf`` occurrences come from the elite component of the term's
    two-Poisson mixture, ``score`` is that times ln(n / df): common terms count little, rare ones that a
    record keeps repeating count much. ``min_tf`` and ``max_df`` limit the rows given, not the records counted. Terms are trimmed
    and lower-cased, NULL and blank entries are none; records with a NULL or empty array give no rows, but empty ones count in n.
    An id that comes twice is two records. An empty table gives no rows.

    A term in more than one record in ``HOT_SHARE`` is scored through a broadcast: there are at most
    ``HOT_SHARE`` times the mean number of distinct terms of a record of them, however many records there are. All
    others meet their model in a join by term, where no key has more than that share of the records.
    """
    model = term_models(df, key, terms, at_least=min_tf)
    if max_df is not None:
        model = model.where(F.col("df") <= max_df)
    tfs = occurrences(df, key, terms).where(F.col("tf") >= min_tf)
    odds = F.log("share") - F.log1p(-F.col("share")) + F.col("tf") * (F.log("elite") - F.log("rest")) - F.col("elite") + F.col("rest")
    posterior = 1 / (1 + F.exp(F.least(F.greatest(-odds, F.lit(-700.0)), F.lit(700.0))))
    is_hot = F.col("df") * HOT_SHARE > F.col("n")
    if max_df is None:
        model = stage_table(model, "models")
        hot = F.broadcast(model.where(is_hot))
        cold = tfs.join(F.broadcast(model.where(is_hot).select("term")), "term", "left_anti").join(model.where(~is_hot), "term")
        joined = tfs.join(hot, "term").unionByName(cold)
    else:
        joined = tfs.join(model, "term")
    score = F.col("elite") * F.log(F.col("n") / F.col("df"))
    return joined.withColumn("elite", posterior).select("id", "term", "tf", "df", "elite", score.alias("score"))
