"""The three ranked lists of a search. Each gives ``qid, id, <value columns>, <branch>_rank``, at most k rows for each query."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import analyzer, multivector, vectors

from .corpus import Corpus

K1, B = 1.2, 0.75
DENSE_BATCH = LEXICAL_BATCH = LATE_BATCH = 4096


def top(df: DataFrame, order: Sequence[Column], k: int, rank: str, by: str | None = None) -> DataFrame:
    """The first k rows with their rank, for each ``by`` or over all. Ranking all takes a bounded sort per task first, and ranks k rows."""
    if by is None:
        return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


# ---- dense


def dense(corpus: Corpus, vector: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest rows, exactly. ``dense_sim`` is the negated ranking distance. A zero query under cosine is refused, and so is a row of another dimension."""
    q = vectors.literal(vector)
    if corpus.metric == "cosine" and not any(vector):
        raise ValueError("a zero vector has no cosine distance")
    rows = corpus.rows if where is None else corpus.rows.where(where)
    col = vectors.same_dimension(F.col(corpus.vector), q)
    scored = rows.select(F.lit(0).alias("qid"), F.col(corpus.id).alias("id"), vectors.RANKING[corpus.metric](col, q).alias("dense_dist"))
    return top(scored, [F.col("dense_dist"), F.col("id")], k, "dense_rank").withColumn("dense_sim", -F.col("dense_dist"))


def dense_batch(corpus: Corpus, queries: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """The k nearest rows of many queries, in blocks of products: each task keeps the best k it has seen for each query, and those are ranked."""
    if len(queries) > DENSE_BATCH:
        parts = [dense_batch(corpus, queries[i : i + DENSE_BATCH], k) for i in range(0, len(queries), DENSE_BATCH)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    names, q = np.array([i for i, _ in queries], np.int64), np.array([list(v) for _, v in queries], np.float64)
    metric, dim = corpus.metric, q.shape[1]
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dense_dist", pa.float64())])

    def distances(x: np.ndarray) -> np.ndarray:
        if metric == "ip":
            return -(q @ x.T)
        if metric == "l1":
            return np.stack([np.abs(x - v).sum(axis=1) for v in q])
        if metric == "l2":
            return np.stack([((x - v) ** 2).sum(axis=1) for v in q])
        length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(length > 0, 1 - np.clip(q @ x.T / np.where(length > 0, length, 1), -1, 1), 1.0)

    def search(batches):
        best_d, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for whole in batches:
            for b in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) != dim * b.num_rows:
                    raise ValueError("different vector dimensions")
                ids = b.column(0).to_numpy(zero_copy_only=False)
                d = np.concatenate([best_d, distances(x.reshape(-1, dim))], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_d.shape[1])), pa.array(best_i.reshape(-1)), pa.array(best_d.reshape(-1))], schema=schema)

    found = corpus.rows.selectExpr(f"cast(`{corpus.id}` as long)", f"cast(`{corpus.vector}` as array<double>)").mapInArrow(search, "qid long, id long, dense_dist double")
    return top(found, [F.col("dense_dist"), F.col("id")], k, "dense_rank", by="qid").withColumn("dense_sim", -F.col("dense_dist"))


# ---- lexical


def statistics(corpus: Corpus, terms: Sequence[str]) -> DataFrame:
    """One row: the number of lexical documents ``n``, their mean length ``avgdl``, and the document frequency ``df_i`` of each term."""
    if corpus.index is not None:
        held = corpus.index.lexicon.where(F.col("term").isin(list(terms)))
        found = held.agg(*[F.coalesce(F.max(F.when(F.col("term") == w, F.col("df"))), F.lit(0)).alias(f"df_{i}") for i, w in enumerate(terms)], F.count("*").alias("__known"))
        return found.select(F.lit(corpus.index.docs).alias("n"), F.lit(corpus.index.mean_length).alias("avgdl"), *[f"df_{i}" for i in range(len(terms))])
    t = F.col(corpus.tokens)
    docs = corpus.rows.where(t.isNotNull())
    found = [F.sum(F.array_contains(t, w).cast("long")).alias(f"df_{i}") for i, w in enumerate(terms)]
    return docs.agg(F.count("*").alias("n"), (F.sum(F.size(t)) / F.count("*")).alias("avgdl"), *found)


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / F.greatest(avgdl, F.lit(1.0))))


def lexical(corpus: Corpus, tree, k: int, where: Column | None = None, *, strict_not: bool = False) -> DataFrame:
    """The k best rows that match, by BM25 of the positive terms. Statistics are those of the whole corpus, whatever ``where`` leaves.

    With a stored index, the postings of the query's terms are read and summed by row, and the rows themselves only where ``where`` asks for it. Without one, a row's term counts come
    from its own token list, so that nothing is exploded or shuffled: one pass for the statistics, one for the scores.
    """
    terms = analyzer.positive_terms(tree)
    if corpus.index is not None:
        return _score(corpus, terms, _postings_of(corpus, tree, terms, where, strict_not), k)
    t = F.col(corpus.tokens)
    rows = (corpus.rows if where is None else corpus.rows.where(where)).where(t.isNotNull())
    at = {w: i for i, w in enumerate(terms)}
    if terms:
        rows = rows.where(F.arrays_overlap(t, F.array(*map(F.lit, terms))))
    matched = rows.where(analyzer.condition(tree, lambda w: F.array_contains(t, w), strict_not=strict_not))
    matched = matched.select(F.col(corpus.id).alias("id"), F.size(t).alias("dl"), *[_occurrences(t, w).alias(f"tf_{i}") for w, i in at.items()])
    return _score(corpus, terms, matched, k)


def _postings_of(corpus: Corpus, tree, terms: Sequence[str], where: Column | None, strict_not: bool) -> DataFrame:
    """``id, dl, tf_0, ...`` of the rows that match, from the postings of the terms in question alone."""
    asked = list(terms)
    if strict_not:
        analyzer.condition(tree, lambda w: asked.append(w) or F.lit(True), strict_not=True)
    at = {w: i for i, w in enumerate(dict.fromkeys(asked))}
    counts = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for w, i in at.items()]
    rows = corpus.index.postings.where(F.col("term").isin(list(at))).groupBy("id").agg(F.first("dl").alias("dl"), *counts)
    if terms:
        rows = rows.where(F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf_{at[w]}") for w in terms]) > 0)
    matched = rows.where(analyzer.condition(tree, lambda w: F.col(f"tf_{at[w]}") > 0, strict_not=strict_not))
    if where is not None:
        matched = matched.join(corpus.rows.where(where).select(F.col(corpus.id).alias("id")), "id", "left_semi")
    return matched


def _score(corpus: Corpus, terms: Sequence[str], matched: DataFrame, k: int) -> DataFrame:
    both = matched.join(F.broadcast(statistics(corpus, terms)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf_{i}")
        score = score + F.when(tf > 0, _saturated(_idf(F.col("n"), F.col(f"df_{i}")), tf, F.col("dl"), F.col("avgdl"))).otherwise(0.0)
    scored = both.select(F.lit(0).alias("qid"), "id", score.alias("bm25_score"))
    return top(scored, [F.desc("bm25_score"), F.col("id")], k, "bm25_rank")


def _occurrences(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(word)))


def _blocks(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lexical_batch(corpus: Corpus, queries: Sequence[tuple[int, object]], k: int) -> DataFrame:
    """The k best rows of many queries: postings joined with the queries' terms, one aggregation by query and row, in blocks of ``LEXICAL_BATCH`` queries. Nested boolean queries, which need more than a count of the terms hit, are searched one at a time beside them."""
    nested = [(i, t) for i, t in queries if analyzer.shape(t) == "tree"]
    flat = [(i, t) for i, t in queries if analyzer.shape(t) != "tree"]
    parts = [_flat_batch(corpus, flat[a : a + LEXICAL_BATCH], k) for a in range(0, len(flat), LEXICAL_BATCH)]
    parts += [lexical(corpus, t, k).withColumn("qid", F.lit(i).cast("long")).select("qid", "id", "bm25_score", "bm25_rank") for i, t in nested]
    return _blocks(parts)


def _flat_batch(corpus: Corpus, queries: Sequence[tuple[int, object]], k: int) -> DataFrame:
    spark = corpus.table.sparkSession
    wanted, needed = [], []
    for qid, tree in queries:
        terms = analyzer.positive_terms(tree)
        wanted += [(qid, w) for w in terms]
        needed.append((qid, len(terms) if analyzer.shape(tree) == "all" else 1))
    asked = F.broadcast(spark.createDataFrame(wanted or [], "qid long, term string"))
    least = F.broadcast(spark.createDataFrame(needed, "qid long, needed int"))
    some = F.broadcast(spark.createDataFrame(sorted({(w,) for _, w in wanted}), "term string"))
    if corpus.index is not None:
        postings, df = corpus.index.postings.join(some, "term"), corpus.index.lexicon.join(some, "term").select("term", "df")
        total = spark.createDataFrame([(corpus.index.docs, corpus.index.mean_length)], "n long, avgdl double")
    else:
        postings = corpus.postings().join(some, "term")
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        total = corpus.docstats().agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    scored = postings.join(F.broadcast(df), "term").join(F.broadcast(total)).select("id", "term", _saturated(_idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("s"))
    summed = scored.join(asked, "term").groupBy("qid", "id").agg(F.sum("s").alias("bm25_score"), F.count("*").alias("hits"))
    matched = summed.join(least, "qid").where("hits >= needed").select("qid", "id", "bm25_score")
    return top(matched, [F.desc(F.round("bm25_score", 9)), F.col("id")], k, "bm25_rank", by="qid")  # sums of the same terms in another order are level


def signals(corpus: Corpus, tree) -> dict[str, float]:
    """What the shape of a query is judged by: its number of terms, largest and mean idf, least document frequency, and whether a term looks like an identifier."""
    terms = analyzer.positive_terms(tree)
    row = statistics(corpus, terms).first()
    return _signals(terms, row["n"], [row[f"df_{i}"] or 0 for i in range(len(terms))])


def signals_batch(corpus: Corpus, trees: Sequence[object]) -> list[dict[str, float]]:
    """The signals of many queries, with one look at the lexicon for every ``LEXICAL_BATCH`` of their terms."""
    each = [analyzer.positive_terms(t) for t in trees]
    words = sorted({w for ts in each for w in ts})
    lexicon, known, n = corpus.index.lexicon if corpus.index else corpus.lexicon(), {}, corpus.index.docs if corpus.index else corpus.docstats().count()
    for a in range(0, len(words), LEXICAL_BATCH):
        known |= {r.term: r.df for r in lexicon.where(F.col("term").isin(words[a : a + LEXICAL_BATCH])).select("term", "df").collect()}
    return [_signals(ts, n, [known.get(w, 0) for w in ts]) for ts in each]


def _signals(terms: Sequence[str], n: int, dfs: list[int]) -> dict[str, float]:
    idfs = [float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for d in dfs]
    return {"n": n, "terms": len(terms), "max_idf": max(idfs, default=0.0), "mean_idf": sum(idfs) / max(len(idfs), 1), "min_df": min(dfs, default=0), "identifier": any(map(analyzer.is_identifier, terms))}


# ---- late interaction


def late(corpus: Corpus, query, weights: Sequence[float], k: int, where: Column | None = None, contexts: str | None = None) -> DataFrame:
    """The k best rows by exact MaxSim; ``late_sim`` is that over the sum of the weights, 0 where that is 0."""
    q, total = query.literal(), float(sum(weights))
    rows = corpus.rows if where is None else corpus.rows.where(where)
    mv = F.col(corpus.multivector)
    plain = all(w == 1 for w in weights)
    score = multivector.context_maxsim(q, mv, F.col(contexts)) if contexts else multivector.maxsim(q, mv) if plain else multivector.weighted_maxsim(q, mv, weights)
    scored = rows.select(F.lit(0).alias("qid"), F.col(corpus.id).alias("id"), score.alias("maxsim"))
    ranked = top(scored, [F.desc("maxsim"), F.col("id")], k, "late_rank")
    return ranked.withColumn("late_sim", F.col("maxsim") / total if total else F.lit(0.0))


def late_batch(corpus: Corpus, queries: Sequence[tuple[int, object, Sequence[float]]], k: int) -> DataFrame:
    """The k best rows of many multivector queries (number, multivector, token weights) by exact MaxSim, in blocks of products; each task keeps the best k it has seen for each query."""
    if len(queries) > LATE_BATCH:
        return _blocks([late_batch(corpus, queries[a : a + LATE_BATCH], k) for a in range(0, len(queries), LATE_BATCH)])
    names = np.array([i for i, _, _ in queries], np.int64)
    tokens = np.array([v for _, q, _ in queries for v in q.values], np.float64)
    weight = np.array([x for _, _, w in queries for x in w], np.float64)
    first = np.cumsum([0] + [len(q.values) for _, q, _ in queries[:-1]])
    total = np.add.reduceat(weight, first)
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("maxsim", pa.float64()), ("late_sim", pa.float64())])

    def search(batches):
        best_s, best_i = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                x = b.column(1).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, tokens.shape[1])
                near = np.maximum.reduceat(tokens @ x.T, np.cumsum(sizes) - sizes, axis=1)
                s = np.concatenate([best_s, np.add.reduceat(np.where(weight[:, None] != 0, near * weight[:, None], 0.0), first, axis=0)], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(b.column(0).to_numpy(zero_copy_only=False), (len(names), b.num_rows))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        each = best_s / np.where(total == 0, 1, total)[:, None] * (total != 0)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_s.shape[1])), pa.array(best_i.reshape(-1)), pa.array(best_s.reshape(-1)), pa.array(each.reshape(-1))], schema=schema)

    found = corpus.rows.selectExpr(f"cast(`{corpus.id}` as long)", f"cast(`{corpus.multivector}` as array<array<double>>)").mapInArrow(search, "qid long, id long, maxsim double, late_sim double")
    return top(found, [F.desc("maxsim"), F.col("id")], k, "late_rank", by="qid")


def late_by_proxy(corpus: Corpus, query, k: int, admitted: int, encode=None) -> DataFrame:
    """Two stages: the ``admitted`` rows whose encoded vector (by default the normalised mean) has the largest inner product with the query's, then exact MaxSim of those."""
    encode = encode or multivector.normalised_mean
    mv, q = F.col(corpus.multivector), query.literal()
    proxy = vectors.inner_product(encode(mv, query.dim), encode(q, query.dim))
    first = corpus.rows.select(F.col(corpus.id).alias("id"), mv.alias("mv"), proxy.alias("proxy")).orderBy(F.desc("proxy"), "id").limit(admitted)
    scored = first.select(F.lit(0).alias("qid"), "id", multivector.maxsim(q, F.col("mv")).alias("maxsim"))
    return top(scored, [F.desc("maxsim"), F.col("id")], k, "late_rank").withColumn("late_sim", F.col("maxsim") / len(query))


def token_hits(corpus: Corpus, query, k: int) -> DataFrame:
    """``q_ord, id, sim, token_rank``: for each query token the k rows with the best token for it."""
    mv = F.col(corpus.multivector)
    best = F.array(*[multivector.best(F.array(*map(F.lit, v)), mv) for v in query.values])
    exploded = corpus.rows.select(F.col(corpus.id).alias("id"), F.posexplode(best).alias("q_ord", "sim"))
    return top(exploded, [F.desc("sim"), F.col("id")], k, "token_rank", by="q_ord").select("q_ord", "id", "sim", "token_rank")


def reservoirs(corpus: Corpus, query, k: int, each: int) -> DataFrame:
    """``id`` of the union of four candidate lists of ``each`` rows, from the tokens' k hits: by summed score, by best single token, by number of tokens hit, by mean."""
    hits = token_hits(corpus, query, k).groupBy("id").agg(F.sum("sim").alias("total"), F.max("sim").alias("peak"), F.count("*").alias("cover"), F.avg("sim").alias("mean"))
    out = None
    for c in ("total", "peak", "cover", "mean"):
        part = hits.orderBy(F.desc(c), "id").limit(each).select("id")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates()
