import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import analyzer
from quillrank.functions.multivector import Multivector
from quillrank.operators import branches, fusion
from quillrank.operators.corpus import Corpus
from quillrank.operators.search import search, search_batch
from quillrank.plans.query import HybridQuery

DOCS = [(1, [1.0, 0.0, 0.0], "fast postgres search"), (2, [0.9, 0.1, 0.0], "fast vector search"), (3, [0.0, 1.0, 0.0], "lexical postgres index"), (4, [0.0, 0.0, 1.0], "unrelated document")]


def corpus(spark, rows=DOCS, **more):
    df = spark.createDataFrame([(i, v and [float(x) for x in v], None if t is None else t.split()) for i, v, t in rows], "id long, v array<double>, tokens array<string>")
    return Corpus(df, vector="v", tokens="tokens", **more)


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_dense_and_hybrid_order(spark):
    c = corpus(spark)
    assert ids(search(c, HybridQuery.dense([1, 0, 0], 3, 4), 3)) == [1, 2, 3]
    got = search(c, HybridQuery.hybrid([1, 0, 0], "postgres", 2, 4, 4), 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]
    assert [round(r.fused, 6) for r in got] == [0.032787, 0.032002]
    assert [round(r.bm25_score, 6) for r in got] == [0.668293, 0.668293]
    every = {r.id: round(r.fused, 6) for r in search(c, HybridQuery([1, 0, 0], "postgres", fusion="fast_weighted"), 4).collect()}
    assert every == {1: 0.450293, 3: 0.334763, 2: 0.249235, 4: 0.134471}


def test_life_of_a_corpus(spark):
    c = corpus(spark)
    new = spark.createDataFrame([(5, [0.99, 0.01, 0.0], ["postgres", "extension"])], c.table.schema)
    c = c.insert(new).delete(spark.createDataFrame([(1,)], "id long"))
    assert ids(search(c, HybridQuery.dense([1, 0, 0], 2, 4), 2)) == [5, 2]
    s = c.stats().first()
    assert (s.total_count, s.live_count, s.dead_count) == (5, 4, 1)
    assert {r.check: r.note for r in c.validate(True).collect()}["recommendation"] == "reindex"
    compacted = c.compact()
    assert compacted.stats().first().dead_count == 0
    assert {r.check: (r.failures, r.note) for r in compacted.validate(True).collect()}["recommendation"] == (0, "healthy")
    back = compacted.insert(spark.createDataFrame([(1, [1.0, 0.0, 0.0], ["back"])], c.table.schema))
    assert ids(search(back, HybridQuery.dense([1, 0, 0], 2, 4), 2)) == [1, 5]
    moved = back.update(spark.createDataFrame([(5, [0.0, 0.0, 1.0], ["moved"])], c.table.schema))
    assert ids(search(moved, HybridQuery.dense([0, 0, 1], None, 4), 2)) == [4, 5]
    assert moved.memory().first().vector_bytes == 5 * 12
    assert c.prewarm().stats().first().live_count == 4


def test_l2_sequence(spark):
    make = lambda rows: corpus(spark, rows, metric="l2")
    c = make([(1, [0.0, 0, 0], "zero"), (2, [1.0, 0, 0], "one"), (3, [2.0, 0, 0], "two")])
    q = HybridQuery([0, 0, 0], "two", dense_k=16, bm25_k=0)
    order = [ids(search(c, q, 3))]
    c = c.insert(make([(5, [0.5, 0, 0], "half")]).table)
    order.append(ids(search(c, q, 3)))
    c = c.delete(spark.createDataFrame([(1,)], "id long"))
    order.append(ids(search(c, q, 3)))
    c = c.compact().insert(make([(6, [0.25, 0, 0], "quarter")]).table)
    order.append(ids(search(c, q, 3)))
    assert order == [[1, 2, 3], [1, 5, 2], [5, 2, 3], [6, 5, 2]]


def test_churn_equals_exact_scan(spark):
    live = {g: [float(g), float(g % 11), 0.0] for g in range(1, 101)}
    c = corpus(spark, [(i, v, "x") for i, v in live.items()], metric="l2")
    for cycle in range(3):
        gone = [3 * cycle + 1, 3 * cycle + 2]
        fresh = {100 + 10 * cycle + j: [float(100 + 10 * cycle + j), float(j), 0.0] for j in range(1, 6)}
        c = c.delete(spark.createDataFrame([(i,) for i in gone], "id long")).insert(corpus(spark, [(i, v, "x") for i, v in fresh.items()], metric="l2").table)
        live = {i: v for i, v in (live | fresh).items() if i not in gone}
        best = min(live, key=lambda i: (sum((a - b) ** 2 for a, b in zip(live[i], [50, 6, 0])), i))
        assert ids(search(c, HybridQuery.dense([50, 6, 0]), 1)) == [best]


def test_null_empty_and_zero_rows(spark):
    rows = [*DOCS, (5, None, "postgres"), (6, [0.0, 0.0, 0.0], "postgres"), (7, [1.0, 1.0, 0.0], None), (8, [0.0, 1.0, 1.0], "")]
    df = spark.createDataFrame([(i, v and [float(x) for x in v], None if t is None else t.split()) for i, v, t in rows], "id long, v array<double>, tokens array<string>")
    c = Corpus(df, vector="v", tokens="tokens")
    stats = branches.statistics(c, ["postgres"]).first()
    assert (stats.n, stats.avgdl, stats.df_0) == (5, 11 / 5, 2)
    assert {r.id for r in branches.lexical(c, analyzer.parse("postgres"), 10).collect()} == {1, 3}
    assert ids(search(c, HybridQuery([1, 0, 0], "!postgres", bm25_k=5, dense_k=2), 5)) == [1, 2]
    assert search(c, HybridQuery(text="nothing"), 5).count() == 0
    empty = Corpus(df.limit(0), vector="v", tokens="tokens")
    assert search(empty, HybridQuery([1, 0, 0], "postgres"), 5).count() == 0
    with pytest.raises(ValueError):
        search(c, HybridQuery.dense([0, 0, 0]), 3)
    with pytest.raises(Exception, match="dimension"):
        search(c, HybridQuery.dense([1, 0]), 3).collect()


def test_boolean_shapes(spark):
    c = corpus(spark, [(1, [1.0], "a"), (2, [1.0], "b"), (3, [1.0], "c"), (4, [1.0], "a b"), (5, [1.0], "b c")])
    cases = {"a": {1, 4}, "a & b": {4}, "a | c": {1, 3, 4, 5}, "(a <-> b) | c": {1, 2, 3, 4, 5}, "a <-> b": {4}, "b | !a": {2, 4, 5}, "c & (b | !a)": {3, 5}, "c & (b | a)": {5}, "!a": set()}
    assert {q: {r.id for r in branches.lexical(c, analyzer.parse(q), 10).collect()} for q in cases} == cases
    assert {r.id for r in branches.lexical(c, analyzer.parse("b & !a"), 10, strict_not=True).collect()} == {2, 5}


def test_bm25_by_hand(spark):
    c = corpus(spark, [(1, [1.0], "x x y"), (2, [1.0], "x"), (3, [1.0], "z z z z z")])
    got = {r.id: r.bm25_score for r in branches.lexical(c, analyzer.parse("x | z"), 10).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    term = lambda i, tf, dl: i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 3))
    assert got == pytest.approx({1: term(idf(2), 2, 3), 2: term(idf(2), 1, 1), 3: term(idf(1), 5, 5)})


def lists(spark, dense, bm25):
    d = spark.createDataFrame([(0, i, -s, s, r) for i, s, r in dense], "qid int, id long, dense_dist double, dense_sim double, dense_rank int")
    b = spark.createDataFrame([(0, i, s, r) for i, s, r in bm25], "qid int, id long, bm25_score double, bm25_rank int")
    return fusion.merge([d, b])


@pytest.mark.parametrize("name", ["rrf", "weighted", "fast_weighted", "calibrated", "dbsf"])
def test_fusion_with_a_branch_empty_single_and_level(spark, name):
    one = lists(spark, [(1, -0.2, 1)], [])
    expected = {"rrf": 1 / 61, "weighted": 0.0, "fast_weighted": 0.5 / (1 + math.exp(0.2)), "calibrated": 0.5 / (1 + math.exp(0.2)), "dbsf": 0.5}
    assert fusion.fused_score(one, name).first().fused == pytest.approx(expected[name])
    level = lists(spark, [(1, -0.2, 1), (2, -0.2, 2)], [(1, 3.0, 1), (2, 3.0, 2)])
    got = {r.id: r.fused for r in fusion.fused_score(level, name).collect()}
    if name == "rrf":
        assert got[1] > got[2]
    else:
        assert got[1] == got[2] == pytest.approx({"weighted": 0.5, "fast_weighted": 0.5 / (1 + math.exp(0.2)) + 0.375, "calibrated": 0.5 / (1 + math.exp(0.2)) + 0.435, "dbsf": 1.0}[name])


def test_dbsf_with_ten_candidates(spark):
    values = [float(i) for i in range(10)]
    got = {r.id: r.fused for r in fusion.fused_score(lists(spark, [], [(i, v, 10 - i) for i, v in enumerate(values)]), "dbsf").collect()}
    m, s = np.mean(values), np.std(values, ddof=1)
    assert got == pytest.approx({i: (v - (m - 3 * s)) / (6 * s) for i, v in enumerate(values)})


def test_budgets_and_validation():
    q = HybridQuery([1.0], "a")
    assert q.budgets(3) == (32, 32, 0) and q.budgets(20) == (100, 100, 0) and q.budgets() == (100, 100, 0)
    assert HybridQuery([1.0], "a", dense_k=7).budgets(3) == (7, 32, 0)
    assert HybridQuery(multivector=[[1.0]], multivector_k=500).budgets() == (0, 0, 100)
    assert (q.size(), q.size(50), HybridQuery([1.0], final_k=4).size()) == (10, 50, 4)
    assert "fusion=rrf" in str(q)
    for bad in ({}, {"vector": [1.0], "fusion": "x"}, {"vector": [1.0], "dense_weight": -1}, {"vector": [1.0], "alpha": 2}, {"vector": [1.0], "rrf_k": 0}, {"vector": [1.0], "dense_k": -1}, {"vector": [1.0], "final_k": 0}, {"vector": [1.0], "token_weights": [1]}, {"multivector": [[1.0]], "token_weights": [1, 2]}, {"multivector": [[1.0]], "token_weights": [math.nan]}):
        with pytest.raises(ValueError):
            HybridQuery(**bad)


def test_late_interaction_order_and_weights(spark):
    df = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[0.8, 0.2], [0.2, 0.8]]), (3, [[-1.0, 0.0], [0.0, -1.0]]), (4, None)], "id long, mv array<array<double>>")
    c = Corpus(df, multivector="mv")
    q = Multivector.of([[1, 0], [0, 1]])
    assert ids(search(c, HybridQuery.late(q, 3))) == [1, 2, 3]
    assert branches.late(c, q, [0.0, 0.0], 3).first().late_sim == 0
    assert [r.id for r in branches.late_by_proxy(c, q, 2, 2).orderBy("late_rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        search(c, HybridQuery.dense([1, 0]))


def test_batch_equals_single(spark):
    c = corpus(spark)
    queries = [(7, HybridQuery([1, 0, 0], "postgres | search", dense_k=3, bm25_k=3)), (8, HybridQuery([0, 1, 0], "document", dense_k=3, bm25_k=3)), (9, HybridQuery([0, 0, 1], "fast & vector", dense_k=3, bm25_k=3))]
    got = search_batch(c, queries, 4).collect()
    for qid, q in queries:
        assert [r.id for r in sorted((r for r in got if r.qid == qid), key=lambda r: r.rank)] == ids(search(c, q, 4))


def test_batch_equals_single_whatever_the_options(spark):
    c = corpus(spark).with_index()
    v = [[1, 0, 0], [0, 1, 0], [0.5, 0.5, 0]]
    queries = [
        (1, HybridQuery(v[0], "postgres | search", dense_k=3, bm25_k=3)),
        (2, HybridQuery(v[1], "document", fusion="calibrated", dense_k=3, bm25_k=3)),
        (3, HybridQuery(v[1], "postgres | document", fusion="calibrated", alpha=0.9)),
        (4, HybridQuery(v[2], "fast & (vector | search)", fusion="weighted", alpha=0.3, require_bm25_match=True)),
        (5, HybridQuery(v[2], fusion="calibrated", final_k=2)),
        (6, HybridQuery(None, "postgres", fusion="calibrated")),
        (7, HybridQuery(v[0], "fast", fusion="dbsf", bm25_weight=2.0)),
        (8, HybridQuery(v[0], "fast", fusion="fast_weighted", dense_k=0)),
        (9, HybridQuery(v[0], "nowhere", rrf_k=5)),
    ]
    shown = lambda r: (r.id, r["rank"], round(r.fused, 9), r.dense_rank, r.bm25_rank)
    got = search_batch(c, queries).collect()
    for qid, q in queries:
        assert sorted(shown(r) for r in got if r.qid == qid) == sorted(shown(r) for r in search(c, q).collect()), qid
    assert search_batch(c, [(1, HybridQuery(v[0], dense_k=0))]).count() == 0


def test_late_batch_equals_single(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=(1 + i % 4, 3)).tolist()) for i in range(40)], "id long, mv array<array<double>>")
    c = Corpus(df, multivector="mv")
    queries = [(i, HybridQuery(multivector=Multivector.of(rng.normal(size=(2, 3)).tolist()), token_weights=w, multivector_k=6)) for i, w in ((1, None), (2, (2.0, 0.5)), (3, (0.0, 0.0)))]
    got = search_batch(c, queries, 5).collect()
    for qid, q in queries:
        one = search(c, q, 5).collect()
        assert sorted((r.id, r.rank, round(r.maxsim, 9)) for r in got if r.qid == qid) == sorted((r.id, r.rank, round(r.maxsim, 9)) for r in one)


def test_stored_index_gives_the_rows_of_the_scan_and_reads_no_tokens(spark):
    plain = corpus(spark, DOCS + [(5, [0.1, 0.2, 0.3], ""), (6, [0.3, 0.2, 0.3], None), (7, None, "postgres")])
    c = plain.with_index()
    for text in ("postgres", "postgres | fast", "fast & search", "fast & !vector", "fast & (vector | !search)", "nowhere", "!fast"):
        for strict in (False, True):
            tree = analyzer.parse(text)
            both = [sorted((r.id, r.bm25_rank, round(r.bm25_score, 12)) for r in branches.lexical(x, tree, 5, F.col("id") < 4, strict_not=strict).collect()) for x in (plain, c)]
            assert both[0] == both[1], text
    plan = branches.lexical(c, analyzer.parse("postgres | fast"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan and "PushedFilters: [In(term" in plan
    assert c.delete(spark.createDataFrame([(1,)], "id long")).index is None and c.insert(plain.table).index is None


def test_rescore_and_diversity(spark):
    c = corpus(spark)
    got = {r.id: (r.dense_rank, r.bm25_rank) for r in search(c, HybridQuery([1, 0, 0], "postgres", dense_k=2), 4, rescore=True).collect()}
    assert got[3][0] == 3
    pool = spark.createDataFrame([(0, 1, "a", 1.0), (0, 2, "a", 0.9), (0, 3, "b", 0.7)], "qid int, id long, g string, fused double")
    assert [r.id for r in fusion.diversify(pool, "g", 3, 0.5).orderBy("rank").collect()] == [1, 3, 2]


def test_plans_stay_narrow(spark):
    c = corpus(spark)
    plan = branches.dense(c, [1, 0, 0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "hashpartitioning" not in plan
    plan = branches.lexical(c, analyzer.parse("postgres | fast"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning" not in plan


def test_postings_written_by_term(spark, tmp_path):
    c = corpus(spark)
    c.write_postings(str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).where(F.col("term") == "fast").count() == 2
    assert {r.term: r.df for r in c.lexicon().collect()}["postgres"] == 2
