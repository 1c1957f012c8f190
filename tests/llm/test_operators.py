import collections
import datetime
import itertools
import math
import random
import time
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import bktree, clustering, components, distinctiveness, leakage, near_duplicates, neighbours, packing, queries, ranking, splitting, subjects, term_frequency
from quillrank.llm.arrow import lists_of

RNG = np.random.default_rng(4)


def unit(n, dim, rng=RNG):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- 1: term frequencies


def terms_df(spark, lists):
    return spark.createDataFrame([(i, x, "other") for i, x in enumerate(lists)], "id long, body array<string>, term string")


def test_frequencies_against_brute_force(spark):
    rng = random.Random(1)
    lists = [None, [], [None, " ", ""], [" The", "the ", "THE"]] + [[rng.choice(["the", "a", "b", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(8))] for _ in range(200)]
    clean = [None if x is None else [t.strip().lower() for t in x if t and t.strip()] for x in lists]
    occurrences, records = collections.Counter(t for x in clean for t in x or []), collections.Counter(t for x in clean for t in set(x or []))
    n = sum(x is not None for x in clean)
    for heavy in ([], ["the", "a", "never"], None):
        got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequency.term_frequencies(terms_df(spark, lists), "body", heavy=heavy).collect()}
        assert got == {t: (occurrences[t], c, "rare" if c < 3 else "common" if c > 0.2 * n else None) for t, c in records.items()}


def test_frequencies_of_nothing(spark):
    assert term_frequency.term_frequencies(terms_df(spark, [["x"]]).limit(0), "body").count() == 0
    assert term_frequency.term_frequencies(terms_df(spark, [None, []]), "body").count() == 0


# ---- 2: ranking


@pytest.mark.parametrize("many", [4096, 3])
def test_ranking_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(ranking, "HOT_PASSAGES", many)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 512 if many > 3 else 2)
    rng = np.random.default_rng(8)
    n, dim = 300, 8
    vecs = unit(n, dim, rng).astype(np.float32)
    docs = [(i, None if i % 17 == 0 else [0.0] * dim if i % 23 == 0 else vecs[i].tolist(), None if i % 13 == 0 else [rng.choice(["x", "y", " Z ", "w"]) for _ in range(i % 5)]) for i in range(n)]
    docs[50] = (50, docs[51][1], docs[51][2])
    passages = [(int(rng.integers(0, n)), unit(3, 4, rng).tolist()) for _ in range(200)] + [(None, [[1.0] * 4]), (7, None), (8, [])] + [(5, unit(2, 4, rng).tolist()) for _ in range(30)]
    asked = [(1, unit(1, dim, rng)[0].tolist(), ["x", "z"], unit(2, 4, rng).tolist()), (2, unit(1, dim, rng)[0].tolist(), [], None), (3, None, None, None)]
    d = spark.createDataFrame(docs, "id long, vec array<float>, terms array<string>")
    p = spark.createDataFrame(passages, "document_id long, late array<array<float>>")
    q = spark.createDataFrame(asked, "query_id long, vec array<float>, terms array<string>, late array<array<float>>")
    got = collections.defaultdict(list)
    for r in ranking.rank_documents(d, p, q, dense_dim=dim, late_dim=4, weights=(1.0, 2.0, 1.0)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    clean = [None if t is None else [w.strip().lower() for w in t] for _, _, t in docs]
    held = [t for t in clean if t is not None]
    mean = sum(map(len, held)) / len(held)
    for qid, qv, qt, qm in asked:
        s = np.full((3, n), -np.inf)
        for i, v, _ in docs:
            if qv and v and any(v):
                a, b = np.float32(qv).astype(float), np.float32(v).astype(float)
                s[0, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            score = 0.0
            for t in set(qt or []):
                df, tf = sum(t in x for x in held), (clean[i] or []).count(t)
                score += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(len(clean[i] or []), 1) / mean)) if tf else 0
            s[1, i] = score or -np.inf
        for i, mv in passages:
            if i is not None and mv and qm:
                s[2, i] = max(s[2, i], (np.float32(qm).astype(float) @ np.float32(mv).astype(float).T).max(axis=1).sum())
        z = np.zeros(n)
        for w, x in zip((1, 2, 1), s):
            below, level = (x[None] < x[:, None]).sum(axis=1), (x[None] == x[:, None]).sum(axis=1)
            z += w * np.array([NormalDist().inv_cdf(v) for v in (below + level / 2) / n])
        z /= 4
        order = np.lexsort((np.arange(n), -np.round(z, 9)))[:5]
        assert [i for i, _ in got[qid]] == order.tolist()
        assert [v for _, v in got[qid]] == pytest.approx(z[order].tolist(), abs=1e-6)


def ranked_by_hand(docs, passages, asked, k=5):
    """``{query_id: [(id, score), ...]}``; documents have ids from 0, scores are level if they agree to 12 digits."""
    n, held = len(docs), [t for _, _, t in docs if t is not None]
    mean, df = sum(map(len, held)) / len(held), collections.Counter(w for t in held for w in set(t))
    out = {}
    for qid, qv, qt, qm in asked:
        s = np.full((3, n), -np.inf)
        for i, v, t in docs:
            if qv and v and any(v):
                a, b = np.float32(qv).astype(float), np.float32(v).astype(float)
                s[0, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            for w in {*qt} & {*(t or [])}:
                tf, idf = t.count(w), math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5))
                s[1, i] = max(s[1, i], 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        for i, mv in passages:
            if i is not None and mv and qm:
                s[2, i] = max(s[2, i], (np.float32(qm).astype(float) @ np.float32(mv).astype(float).T).max(axis=1).sum())
        z = np.zeros(n)
        for x in np.round(s, 12):
            o = np.sort(x)
            z += ranking.normal_quantile((np.searchsorted(o, x, "left") + np.searchsorted(o, x, "right")) / 2 / n) / 3
        out[qid] = [(int(i), z[i]) for i in np.lexsort((np.arange(n), -np.round(z, 9)))[:k]]
    return out


def test_ranking_by_tails(spark, monkeypatch):
    """Queries whose first documents stand high on every score are ranked in one reading, without the histograms of all pairs; the others by these."""
    rng, words, n, dim, many = np.random.default_rng(12), random.Random(12), 6000, 8, 40
    asked = [(i, unit(1, dim, rng)[0].tolist(), [f"a{i}", f"b{i}", "x"], unit(4 if i % 2 else 3, 4, rng).tolist()) for i in range(many)]
    asked += [(90, unit(1, dim, rng)[0].tolist(), ["x", "y"], unit(2, 4, rng).tolist()), (91, unit(1, dim, rng)[0].tolist(), ["never"], None), (92, None, ["a0", "y"], unit(1, 4, rng).tolist()), (93, None, [], None)]
    docs = [(i, None if i % 17 == 0 else [0.0] * dim if i % 23 == 0 else v.tolist(), None if i % 13 == 0 else [words.choice("xyzuvw") for _ in range(i % 7)]) for i, v in enumerate(unit(n, dim, rng))]
    passages = [(int(rng.integers(0, n)), (unit(int(rng.integers(1, 5)), 4, rng) * 0.8).tolist()) for _ in range(2000)] + [(None, [[9.0] * 4]), (7, None), (8, []), (9, (unit(150, 4, rng) * 0.5).tolist())]
    for i, v, _, mv in asked[:many]:
        for j in range(5):  # the two words are level whichever of them comes twice
            at = 1000 + 5 * i + j
            docs[at] = (at, (np.array(v) * (2 if j == 4 else 1) + rng.normal(size=dim) * 0.02).tolist(), [f"a{i}", f"b{i}", "x", [f"a{i}", f"b{i}"][j % 2]])
            passages.append((at, (np.array(mv) + rng.normal(size=(len(mv), 4)) * 0.02).tolist()))
    docs[3000] = (3000, (np.float32(docs[1000][1]) * 2).tolist(), docs[1000][2])
    kinds = "id long, vec array<float>, terms array<string>", "document_id long, late array<array<float>>", "query_id long, vec array<float>, terms array<string>, late array<array<float>>"
    d, p, q = (spark.createDataFrame(rows, kind) for rows, kind in zip((docs, passages, asked), kinds))
    slow, whole = [], ranking._rank
    monkeypatch.setattr(ranking, "_rank", lambda docs, hot, q, *rest: slow.extend(q.ids.tolist()) or whole(docs, hot, q, *rest))
    want = ranked_by_hand(docs, passages, asked)
    for most in (ranking.MOST_TAIL, 3):
        monkeypatch.setattr(ranking, "MOST_TAIL", most)
        slow.clear()
        got = collections.defaultdict(list)
        for r in ranking.rank_documents(d, p, q, dense_dim=dim, late_dim=4).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r.score))
        for i, rows in want.items():
            assert [x for x, _ in got[i]] == [x for x, _ in rows]
            assert [x for _, x in got[i]] == pytest.approx([x for _, x in rows], abs=1e-9)
        assert not most > 3 or {*slow} <= {90, 91, 92, 93}


def test_ranking_of_nothing(spark):
    d = spark.createDataFrame([], "id long, vec array<float>, terms array<string>")
    p = spark.createDataFrame([], "document_id long, late array<array<float>>")
    q = spark.createDataFrame([(1, [1.0], ["a"], [[1.0]])], "query_id long, vec array<float>, terms array<string>, late array<array<float>>")
    assert ranking.rank_documents(d, p, q, dense_dim=1, late_dim=1).count() == 0
    one = spark.createDataFrame([(3, None, None)], d.schema)
    assert [r.id for r in ranking.rank_documents(one, p, q, dense_dim=1, late_dim=1).collect()] == [3]
    assert ranking.rank_documents(one, p, q.limit(0), dense_dim=1, late_dim=1).count() == 0


# ---- 3: near-duplicates


def test_bk_forest_against_brute_force():
    rng = np.random.default_rng(3)
    codes, shards = rng.integers(0, 2**12, (300, 2)).astype(np.uint64), rng.integers(0, 4, 300)
    codes[100:150] = codes[:50]
    forest, radius = bktree.Forest(codes, shards), rng.integers(0, 9, 300)
    got = {(int(q), int(n)) for qs, ns in forest.search(codes, shards, radius, most=64) for q, n in zip(qs, ns)}
    d = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(axis=2)
    assert got == {(i, j) for i in range(300) for j in range(300) if shards[i] == shards[j] and d[i, j] <= radius[i]}
    assert not list(bktree.Forest(codes[:0], shards[:0]).search(codes, shards, radius))


@pytest.mark.parametrize("leaf", [4096, 300, 7])
def test_close_pairs_against_brute_force(leaf):
    rng = np.random.default_rng(17)
    codes = rng.integers(0, 2**40, (700, 2)).astype(np.uint64)
    codes[300:600] = codes[rng.integers(0, 300, 300)] ^ (np.uint64(1) << rng.integers(0, 40, (300, 2)).astype(np.uint64))
    codes[600:] = codes[5]
    reach = np.sort(rng.uniform(0.2, 12, 700)).astype(np.float32)
    got = [frozenset((int(i), int(j))) for x, y in bktree.close_pairs(codes, reach, np.arange(700), leaf=leaf) for i, j in zip(x, y)]
    d = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2, dtype=np.int64)
    good = (d <= reach[:, None] + reach[None] + 1e-4) & (np.minimum(reach[:, None], reach[None]) >= 0.75 * np.maximum(reach[:, None], reach[None]) - 1e-4)
    assert len(got) == len(set(got)) and set(got) == {frozenset((i, j)) for i, j in itertools.combinations(range(700), 2) if good[i, j]}


def test_a_shard_of_unrelated_codes_costs_far_less_than_a_tree_of_single_rows():
    codes = np.random.default_rng(18).integers(0, 2**63, (2500, 2)).astype(np.uint64)
    reach = np.full(len(codes), 10, np.float32)
    began = time.process_time()
    for _ in bktree.Forest(codes, np.zeros(len(codes), np.int64)).search(codes, np.zeros(len(codes), np.int64), np.full(len(codes), 20)):
        pass
    tree = time.process_time() - began
    began = time.process_time()
    assert not list(bktree.close_pairs(codes, reach, np.arange(len(codes))))
    assert time.process_time() - began < tree / 3


def edited_texts(rng, n=150):
    pool = [f"word{i}" for i in range(400)] + ["the", "a", "of"] * 30
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(4, 60))) for _ in range(n)]
    for _ in range(n):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(pool)
        rng.shuffle(words)
        texts.append(" ".join(words).upper() if rng.random() < 0.3 else "  ".join(words))
    return texts


@pytest.mark.parametrize("blocks", [20_000, 3])
def test_near_texts_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(near_duplicates, "COMMON_ROWS", 20)
    texts = [None, "", " \n", "!!!", "one", "ONE one", *edited_texts(random.Random(5))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, body string, words string")
    found = near_duplicates.near_texts(df, "id", "body")
    sets = {i: set(leakage.WORD.findall(t.lower())) for i, t in enumerate(texts) if t}
    sets = {i: s for i, s in sets.items() if s}
    expected = {(i, j) for i, j in itertools.combinations(sets, 2) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    pairs = [tuple(r) for r in found.pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    groups = found.groups().collect()
    assert {r.id for r in groups} == set(sets) and len(groups) == len(sets)
    by_id = {r.id: r for r in groups}
    assert by_id[4].copies == 2 and by_id[5].class_id == 4
    for i, j in expected:
        assert by_id[i].group_id == by_id[j].group_id


def test_near_vectors_against_brute_force(spark):
    x = unit(200, 16)
    y = np.concatenate([x, x[:60] + RNG.normal(size=(60, 16)) * 0.03, x[:5], x[:3] * 7])
    rows = [(i, v.tolist()) for i, v in enumerate(y)] + [(900, None), (901, [0.0] * 16), (902, [1.0]), (903, [float("nan")] * 16)]
    found = near_duplicates.near_vectors(spark.createDataFrame(rows, "id long, e array<float>"), "id", "e", 16)
    z = y.astype(np.float32).astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    s = z @ z.T
    assert {tuple(r) for r in found.pairs().collect()} == {(i, j) for i, j in itertools.combinations(range(len(y)), 2) if s[i, j] >= 0.98}


def test_near_vectors_of_a_dense_cluster_in_split_shards(spark, monkeypatch):
    """A cluster fills whole shards; they are split, and no pair is lost."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 64)
    monkeypatch.setattr(near_duplicates, "SEEN_ROWS", 64)
    rng = np.random.default_rng(21)
    x = np.concatenate([unit(1, 32, rng) + rng.normal(size=(400, 32)) * 0.04, unit(100, 32, rng)]).astype(np.float32)
    split = []
    whole = near_duplicates.large_shards
    monkeypatch.setattr(near_duplicates, "large_shards", lambda *a: split.append(whole(*a)) or split[-1])
    got = {(r.a, r.b) for r in near_duplicates.vector_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>"), 32).collect()}
    y = x.astype(float)
    s = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    expected = {(i, j) for i, j in zip(*np.nonzero(s >= 0.98)) if i < j}
    assert len(split[0][0]) and split[0][1].max() > 1
    assert got <= expected and len(got) >= 0.998 * len(expected) > 50


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, body string, e array<float>")
    assert near_duplicates.near_texts(empty, "id", "body").pairs().count() == 0
    assert near_duplicates.near_texts(empty, "id", "body").groups().count() == 0
    assert near_duplicates.near_vectors(empty, "id", "e", 4).pairs().count() == 0


def test_components_of_a_long_path_come_to_rest_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components.connected_components(path, "a", "b").collect()} == {0}
    with pytest.raises(RuntimeError):
        components.connected_components(path, "a", "b", most=2)


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {v: root(v) for v in parent}
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# ---- 4: splitting


def joined(pieces, overlap):
    return "".join(p if i == 0 else p[overlap:] for i, p in enumerate(pieces))


@given(st.text(alphabet="ab. \n!é", max_size=400), st.integers(5, 60), st.data())
@settings(max_examples=150, deadline=None)
def test_text_pieces_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    body = text.strip(" \r\n")
    if len(body) <= limit:
        return
    owner, number, start, end = splitting._pieces([splitting._text_item(body)] * 2, limit, overlap)
    for o in (0, 1):
        spans = [(s, e) for w, s, e in zip(owner.tolist(), start.tolist(), end.tolist()) if w == o]
        pieces = [body[s:e] for s, e in spans]
        assert all(0 < len(p) <= limit for p in pieces) and len(pieces) > 1
        assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(spans, spans[1:]))
        assert joined(pieces, overlap) == body


def greedy(body, limit, overlap):
    n, strong, weak = splitting._text_item(body)
    strong, weak = {*strong.tolist(), n}, set(weak.tolist())
    cuts, p = [], overlap
    while not cuts or cuts[-1] < n:
        window = range(min(p + limit - overlap, n), p, -1)
        p = next((x for x in window if x in strong), None) or next((x for x in window if x in weak), None) or min(p + limit - overlap, n)
        cuts.append(p)
    return cuts


def test_pointer_doubling_gives_the_greedy_cuts():
    rng = random.Random(2)
    for _ in range(60):
        body = "".join(rng.choice(["word ", "a. ", "longerword ", "\n", "x! "]) for _ in range(rng.randrange(30, 200))).strip(" \r\n")
        if len(body) > 40:
            assert splitting._pieces([splitting._text_item(body)], 40, 7)[3].tolist() == greedy(body, 40, 7)


def test_split_texts_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x" * 1000), (5, " " * 50 + "y" * 1000 + "\n" * 9), (6, "z" * 1001), (7, "One sentence. " * 200), (7, "One sentence. " * 200), (8, "é" * 50_000)]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "id int, body string, piece int, content string")
    got = splitting.split_texts(df, "id", "body").collect()
    counts = collections.Counter(r.id for r in got)
    assert [counts[i] for i in range(1, 7)] == [1, 1, 1, 1, 1, 2] and counts[7] == 2 * next(r.n_pieces for r in got if r.id == 7)
    assert all(len(r.content) == r.end - r.start <= 1000 for r in got)
    long = sorted((r for r in got if r.id == 8), key=lambda r: r.piece)
    assert joined([r.content for r in long], 100) == "é" * 50_000
    inner = [r for r in got if r.id == 7 and r.piece < r.n_pieces - 1]
    assert all(r.content.rstrip().endswith(".") for r in inner)
    assert splitting.split_texts(df.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, "id", "body", limit=5, overlap=5)


def test_split_sequences(spark):
    ids = [101, *([7] * 60 + [1012]) * 5, 102, 103, 5, 102] + [103] * 40
    rows = [(1, ids), (2, None), (3, []), (4, [103] * 300), (5, [9] * 128 + [103] * 9), (6, [9] * 129), (7, [None] * 130)]
    got = splitting.split_sequences(spark.createDataFrame(rows, "plan_id int, t array<int>"), "plan_id", "t").collect()
    counts = collections.Counter(r.id for r in got)
    assert [counts[i] for i in (2, 3, 4, 5, 6, 7)] == [1, 1, 1, 1, 2, 2]
    pieces = sorted((r for r in got if r.id == 1), key=lambda r: r.piece)
    back = [x for i, r in enumerate(pieces) for x in (r.content if i == 0 else r.content[16:])]
    assert back == ids[:-40] and all(len(r.content) <= 128 for r in pieces) and pieces[0].content[-1] == 1012


# ---- 5: distinctiveness


def test_two_poisson_tells_the_elite():
    owner, tf, records = np.array([0, 0, 1, 1]), np.array([1.0, 9.0, 1.0, 2.0]), np.array([40.0, 5.0, 90.0, 5.0])
    share, elite, rest = distinctiveness.two_poisson(owner, tf, records, np.array([100.0, 100.0]))
    assert elite[0] > 5 > 1 > rest[0] and share[0] == pytest.approx(0.05, abs=0.02)
    p = distinctiveness._posterior(np.array([0.0, 1.0, 9.0]), share[0], elite[0], rest[0])
    assert p[0] < p[1] < 0.1 and p[2] > 0.99


def test_distinctive_terms(spark):
    rng = random.Random(3)
    lists = [["the", "of", f"r{i}"] + [rng.choice("abcdefgh") for _ in range(4)] for i in range(300)]
    lists[7] += ["beacon"] * 6
    lists += [None, [], [None, " ", "The"]]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(lists)], "id long, body array<string>, tf int")
    got = distinctiveness.distinctive_terms(df, "id", "body").collect()
    assert len(got) == sum(len({t.strip().lower() for t in x if t and t.strip()}) for x in lists if x)
    best = max(got, key=lambda r: r.score)
    assert (best.id, best.term, best.tf, best.df) == (7, "beacon", 6, 1)
    assert all(r.score < 0.1 for r in got if r.term == "the")
    few = distinctiveness.distinctive_terms(df, "id", "body", min_tf=3, max_df=5).where("elite > 0.5").collect()
    assert [(r.id, r.term) for r in few] == [(7, "beacon")]
    assert distinctiveness.distinctive_terms(df.limit(0), "id", "body").count() == 0


def test_found_terms_beside_a_record_that_repeats_them(spark, tmp_path):
    lists = [["beacon"] * 3, ["beacon"] * 60, ["beacon"] * 2] + [["the", f"r{i}"] for i in range(997)]
    rows = [(i, x, datetime.datetime(2026, 1, 1)) for i, x in enumerate(lists)]
    for name in (queries.HYBRID, queries.LATE):
        spark.createDataFrame(rows, "id long, body_tsv array<string>, ingested_at timestamp").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = [tuple(r) for r in queries.QUERIES["p5_found"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((name, i, "beacon") for name in (queries.HYBRID, queries.LATE) for i in (0, 1))


# ---- 6: nearest neighbours


def brute(x, own, k):
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    s[own[:, None] == own[None]] = -9
    return {i: [j for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] if s[i, j] > -9] for i in range(len(x))}


def test_nearest_exact_while_small(spark):
    x = np.concatenate([unit(150, 8), unit(1, 8).repeat(4, 0)]).astype(np.float32)
    own = np.arange(len(x)) // 2
    rows = [(i, int(o), v.tolist()) for i, (o, v) in enumerate(zip(own, x))] + [(900, 900, None), (901, 901, [0.0] * 8), (902, 902, [1.0]), (903, 903, [float("inf")] * 8)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "key long, doc long, v array<float>"), "key", "v", 8, own="doc").orderBy("key", "rank").collect():
        got[r.key].append(r.other)
    expected = brute(x.astype(float), own, 5)
    same = [i for i in range(150) if got[i] == expected[i]]
    assert set(got) == set(range(len(x))) and len(same) >= 149
    assert set(got[150][:2]) == {152, 153}


@pytest.mark.parametrize("least,groups", [(1500, 250_000), (300, 250_000), (100, 100)])
def test_nearest_recall_and_split_groups(spark, monkeypatch, least, groups):
    monkeypatch.setattr(neighbours, "LEAST_GROUP_ROWS", least)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", groups)
    rng = np.random.default_rng(6)
    x = (np.repeat(unit(40, 16, rng), 75, 0) + rng.normal(size=(3000, 16)) * 0.12).astype(np.float32)
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<float>"), "key", "v", 16, probes=0.3).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r.key].add(r.other)
    expected = brute(x.astype(float), np.arange(3000), 5)
    assert len(got) == sum(map(len, found.values())) and {(r.key, r.rank) for r in got} == {(i, n) for i in range(3000) for n in range(1, 6)}
    assert sum(len(found[i] & set(expected[i])) for i in expected) >= 0.9 * 5 * 3000


def routed_per_vector(rows, dim):
    """What one vector is sent to, by the routing alone."""
    bits, tables, visits = neighbours.layout(rows)
    x = unit(500, dim, np.random.default_rng(3)).astype(np.float32)
    plans = [neighbours.Plan(dim, rows, x, bits, visits, 0.06, n) for n in range(tables)]
    table = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(np.arange(500)), lists_of(x)], names=["key", "own", "vec"])
    return sum(b.num_rows for b in neighbours._route(plans, dim)([table])) / 500, rows / (1 << bits)


def test_nearest_moves_a_vector_a_few_times_at_any_size():
    moved = {n: routed_per_vector(n, 32) for n in (100_000, 1_000_000, 2_000_000, 8_000_000, 64_000_000)}
    assert [r for r, _ in moved.values()] == [4, 4, 4, 8, 16] and all(held <= neighbours.GROUP_ROWS for _, held in moved.values())


def test_nearest_of_two_passages_with_many_equal_vectors(spark):
    """Forty copies in each of two passages: every one finds copies of the other passage."""
    x = np.concatenate([np.tile(unit(1, 8), (80, 1)), unit(60, 8)]).astype(np.float32)
    own = np.concatenate([np.repeat([0, 1], 40), 2 + np.arange(60)])
    rows = [(1000 * int(o) + i, int(o), v.tolist()) for i, (o, v) in enumerate(zip(own, x))]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "key long, doc long, v array<float>"), "key", "v", 8, own="doc").orderBy("key", "rank").collect():
        got[r.key].append((r.other, r.cosine))
    keys = {0: [r[0] for r in rows[:40]], 1: [r[0] for r in rows[40:80]]}
    for mine, other in ((0, 1), (1, 0)):
        for key in keys[mine]:
            assert [o for o, _ in got[key]] == sorted(keys[other])[:5] and all(c > 0.999999 for _, c in got[key])


def test_nearest_with_many_copies(spark):
    n = 52
    x = np.concatenate([np.ones((n, 4)), unit(10, 4)])
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<float>"), "key", "v", 4).orderBy("key", "rank").collect():
        got[r.key].append((r.other, r.rank))
    assert all(got[i] == [(o, r + 1) for r, o in enumerate([j for j in range(6) if j != i][:5])] for i in range(n))
    assert neighbours.nearest(spark.createDataFrame([], "key long, v array<float>"), "key", "v", 4).count() == 0


@pytest.mark.parametrize("foreign", [0, 2, 9])
def test_nearest_with_many_copies_of_one_own(spark, foreign):
    n = 40
    x = np.concatenate([np.ones((n + foreign, 8)), unit(30, 8)]).astype(np.float32)
    own = np.concatenate([np.zeros(n), 1 + np.arange(foreign) // 2, 100 + np.arange(30)]).astype(int)
    got = collections.defaultdict(list)
    rows = [(i, int(o), v.tolist()) for i, (o, v) in enumerate(zip(own, x))]
    for r in neighbours.nearest(spark.createDataFrame(rows, "key long, doc long, v array<float>"), "key", "v", 8, own="doc").orderBy("key", "rank").collect():
        got[r.key].append(r.other)
    expected = brute(x.astype(float), own, 5)
    copies = {i: sum(own[j] != own[i] for j in range(n + foreign)) for i in range(n + foreign)}
    for i in range(n + foreign):
        equal = [j for j in got[i] if j < n + foreign]
        assert len(got[i]) == 5 and len(equal) == min(5, copies[i]) and all(own[j] != own[i] for j in got[i])
        assert set(got[i]) - set(equal) == set(expected[i]) - set(range(n + foreign))


# ---- 7: clusters


def test_clusters_of_known_middles(spark):
    rng = np.random.default_rng(12)
    middles, size = unit(4, 32, rng), 60
    parts = [m + rng.normal(size=(size, 32)) * 0.12 for m in middles]
    x = np.concatenate([*parts, unit(200, 32, rng)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 32)]
    found = clustering.cluster(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 32)
    members = {r.id: r.cluster for r in found.members.collect()}
    for c in range(4):
        names = collections.Counter(members.get(i) for i in range(c * size, (c + 1) * size))
        name, n = names.most_common(1)[0]
        assert name is not None and n >= 0.9 * size
    assert sum(i in members for i in range(4 * size, len(x))) <= 5
    samples = spark.createDataFrame([(c, m.tolist()) for c, m in enumerate(middles)] + [(9, (-middles[0]).tolist()), (10, [0.0] * 32)], "id long, vec array<float>")
    matched = {r.id: r.cluster for r in clustering.match(found, samples, 32).collect()}
    assert set(matched) == {0, 1, 2, 3} and len(set(matched.values())) == 4
    summary = {r.cluster: r for r in found.summary().collect()}
    assert sum(r["size"] for r in summary.values()) == len(members) and all(1 <= len(r.typical) <= 5 for r in summary.values())


def test_a_small_cluster_stands_out_among_many_unrelated_records(spark):
    """Thirty members stay though more unrelated records than that lie just outside; evenly spread records make no cluster, whichever middle they are nearest to."""
    rng = np.random.default_rng(3)
    middles, others = unit(2, 16, rng), unit(60_000, 16, rng)
    cosine = others @ middles[0]
    assert ((cosine >= 0.55) & (cosine < 0.6)).sum() > 100
    x = np.concatenate([middles[0] + rng.normal(size=(30, 16)) * 0.13, others[cosine < 0.6]])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<float>")
    counted = clustering.around(rows, 16, np.array([5, 6]), middles, inner=0.65, outer=0.6)
    assert {r.cluster: r.core >= 29 for r in counted.collect()}[5]
    assert [r.cluster for r in counted.where(clustering._apart(16, 0.65, 0.6, 5, 4)).collect()] == [5]


@pytest.mark.parametrize(("rows", "small"), [(50_000, 24), (40, 24), (40, 2)])
def test_links_are_all_pairs_of_a_bucket(spark, monkeypatch, rows, small):
    """Every two similar rows of a bucket are linked, not the rows and a leader alone, and parts of a split bucket meet; the degrees and stars are those of these links."""
    monkeypatch.setattr(clustering, "BUCKET_ROWS", rows)
    monkeypatch.setattr(clustering, "SMALL_ROWS", small)
    monkeypatch.setattr(clustering, "TILE", 16)
    rng = np.random.default_rng(31)
    x = np.concatenate([*(m + rng.normal(size=(90, 16)) * 0.14 for m in unit(2, 16, rng)), unit(60, 16, rng)]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<float>")
    sets = clustering.Sets(16)
    elements = sets.elements(x)
    bands = sets.buckets(elements)
    near = ((elements[:, None] == elements[None]).sum(axis=2) >= clustering.agreements(0.15)) & (bands[:, None] == bands[None]).any(axis=2) & ~np.eye(len(x), dtype=bool)
    expected = {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near)) if ids[i] < ids[j]}
    got = [tuple(r) for r in clustering.links(df, 16, jaccard=0.15).collect()]
    assert len(got) == len(set(got)) > 1000 and set(got) == expected
    degree = {int(ids[i]): int(n) for i, n in enumerate(near.sum(axis=1)) if n}
    assert {r.id: r.degree for r in clustering.degrees(df, 16, jaccard=0.15).collect()} == degree
    stars = {int(ids[i]): max((degree[int(ids[j])], int(ids[j])) for j in [i, *np.nonzero(near[i])[0]])[1] for i in range(len(x)) if near[i].any()}
    assert {r.id: r.star for r in clustering.stars(df, 16, jaccard=0.15).collect()} == stars


@pytest.mark.parametrize("middle", [0, 256])
def test_buckets_of_about_one_size_are_compared_together(monkeypatch, middle):
    """All pairs of all buckets come out whichever way a bucket is compared, and buckets of a few dozen rows not one by one."""
    monkeypatch.setattr(clustering, "MIDDLE_ROWS", middle)
    rng = np.random.default_rng(8)
    size = np.concatenate([rng.integers(1, 25, 40), rng.integers(25, 45, 200), [256, 257, 300]])
    number = np.repeat(np.arange(len(size)), size)
    bucket, side = (5 << 16) + number, np.where(number % 3, clustering.WHOLE, rng.integers(0, 2, len(number)))
    elements, bands = rng.integers(0, 4, (len(number), clustering.FEATURES)).astype(np.uint8) * 85, rng.integers(0, 30, (len(number), clustering.BANDS)).astype(np.uint16)
    bands[:, 5] = number
    for held in (bands, None):
        got, blocks = [], 0
        for i, j, mask in clustering.linked_rows(bucket, side.astype(np.int8), elements, held, 7):
            if mask is not None:
                row, column = np.nonzero(mask)
                i, j = i[row], j[column]
            got += zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())
            blocks += 1
        expected = set()
        for n in range(len(size)):
            at = np.nonzero(number == n)[0]
            near = ((elements[at][:, None] == elements[at][None]).sum(axis=2) >= 7) & ((side[at][:, None] != side[at][None]) | (n % 3 > 0))
            if held is not None:
                near &= ~(bands[at][:, None, :5] == bands[at][None, :, :5]).any(axis=2)
            expected |= {(int(at[i]), int(at[j])) for i, j in zip(*np.nonzero(near)) if i < j}
        assert len(got) == len(set(got)) > 1000 and set(got) == expected
        assert not middle or blocks < 40


def test_one_reading_counts_and_averages_the_records_of_each_middle(spark, monkeypatch):
    """Numbers around each centre and the mean of the records nearest to it are those of brute force, whatever part of the centres or records is taken at a time."""
    monkeypatch.setattr(clustering, "SUM_ROWS", 30)
    rng = np.random.default_rng(14)
    centres = unit(5, 16, rng)
    x = np.concatenate([*(m + rng.normal(size=(40, 16)) * 0.2 for m in centres[:4]), unit(100, 16, rng)]).astype(np.float32)
    bad = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15, [None, *[1.0] * 15]]
    unit_rows = clustering._unit(spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *((900 + i, v) for i, v in enumerate(bad))], "id long, vec array<float>"), 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([r.vec for r in unit_rows.orderBy("id").collect()], x, atol=1e-6)
    s = x @ centres.T
    nearest, best = s.argmax(axis=1), s.max(axis=1)
    monkeypatch.setattr(clustering, "CENTRE_BLOCK", 2)
    lists = pa.array(x.tolist(), pa.list_(pa.float32()))
    assert (clustering._scored(lists, 16, centres.astype(np.float32))[2] == nearest).all()
    found = {r.cluster: r for r in clustering.around(unit_rows, 16, np.arange(10, 15), centres, inner=0.65, outer=0.6, least=0.625).collect()}
    assert set(found) == set(range(10, 15))
    for c in range(5):
        own, r = (nearest == c) & (best >= 0.625), found[10 + c]
        assert (r.core, r.rim, r.n) == ((s[:, c] >= 0.65).sum(), ((s[:, c] >= 0.6) & (s[:, c] < 0.65)).sum(), own.sum())
        assert not r.n or np.allclose(r.vec, x[own].mean(axis=0), atol=1e-5)


def test_clusters_of_nothing(spark):
    found = clustering.cluster(spark.createDataFrame([], "id long, v array<float>"), "id", "v", 4)
    assert found.members.count() == 0 and clustering.match(found, spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "id long, vec array<float>"), 4).count() == 0


def test_agreements_are_those_of_the_jaccard():
    n = clustering.FEATURES
    for a in range(n + 1):
        assert clustering.agreements(a / (2 * n - a)) == a


# ---- 8: packing


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=200, deadline=None)
def test_packing_holds_the_capacity_and_wastes_little(sizes):
    sizes = np.array(sizes, np.int64)
    place = packing.pack_sizes(sizes, 50)
    fill = np.bincount(place, sizes, minlength=0) if len(sizes) else np.zeros(0)
    assert (fill <= 50).all() and set(place.tolist()) == set(range(len(fill)))
    large = np.bincount(place[3 * sizes > 50]) if len(sizes) else np.zeros(0)
    assert (large <= 2).all()
    assert len(fill) <= 11 / 9 * math.ceil(sizes.sum() / 50) * 1.5 + 1


def test_pack_texts(spark):
    rng = random.Random(7)
    texts = [None, ""] + [" ".join("word" for _ in range(rng.randrange(1, 90))) for _ in range(300)] + ["word " * 501]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = packing.pack(df.unionByName(df.where("doc_id = 5")), "doc_id", "text", capacity=128, shard_rows=100).collect()
    assert {r.id for r in got} == set(range(len(texts))) and sum(r.id == 5 for r in got) == 2
    assert [r.container for r in got if r.id in (0, 1)] == [None, None]
    fill = collections.Counter()
    for r in got:
        if r.container is not None:
            fill[r.shard, r.container] += r.n_tokens
    assert max(fill.values()) <= 128 and all(fill[r.shard, r.container] == r.fill for r in got if r.container is not None)
    assert sum(fill.values()) >= 0.9 * 128 * (len(fill) - 4)
    cut = [r for r in got if r.n_pieces > 1]
    assert {r.id for r in cut} == {302} and all(r.n_tokens == 128 for r in cut if r.piece < r.n_pieces - 1)
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# ---- 9: leakage


def test_leaks_whatever_stands_between_the_words(spark):
    words = [f"w{i}" for i in range(30)]
    leaked = " ".join(words[5:17])
    docs = [(1, f"intro {leaked} outro"), (2, " / ".join(words[5:17]).upper()), (3, " ".join(words[5:16])), (4, " ".join([*words[5:10], "gap", *words[10:17]])), (5, None), (6, ""), (7, "x " * 20_000 + leaked), (1, leaked)]
    items = [(1, " ".join(words)), (2, leaked), (3, "too short"), (4, None)]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id int, text string"), "item_id", "text").collect()
    assert sorted((r.id, r.item_id) for r in got) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (7, 1), (7, 2)]
    assert {r.first_word for r in got if r.id == 7} == {20_000}
    empty = spark.createDataFrame([], "item_id int, text string")
    assert leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", empty, "item_id", "text").count() == 0


def test_leaks_by_block_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 3)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(13))) for i in range(10)]
    got = leakage.find_leaks(spark.createDataFrame(items, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert sorted((r.id, r.item_id) for r in got) == [(i, i) for i in range(10)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_verification_and_recall():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 30, (200, 12)).astype(np.int32)
    b = a.copy()
    b[np.arange(200), rng.integers(0, 12, 200)] = rng.integers(1, 30, 200)
    b[:60] = np.roll(b[:60], 1, axis=1)
    for most in (0, 1, 2):
        assert leakage.edit_distance_at_most(a, b, most).tolist() == [levenshtein(x, y) <= most for x, y in zip(a.tolist(), b.tolist())]
    items = [(i, " ".join(f"k{v}" for v in row)) for i, row in enumerate(rng.integers(0, 500, (300, 12)))]
    index = leakage.Index(items, 12, 1, 6, 0.95)
    windows = index.windows.copy()
    windows[np.arange(300), rng.integers(0, 12, 300)] = 0
    mine, item = index.matches(windows)
    assert len({(m, i) for m, i in zip(mine.tolist(), item.tolist()) if i == index.owner[m]}) >= 0.9 * 300


@pytest.mark.parametrize("edits, sampled", [(1, 6), (2, 3)])
def test_near_leaks_with_words_put_in_left_out_or_replaced(spark, edits, sampled):
    rng = random.Random(edits)
    items = [(i, [f"k{rng.randrange(900)}" for _ in range(12)]) for i in range(60)]
    documents, kinds = [], list(itertools.combinations_with_replacement(["put in", "left out", "replaced"], edits))
    for n, (kind, (i, words)) in enumerate(itertools.product(kinds, items)):
        held = list(words)
        for k in kind:
            at = rng.randrange(1, len(held) - 1)
            held[at : at + (k != "put in")] = [] if k == "left out" else ["foreign"]
        documents.append((n, i, kind, " ".join(held if n % 2 else ["before", "it", *held, "after", "it"])))
    documents.append((-1, 0, None, " ".join([*items[0][1][:4], "a", "b", "c", *items[0][1][4:]])))
    items = [(i, " ".join(words)) for i, words in items]
    frame = spark.createDataFrame([(n, text) for n, _, _, text in documents], "doc_id long, text string")
    got = leakage.find_leaks(frame, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", edits=edits, sampled=sampled).collect()
    found = {(r.id, r.item_id) for r in got}
    assert len(got) == len(found) and found <= {(n, i) for n, i, kind, _ in documents if kind}
    for kind in kinds:
        assert sum((n, i) in found for n, i, k, _ in documents if k == kind) >= 0.95 * 60


def test_near_leaks_are_queried_with_two_edits(spark, tmp_path):
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(words), " ".join(words[:5] + words[6:]), " ".join([*words[:4], "x", *words[4:8], "y", *words[8:]]), " ".join(words[:9])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(words))], "item_id int, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert {(r.doc_id, r.item_id) for r in queries.QUERIES["p9_near"](spark, str(tmp_path)).collect()} == {(0, 7), (1, 7), (2, 7)}


# ---- 10: subjects

WORDS = {s: [f"{s}{c}" for c in "abcdefghijkl"] for s in ("law", "food", "sport")}


def document(rng, *plan):
    out = []
    for s, n in plan:
        for _ in range(n):
            out.append("the " + " and ".join(rng.choice(WORDS[s]) for _ in range(3)) + " again here.")
    rng.shuffle(out)
    return " ".join(out)


def test_subject_chain_on_held_out_documents(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(500):
        kinds = rng.sample(sorted(WORDS), 2 if rng.random() < 0.3 else 1)
        extra = [(next(s for s in WORDS if s not in kinds), 1)] if rng.random() < 0.3 else []
        rows.append((i, document(rng, *[(s, rng.randrange(4, 8)) for s in kinds], *extra), rng.choice("pq")))
        truth[i] = set(kinds)
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "p"), (902, "1 2 3 4 5 6; 7 8 | 9", "q")], "doc_id long, text string, source string")
    labels = [(i, s.title() if i % 9 == 0 else s) for i in range(250) for s in truth[i]] + [(3, "no subject"), (None, "law"), (0, next(iter(truth[0])))]
    chain = subjects.train(docs, "doc_id", "text", "source", spark.createDataFrame(labels, "doc_id long, subject string"), "doc_id", "subject", sorted(WORDS))
    got = collections.defaultdict(set)
    for r in subjects.assign_subjects(docs, "doc_id", "text", "source", chain).collect():
        got[r.id].add(r.subject)
        assert 0 <= r.probability <= 1
    assert not {900, 901, 902} & set(got)
    hits = sum(len(got[i] & truth[i]) for i in range(250, 500))
    assert hits >= 0.95 * sum(len(got[i]) for i in range(250, 500)) and hits >= 0.95 * sum(len(truth[i]) for i in range(250, 500))


def test_subjects_are_learnt_from_all_documents(spark):
    """Every label counts, and so does every unlabelled text, however many there are."""
    rng = random.Random(12)
    kinds = ["law"] * 15_000 + ["food"] * 5_500
    rows = [(i, document(rng, (s, 1)), f"s{i % 7}") for i, s in enumerate(kinds)]
    rows += [(30_000 + 3 * w + j, f"the {rng.choice(WORDS['law'])} and {rng.choice(WORDS['law'])} with rare{chr(97 + w)} here.", None) for w in range(20) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, subject string")
    chain = subjects.train(docs, "doc_id", "text", "source", labels, "doc_id", "subject", ["food", "law"])
    assert chain.prior.tolist() == [5_500 / 20_500, 15_000 / 20_500]
    assert {f"rare{chr(97 + w)}" for w in range(20)} <= set(chain.lexicon.code)
    assert chain.sources["s3"][1] == pytest.approx(math.log((sum(k == "law" and i % 7 == 3 for i, k in enumerate(kinds)) + 5 * chain.prior[1] + 1e-3) / (sum(i % 7 == 3 for i in range(20_500)) + 5)) - math.log(chain.prior[1] + 1e-3))


def test_regressions_over_tasks_are_those_of_all_rows():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)), np.ones((300, 1))], axis=1)
    y = (x @ [1.0, -2.0, 0.0, 0.5] + rng.normal(size=300) > 0).astype(float)

    def sums(ws):
        parts = [subjects._slopes(x[i::3], y[i::3], ws[0]) for i in range(3)]
        return {0: tuple(sum(p[i] for p in parts) for i in range(2))}

    assert subjects._newton(sums, [4], 1.0)[0] == pytest.approx(subjects._logistic(x, y))


def test_beam_finds_the_best_combination():
    rng = random.Random(6)
    rows = [(document(rng, (s, 5)), "p", {i}) for i, s in enumerate(sorted(WORDS)) for _ in range(20)]
    chain = subjects.Chain(sorted(WORDS), rows)
    texts = [document(rng, ("law", 3), ("food", 3)), document(rng, ("sport", 4))]
    mask, _ = chain.decode(texts, ["p", None])
    own, everywhere = chain.features([subjects.sentences(t) for t in texts], ["p", None], texts)
    for n in range(2):
        worth = {}
        for combo in itertools.product((0, 1), repeat=3):
            if not 1 <= sum(combo) <= 2:
                continue
            total = 0.0
            for step, s in enumerate(chain.order):
                x = np.concatenate([own[n, s], everywhere[n], [combo[t] for t in chain.order[:step]], [1]])
                a, b = chain.scale[step]
                p = 1 / (1 + np.exp(-(a * (x @ chain.weights[step]) + b)))
                total += np.log(p if combo[s] else 1 - p)
            worth[combo] = total
        assert tuple(mask[n].astype(int)) == max(worth, key=worth.get)


def test_probabilities_are_calibrated_out_of_fold():
    rng = random.Random(9)
    names = sorted(WORDS)
    rows = []
    for i in range(240):
        s = i % len(names)
        # one label in five is wrong, which the probabilities must show
        rows.append((document(rng, (names[s], 5)), "p", {s if i % 5 else (s + 1) % len(names)}))
    chain = subjects.Chain(names, rows)
    assert chain.calibration_error < 0.05 and all(np.isfinite(x).all() for x in chain.scale)


def test_subjects_without_labels(spark):
    docs = spark.createDataFrame([(1, "some plain words stand here.", "p")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    chain = subjects.train(docs, "doc_id", "text", "source", none, "doc_id", "subject", ["law"])
    assert subjects.assign_subjects(docs, "doc_id", "text", "source", chain).count() == 0
    assert subjects.assign_subjects(docs.limit(0), "doc_id", "text", "source", chain).count() == 0


