import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.functions import analyzer, encode, multivector, vectors
from quillrank.functions.multivector import Multivector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances(spark):
    assert one(spark, vectors.cosine(vec(1, 0, 0), vec(1, 0, 0))) == 0
    assert one(spark, vectors.l2(vec(1, 2, 3), vec(1, 2, 5))) == 2
    assert one(spark, vectors.negative_inner_product(vec(1, 2, 3), vec(2, 0, 1))) == -5
    assert one(spark, vectors.cosine(vec(0, 0), vec(1, 0))) == 1
    assert one(spark, vectors.l1(vec(1, 2), vec(3, -1))) == 5
    assert one(spark, vectors.normalise(vec(0, 0))) == [0, 0]


def test_dimension_and_finiteness(spark):
    with pytest.raises(Exception, match="different vector dimensions"):
        one(spark, vectors.same_dimension(vec(1, 2), vec(1, 2, 3)))
    assert one(spark, vectors.valid(vec(1, 2), 2)) is True
    assert one(spark, vectors.valid(vec(1, 2), 3)) is False
    assert one(spark, vectors.valid(F.array(F.lit(1.0), F.lit(None).cast("double")))) is False
    assert one(spark, vectors.valid(F.array(F.lit(float("nan"))))) is False
    assert one(spark, vectors.valid(F.lit(None).cast("array<double>"))) is False
    for bad in ([], [math.inf], [math.nan]):
        with pytest.raises(ValueError):
            vectors.literal(bad)


def test_multivector_values(spark):
    q = Multivector.of([[1, 0], [0, 1]])
    rows = {1: [[1, 0], [0, 1]], 2: [[0.8, 0.2], [0.2, 0.8]], 3: [[-1, 0], [0, -1]]}
    got = {i: one(spark, multivector.maxsim(q.literal(), Multivector.of(v).literal())) for i, v in rows.items()}
    assert got == pytest.approx({1: 2.0, 2: 1.6, 3: 0.0})
    assert (q.dim, len(q), q.subvector(1)) == (2, 2, (1.0, 0.0))
    with pytest.raises(IndexError):
        q.subvector(0)
    with pytest.raises(Exception, match="ordinal"):
        one(spark, multivector.subvector(Multivector.of([[1, 2]]).literal(), 2))
    assert multivector.render(Multivector.from_floats([1, 0, 0, 1], 2)) == "multivector(dim=2,count=2,values=[[1,0],[0,1]])"
    assert one(spark, multivector.from_floats(vec(1, 0, 0, 1), 2)) == [[1, 0], [0, 1]]
    with pytest.raises(Exception, match="multiple"):
        one(spark, multivector.from_floats(vec(1, 0, 0), 2))


def test_weighted_context_and_field_maxsim(spark):
    q, d = Multivector.of([[1, 0], [0, 1]]), Multivector.of([[1, 0], [0, 1], [2, 2]])
    assert one(spark, multivector.weighted_maxsim(q.literal(), d.literal(), [2, 1], [False, True])) == 4
    assert one(spark, multivector.weighted_maxsim(q.literal(), d.literal(), skip=[True, True])) == 0
    contexts = F.array(F.lit(0), F.lit(2))
    assert one(spark, multivector.context_maxsim(q.literal(), d.literal(), contexts)) == 4
    assert one(spark, multivector.context_maxsim(q.literal(), d.literal(), F.array().cast("array<int>"))) == 4
    assert one(spark, multivector.field_maxsim(q.literal(), d.literal(), contexts, F.array(F.lit(0), F.lit(1)), {0: 1.0, 1: 10.0})) == 42


@pytest.mark.parametrize("bad", [[], [[1], [1, 2]], [[math.inf]], [[]]])
def test_bad_multivectors(bad):
    with pytest.raises(ValueError):
        Multivector.of(bad)


@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.floats(-100, 100, width=32), min_size=d, max_size=d), min_size=1, max_size=6)), st.booleans())
@settings(max_examples=50, deadline=None)
def test_multivector_round_trips(values, with_contexts):
    mv = Multivector.of(values, contexts=(0,) if with_contexts else None, fields=(3,) if with_contexts else None)
    assert multivector.from_bytes(multivector.to_bytes(mv)) == mv
    back = multivector.parse(multivector.render(mv))
    assert np.array_equal(np.float32(back.values), np.float32(mv.values)) and back.contexts == mv.contexts and back.fields == mv.fields


def test_bad_binary_input():
    good = multivector.to_bytes(Multivector.of([[1, 2], [3, 4]]))
    for bad in (b"", good[:-1], good + b"x", b"\0\0\0\7" + good[4:], good[:4] + b"\0\0\0\0" + good[8:], good[:8] + b"\xff\xff\xff\xff" + good[12:]):
        with pytest.raises(ValueError):
            multivector.from_bytes(bad)
    for text in ("", "multivector()", "multivector(dim=2,count=1,values=[[1,2,3]])"):
        with pytest.raises(ValueError):
            multivector.parse(text)


def test_encodings_and_pooling(spark):
    d = Multivector.of([[1, -5], [3, 2]]).literal()
    assert one(spark, multivector.mean(d, 2)) == [2, -1.5]
    assert one(spark, multivector.max_pool(d, 2)) == [3, 2]
    assert one(spark, multivector.max_abs(d, 2)) == [3, -5]
    assert np.linalg.norm(one(spark, multivector.normalised_mean(d, 2))) == pytest.approx(1)
    assert [multivector.centroid_count(n) for n in (1, 4, 5, 26, 10_000)] == [1, 4, 4, 6, 64]
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    centres = multivector.pool(x, 2, 4)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1) and multivector.residual(x, centres) < 0.05
    got = spark.createDataFrame([(1, x.tolist()), (2, None)], "id int, mv array<array<double>>").select("id", multivector.pooled(0.5)("mv").alias("p")).collect()
    assert {r.id: None if r.p is None else len(r.p) for r in got} == {1: 2, 2: None}


def test_pooling_seeds_by_cosine_and_leaves_what_needs_none():
    x = np.array([[3.0, 0.0], [10.0, 1.0], [0.0, 2.0], [-1.0, 0.1]])
    assert np.array_equal(multivector.pool(x, 4, 4), x) and np.array_equal(multivector.pool(x[:1], 1, 4), x[:1])
    got = multivector.pool(x, 2, 1)  # the second seed is the last vector, opposite in direction
    near = (x @ np.array([[3.0, 0.0], [-1.0, 0.1]]).T).argmax(axis=1)
    expected = np.stack([x[near == c].mean(axis=0) for c in range(2)])
    assert np.allclose(got, expected / np.linalg.norm(expected, axis=1, keepdims=True))


def test_query_parsing():
    shapes = {"a": "one", "a & b": "all", "a | b": "any", "(a <-> b) | c": "any", "a <-> b": "tree", "c & (b | !a)": "tree", "!a": "none", "b | !a": "any", "!!a": "one", "a & (b | c)": "tree"}
    assert {q: analyzer.shape(analyzer.parse(q)) for q in shapes} == shapes
    assert analyzer.positive_terms(analyzer.parse("c & (b | !a) & !!d & c")) == ["c", "b", "d"]
    for bad in ("a &", "(a", "a b", "foo:*", "a | | b", ")"):
        with pytest.raises(ValueError):
            analyzer.parse(bad)
    assert analyzer.parse("  ") is None
    with pytest.raises(ValueError):
        analyzer.positive_terms(analyzer.parse(" | ".join(f"t{i}" for i in range(65))))
    assert analyzer.web('fast "dense search" -slow or other') == analyzer.Group("or", (analyzer.Group("and", (analyzer.Term("fast"), analyzer.Group("phrase", (analyzer.Term("dense"), analyzer.Term("search"))), analyzer.Not(analyzer.Term("slow")))), analyzer.Term("other")))
    assert analyzer.is_identifier("abc_d") and analyzer.is_identifier("ab1234") and not analyzer.is_identifier("plain")


def test_stub_encoder(spark):
    stub = encode.StubEncoder()
    assert stub.encode("x", "generic", encode.Options()) == [[1, 0, 0, 0]]
    assert len(stub.encode("x", "query", encode.Options(mode="tokens"))) == 2
    assert stub.encode("x", "doc", encode.Options(mode="tokens", normalize=False))[1] == [2, 3, 4, 5]
    df = spark.createDataFrame([("Mars",), (None,)], "t string")
    assert [r[0] for r in df.select(encode.dense_udf(stub)("t")).collect()] == [[1, 0, 0, 0], None]
    for bad in ({"mode": "x"}, {"pooling": "none"}, {"mode": "tokens", "pooling": "mean"}, {"max_vectors": 0}, {"expected_dim": 0}):
        with pytest.raises(ValueError):
            encode.Options(**bad)
    for bad in (".x", "a..b", "a/b", "", "m:other"):
        with pytest.raises(ValueError):
            encode.alias(bad)
    with pytest.raises(PermissionError):
        encode.alias("m", ["n"])
    assert encode.alias("m.1:query") == ("m.1", "query")
    with pytest.raises(ValueError):
        encode.checked([[2.0]], encode.Options())
    assert encode.retained([101, 5, 103, 103], [1, 1, 0, 0], "Query") == [1, 1, 1, 1]
    assert encode.retained([101, 5, 1012, 102, 103], None, "doc") == [1, 1, 0, 1, 0]
