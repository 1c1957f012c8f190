"""The queries of the search engine's own operators over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.functions import analyzer, multivector, vectors
from quillrank.functions.multivector import Multivector
from quillrank.operators import branches, fusion, quantise, search
from quillrank.operators.corpus import Corpus
from quillrank.sources import read_table

from .catalog import query
from .query import HybridQuery

K1, B = branches.K1, branches.B
TOKENS = 8

# ---- corpora


_BUILT: dict[tuple, Corpus] = {}


def _indexed(spark, folder, make) -> Corpus:
    """The corpus with its lexical index, built once for a session and folder, as an index is created once and searched often."""
    key = (spark.sparkContext.applicationId, folder, make.__name__)
    if key not in _BUILT:
        _BUILT[key] = make(spark, folder).with_index()
    return _BUILT[key]


def hybrid(spark, folder, metric: str = "cosine") -> Corpus:
    """Documents with the embedding of the same number; label and language can be filtered on."""
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), analyzer.tokens(F.col("text")).alias("tokens"), "lang")
    vecs = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return Corpus(docs.join(vecs, "id"), vector="v", tokens="tokens", metric=metric)


def lexical(spark, folder) -> Corpus:
    return Corpus(read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), analyzer.tokens(F.col("text")).alias("tokens"), "lang"), tokens="tokens")


def late(spark, folder, tokens: bool = False) -> Corpus:
    """Every eight embeddings in a row are one multivector; with ``tokens``, the document of its number lends the text."""
    rows = read_table(spark, folder, "embeddings").groupBy(F.floor(F.col("vec_id") / TOKENS).cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    mv = rows.select("id", F.transform("s", lambda x: x["embedding"]).alias("mv"))
    if tokens:
        docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), analyzer.tokens(F.col("text")).alias("tokens"))
        return Corpus(mv.join(docs, "id"), multivector="mv", tokens="tokens")
    return Corpus(mv, multivector="mv")


def late_with_text(spark, folder) -> Corpus:
    return late(spark, folder, tokens=True)


def some_vectors(spark, folder, n: int = 1) -> list[list[float]]:
    """The first n embeddings, which serve as queries."""
    return [list(r.embedding) for r in read_table(spark, folder, "embeddings").orderBy("vec_id").limit(n).collect()]


_H = r"h as (select d.doc_id as id, e.embedding::double[] as v, regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+') as tokens, e.label, d.lang from documents d join embeddings e on d.doc_id = e.vec_id)"
_L = r"h as (select doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as tokens, lang from documents)"
_Q = "q as (select embedding::double[] as q from embeddings order by vec_id limit 1)"
_MV = f"h as (select id, mv from (select vec_id // {TOKENS} as id, list(embedding::double[] order by vec_id) as mv from embeddings group by 1))"
_MVL = rf"h as (select m.id, m.mv, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+') as tokens from (select vec_id // {TOKENS} as id, list(embedding::double[] order by vec_id) as mv from embeddings group by 1) m join documents d on d.doc_id = m.id)"
_QM = "q as (select list(embedding::double[] order by vec_id) as q from (select * from embeddings order by vec_id limit 3))"

_DISTANCE = {
    "cosine": "1 - greatest(-1, least(1, list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q))))",
    "l2": "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i])))",
    "ip": "-list_inner_product(v, q)",
    "l1": "list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - q[i])))",
}
_MAXSIM = "list_sum(list_transform(q, lambda a: list_max(list_transform(mv, lambda d: list_inner_product(a, d)))))"


def _dense_sql(k: int, metric: str = "cosine", where: str = "true") -> str:
    return f"dn as (select id, d as dense_dist, -d as dense_sim, row_number() over (order by d, id) as dense_rank from (select id, {_DISTANCE[metric]} as d from h, q where {where}) qualify dense_rank <= {k})"


def _late_sql(k: int, score: str = _MAXSIM, total: float = 3.0) -> str:
    return f"lt as (select id, s as maxsim, s / {total} as late_sim, row_number() over (order by s desc, id) as late_rank from (select id, {score} as s from h, q) qualify late_rank <= {k})"


def _bm25_sql(terms: list[str], match: str, k: int, where: str = "true") -> str:
    """``match`` speaks of the counts tf_0, tf_1, ..."""
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) as tf_{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (where list_contains(tokens, '{t}')) as df_{i}" for i, t in enumerate(terms))
    score = " + ".join(f"case when tf_{i} > 0 then ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * tf_{i} * {K1 + 1} / (tf_{i} + {K1} * ({1 - B} + {B} * greatest(dl, 1) / greatest(avgdl, 1))) else 0 end" for i in range(len(terms)))
    return f"""st as (select count(*) as n, sum(len(tokens)) / count(*) as avgdl, {df} from h where tokens is not null),
    tf as (select id, len(tokens) as dl, {tf} from h where tokens is not null and {where}),
    bm as (select id, s as bm25_score, row_number() over (order by s desc, id) as bm25_rank from (select id, {score} as s from tf, st where {match}) qualify bm25_rank <= {k})"""


def _fused_sql(parts: list[str], lists: list[str], score: str, size: int, where: str = "true", extra: str = "") -> str:
    """Full outer union of the lists, ``score`` of their columns, the final order and the first rows."""
    known = {"dn": "dense_dist, dense_sim, dense_rank", "bm": "bm25_score, bm25_rank", "lt": "maxsim, late_sim, late_rank"}
    joined = lists[0] + "".join(f" full outer join {x} using (id)" for x in lists[1:])
    columns = ", ".join(["id", *[known[x] if x in lists else ", ".join(f"null::double as {c.strip()}" for c in known[x].split(",")) for x in known]])
    return f"""with {", ".join(parts)}, m as (select * from (select {columns} from {joined}) where {where}){extra},
    f as (select *, {score} as fused from {"m2" if extra else "m"})
    select id, round(fused, 6) as fused, dense_rank::int as dense_rank, bm25_rank::int as bm25_rank, late_rank::int as late_rank, (row_number() over (order by fused desc,
      (coalesce(dense_rank, late_rank) is not null and bm25_rank is not null) desc, dense_rank asc nulls last, late_rank asc nulls last, bm25_rank asc nulls last, id))::int as rank
    from f qualify rank <= {size}"""


def _shown(df):
    return df.select("id", F.round("fused", 6).alias("fused"), "dense_rank", "bm25_rank", "late_rank", "rank")


# ---- distances and nearest rows


def _nearest(metric: str):
    def run(spark, folder):
        got = branches.dense(hybrid(spark, folder, metric), some_vectors(spark, folder)[0], 20)
        return got.select("id", F.round("dense_dist", 6).alias("dist"), F.col("dense_rank").alias("rank"))

    return run


for _metric in _DISTANCE:
    query(f"dense_{_metric}_topk", f"with {_H}, {_Q}, {_dense_sql(20, _metric)} select id, round(dense_dist, 6) as dist, dense_rank::int as rank from dn")(_nearest(_metric))


@query("dense_filtered_topk", f"with {_H}, {_Q}, {_dense_sql(20, where='label = 3')} select id, round(dense_dist, 6) as dist, dense_rank::int as rank from dn")
def dense_filtered_topk(spark, folder):
    got = branches.dense(hybrid(spark, folder), some_vectors(spark, folder)[0], 20, F.col("label") == 3)
    return got.select("id", F.round("dense_dist", 6).alias("dist"), F.col("dense_rank").alias("rank"))


@query(
    "vector_functions",
    """with q as (select embedding::double[] as q from embeddings order by vec_id limit 1), e as (select vec_id, embedding::double[] as v from embeddings)
    select vec_id, round(sqrt(list_inner_product(v, v)), 6) as norm, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i])))), 6) as l2,
    round(-list_inner_product(v, q), 6) as negative_ip, round(1 - list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)), 6) as cosine from e, q""",
)
def vector_functions(spark, folder):
    q, v = vectors.literal(some_vectors(spark, folder)[0]), F.col("embedding")
    named = {"norm": vectors.norm(v), "l2": vectors.l2(v, q), "negative_ip": vectors.negative_inner_product(v, q), "cosine": vectors.cosine(v, q)}
    return read_table(spark, folder, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


@query("vector_normalise", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[])))), 5) as total from embeddings")
def vector_normalise(spark, folder):
    unit = vectors.normalise(F.transform("embedding", lambda x: x * 3))
    return read_table(spark, folder, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# ---- lexical


def _lexical(text: str, where=None):
    def run(spark, folder):
        return branches.lexical(_indexed(spark, folder, lexical), analyzer.parse(text), 25, None if where is None else F.expr(where)).select("id", F.round("bm25_score", 6).alias("score"), F.col("bm25_rank").alias("rank"))

    return run


def _lexical_sql(terms: list[str], match: str, where: str = "true") -> str:
    return f"with {_L}, {_bm25_sql(terms, match, 25, where)} select id, round(bm25_score, 6) as score, bm25_rank::int as rank from bm"


query("bm25_single", _lexical_sql(["cache"], "tf_0 > 0"))(_lexical("cache"))
query("bm25_or", _lexical_sql(["cache", "kernel", "verdict"], "tf_0 > 0 or tf_1 > 0 or tf_2 > 0"))(_lexical("cache | kernel | verdict"))
query("bm25_and", _lexical_sql(["without", "cache"], "tf_0 > 0 and tf_1 > 0"))(_lexical("without & cache"))
query("bm25_not_ignored", _lexical_sql(["cache"], "tf_0 > 0"))(_lexical("cache | !without"))
query("bm25_phrase_as_and", _lexical_sql(["lexical", "parser"], "tf_0 > 0 and tf_1 > 0"))(_lexical("lexical <-> parser"))
query("bm25_tree", _lexical_sql(["without", "kernel", "cache"], "tf_0 > 0 and (tf_1 > 0 or tf_2 > 0)"))(_lexical("without & (kernel | cache)"))
query("bm25_tree_not_true", _lexical_sql(["without", "kernel"], "tf_0 > 0"))(_lexical("without & (kernel | !cache)"))
query("bm25_phrase_in_or", _lexical_sql(["lexical", "parser", "verdict"], "tf_0 > 0 or tf_1 > 0 or tf_2 > 0"))(_lexical("(lexical <-> parser) | verdict"))
query("bm25_filtered", _lexical_sql(["cache", "kernel"], "tf_0 > 0 or tf_1 > 0", "lang = 'en'"))(_lexical("cache | kernel", "lang = 'en'"))


@query("bm25_strict_not", _lexical_sql(["cache", "without"], "tf_0 > 0 and tf_1 = 0").replace("+ case when tf_1 > 0", "+ case when false"))
def bm25_strict_not(spark, folder):
    got = branches.lexical(_indexed(spark, folder, lexical), analyzer.parse("cache & !without"), 25, strict_not=True)
    return got.select("id", F.round("bm25_score", 6).alias("score"), F.col("bm25_rank").alias("rank"))


@query("lexicon_stats", f"with {_L} select term, count(distinct id) as df, count(*) as cf from (select id, unnest(tokens) as term from h) group by term")
def lexicon_stats(spark, folder):
    return lexical(spark, folder).lexicon()


@query("postings", f"with {_L} select id, term, count(*) as tf, dl from (select id, len(tokens) as dl, unnest(tokens) as term from h) group by id, term, dl")
def postings(spark, folder):
    return lexical(spark, folder).postings()


@query("index_stats", f"with {_H} select count(*) as total_count, count(*) as live_count, max(len(v)) as dim, count(tokens) as lexical_count, round(sum(len(tokens)) / count(tokens), 6) as mean_length, 0 as dead_count, 0.0::double as dead_ratio from h")
def index_stats(spark, folder):
    return hybrid(spark, folder).stats()


@query("estimate_memory", f"with {_H} select sum(4 * len(v))::bigint as vector_bytes, 0::bigint as multivector_bytes, sum(12 * len(list_distinct(tokens)))::bigint as postings_bytes from h")
def estimate_memory(spark, folder):
    return hybrid(spark, folder).memory()


def _dirty(spark, folder) -> Corpus:
    """The hybrid corpus with every fiftieth row twice, some vectors cut short, some with an element that is no number, and some ids lost."""
    clean = hybrid(spark, folder).table.select("id", "v", "tokens")
    worse = F.when(F.col("id") % 30 == 2, F.slice("v", 1, 10)).when(F.col("id") % 40 == 3, F.transform("v", lambda x: (x * float("nan")).cast("float"))).otherwise(F.col("v"))
    rows = clean.unionByName(clean.where("id % 50 = 0")).select(F.when(F.col("id") % 70 != 1, F.col("id")).alias("id"), worse.alias("v"), "tokens")
    return Corpus(rows, vector="v", tokens="tokens")


@query(
    "validate_index",
    f"""with {_H}, c as (select * from h union all select * from h where id % 50 = 0), d as (select case when id % 70 <> 1 then id end as id,
      case when id % 30 = 2 then v[1:10] when id % 40 = 3 then list_transform(v, lambda x: 'nan'::double) else v end as v, len(tokens) as dl from c),
    z as (select len(v) as s from d group by s order by count(*) desc, s limit 1), t as (select id, sum(dl) as n from d where dl > 0 group by id),
    k as (select 'null_id' as "check", (select count(*) from d where id is null) as failures
      union all select 'repeated_id', (select count(*) from (select id from d where id is not null group by id having count(*) > 1))
      union all select 'dimension', (select count(*) from d, z where len(v) <> s) union all select 'finite', (select count(*) from d where len(list_filter(v, lambda x: isnan(x))) > 0)
      union all select 'postings', (select count(*) from d join t using (id) where dl > 0 and n <> dl) + (select count(*) * 1 from d where id is null and dl > 0) + (select count(*) from t where id is null))
    select "check", failures, null::varchar as note from k union all select 'recommendation', 0, case when (select sum(failures) from k) > 0 then 'corrupt' else 'healthy' end""",
)
def validate_index(spark, folder):
    return _dirty(spark, folder).validate(deep=True)


# ---- fusion

_TERMS, _TEXT, _MATCH = ["cache", "kernel", "verdict"], "cache | kernel | verdict", "tf_0 > 0 or tf_1 > 0 or tf_2 > 0"
_TWO = [_H, _Q, _dense_sql(30), _bm25_sql(_TERMS, _MATCH, 30)]
_SPAN = """, m2 as (select *, min(dense_sim) over () as d_low, max(dense_sim) over () as d_high, avg(dense_sim) over () as d_mean, stddev_samp(dense_sim) over () as d_sd, count(dense_sim) over () as d_n,
  min(bm25_score) over () as b_low, max(bm25_score) over () as b_high, avg(bm25_score) over () as b_mean, stddev_samp(bm25_score) over () as b_sd, count(bm25_score) over () as b_n from m)"""


def _rrf(k: float = 60, dense: float = 1, bm25: float = 1, late: float = 1) -> str:
    return f"coalesce({dense} / ({k} + dense_rank), 0) + coalesce({bm25} / ({k} + bm25_rank), 0) + coalesce({late} / ({k} + late_rank), 0)"


def _hybrid(limit: int | None = 15, search_options: dict | None = None, **options):
    def run(spark, folder):
        q = HybridQuery(vector=some_vectors(spark, folder)[0], text=_TEXT, **({"dense_k": 30, "bm25_k": 30} | options))
        return _shown(search.search(_indexed(spark, folder, hybrid), q, limit, **(search_options or {})))

    return run


query("rrf", _fused_sql(_TWO, ["dn", "bm"], _rrf(), 15))(_hybrid())
query("rrf_weights", _fused_sql(_TWO, ["dn", "bm"], _rrf(dense=0.5, bm25=2), 15))(_hybrid(dense_weight=0.5, bm25_weight=2.0))
query("rrf_k", _fused_sql(_TWO, ["dn", "bm"], _rrf(k=5), 15))(_hybrid(rrf_k=5))
query("final_k", _fused_sql(_TWO, ["dn", "bm"], _rrf(), 7))(_hybrid(None, final_k=7))
query("final_default", _fused_sql(_TWO, ["dn", "bm"], _rrf(), 10))(_hybrid(None))
query("require_bm25_match", _fused_sql(_TWO, ["dn", "bm"], _rrf(), 15, "bm25_rank is not null"))(_hybrid(require_bm25_match=True))
query("budget_zero_branch", _fused_sql([_H, _Q, _dense_sql(30)], ["dn"], _rrf(), 15))(_hybrid(bm25_k=0))
query("budget_from_limit", _fused_sql([_H, _Q, _dense_sql(40), _bm25_sql(_TERMS, _MATCH, 40)], ["dn", "bm"], _rrf(), 5))(_hybrid(5, dense_k=None, bm25_k=None))
_MINMAX = "case when {v} is null then 0 when {h} <= {l} then (case when {v} > 0 then 1 else 0 end) else ({v} - {l}) / ({h} - {l}) end"
query("weighted_alpha", _fused_sql(_TWO, ["dn", "bm"], f"0.3 * {_MINMAX.format(v='dense_sim', l='d_low', h='d_high')} + 0.7 * {_MINMAX.format(v='bm25_score', l='b_low', h='b_high')}", 15, extra=_SPAN))(_hybrid(fusion="weighted", alpha=0.3))
_FAST = "coalesce(1 / (1 + exp(-dense_sim)), 0) * {a} + (1 - {a}) * (case when bm25_score > 0 then bm25_score / (bm25_score + 1) else 0 end)"
query("fast_weighted", _fused_sql(_TWO, ["dn", "bm"], _FAST.format(a=0.5), 15))(_hybrid(fusion="fast_weighted"))
_ALPHA = "(select case when greatest(i0, i1, i2) >= 2.8 or (least(df_0, df_1, df_2) > 0 and least(df_0, df_1, df_2) <= greatest(4, n // 20)) then 0.35 when greatest(i0, i1, i2) < 1.5 or least(df_0, df_1, df_2) >= greatest(1, n // 2) then 0.7 else 0.5 end from (select *, ln(1 + (n - df_0 + 0.5) / (df_0 + 0.5)) as i0, ln(1 + (n - df_1 + 0.5) / (df_1 + 0.5)) as i1, ln(1 + (n - df_2 + 0.5) / (df_2 + 0.5)) as i2 from st))"
query("calibrated_shape", _fused_sql(_TWO, ["dn", "bm"], _FAST.format(a=_ALPHA) + " + case when dense_sim is not null and bm25_score is not null then 0.06 else 0 end", 15))(_hybrid(fusion="calibrated"))
_DBSF = "case when {v} is null then 0 when {n} < 10 or {s} is null or {s} = 0 then 0.5 else greatest(0, least(1, ({v} - ({m} - 3 * {s})) / (6 * {s}))) end"
query("dbsf", _fused_sql(_TWO, ["dn", "bm"], f"{_DBSF.format(v='dense_sim', n='d_n', s='d_sd', m='d_mean')} + 2 * {_DBSF.format(v='bm25_score', n='b_n', s='b_sd', m='b_mean')}", 15, extra=_SPAN))(_hybrid(fusion="dbsf", bm25_weight=2.0))
_ROBUST = """, m1 as (select *, abs(dense_sim - median(dense_sim) over ()) as d_off, abs(bm25_score - median(bm25_score) over ()) as b_off, median(dense_sim) over () as d_mean, median(bm25_score) over () as b_mean,
  count(dense_sim) over () as d_n, count(bm25_score) over () as b_n from m), m2 as (select *, 1.4826 * median(d_off) over () as d_sd, 1.4826 * median(b_off) over () as b_sd from m1)"""
query("dbsf_robust", _fused_sql(_TWO, ["dn", "bm"], f"{_DBSF.format(v='dense_sim', n='d_n', s='d_sd', m='d_mean')} + {_DBSF.format(v='bm25_score', n='b_n', s='b_sd', m='b_mean')}", 15, extra=_ROBUST))(_hybrid(fusion="dbsf", search_options={"robust": True}))
_RESCORE = f""", md as (select m.*, {_DISTANCE["cosine"]} as dd from m join h using (id), q), mr as (select * exclude (dense_rank, dense_dist, dense_sim), dd as dense_dist, -dd as dense_sim,
  coalesce(dense_rank, 1 + count(dense_rank) over (order by dd, id)) as dense_rank from md), m2 as (select * from mr)"""
query("bm25_only_rescore", _fused_sql(_TWO, ["dn", "bm"], _rrf(), 15, extra=_RESCORE))(_hybrid(search_options={"rescore": True}))


@query("filtered_hybrid", _fused_sql([_H, _Q, _dense_sql(30, where="label < 5"), _bm25_sql(_TERMS, _MATCH, 30, "label < 5")], ["dn", "bm"], _rrf(), 15))
def filtered_hybrid(spark, folder):
    q = HybridQuery(vector=some_vectors(spark, folder)[0], text=_TEXT, dense_k=30, bm25_k=30)
    return _shown(search.search(_indexed(spark, folder, hybrid), q, 15, F.col("label") < 5))


_POOL = _fused_sql([_H, _Q, _dense_sql(60), _bm25_sql(_TERMS, _MATCH, 60)], ["dn", "bm"], _rrf(), 60).replace("round(fused, 6) as fused", "fused as fused")


@query(
    "final_diversity",
    f"""with p as ({_POOL}), s as (select p.id, p.fused, e.label, (p.fused - min(p.fused) over ()) / (max(p.fused) over () - min(p.fused) over ()) as rel,
      row_number() over (partition by e.label order by p.fused desc, p.id) as nth from p join embeddings e on e.vec_id = p.id)
    select 0 as qid, id, label, round(fused, 6) as fused, (row_number() over (order by 0.7 * rel - case when nth > 1 then 0.3 else 0 end desc, fused desc, id))::int as rank from s qualify rank <= 10""",
)
def final_diversity(spark, folder):
    corpus = _indexed(spark, folder, hybrid)
    q = HybridQuery(vector=some_vectors(spark, folder)[0], text=_TEXT, dense_k=60, bm25_k=60)
    pool = search.search(corpus, q, 60).withColumn("qid", F.lit(0)).join(corpus.rows.select("id", "label"), "id")
    return fusion.diversify(pool, "label", 10).withColumn("fused", F.round("fused", 6))


_ASKED = "list_slice(list_sort(list_distinct(tokens)), 1, 5)"


def _batch_sql(fused: str, extra: str = "") -> str:
    """Every twentieth embedding is a query, with the first five words of its document in the order of the alphabet."""
    return f"""with {_H}, q as (select id as qid, v as q, {_ASKED} as terms from h where id % 20 = 0),
    dn as (select qid, id, -d as dense_sim, row_number() over (partition by qid order by d, id) as dense_rank from (select qid, id, {_DISTANCE["cosine"]} as d from h, q) qualify dense_rank <= 30),
    st as (select count(*) as n, sum(len(tokens)) / count(*) as avgdl from h),
    p as (select id, term, count(*) as tf, dl from (select id, len(tokens) as dl, unnest(tokens) as term from h) group by id, term, dl),
    f0 as (select term, count(*) as df from p group by term),
    bm as (select qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * greatest(dl, 1) / greatest(avgdl, 1)))) as s
      from (select qid, unnest(terms) as term from q) a join p using (term) join f0 using (term), st group by qid, id),
    bq as (select qid, id, s as bm25_score, row_number() over (partition by qid order by round(s, 9) desc, id) as bm25_rank from bm qualify bm25_rank <= 30){extra},
    f as (select qid, id, {fused} as fused, dense_rank, bm25_rank from dn full outer join bq using (qid, id))
    select qid, id, round(fused, 6) as fused, dense_rank::int as dense_rank, bm25_rank::int as bm25_rank, (row_number() over (partition by qid order by fused desc,
      (dense_rank is not null and bm25_rank is not null) desc, dense_rank asc nulls last, bm25_rank asc nulls last, id))::int as rank from f qualify rank <= 10"""


def _batch(spark, folder, **options):
    """All rows whose number is divisible by 20 are queries, against all rows."""
    corpus = _indexed(spark, folder, hybrid)
    asked = corpus.rows.where("id % 20 = 0").select("id", "v", F.slice(F.array_sort(F.array_distinct("tokens")), 1, 5).alias("terms")).collect()
    queries = [(r.id, HybridQuery(vector=list(r.v), text=" | ".join(r.terms) if r.terms else None, dense_k=30, bm25_k=30, **options)) for r in asked]
    return search.search_batch(corpus, queries, 10).select("qid", "id", F.round("fused", 6).alias("fused"), "dense_rank", "bm25_rank", "rank")


query("batch_queries_rrf", _batch_sql("coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0)"))(lambda spark, folder: _batch(spark, folder))
_ALPHA_EACH = f""", sg as (select qid, max(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) as high, min(coalesce(df, 0)) as low, count(*) as terms,
      bool_or(len(term) >= 16 or (len(term) >= 6 and regexp_matches(term, '\\p{{L}}') and regexp_matches(term, '\\p{{N}}'))) as named, any_value(n) as n
      from (select qid, unnest(terms) as term from q) left join f0 using (term), st group by qid),
    al as (select qid, case when named or high >= 2.8 or (low > 0 and low <= greatest(4, n // 20)) then 0.35 when terms >= 2 and (high < 1.5 or low >= greatest(1, n // 2)) then 0.7 else 0.5 end as alpha from sg)"""
_EACH = "(select alpha from al where al.qid = coalesce(dn.qid, bq.qid))"
query(
    "batch_queries_calibrated",
    _batch_sql(_FAST.format(a=f"coalesce({_EACH}, 0.5)") + " + case when dense_sim is not null and bm25_score is not null then 0.06 else 0 end", _ALPHA_EACH),
)(lambda spark, folder: _batch(spark, folder, fusion="calibrated"))


# ---- late interaction


def _late_query(spark, folder, **options) -> HybridQuery:
    return HybridQuery(multivector=Multivector.of(some_vectors(spark, folder, 3)), multivector_k=20, **options)


query("maxsim_topk", _fused_sql([_MV, _QM, _late_sql(20)], ["lt"], _rrf(), 15))(lambda spark, folder: _shown(search.search(late(spark, folder), _late_query(spark, folder), 15)))
_WEIGHTED = "list_max(list_transform(mv, lambda d: list_inner_product(q[1], d))) * 2 + list_max(list_transform(mv, lambda d: list_inner_product(q[3], d))) * 0.5"


@query("maxsim_weighted_masked", f"with {_MV}, {_QM}, {_late_sql(15, _WEIGHTED, 2.5)} select id, round(maxsim, 6) as maxsim, round(late_sim, 6) as late_sim, late_rank::int as rank from lt")
def maxsim_weighted_masked(spark, folder):
    q = _late_query(spark, folder, token_weights=(2.0, 1.0, 0.5), token_skip=(False, True, False))
    got = branches.late(late(spark, folder), q.multivector, q.weights(), 15)
    return got.select("id", F.round("maxsim", 6).alias("maxsim"), F.round("late_sim", 6).alias("late_sim"), F.col("late_rank").alias("rank"))


query("mv_bm25_rrf", _fused_sql([_MVL, _QM, _late_sql(20), _bm25_sql(_TERMS, _MATCH, 20)], ["lt", "bm"], _rrf(), 15))(
    lambda spark, folder: _shown(search.search(_indexed(spark, folder, late_with_text), _late_query(spark, folder, text=_TEXT, bm25_k=20), 15))
)


@query("mv_functions", f"with {_MV}, {_QM} select id, len(mv[1]) as dims, len(mv) as n, round(list_sum(mv[2]), 6) as second, round({_MAXSIM}, 6) as maxsim, round(-({_MAXSIM}), 6) as distance from h, q")
def mv_functions(spark, folder):
    q, mv = Multivector.of(some_vectors(spark, folder, 3)).literal(), F.col("mv")
    total = F.aggregate(multivector.subvector(mv, 2), F.lit(0.0), lambda s, x: s + x.cast("double"))
    score = multivector.maxsim(q, mv)
    return late(spark, folder).rows.select("id", multivector.dims(mv).alias("dims"), multivector.count(mv).alias("n"), F.round(total, 6).alias("second"), F.round(score, 6).alias("maxsim"), F.round(-score, 6).alias("distance"))


_PART = "list_sum(list_transform(q, lambda a: list_max(list_transform({m}, lambda d: list_inner_product(a, d)))))"


@query("maxsim_context", f"with {_MV}, {_QM} select id, round(greatest({_PART.format(m='mv[1:3]')}, {_PART.format(m='mv[4:]')}), 6) as score from h, q where len(mv) > 3")
def maxsim_context(spark, folder):
    q = Multivector.of(some_vectors(spark, folder, 3)).literal()
    contexts = F.array(F.lit(0), F.lit(3))
    return late(spark, folder).rows.where("size(mv) > 3").select("id", F.round(multivector.context_maxsim(q, F.col("mv"), contexts), 6).alias("score"))


@query("maxsim_field", f"with {_MV}, {_QM} select id, round(0.5 * greatest({_PART.format(m='mv[1:1]')}, {_PART.format(m='mv[4:]')}) + 2 * {_PART.format(m='mv[2:3]')}, 6) as score from h, q where len(mv) > 3")
def maxsim_field(spark, folder):
    q = Multivector.of(some_vectors(spark, folder, 3)).literal()
    contexts, fields = F.array(F.lit(0), F.lit(1), F.lit(3)), F.array(F.lit(0), F.lit(1), F.lit(0))
    return late(spark, folder).rows.where("size(mv) > 3").select("id", F.round(multivector.field_maxsim(q, F.col("mv"), contexts, fields, {0: 0.5, 1: 2.0}), 6).alias("score"))


@query(
    "symmetric_maxsim",
    f"with {_MV}, {_QM} select id, round(0.5 * ({_MAXSIM} / len(q) + list_sum(list_transform(mv, lambda d: list_max(list_transform(q, lambda a: list_inner_product(a, d))))) / len(mv)), 6) as score from h, q",
)
def symmetric_maxsim(spark, folder):
    q = Multivector.of(some_vectors(spark, folder, 3)).literal()
    return late(spark, folder).rows.select("id", F.round(multivector.symmetric_maxsim(q, F.col("mv")), 6).alias("score"))


_UNNESTED = f"{_MV}, t as (select id, unnest(mv) as v, unnest(range(len(mv))) as o from h), x as (select id, o, unnest(v) as e, unnest(range(len(v))) as i from t)"


@query(
    "proxy_encoders",
    f"with {_UNNESTED} select id, i::int as i, round(avg(e), 6) as mean, round(max(e), 6) as max_pool, round(arg_min(e, o), 6) as first, round(case when max(e) >= -min(e) then max(e) else min(e) end, 6) as max_abs from x group by id, i",
)
def proxy_encoders(spark, folder):
    mv, dim = F.col("mv"), len(some_vectors(spark, folder)[0])
    encoded = late(spark, folder).rows.select("id", F.arrays_zip(multivector.mean(mv, dim).alias("mean"), multivector.max_pool(mv, dim).alias("max_pool"), multivector.first_vector(mv).alias("first"), multivector.max_abs(mv, dim).alias("max_abs")).alias("z"))
    flat = encoded.select("id", F.posexplode("z").alias("i", "z"))
    return flat.select("id", "i", *[F.round(F.col(f"z.{c}").cast("double"), 6).alias(c) for c in ("mean", "max_pool", "first", "max_abs")])


@query("proxy_two_stage", f"with {_MV}, {_QM}, {_late_sql(10)} select id, round(maxsim, 6) as maxsim, late_rank::int as rank from lt")
def proxy_two_stage(spark, folder):
    """With as many rows admitted as there are, so that the result is that of the exact search."""
    corpus = late(spark, folder)
    got = branches.late_by_proxy(corpus, Multivector.of(some_vectors(spark, folder, 3)), 10, 1_000_000)
    return got.select("id", F.round("maxsim", 6).alias("maxsim"), F.col("late_rank").alias("rank"))


_HITS = """th as (select o::int as q_ord, id, list_max(list_transform(mv, lambda d: list_inner_product(a, d))) as sim from h, (select unnest(q) as a, unnest(range(len(q))) as o from q)),
tr as (select *, row_number() over (partition by q_ord order by sim desc, id) as r from th qualify r <= 12)"""


@query("per_token_topk", f"with {_MV}, {_QM}, {_HITS} select q_ord, id, round(sim, 6) as sim, r::int as token_rank from tr")
def per_token_topk(spark, folder):
    got = branches.token_hits(late(spark, folder), Multivector.of(some_vectors(spark, folder, 3)), 12)
    return got.select("q_ord", "id", F.round("sim", 6).alias("sim"), "token_rank")


@query(
    "candidate_reservoirs",
    f"""with {_MV}, {_QM}, {_HITS}, g as (select id, sum(sim) as a, max(sim) as b, count(*) as c, avg(sim) as d from tr group by id)
    select distinct id from ((select id from g order by a desc, id limit 5) union all (select id from g order by b desc, id limit 5) union all (select id from g order by c desc, id limit 5) union all (select id from g order by d desc, id limit 5))""",
)
def candidate_reservoirs(spark, folder):
    return branches.reservoirs(late(spark, folder), Multivector.of(some_vectors(spark, folder, 3)), 12, 5)


@query("kmeans_pooling")
def kmeans_pooling(spark, folder):
    return late(spark, folder).rows.select("id", F.size(multivector.pooled(0.5)("mv")).alias("vectors"))


# ---- life of a corpus


@query("tombstone_search", f"with {_H.replace('d.doc_id = e.vec_id', 'd.doc_id = e.vec_id and d.doc_id % 3 <> 0')}, {_Q}, {_dense_sql(20)} select id, round(dense_dist, 6) as dist, dense_rank::int as rank from dn")
def tombstone_search(spark, folder):
    corpus = hybrid(spark, folder)
    left = corpus.delete(corpus.table.where("id % 3 = 0").select("id"))
    got = branches.dense(left, some_vectors(spark, folder)[0], 20)
    return got.select("id", F.round("dense_dist", 6).alias("dist"), F.col("dense_rank").alias("rank"))


@query("delta_equals_rebuild", _fused_sql(_TWO, ["dn", "bm"], _rrf(), 15))
def delta_equals_rebuild(spark, folder):
    whole = hybrid(spark, folder)
    halves = Corpus(whole.table.where("id % 2 = 0"), vector="v", tokens="tokens").insert(whole.table.where("id % 2 = 1"))
    return _shown(search.search(halves, HybridQuery(vector=some_vectors(spark, folder)[0], text=_TEXT, dense_k=30, bm25_k=30), 15))


@query("compacted_stats", f"with {_H.replace('d.doc_id = e.vec_id', 'd.doc_id = e.vec_id and d.doc_id % 4 <> 0')} select count(*) as total_count, count(*) as live_count, max(len(v)) as dim, count(tokens) as lexical_count, round(sum(len(tokens)) / count(tokens), 6) as mean_length, 0 as dead_count, 0.0::double as dead_ratio from h")
def compacted_stats(spark, folder):
    corpus = hybrid(spark, folder)
    return corpus.delete(corpus.table.where("id % 4 = 0").select("id")).compact().stats()


# ---- quantised codes


@query("quantised_topk")
def quantised_topk(spark, folder):
    """A coarse list by 4-bit codes, reranked exactly."""
    return quantise.coarse_then_exact(hybrid(spark, folder), some_vectors(spark, folder)[0], 10, oversample=8).select("id", F.round("dense_dist", 6).alias("dist"), F.col("dense_rank").alias("rank"))


@query("dimension_corrections", "select i::int as i, round(-avg(e), 5) as shift, round(1 / stddev_samp(e), 4) as scale from (select unnest(embedding::double[]) as e, unnest(range(len(embedding))) as i from embeddings) group by i")
def dimension_corrections(spark, folder):
    return quantise.corrections(read_table(spark, folder, "embeddings"), "embedding").select("i", F.round("shift", 5).alias("shift"), F.round("scale", 4).alias("scale"))


# ---- text encoders


@query("stub_encoder", "select item_id, 3 as vectors, 4 as dims, 2.0::double as maxsim from eval_items")
def stub_encoder(spark, folder):
    from quillrank.functions import encode

    stub = encode.StubEncoder()
    both = read_table(spark, folder, "eval_items").select("item_id", encode.tokens_udf(stub, "doc")(F.col("text")).alias("d"), encode.tokens_udf(stub, "query")(F.col("text")).alias("q"))
    return both.select("item_id", F.size("d").alias("vectors"), F.size(F.col("d")[0]).alias("dims"), multivector.maxsim(F.col("q"), F.col("d")).alias("maxsim"))
