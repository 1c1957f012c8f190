"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources import current_rows, read_table

from . import clustering, distinctiveness, leakage, near_duplicates, neighbours, packing, ranking, splitting, subjects, term_frequency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HYBRID, PASSAGES, LATE, PLANS = "hybrid_documents", "passages", "pg_colbert_llama_passages", "token_plan_red_planet_query"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def current(spark: SparkSession, folder: str, name: str, *columns: str, key: str = "id") -> DataFrame:
    return current_rows(read_table(spark, folder, name), key, [key, *columns])


def _now(name: str, key: str = "id") -> str:
    """SQL for the current rows of a table."""
    return f"(select * from {name} where {key} is not null qualify row_number() over (partition by {key} order by ingested_at desc) = 1)"


def _terms(name: str) -> str:
    return f"(select id, lower(trim(t, ' \t\n\r')) as term from (select id, unnest(body_tsv) as t from {_now(name)}) where t is not null and trim(t, ' \t\n\r') <> '')"


# ---- 1


@query(
    "p1_found",
    f"""with t as {_terms(HYBRID)}, c as (select term, count(distinct id) as records from t group by term), n as (select count(body_tsv) as n from {_now(HYBRID)})
    select term, case when records < 3 then 'rare' else 'common' end as mark from c, n where records < 3 or records > 0.2 * n""",
)
def p1_found(spark, folder):
    return QUERIES["p1_frequencies"](spark, folder).where("mark is not null").select("term", "mark")


@query(
    "p1_frequencies",
    f"""with t as {_terms(HYBRID)}, c as (select term, count(*) as occurrences, count(distinct id) as records from t group by term), n as (select count(body_tsv) as n from {_now(HYBRID)})
    select term, occurrences, records, case when records < 3 then 'rare' when records > 0.2 * n then 'common' end as mark from c, n""",
)
def p1_frequencies(spark, folder):
    return term_frequency.term_frequencies(current(spark, folder, HYBRID, "body_tsv"), "body_tsv")


# ---- 2


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + {c!r})"
    return out


def _inverse_normal(p: str) -> str:
    """SQL for the inverse normal distribution by rational approximations, good to nine digits."""
    # fixed values: Acklam's coefficients
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    middle, tail = f"(({p} - 0.5) * ({p} - 0.5))", "sqrt(-2 * ln({}))"
    low, high = tail.format(p), tail.format(f"(1 - {p})")
    return f"""case when {p} < 0.02425 then ({_polynomial(c, low)}) / ({_polynomial(d, low)}) when {p} > 0.97575 then -({_polynomial(c, high)}) / ({_polynomial(d, high)})
      else ({_polynomial(a, middle)}) * ({p} - 0.5) / ({_polynomial(b, middle)}) end"""


def _standing(name: str) -> str:
    """SQL for the percentile of a score among all documents of a query, ties averaged; those without it are tied below."""
    return f"(rank() over (partition by query_id order by coalesce({name}, -1e300)) - 1 + count(*) over (partition by query_id, coalesce({name}, -1e300)) / 2) / count(*) over (partition by query_id)"


_RANKING = f"""with d as (select id::bigint as id, embedding::double[] as v, body_tsv from {_now(HYBRID)}), q as (select query_id, vector_query::double[] as qv, text_query, multivector_query::double[][] as qm from search_queries),
    t as (select id, term, count(*) as tf from {_terms(HYBRID)} group by id, term), l as (select id, sum(tf) as dl from t group by id),
    st as (select (select count(body_tsv) from d) as n, (select sum(dl) from l) / (select count(body_tsv) from d) as avgdl), df as (select term, count(*) as df from t group by term),
    qt as (select distinct query_id, lower(trim(w, ' \t\n\r')) as term from (select query_id, unnest(text_query) as w from q) where trim(w, ' \t\n\r') <> ''),
    lx as (select query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {ranking.K1 + 1} / (tf + {ranking.K1} * ({1 - ranking.B} + {ranking.B} * greatest(dl, 1) / greatest(avgdl, 1)))) as s1 from qt join t using (term) join df using (term) join l using (id), st group by query_id, id),
    p as (select document_id as id, list_filter(colbert::double[][], lambda x: len(x) = 16 and list_inner_product(x, x) > 0) as mv from {_now(PASSAGES)} where document_id is not null),
    lt as (select query_id, id, max(list_sum(list_transform(qm, lambda a: list_max(list_transform(mv, lambda b: list_inner_product(a, b)))))) as s2 from p, q where len(mv) > 0 group by query_id, id),
    s as (select query_id, id, case when len(v) = 32 and list_inner_product(v, v) > 0 then list_inner_product(v, qv) / sqrt(list_inner_product(v, v) * list_inner_product(qv, qv)) end as s0, s1, s2
      from q cross join d left join lx using (query_id, id) left join lt using (query_id, id)),
    u as (select query_id, id, {_standing("round(s0, 14)")} as p0, {_standing("round(s1, 12)")} as p1, {_standing("round(s2, 12)")} as p2 from s),
    z as (select query_id, id, {_inverse_normal("p0")} as z0, {_inverse_normal("p1")} as z1, {_inverse_normal("p2")} as z2 from u),
    r as (select *, row_number() over (partition by query_id order by round(z0 + z1 + z2, 8) desc, id) as rank from z qualify rank <= 5)"""


@query(
    "p2_ranking",
    f"{_RANKING} select query_id, id, rank::int as rank, round((z0 + z1 + z2) / 3, 5) as score, round(z0, 5) as z_dense, round(z1, 5) as z_lexical, round(z2, 5) as z_late from r",
)
def p2_ranking(spark, folder):
    docs = current(spark, folder, HYBRID, "embedding", "body_tsv").select("id", F.col("embedding").alias("vec"), F.col("body_tsv").alias("terms"))
    passages = current(spark, folder, PASSAGES, "document_id", "colbert").select("document_id", F.col("colbert").alias("late"))
    asked = read_table(spark, folder, "search_queries").select("query_id", F.col("vector_query").alias("vec"), F.col("text_query").alias("terms"), F.col("multivector_query").alias("late"))
    found = ranking.rank_documents(docs, passages, asked, dense_dim=32, late_dim=16)
    return found.select("query_id", "id", "rank", *[F.round(c, 5).alias(c) for c in ("score", "z_dense", "z_lexical", "z_late")])


@query("p2_found", f"{_RANKING} select query_id, id from r")
def p2_found(spark, folder):
    return QUERIES["p2_ranking"](spark, folder).select("query_id", "id")


# ---- 3


def _duplicates(spark, folder):
    return (
        (LATE, near_duplicates.near_texts(current(spark, folder, LATE, "body"), "id", "body")),
        (HYBRID, near_duplicates.near_vectors(current(spark, folder, HYBRID, "embedding"), "id", "embedding", 32)),
    )


@query(
    "p3_found",
    f"""with w as (select id::bigint as id, unnest(list_distinct(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+'))) as word from {_now(LATE)}),
    c as (select id, count(*) as n from w group by id),
    j as (select x.id as a, y.id as b, count(*) as n from w x join w y using (word) where x.id < y.id group by x.id, y.id),
    v as (select id::bigint as id, embedding::double[] as v from {_now(HYBRID)} where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0)
    select '{LATE}' as table_name, a as id_a, b as id_b from j join c p on p.id = a join c q on q.id = b where j.n >= 0.75 * (p.n + q.n - j.n)
    union all select '{HYBRID}', x.id, y.id from v x join v y on x.id < y.id
    where list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) >= 0.98""",
)
def p3_found(spark, folder):
    parts = [d.pairs().select(F.lit(name).alias("table_name"), "id_a", "id_b") for name, d in _duplicates(spark, folder)]
    return parts[0].unionByName(parts[1])


def _groups_sql(name: str, classes: str, links: str) -> str:
    """``classes``: SQL of ``id`` and ``content``; ``links``: SQL of the pairs ``a, b`` of classes that qualify, both ways, from ``k`` (``class_id, content``)."""
    return f"""select id, class_id, copies, coalesce(links, 0) as links, coalesce(group_id, class_id) as group_id, '{name}' as table_name from (
      with recursive m as (select id, min(id) over (partition by content) as class_id, count(*) over (partition by content) as copies, content from ({classes})),
      k as materialized (select distinct class_id, content from m where id = class_id), e as materialized ({links}), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
      select m.id, m.class_id, m.copies, g.links, h.group_id from m left join (select a as class_id, count(*) as links from e group by a) g using (class_id)
      left join (select a as class_id, least(a, min(b)) as group_id from r group by a) h using (class_id))"""


_WORD_SETS = f"select id::bigint as id, list_sort(list_distinct(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+'))) as content from {_now(LATE)} where len(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) > 0"
_WORD_LINKS = """select x.class_id as a, y.class_id as b from (select class_id, len(content) as n, unnest(content) as w from k) x join (select class_id, len(content) as n, unnest(content) as w from k) y using (w)
      where x.class_id <> y.class_id group by x.class_id, y.class_id, x.n, y.n having count(*) >= 0.75 * (x.n + y.n - count(*))"""
_VECTOR_SETS = f"select id::bigint as id, embedding::double[] as content from {_now(HYBRID)} where len(embedding) = 32 and list_inner_product(embedding::double[], embedding::double[]) > 0"
_VECTOR_LINKS = """select x.class_id as a, y.class_id as b from k x join k y on x.class_id <> y.class_id
      where list_inner_product(x.content, y.content) / sqrt(list_inner_product(x.content, x.content) * list_inner_product(y.content, y.content)) >= 0.98"""


@query("p3_groups", f"{_groups_sql(LATE, _WORD_SETS, _WORD_LINKS)} union all {_groups_sql(HYBRID, _VECTOR_SETS, _VECTOR_LINKS)}")
def p3_groups(spark, folder):
    parts = [d.groups().withColumn("table_name", F.lit(name)) for name, d in _duplicates(spark, folder)]
    return parts[0].unionByName(parts[1])


# ---- 4

_BODY = "trim(body, ' ' || chr(10) || chr(13))"
_IDS = "token_ids_after_padding_truncation"


@query(
    "p4_found",
    f"""select '{LATE}' as table_name, id::bigint as id from {_now(LATE)} where length({_BODY}) > 1000
    union all select '{PLANS}', plan_id::bigint from (select plan_id, max(o) as size from
      (select plan_id, unnest({_IDS}) as v, unnest(range(1, len({_IDS}) + 1)) as o from {_now(PLANS, "plan_id")}) where v is null or v <> 103 group by plan_id) where size > 128""",
)
def p4_found(spark, folder):
    texts = splitting.split_texts(current(spark, folder, LATE, "body"), "id", "body", with_text=False).select(F.lit(LATE).alias("table_name"), "id", "piece")
    plans = splitting.split_sequences(current(spark, folder, PLANS, _IDS, key="plan_id"), "plan_id", _IDS).select(F.lit(PLANS).alias("table_name"), "id", "piece")
    return texts.unionByName(plans).where("piece = 1").drop("piece")


@query("p4_text_pieces")
def p4_text_pieces(spark, folder):
    return splitting.split_texts(current(spark, folder, LATE, "body"), "id", "body")


@query("p4_plan_pieces")
def p4_plan_pieces(spark, folder):
    return splitting.split_sequences(current(spark, folder, PLANS, _IDS, key="plan_id"), "plan_id", _IDS)


# ---- 5


def _found_terms(name: str) -> str:
    return f"select '{name}' as table_name, id::bigint as id, term from (select id, term, count(*) as tf, count(*) over (partition by term) as df from {_terms(name)} group by id, term) where tf >= 3 and df <= 5"


@query("p5_found", f"{_found_terms(HYBRID)} union all {_found_terms(LATE)}")
def p5_found(spark, folder):
    parts = []
    for name in (HYBRID, LATE):
        scored = distinctiveness.distinctive_terms(current(spark, folder, name, "body_tsv"), "id", "body_tsv", min_tf=3, max_df=5)
        parts.append(scored.select(F.lit(name).alias("table_name"), "id", "term"))
    return parts[0].unionByName(parts[1])


@query("p5_scores")
def p5_scores(spark, folder):
    parts = [distinctiveness.distinctive_terms(current(spark, folder, name, "body_tsv"), "id", "body_tsv").select(F.lit(name).alias("table_name"), "id", "term", "tf", "df", "elite", "score") for name in (HYBRID, LATE)]
    return parts[0].unionByName(parts[1])


# ---- 6

ORD = 1 << 20


def _near_sql(name: str, vectors: str) -> str:
    return f"""select distinct '{name}' as table_name, least(a, b) // {ORD} as id_a, (least(a, b) % {ORD})::int as ord_a, greatest(a, b) // {ORD} as id_b, (greatest(a, b) % {ORD})::int as ord_b from (
      select x.k as a, y.k as b, row_number() over (partition by x.k order by list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) desc, y.k) as r
      from {vectors} x join {vectors} y on x.k // {ORD} <> y.k // {ORD}) where r <= 5"""


_VECTORS = f"(select id * {ORD} as k, embedding::double[] as v from {_now(HYBRID)} where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0)"
_TOKENS = f"(select id::bigint * {ORD} + o as k, v::double[] as v from (select id, unnest(tokens) as v, unnest(range(len(tokens))) as o from {_now(PASSAGES)}) where list_inner_product(v::double[], v::double[]) > 0)"


@query("p6_found", _near_sql(HYBRID, _VECTORS) + " union all " + _near_sql(PASSAGES, _TOKENS))
def p6_found(spark, folder):
    both = None
    for name, ranked in (("hybrid_documents", near_documents(spark, folder)), ("passages", near_tokens(spark, folder))):
        pairs = ranked.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
        cut = [F.floor(F.col(c) / ORD).cast("long").alias(f"id_{c}") for c in "ab"]
        ords = [F.pmod(F.col(c), F.lit(ORD)).cast("int").alias(f"ord_{c}") for c in "ab"]
        part = pairs.select(F.lit(name).alias("table_name"), cut[0], ords[0], cut[1], ords[1])
        both = part if both is None else both.unionByName(part)
    return both


def near_documents(spark, folder):
    rows = current(spark, folder, HYBRID, "embedding").select((F.col("id") * ORD).alias("key"), "id", "embedding")
    return neighbours.nearest(rows, "key", "embedding", 32, own="id")


def near_tokens(spark, folder):
    rows = current(spark, folder, PASSAGES, "tokens").select(F.col("id").cast("long").alias("id"), F.posexplode("tokens").alias("ord", "vec"))
    return neighbours.nearest(rows.select((F.col("id") * ORD + F.col("ord")).alias("key"), "id", "vec"), "key", "vec", 16, own="id")


# ---- 7


def _mean_vector(column: str, dim: int):
    """The direction of the mean of the vectors of an array of vectors, those of another length left out: their sum."""
    good = f"filter({column}, v -> size(v) = {dim})"
    added = f"aggregate({good}, array_repeat(0D, {dim}), (s, v) -> zip_with(s, v, (x, y) -> x + y))"
    return F.expr(f"if(size({good}) > 0, transform({added}, x -> cast(x as float)), null)")


def _clusters(spark, folder):
    documents = clustering.cluster(current(spark, folder, HYBRID, "embedding"), "id", "embedding", 32)
    passages = clustering.cluster(current(spark, folder, PASSAGES, "tokens").select("id", _mean_vector("tokens", 16).alias("vec")), "id", "vec", 16)
    return (HYBRID, documents), (PASSAGES, passages)


@query("p7_found")
def p7_found(spark, folder):
    samples = read_table(spark, folder, "cluster_exemplars")
    both = None
    for (name, found), dim in zip(_clusters(spark, folder), (32, 16)):
        held = samples.where(F.col("table_name") == name).select(F.col("exemplar_id").cast("long").alias("id"), _mean_vector("vectors", dim).alias("vec")).where("vec is not null")
        wanted = clustering.match(found, held, dim).select(F.col("id").cast("int").alias("exemplar_id"), "cluster")
        part = found.members.join(wanted, "cluster").select("exemplar_id", "id")
        both = part if both is None else both.unionByName(part)
    return both


@query("p7_clusters")
def p7_clusters(spark, folder):
    parts = [c.summary().withColumn("table_name", F.lit(name)) for name, c in _clusters(spark, folder)]
    return parts[0].unionByName(parts[1])


# ---- 8


@query("p8_found")
def p8_found(spark, folder):
    return packing.pack(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text").where("n_pieces > 1 and piece = 0").select(F.col("id").alias("doc_id"))


@query("p8_containers")
def p8_containers(spark, folder):
    return packing.pack(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


# ---- 9

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _windows(key: str, table: str) -> str:
    return f"(select {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) as g from (select {key}, {_WORDS} as w from {table}) where len(w) >= 12)"


@query("p9_found", f"select distinct doc_id, item_id from {_windows('doc_id', 'documents')} join {_windows('item_id', 'eval_items')} using (g)")
def p9_found(spark, folder):
    found = leakage.find_leaks(read_table(spark, folder, "documents"), "doc_id", "text", read_table(spark, folder, "eval_items"), "item_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("item_id").cast("int").alias("item_id"))


@query("p9_near")
def p9_near(spark, folder):
    found = leakage.find_leaks(read_table(spark, folder, "documents"), "doc_id", "text", read_table(spark, folder, "eval_items"), "item_id", "text", width=12, edits=2, sampled=3)
    return found.select(F.col("id").alias("doc_id"), "item_id", "windows", "first_word")


# ---- 10


def _subjects(spark, folder):
    names = [r.subject for r in read_table(spark, folder, "subjects").orderBy("subject").collect() if r.subject]  # one classifier each
    documents = read_table(spark, folder, "documents")
    chain = subjects.train(documents, "doc_id", "text", "source", read_table(spark, folder, "subject_labels"), "doc_id", "subject", names)
    return documents, subjects.assign_subjects(documents, "doc_id", "text", "source", chain)


@query("p10_found")
def p10_found(spark, folder):
    return _subjects(spark, folder)[1].select(F.col("id").alias("doc_id"), "subject")


@query("p10_makeup")
def p10_makeup(spark, folder):
    documents, found = _subjects(spark, folder)
    about = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.regexp_extract(F.lower(F.col("lang")), "^([a-z]+)", 1), F.lit("und")).alias("lang"), "source")
    return about.join(found, "id").groupBy("lang", "source", "subject").agg(F.count("*").alias("documents"))
