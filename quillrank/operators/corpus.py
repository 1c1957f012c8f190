"""A searchable corpus over a table, its statistics and checks, and its life under inserts, deletes and compaction."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import vectors
from quillrank.sources import stage_table


@dataclass(frozen=True)
class LexicalIndex:
    """The stored inverted index of a corpus: ``postings`` (``id, term, tf, dl``, in files by term and sorted by it), ``lexicon`` (``term, df, cf``), the number of lexical documents and their mean length."""

    postings: DataFrame
    lexicon: DataFrame
    docs: int
    mean_length: float


@dataclass(frozen=True)
class Corpus:
    """A table with a unique ``id`` and any of a vector, a token-list and a multivector column (vector or multivector, not both).

    A row without its vector (or multivector) is in no branch; under cosine, neither is one whose vector is all zero. A row with NULL tokens is no
    lexical document, one with an empty list counts as one of length 0. Further columns can be filtered on. With an ``index`` (``with_index``), lexical
    searches read postings and never the token lists; a change of the rows drops it.
    """

    table: DataFrame
    id: str = "id"
    vector: str | None = None
    tokens: str | None = None
    multivector: str | None = None
    metric: str = "cosine"
    deleted: DataFrame | None = None
    index: LexicalIndex | None = None

    def __post_init__(self):
        if self.metric not in vectors.RANKING:
            raise ValueError(f"unknown metric {self.metric!r}")
        if not (self.vector or self.tokens or self.multivector):
            raise ValueError("a corpus needs a vector, tokens or a multivector")
        if self.vector and self.multivector:
            raise ValueError("a corpus has a vector or a multivector, not both")
        missing = [c for c in (self.id, self.vector, self.tokens, self.multivector) if c and c not in self.table.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")

    @property
    def rows(self) -> DataFrame:
        """The rows that can be found."""
        df = self.table
        if self.deleted is not None:
            df = df.join(self.deleted.select(self.id).distinct(), self.id, "left_anti")
        if self.vector:
            df = df.where(F.col(self.vector).isNotNull())
            if self.metric == "cosine":
                df = df.where(F.exists(self.vector, lambda x: x != 0))
        if self.multivector:
            df = df.where(F.size(self.multivector) > 0)
        return df

    # ---- lexical tables

    def docstats(self) -> DataFrame:
        """``id, dl`` of every lexical document."""
        return self.rows.where(F.col(self.tokens).isNotNull()).select(F.col(self.id).alias("id"), F.size(self.tokens).alias("dl"))

    def postings(self) -> DataFrame:
        """``id, term, tf, dl``."""
        exploded = self.rows.select(F.col(self.id).alias("id"), F.size(self.tokens).alias("dl"), F.explode(self.tokens).alias("term"))
        return exploded.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")

    def lexicon(self) -> DataFrame:
        """``term, df, cf`` of every term."""
        counts = self.index.postings if self.index else self.postings()
        return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def with_index(self, files: int = 16) -> Corpus:
        """With its postings and lexicon written to the shared folder, in ``files`` files by term, so that a query's terms leave most of them unread."""
        if not self.tokens:
            raise ValueError("the corpus has no tokens")
        postings = stage_table(self.postings().repartition(files, "term").sortWithinPartitions("term", "id"), "postings")
        lexicon = stage_table(postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "lexicon")
        n, mean = self.docstats().agg(F.count("*"), F.sum("dl") / F.count("*")).first()
        return replace(self, index=LexicalIndex(postings, lexicon, n, mean or 0.0))

    def write_postings(self, path: str, files: int = 16) -> None:
        """The postings as Parquet, sorted by term in files by term, so that a query's terms prune row groups."""
        self.postings().repartition(files, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)

    # ---- life

    def insert(self, rows: DataFrame) -> Corpus:
        """With new rows; those whose id was deleted earlier count again."""
        deleted = self.deleted and self.deleted.join(rows.select(self.id).distinct(), self.id, "left_anti")
        old = self.table.join(self.deleted.select(self.id).distinct(), self.id, "left_anti") if self.deleted is not None else self.table
        return replace(self, table=old.unionByName(rows.select(*self.table.columns)), deleted=deleted, index=None)

    def delete(self, ids: DataFrame) -> Corpus:
        """Without the rows of these ids, which stay in the table until it is compacted."""
        gone = ids.select(self.id)
        return replace(self, deleted=gone if self.deleted is None else self.deleted.select(self.id).unionByName(gone), index=None)

    def update(self, rows: DataFrame) -> Corpus:
        """A delete and an insert."""
        return self.delete(rows.select(self.id)).insert(rows)

    def compact(self) -> Corpus:
        """The live rows alone, written anew."""
        live = self.table if self.deleted is None else self.table.join(self.deleted.select(self.id).distinct(), self.id, "left_anti")
        return replace(self, table=stage_table(live, "corpus"), deleted=None)

    def prewarm(self) -> Corpus:
        """With the findable rows in the executors' memory, and on disk where that is short."""
        held = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        held.count()
        return replace(self, table=held, deleted=None)

    # ---- operations

    def stats(self) -> DataFrame:
        """One row: rows in the table, live and dead ones, their share, dimension, lexical documents and their mean length."""
        one = self.table.agg(F.count("*").alias("total_count"))
        columns = [F.count("*").alias("live_count")]
        columns.append(F.max(F.size(self.vector)).alias("dim") if self.vector else F.max(F.size(F.col(self.multivector)[0])).alias("dim") if self.multivector else F.lit(None).cast("int").alias("dim"))
        if self.tokens:
            columns += [F.count(self.tokens).alias("lexical_count"), F.round(F.sum(F.when(F.col(self.tokens).isNotNull(), F.size(self.tokens))) / F.count(self.tokens), 6).alias("mean_length")]
        both = one.crossJoin(self.rows.agg(*columns))
        dead = (F.col("total_count") - F.col("live_count")).alias("dead_count")
        return both.select("*", dead, F.round((F.col("total_count") - F.col("live_count")) / F.greatest("total_count", F.lit(1)), 6).alias("dead_ratio"))

    def memory(self) -> DataFrame:
        """One row: estimated bytes of vectors, multivectors and postings, from lengths alone."""
        floats = lambda c: F.coalesce(F.sum(4 * c), F.lit(0))
        none = F.lit(0)
        dense = floats(F.size(self.vector)) if self.vector else none
        late = floats(F.size(self.multivector) * F.size(F.col(self.multivector)[0])) if self.multivector else none
        lexical = F.coalesce(F.sum(F.when(F.col(self.tokens).isNotNull(), 12 * F.size(F.array_distinct(self.tokens)))), F.lit(0)) if self.tokens else none
        return self.rows.agg(dense.cast("long").alias("vector_bytes"), late.cast("long").alias("multivector_bytes"), lexical.cast("long").alias("postings_bytes"))

    def validate(self, deep: bool = False) -> DataFrame:
        """``check, failures`` for each check, and a last row ``recommendation`` with 0 and its text in ``note``.

        Checks: ids that repeat or are NULL, vectors of another dimension than most, non-finite or NULL elements; with ``deep``, whether
        the postings add up to the documents' lengths. Failures make it ``corrupt``, a fifth of dead rows ``reindex``, some ``monitor_churn``, else it is ``healthy``.
        """
        rows = self.rows
        checks = [
            ("null_id", rows.where(F.col(self.id).isNull()).agg(F.count("*").alias("failures"))),
            ("repeated_id", rows.where(F.col(self.id).isNotNull()).groupBy(self.id).count().where("count > 1").agg(F.count("*").alias("failures"))),
        ]
        if self.vector:
            size = rows.groupBy(F.size(self.vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
            checks.append(("dimension", rows.join(F.broadcast(size), F.size(self.vector) != F.col("d")).agg(F.count("*").alias("failures"))))
            checks.append(("finite", rows.where(~vectors.valid(F.col(self.vector))).agg(F.count("*").alias("failures"))))
        if self.multivector:
            checks.append(("finite", rows.where(F.exists(self.multivector, lambda v: ~vectors.valid(v))).agg(F.count("*").alias("failures"))))
            checks.append(("dimension", rows.where(F.exists(self.multivector, lambda v: F.size(v) != F.size(F.col(self.multivector)[0]))).agg(F.count("*").alias("failures"))))
        if self.tokens and deep:
            added = self.postings().groupBy("id").agg(F.sum("tf").alias("n"))
            wrong = self.docstats().where("dl > 0").join(added, "id", "full_outer").where("n is null or dl is null or n != dl")
            checks.append(("postings", wrong.agg(F.count("*").alias("failures"))))
        out = None
        for name, df in checks:
            part = df.select(F.lit(name).alias("check"), "failures")
            out = part if out is None else out.unionByName(part)
        failures = out.agg(F.sum("failures").alias("bad")).crossJoin(self.stats().select("dead_ratio"))
        verdict = F.when(F.col("bad") > 0, "corrupt").when(F.col("dead_ratio") >= 0.2, "reindex").when(F.col("dead_ratio") > 0, "monitor_churn").otherwise("healthy")
        last = failures.select(F.lit("recommendation").alias("check"), F.lit(0).cast("long").alias("failures"), verdict.alias("note"))
        return out.withColumn("note", F.lit(None).cast("string")).unionByName(last)
