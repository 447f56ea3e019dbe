"""How often every distinct term occurs and in how many records, kept up to date by deltas.

Counts are persistent: one row per term in a table partitioned by term bucket,
in a folder that ``TermCounts.create`` makes and ``TermCounts.open`` takes up
again in another session. A change of the collection is a set of added (+1),
deleted (-1) or changed records (the old one -1, the new one +1). Only these
are aggregated, on the map side first, into signed changes of occurrences and
records per term, and the changes are merged into the buckets they touch; other
buckets stay as written. Buckets are split in two when they hold more than
``ROWS_PER_BUCKET`` terms on average, so a bucket that is written anew for one
changed term is of bounded size, and merging has as many tasks as the table
needs.

Defined cases: null arrays and maps hold no terms; null and empty tags are no
terms; tags lose leading and trailing spaces and tabs, category keys are taken
as stored, and case and accents count; a term repeated within a record counts
each time as occurrence and once as record; a null map value adds 0
occurrences; counts that reach zero leave the table; an empty collection has no
terms and 0 records; input columns that are not named are not read; a commit
that failed half way leaves the state before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aulamill.llm.state import commit, latest
from aulamill.operators.work import delete_path, new_path

ROWS_PER_BUCKET = 250_000
RARE_BELOW = 3
COMMON_ABOVE = 0.1

COUNTS = "term_kind string, term string, n_occurrences long, n_records long"
TERMS = "array<struct<term:string,occurrences:bigint,records:bigint>>"


def tag_terms(tags: Column) -> Column:
    """array<struct<term, occurrences, records>> of an array of tags, one element per tag; the first of equal ones is the record's."""
    clean = F.filter(
        F.transform(tags, lambda t: F.regexp_replace(t, r"^[ \t]+|[ \t]+$", "")), lambda t: F.length(t) > 0
    )
    ordered = F.sort_array(clean)
    before = F.concat(F.array(F.lit(None).cast("string")), ordered)
    each = F.zip_with(
        ordered,
        before,
        lambda t, last: F.struct(
            t.alias("term"), F.lit(1).cast("long").alias("occurrences"), (~t.eqNullSafe(last)).cast("long").alias("records")
        ),
    )
    return F.filter(each, lambda x: x["term"].isNotNull())


def map_terms(counts: Column) -> Column:
    """array<struct<term, occurrences, records>> of a map from term to number."""
    return F.transform(
        F.map_entries(counts),
        lambda e: F.struct(
            e["key"].alias("term"),
            F.coalesce(e["value"], F.lit(0)).cast("long").alias("occurrences"),
            F.lit(1).cast("long").alias("records"),
        ),
    )


def signed_delta(changes: DataFrame) -> DataFrame:
    """Signed changes per term of ``changes(sign int, term_kind, terms)``.

    The row whose term is null holds the change of the number of records of its kind.
    """
    record = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("records")))
    return (
        changes.select("sign", "term_kind", F.explode(F.concat(record, F.coalesce("terms", F.expr(f"cast(array() as {TERMS})")))).alias("t"))
        .groupBy("term_kind", F.col("t.term").alias("term"))
        .agg(
            F.sum(F.col("sign") * F.col("t.occurrences")).alias("n_occurrences"),
            F.sum(F.col("sign") * F.col("t.records")).alias("n_records"),
        )
    )


class TermCounts:
    """Persistent partitioned counts: bucket -> folder of the version that wrote it last. Use ``create`` or ``open``.

    Every commit writes new folders and then the manifest, so a lost executor
    or a failed job leaves the previous version whole.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 16) -> TermCounts:
        path = path.rstrip("/")
        return cls(spark, path, commit(spark, path, {"buckets": buckets, "folders": {}}))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TermCounts:
        """The counts that an earlier session left in a folder."""
        return cls(spark, path, latest(spark, path.rstrip("/")))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term_kind", "term"), F.lit(self.state["buckets"])).cast("int")

    def _read(self, buckets) -> DataFrame:
        paths = [self.state["folders"][str(b)] for b in sorted(buckets) if str(b) in self.state["folders"]]
        if not paths:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*(f"{self.path}/{p}" for p in paths))

    def counts(self) -> DataFrame:
        """All counts; the row of a kind with a null term is its number of records."""
        return self._read(range(self.state["buckets"]))

    def apply(self, changes: DataFrame) -> None:
        """Merge the signed delta of ``changes`` into the buckets it touches. Frames of earlier counts end with it."""
        delta_path = f"{self.path}/delta-{uuid.uuid4().hex}"
        signed_delta(changes).withColumn("bucket", self._bucket()).write.parquet(delta_path)
        delta = self.spark.read.schema(COUNTS + ", bucket int").parquet(delta_path)
        touched = [r[0] for r in delta.select("bucket").distinct().collect()]  # at most one row per bucket
        if touched:
            # Both sides hold a term once, so one shuffle by bucket merges and lays out.
            rows = self._read(touched).withColumn("bucket", self._bucket()).unionByName(delta)
            self._store(rows, touched)
        delete_path(self.spark, delta_path)
        if self.counts().count() > ROWS_PER_BUCKET * self.state["buckets"]:
            self._split()

    def _store(self, rows: DataFrame, touched: list[int]) -> None:
        merged = (
            rows.repartition(len(touched), "bucket")
            .groupBy("bucket", "term_kind", "term")
            .agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
            .where("n_records <> 0 or n_occurrences <> 0")
        )
        version = f"counts-{uuid.uuid4().hex}"
        merged.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        kept = {r[0] for r in self.spark.read.schema(COUNTS + ", bucket int").parquet(f"{self.path}/{version}").select("bucket").distinct().collect()}
        folders = {b: f for b, f in self.state["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{version}/bucket={b}" for b in kept}
        gone = [f for f in self.state["folders"].values() if f not in folders.values()]
        self.state = commit(self.spark, self.path, self.state | {"folders": folders})
        for folder in gone:
            delete_path(self.spark, f"{self.path}/{folder}")

    def _split(self) -> None:
        """Twice the buckets until they are small enough, all written anew: rare enough to cost a constant a term."""
        rows = self.counts()
        total = rows.count()
        while total > ROWS_PER_BUCKET * self.state["buckets"]:
            self.state["buckets"] *= 2
        self._store(rows.withColumn("bucket", self._bucket()), list(range(self.state["buckets"])))


def with_verdict(counts: DataFrame) -> DataFrame:
    """Counts with a mark: 'rare' below RARE_BELOW records, 'common' above COMMON_ABOVE of all, else null.

    In a collection so small that both hold, 'rare' does.
    """
    totals = counts.where("term is null").select("term_kind", F.col("n_records").alias("n_all"))
    return (
        counts.where("term is not null")
        .join(F.broadcast(totals), "term_kind")  # one row per kind of term
        .withColumn(
            "verdict",
            F.when(F.col("n_records") < RARE_BELOW, "rare").when(
                F.col("n_records") > F.col("n_all") * COMMON_ABOVE, "common"
            ),
        )
    )


def bank_changes(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """The tables' rows as added records, with the time each arrived."""
    return questions.select(
        F.lit("tag").alias("term_kind"), tag_terms(F.col("tags")).alias("terms"), F.col("loaded_at").alias("arrived")
    ).unionByName(
        stats.select(
            F.lit("category").alias("term_kind"),
            map_terms(F.col("by_category")).alias("terms"),
            F.col("scanned_at").alias("arrived"),
        )
    ).withColumn("sign", F.lit(1))


def bank_counts(spark: SparkSession, sf_dir: str, recent_days: int = 30) -> DataFrame:
    """Counts of the bank: a first load, then the last ``recent_days`` days as an increment to the stored state."""
    changes = bank_changes(
        spark.read.parquet(f"{sf_dir}/questions.parquet"), spark.read.parquet(f"{sf_dir}/gift_stats.parquet")
    )
    last = changes.agg(F.max("arrived")).head()[0]
    recent = F.coalesce(F.col("arrived") > F.lit(last) - F.expr(f"interval {recent_days} days"), F.lit(False))
    path = new_path(spark, "term-counts")
    TermCounts.create(spark, path).apply(changes.where(~recent))
    state = TermCounts.open(spark, path)
    state.apply(changes.where(recent))
    return state.counts()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(bank_counts(spark, sf_dir)).where("verdict is not null").select("term_kind", "term", "verdict")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return with_verdict(bank_counts(spark, sf_dir)).select(
        "term_kind", "term", "n_occurrences", "n_records", "verdict"
    )
