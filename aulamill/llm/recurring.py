"""Records that differ only in formatting: collapse each group of them into one.

Byte-identical raw records collapse first, with counts. Only the distinct
survivors are brought to canonical text (case, punctuation and white space
removed), and a second grouping on the full canonical text sums the counts.
Both groupings combine on the map side, so a group that holds a third of all
rows reaches the shuffle as one partial row per task.

Defined cases: a null title, an empty one and one without words are the same;
a stem whose text is null or has no words has the empty word sequence; rows
without a stem are no records; an empty table gives an empty result; repeated
rows and ties count as copies and the smallest id is kept; other columns of
the inputs, whatever their names, are not read; texts have no length limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aulamill.operators.work import digest, join_skewed, stored

#: A word is a longest run of letters or digits; combining marks stay with their letter.
NOT_WORDS = r"[^\p{L}\p{M}\p{N}]+"

WIRE = "title string, stem struct<text string>"


def canonical(text: Column) -> Column:
    """The sequence of words of a text, lower case, one space between; '' for null."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORDS, " ")))


def question_records(questions: DataFrame, wire: DataFrame | None = None) -> DataFrame:
    """(rec_id, title, stem) of every stored question that has a stem, from rows and from JSON.

    JSON is read by field name, so the order and layout of its fields drop out here.
    """
    rows = questions.where(F.col("stem").isNotNull()).select(
        F.col("question_id").alias("rec_id"), "title", F.col("stem.text").alias("stem")
    )
    if wire is None:
        return rows
    parsed = wire.select(F.col("question_id").alias("rec_id"), F.from_json("payload", WIRE).alias("q"))
    return rows.unionByName(
        parsed.where(F.col("q.stem").isNotNull()).select("rec_id", "q.title", F.col("q.stem.text").alias("stem"))
    )


def survivors(records: DataFrame) -> DataFrame:
    """One row per distinct raw record: (raw, canon, first_id, n)."""
    return (
        records.groupBy("title", "stem")
        .agg(F.min("rec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .select(
            digest("title", "stem").alias("raw"),
            digest(canonical(F.col("title")), canonical(F.col("stem"))).alias("canon"),
            "first_id",
            "n",
        )
    )


def collapse(distinct: DataFrame) -> DataFrame:
    """One row per canonical record: (canon, keep_id, n_copies, n_writings)."""
    return distinct.groupBy("canon").agg(
        F.min("first_id").alias("keep_id"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_writings")
    )


def repeats(records: DataFrame) -> DataFrame:
    """(keep_id, dup_id) for every record but the kept one of its group.

    A writing that occurs once is its own record, so only writings that occur
    more than once are joined back to the rows, and only those of groups with
    more than one record.
    """
    distinct = stored(survivors(records), "writings")
    groups = collapse(distinct).where("n_copies > 1").select("canon", "keep_id", "n_writings")
    total = distinct.agg(F.sum("n"), F.count(F.lit(1))).head()
    known = join_skewed(
        distinct.select("canon", "raw", "first_id", "n"), groups, "canon", "n_writings", total[1] or 0
    )
    single = known.where("n = 1").select("keep_id", F.col("first_id").alias("dup_id"))
    keyed = known.where("n > 1").select("raw", "keep_id", "n")
    rows = records.select(F.col("rec_id").alias("dup_id"), digest("title", "stem").alias("raw"))
    copied = join_skewed(rows, keyed, "raw", "n", total[0] or 0).select("keep_id", "dup_id")
    return single.unionByName(copied).where("dup_id <> keep_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return repeats(question_records(read("questions"), read("question_wire")))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with its number of copies and of writings."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    records = question_records(read("questions"), read("question_wire"))
    return collapse(survivors(records)).select("keep_id", "n_copies", "n_writings")
