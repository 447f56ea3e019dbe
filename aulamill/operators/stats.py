"""Bank statistics and quality checks over parsed questions.

Inputs have the columns of ``gift.parse``; the driver's tables store ``type``
as ``qtype`` and ``format`` as ``fmt``, which ``from_table`` renames. Every
aggregate combines on the map side, so a file, tag or category with a third of
all rows is one partial row per task at the shuffle.

Defined cases: categories count only as categories; Descriptions count in the
total and by type but have no tags, feedback or checks; null and empty titles,
stems, tags and lists are absent ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulamill.functions.text import newlines

UNTITLED = "<sin título>"
NO_CATEGORY = "Sin categoría"


def from_table(rows: DataFrame) -> DataFrame:
    """Stored question rows under the parser's names."""
    return rows.withColumnRenamed("qtype", "type")


def _answered(questions: DataFrame) -> DataFrame:
    return questions.where(~F.col("type").isin("Category", "Description"))


def _absent(column) -> F.Column:
    return F.coalesce(F.length(column), F.lit(0)) == 0


def _size(column: str) -> F.Column:
    return F.coalesce(F.nullif(F.size(column), F.lit(-1)), F.lit(0))


def type_counts(questions: DataFrame) -> DataFrame:
    """(type, n, percent) without categories."""
    counts = questions.where("type <> 'Category'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(  # the total is one row
        "type", "n", F.round(F.col("n") / F.col("total") * 100, 6).alias("percent")
    )


def category_counts(questions: DataFrame) -> DataFrame:
    return (
        questions.where("type = 'Category'")
        .groupBy(F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_CATEGORY)).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("filepath").alias("n_files"))
    )


def category_files(questions: DataFrame) -> DataFrame:
    """(category, filepath, n): the files that name each category, and how often."""
    name = F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_CATEGORY))
    named = questions.where("type = 'Category'").select(name.alias("category"), "filepath")
    return named.groupBy("category", "filepath").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(questions: DataFrame) -> DataFrame:
    """(tag, n); a tag repeated in a question counts each time."""
    return (
        _answered(questions).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    )


def content_quality(questions: DataFrame) -> DataFrame:
    """One row of counters."""
    kind = F.col("type")
    checked = ~kind.isin("Category", "Description")
    empty = _absent("title") & _absent("stem.text" if "stem" in questions.columns else F.lit(None))
    counted = lambda c: F.count_if(checked & c)
    return questions.agg(
        F.count_if(kind != "Category").alias("total_questions"),
        counted(_size("tags") > 0).alias("with_tags"),
        counted(_size("tags") == 0).alias("without_tags"),
        counted(F.col("global_feedback").isNotNull()).alias("with_feedback"),
        counted(F.col("global_feedback").isNull()).alias("without_feedback"),
        counted(empty).alias("empty_questions"),
    )


def depth_counts(files: DataFrame, base: str = "", path: str = "filepath") -> DataFrame:
    """(depth, n_files): directories below the base; 0 for a file outside it."""
    rel = F.col(path)
    if base:
        prefix = base.rstrip("/") + "/"
        rel = F.when(rel.startswith(prefix), F.substr(rel, F.lit(len(prefix) + 1))).otherwise("x")
    depth = F.length(rel) - F.length(F.replace(rel, F.lit("/"), F.lit("")))
    return files.groupBy(depth.alias("depth")).agg(F.count(F.lit(1)).alias("n_files"))


def file_counts(parsed: DataFrame) -> DataFrame:
    """(total_files, valid_files, invalid_files) of file results with ``success``."""
    return parsed.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("success").alias("valid_files"),
        F.count_if(~F.col("success")).alias("invalid_files"),
    )


def issues(questions: DataFrame) -> DataFrame:
    """(filepath, ordinal, issue, label) of questions that break a rule of their type."""
    correct = F.size(F.filter("choices", lambda c: c["is_correct"]))
    weight = F.aggregate(
        F.filter("choices", lambda c: c["is_correct"] | F.coalesce(c["weight"] > 0, F.lit(False))),
        F.lit(0.0),
        lambda a, c: a + F.coalesce(c["weight"], F.when(c["is_correct"], 100.0).otherwise(0.0)),
    )
    kind = F.col("type")
    found = F.filter(
        F.array(
            F.when(_absent("title") & _absent("stem.text"), F.lit("empty")),
            F.when((kind == "MC") & (_size("choices") == 0), F.lit("mc_without_correct"))
            .when((kind == "MC") & (correct == 0) & (weight < 95), F.lit("mc_without_correct"))
            .when((kind == "Matching") & (_size("match_pairs") < 2), F.lit("matching_below_two_pairs"))
            .when((kind == "Short") & (_size("choices") == 0), F.lit("short_without_answers")),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        _answered(questions)
        .select(
            "filepath",
            "ordinal",
            F.explode(found).alias("issue"),
            F.coalesce(F.substring(F.nullif("title", F.lit("")), 1, 50), F.lit(UNTITLED)).alias("label"),
        )
    )


def descriptions(questions: DataFrame) -> DataFrame:
    """(filepath, ordinal, title, text) of Descriptions, which often are questions with broken answers."""
    return questions.where("type = 'Description'").select(
        "filepath",
        "ordinal",
        F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"),
        F.coalesce(F.substring(F.nullif("stem.text", F.lit("")), 1, 100), F.lit("<sin texto>")).alias("text"),
    )


def answer_texts(questions: DataFrame) -> DataFrame:
    """Adds ``answers``: choice texts, then both sides of each pair; absent texts are ''."""
    none = F.expr("cast(array() as array<string>)")
    text = lambda c: F.coalesce(c, F.lit(""))
    choices = F.transform(F.filter("choices", lambda c: c["text"].isNotNull()), lambda c: text(c["text"]["text"]))
    pairs = F.flatten(
        F.transform("match_pairs", lambda p: F.array(text(p["subquestion"]["text"]), text(p["subanswer"])))
    )
    return questions.withColumn("answers", F.concat(F.coalesce(choices, none), F.coalesce(pairs, none)))


def full_texts(questions: DataFrame) -> DataFrame:
    """(filepath, ordinal, full_text) of the questions that take part in the duplicate search."""
    text = F.concat(
        F.coalesce("title", F.lit("")),
        F.lit(" "),
        F.coalesce("stem.text", F.lit("")),
        F.lit(" "),
        F.array_join("answers", " "),
    )
    keep = [c for c in ("question_id", "key") if c in questions.columns]
    return answer_texts(_answered(questions)).select(*keep, "filepath", "ordinal", text.alias("full_text"))


def parsed_files(files: DataFrame) -> DataFrame:
    """(filepath, success, error, content) of files given as (filepath, bytes): invalid ones aren't UTF-8."""
    valid = F.expr("is_valid_utf8(cast(content as string))") & F.col("content").isNotNull()
    return files.select(
        "filepath",
        valid.alias("success"),
        F.when(~valid, F.lit("not UTF-8")).alias("error"),
        F.when(valid, newlines(F.col("content").cast("string"))).alias("content"),
    )


def files_without_questions(parsed: DataFrame, questions: DataFrame) -> DataFrame:
    return parsed.where("success").join(questions.select("filepath").distinct(), "filepath", "left_anti").select("filepath")
