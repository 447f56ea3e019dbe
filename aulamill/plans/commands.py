"""One function for each task on question files: paths in, a report or a plan of changes out.

Paths are files or directories. A plan is a table; ``changes.write_texts``
stores its contents elsewhere. Nothing here changes an input.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulamill.functions import text as X
from aulamill.operators import gift
from aulamill.operators.work import stored
from aulamill.plans import changes, report
from aulamill.sources.files import EXTENSIONS, read_texts

Paths = str | Iterable[str]


def bank(spark: SparkSession, paths: Paths, recursive: bool = True, threshold: float = 0.85, base: str = "") -> report.Bank:
    """The GIFT files of all paths as one bank; ``report.render`` and ``report.json_lines`` show it.

    Depth counts from ``base``, or from the directory where there is only one path.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = stored(read_texts(spark, paths, EXTENSIONS["gift"], recursive), "files")
    questions = stored(gift.parse(files.where("success")), "questions")
    return report.Bank(files.drop("content"), questions, base or (paths[0] if len(paths) == 1 else ""), threshold)


def validate(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    """(filepath, success, error, n_questions) of each file; one that is missing or isn't UTF-8 has failed."""
    files = stored(read_texts(spark, paths, EXTENSIONS["gift"], recursive), "files")
    counts = gift.parse(files.where("success")).groupBy("filepath").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("success"), F.coalesce("n", F.lit(0)))
    return files.join(counts, "filepath", "left").select("filepath", "success", "error", n.alias("n_questions"))


def similar(spark: SparkSession, paths: Paths, recursive: bool = True, threshold: float = 0.85) -> DataFrame:
    """(nth, similarity, filepath, title and type of both questions), most similar first by ``nth``."""
    found = bank(spark, paths, recursive, threshold).duplicates
    return found.select("nth", "similarity", *(f"{c}_{x}" for x in "ab" for c in ("filepath", "title", "type")))


def _read(spark: SparkSession, paths: Paths, kind: str, recursive: bool) -> DataFrame:
    return read_texts(spark, paths, EXTENSIONS[kind], recursive).where("success").select("filepath", "content")


def _by_kind(path, xml, other):
    return F.when(path.endswith(".xml"), xml).otherwise(other)


def format_files(
    spark: SparkSession, paths: Paths, recursive: bool = True, code: bool = False, to_plain: bool | None = None, correct_first: bool = False
) -> DataFrame:
    """Rewrite plan: GIFT in the standard layout; with ``code`` its indents and with ``to_plain`` its characters mapped, in XML and Markdown too."""
    files = _read(spark, paths, "texts" if code or to_plain is not None else "gift", recursive)
    path = F.col("filepath")

    def change(content):
        new = F.when(path.endswith(".gift"), X.format_gift(content, correct_first)).otherwise(content)
        new = X.indent_code(new) if code else new
        return new if to_plain is None else _by_kind(path, X.map_code_in_cdata(new, to_plain), X.map_code(new, to_plain))

    return changes.rewrite(files, change)


def fix_code_characters(spark: SparkSession, paths: Paths, recursive: bool = True, to_plain: bool = True) -> DataFrame:
    """Rewrite plan with the number of code spans whose characters change."""
    path = F.col("filepath")
    return changes.rewrite(
        _read(spark, paths, "texts", recursive),
        lambda c: _by_kind(path, X.map_code_in_cdata(c, to_plain), X.map_code(c, to_plain)),
        lambda c: _by_kind(path, X.count_mapped_code_in_cdata(c, to_plain), X.count_mapped_code(c, to_plain)),
    )


def fix_code_indents(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.rewrite(_read(spark, paths, "gift", recursive), X.indent_code, X.count_indents)


def fix_names(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.rename_to_slug(_read(spark, paths, "texts", recursive))


def fix_names_from_titles(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.rename_from_title(_read(spark, paths, "questions", recursive))


def fix_titles_from_names(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.titles_from_names(_read(spark, paths, "questions", recursive))


def html_to_markdown(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    """Rewrite plan: HTML tags as Markdown, in XML inside CDATA only."""
    path = F.col("filepath")
    files = _read(spark, paths, "texts", recursive)
    return changes.rewrite(files, lambda c: _by_kind(path, X.html_to_markdown_in_xml(c), X.html_to_markdown(c)))


def split(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.split_files(_read(spark, paths, "gift", recursive))


def xml_cdata(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.rewrite(_read(spark, paths, "xml", recursive), X.ensure_cdata, X.count_missing_cdata)


def xml_without_tags(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.rewrite(_read(spark, paths, "xml", recursive), X.remove_tags, X.count_tags)


def xml_names(spark: SparkSession, paths: Paths, recursive: bool = True) -> DataFrame:
    return changes.rename_xml(_read(spark, paths, "xml", recursive))
