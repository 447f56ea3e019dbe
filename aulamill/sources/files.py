"""Readers of question files and stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that each kind of work reads.
EXTENSIONS = {
    "gift": ("gift",),
    "xml": ("xml",),
    "questions": ("gift", "xml"),
    "texts": ("gift", "xml", "md"),
}


def find_files(
    spark: SparkSession, paths: str | Iterable[str], extensions: Iterable[str] = ("gift",), recursive: bool = True
) -> DataFrame:
    """(filepath, content binary) of files or of the matching files of directories; other files are not opened."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    wanted = [e.lower() for e in extensions]
    glob = f"*.{wanted[0]}" if len(wanted) == 1 else f"*.{{{','.join(wanted)}}}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    found = reader.load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("filepath"), "content")
    return found.where(F.regexp_extract("filepath", r"\.([^./]+)$", 1).isin(wanted))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_texts(
    spark: SparkSession, paths: str | Iterable[str], extensions: Iterable[str] = ("gift",), recursive: bool = True
) -> DataFrame:
    """(filepath, success, error, content) with line ends as \\n; a file that isn't UTF-8 or isn't there is invalid."""
    from aulamill.operators.stats import parsed_files

    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if _exists(spark, p)]
    missing = [(p, False, f"Archivo no encontrado: {p}", None) for p in paths if p not in there]
    lost = spark.createDataFrame(missing, "filepath string, success boolean, error string, content string")
    return parsed_files(find_files(spark, there, extensions, recursive)).unionByName(lost) if there else lost


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
