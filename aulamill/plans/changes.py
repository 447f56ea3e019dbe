"""Plans of file changes. A plan is a table of what to write or rename; inputs are never touched.

``write_texts`` stores the new contents of a plan under another directory.
Names that collide get a suffix by their order in path, so a plan is the same
on every run, and no two rows of one have the same new path (but for the XML
rename, which marks collisions instead).
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulamill.functions import text as X
from aulamill.operators.work import ranked, stored

FOLDER = r"^(.*/)?[^/]*$"
STEM = r"([^/]*?)(?:\.[^./]*)?$"
EXTENSION = r"(\.[^./]*)$"


def with_parts(files: DataFrame) -> DataFrame:
    """Adds folder, stem and extension of ``filepath``."""
    path = F.col("filepath")
    return files.withColumns(
        {
            "folder": F.regexp_extract(path, FOLDER, 1),
            "stem": F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1),
            "extension": F.regexp_extract(path, EXTENSION, 1),
        }
    )


def rewrite(files: DataFrame, change: Callable[[Column], Column], count: Callable[[Column], Column] | None = None) -> DataFrame:
    """(filepath, new_content, changed, n_changes) of applying a text function."""
    content = F.col("content")
    n = count(content) if count else F.lit(None).cast("int")
    return files.select("filepath", change(content).alias("new_content"), content.alias("old"), n.alias("n_changes")).select(
        "filepath", "new_content", (F.col("new_content") != F.col("old")).alias("changed"), "n_changes"
    )


def _unique(rows: DataFrame, taken: DataFrame, start: int) -> DataFrame:
    """Adds ``new_path``, which no two rows share and no path of ``taken(new_path)`` has.

    ``rows`` has folder, extension, first, later and a unique ``order``. The
    name is ``first`` for the row of the lowest order; others get ``later`` with
    a number, from ``start`` on, where 0 is no number. Numbers are given by
    order, and rows whose name turns out to be taken, by a name of another
    group, get higher ones in the next round; a round settles every name that
    is free. No step sees a whole group in one task.
    """
    named = rows.withColumn("new_path", F.concat("folder", "first", "extension"))
    done, used = [], taken
    while True:
        named = stored(named, "wanted-names")
        best = named.groupBy("new_path").agg(F.min("order").alias("order"))
        won = stored(best.join(used, "new_path", "left_anti"), "won-names")
        done.append(named.drop("new_path").join(won, "order"))
        left = named.join(won.select("order"), "order", "left_anti").drop("new_path")
        if not left.head(1):
            break
        used = stored(used.unionByName(won.select("new_path")), "used-names")
        n = F.col("nth") + start
        suffix = F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise("")
        groups = ["folder", "later", "extension"]
        placed = ranked(left, groups, "order")
        named = placed.withColumn("new_path", F.concat("folder", "later", suffix, "extension")).drop("nth")
        # What a group has tried it need not try again.
        start += placed.agg(F.max("nth")).head()[0] + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _renamed(named: DataFrame, files: DataFrame) -> DataFrame:
    """(filepath, new_path, renamed) of files with folder, extension and the wanted name.

    A file that has its name already keeps it; names of other files of the input are taken.
    """
    own = F.concat("folder", "wanted", "extension") == F.col("filepath")
    keep = named.where(own).select("filepath", F.col("filepath").alias("new_path"))
    rows = named.where(~own).select("filepath", "folder", "extension", F.col("wanted").alias("first"), F.col("wanted").alias("later"))
    taken = files.select(F.col("filepath").alias("new_path")).distinct()
    moved = _unique(rows.withColumn("order", F.col("filepath")), taken, 1).select("filepath", "new_path")
    return keep.unionByName(moved).withColumn("renamed", F.col("filepath") != F.col("new_path"))


def rename_to_slug(files: DataFrame) -> DataFrame:
    """(filepath, new_path, renamed)."""
    named = with_parts(files.select("filepath")).withColumn("wanted", X.slugify("stem"))
    return _renamed(named, files)


def rename_from_title(files: DataFrame) -> DataFrame:
    """(filepath, new_path, renamed) of files that have a title."""
    titled = files.select("filepath", X.question_title(F.col("filepath"), F.col("content")).alias("title"))
    named = with_parts(titled.where(F.length("title") > 0)).withColumn("wanted", X.slugify("title"))
    return _renamed(named, files)


def rename_xml(files: DataFrame) -> DataFrame:
    """(filepath, new_path, collides): the name of the first question; collisions are marked, not solved."""
    titled = files.select("filepath", X.xml_title(F.col("content")).alias("title"))
    named = with_parts(titled.where("title is not null")).withColumn("wanted", X.sanitize_filename(F.col("title")))
    named = named.withColumn("new_path", F.concat("folder", "wanted", F.lit(".xml")))
    per_name = Window.partitionBy("new_path")
    return named.select("filepath", "new_path", (F.count(F.lit(1)).over(per_name) > 1).alias("collides"))


def titles_from_names(files: DataFrame) -> DataFrame:
    """(filepath, title, new_content, changed): the title set to the file's name."""
    named = with_parts(files).withColumn("title", X.title_from_name(F.col("stem")))
    content, title = F.col("content"), F.col("title")
    new = F.when(F.col("extension") == ".gift", X.set_gift_title(content, title)).when(
        F.col("extension") == ".xml", X.set_xml_title(content, title)
    ).otherwise(content)
    return named.select("filepath", "title", new.alias("new_content"), (new != content).alias("changed"))


def split_files(files: DataFrame) -> DataFrame:
    """(filepath, pos, new_path, new_content): one file per question of GIFT files with several.

    The name is the sanitised title or the stem with the position; where an
    earlier question of the folder or a file of the input has it, the position
    is added, and then a number until it is free.
    """
    parts = with_parts(files.where(F.col("filepath").endswith(".gift"))).withColumn("blocks", X.gift_blocks(F.col("content")))
    rows = parts.where(F.size("blocks") > 1).select("filepath", "folder", "stem", F.posexplode("blocks").alias("pos", "block"))
    title = F.coalesce(X.gift_title(F.col("block")), F.lit(""))
    number = (F.col("pos") + 1).cast("string")
    base = F.when(title != "", X.sanitize_filename(title)).otherwise(F.concat_ws("_", "stem", number))
    rows = stored(
        rows.select(
            "filepath", "pos", "folder", F.lit(".gift").alias("extension"), base.alias("first"), F.concat_ws("_", base, number).alias("later"),
            F.concat("filepath", F.lit("\x01"), F.lpad(F.col("pos").cast("string"), 10, "0")).alias("order"),
            F.concat("block", F.lit("\n")).alias("new_content"),
        ),
        "parts-of-files",
    )
    taken = files.select(F.col("filepath").alias("new_path")).distinct()
    names = _unique(rows.drop("new_content", "filepath", "pos"), taken, 0).select("order", "new_path")
    return rows.join(names, "order").select("filepath", "pos", "new_path", "new_content")


def write_texts(plan: DataFrame, directory: str, path: str = "new_path", content: str = "new_content") -> DataFrame:
    """Write a plan's files under ``directory``, from the executors; (path, written) of each.

    ``directory`` is a path or URI (file, hdfs, s3 ...) of a folder that all executors share.
    """

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        for batch in batches:
            for name, body in zip(batch[path], batch[content], strict=True):
                target = posixpath.join(root, posixpath.normpath("/" + name).lstrip("/"))
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(body.encode())
            yield pd.DataFrame({"path": batch[path], "written": True})

    return plan.select(path, content).where(F.col(content).isNotNull()).mapInPandas(write, "path string, written boolean")
