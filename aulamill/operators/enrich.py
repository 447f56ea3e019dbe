"""Batches of question blocks sent to a text service and mapped back to their files.

Blocks are numbered over all files in path order and cut into batches of a fixed
size that cross file borders. Numbers come from a range sort and per-partition
counts, so no single task sees all blocks; a batch is one small group. The
service is any function from a list of blocks to a list of texts; without one,
blocks come back as they are. Nothing here calls a network.

Defined cases: a service that fails or returns too few texts leaves the
originals; in mode multiply, three texts per block are shared out if there are
exactly three each, else the first block takes all and the others keep theirs;
an empty answer counts as none; files without blocks have no output.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulamill.functions.text import gift_blocks
from aulamill.operators.work import stored

MODES = ("improve", "multiply", "transform")
Service = Callable[[list[str], str], list[str]]


def mode_for(mode: str, prompt: str | None = None) -> str:
    """A prompt turns improve into transform."""
    return "transform" if prompt and mode == "improve" else mode


def numbered_blocks(files: DataFrame) -> DataFrame:
    """(filepath, pos, text, n): blocks with their number over all files, from 0."""
    rows = files.select("filepath", F.posexplode(gift_blocks(F.col("content"))).alias("pos", "text"))
    ordered = stored(
        rows.repartitionByRange("filepath", "pos")
        .sortWithinPartitions("filepath", "pos")
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ordered-blocks",
    )
    shift, total = {}, 0
    for r in sorted(ordered.groupBy("part").count().collect()):  # one row per partition
        shift[r["part"]] = total
        total += r["count"]
    if not shift:
        return ordered.select("filepath", "pos", "text", F.col("seq").alias("n"))
    offsets = files.sparkSession.createDataFrame(list(shift.items()), "part int, shift long")
    return ordered.join(F.broadcast(offsets), "part").select(
        "filepath", "pos", "text", (F.col("shift") + F.col("seq")).alias("n")
    )


def batched(files: DataFrame, size: int = 5) -> DataFrame:
    """(batch_id, slot, filepath, pos, text)."""
    n = F.col("n")
    return numbered_blocks(files).select(
        F.floor(n / size).alias("batch_id"), (n % size).cast("int").alias("slot"), "filepath", "pos", "text"
    )


def split_answer(answer: str) -> list[str]:
    """Texts of a service's raw answer, parted by lines of three hyphens."""
    return [p.strip() for p in re.split(r"\n---\n|---", answer.strip()) if p.strip()]


def share_out(texts: list[str], answers: list[str], mode: str) -> list[str]:
    """The answers for each text, by the rule of the mode."""
    if mode == "multiply":
        if len(answers) == 3 * len(texts):
            out = ["\n\n".join(answers[3 * i : 3 * i + 3]) for i in range(len(texts))]
        else:
            out = ["\n\n".join(answers)] + [""] * (len(texts) - 1)
    else:
        out = list(answers[: len(texts)])
    out += [""] * (len(texts) - len(out))
    return [new or old for new, old in zip(out, texts, strict=True)]


def enriched(files: DataFrame, service: Service | None = None, mode: str = "improve", size: int = 5) -> DataFrame:
    """(filepath, pos, processed)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("slot")
        texts = batch["text"].tolist()
        try:
            answers = service(texts, mode) if service else list(texts)
        except Exception:  # the originals are kept whatever went wrong
            answers = list(texts)
        return pd.DataFrame(
            {"filepath": batch["filepath"], "pos": batch["pos"], "processed": share_out(texts, answers, mode)}
        )

    return batched(files, size).groupBy("batch_id").applyInPandas(run, "filepath string, pos int, processed string")


def outputs(done: DataFrame, mode: str = "improve", in_place: bool = False, suffix: str = "") -> DataFrame:
    """(filepath, new_path, new_content): blocks of each file joined again, in order."""
    joined = done.groupBy("filepath").agg(F.array_sort(F.collect_list(F.struct("pos", "processed"))).alias("parts"))
    tail = suffix if in_place else f"_{mode}"
    return joined.select(
        "filepath",
        F.regexp_replace("filepath", r"^(.*?)(\.[^./]*)?$", f"$1{tail}$2").alias("new_path"),
        F.concat(F.array_join(F.transform("parts", lambda p: p["processed"]), "\n\n"), F.lit("\n")).alias("new_content"),
    )
