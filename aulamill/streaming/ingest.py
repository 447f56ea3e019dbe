"""Incremental ingest: new GIFT files are parsed as they arrive.

The parser needs one window per file, which a stream cannot run, so each
micro-batch goes through the same batch operators and is appended to a table.
Structured Streaming keeps the list of files that were read, so a restart
neither misses nor repeats one; a micro-batch that is repeated after a failure
overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aulamill.operators import gift, stats

FILE = "path string, modificationTime timestamp, length long, content binary"


def parse_new_files(
    spark: SparkSession, directory: str, table: str, checkpoint: str, pattern: str = "*.gift", once: bool = True
) -> StreamingQuery:
    """Parse files that appear in ``directory`` and append their questions under ``table``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(directory)
    )

    def append(batch: DataFrame, number: int) -> None:
        named = batch.select(F.regexp_replace("path", "^file:/+", "/").alias("filepath"), "content")
        valid = stats.parsed_files(named).where("success")
        gift.parse(valid).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
