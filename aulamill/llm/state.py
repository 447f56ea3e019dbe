"""State that outlives a session: a folder whose manifests name what is committed.

A manifest is written under a hidden name and renamed, which is the commit; the
highest number holds. Files that no manifest names are leftovers of a failed
writer and never read. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, state: dict) -> dict:
    """Write ``state`` as the next manifest of the folder; returns it with its number."""
    state = state | {"number": state.get("number", 0) + 1}
    hidden, system = _system(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    shown, _ = _system(spark, f"{path}/manifest/{state['number']:09d}")
    out = system.create(hidden, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if system.exists(shown) or not system.rename(hidden, shown):
        raise RuntimeError(f"another writer committed version {state['number']} of {path}")
    return state


def latest(spark: SparkSession, path: str) -> dict:
    """The state that was committed last."""
    folder, system = _system(spark, f"{path}/manifest")
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    number = max(int(n) for n in names if n.isdigit())
    return json.loads(spark.read.text(f"{path}/manifest/{number:09d}", wholetext=True).head()[0])
