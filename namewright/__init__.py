"""Name resolution and training-data analytics on Spark."""

from __future__ import annotations

from pathlib import Path

#: What Python workers get: freed memory goes back to the system at once instead of adding up over the stages of an application.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch, where the session leaves Spark's own bound: long texts make few rows a batch.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")


def reach_workers(spark) -> None:
    """Lets Python workers import this package where the folder it lies in is mounted (elsewhere ship it with --py-files), and bounds their memory."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if spark.conf.get(BATCH[0], BATCH[1]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
