"""What a Python worker may hold: small batches, and the cache of one operator at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_ROWS = 1_000          # texts in an Arrow batch, which both the JVM and Python hold whole
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CACHES: dict[tuple, object] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch, which by default fit narrow rows and not whole texts."""
    if not 0 < int(spark.conf.get(_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def worker_cache(key: tuple, make):
    """The worker's object for ``key``, kept from task to task until another operator needs one."""
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = make()
    return _CACHES[key]
