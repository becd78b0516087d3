"""Tables written to the folder that the whole cluster shares.

An operator that needs an intermediate result twice, or wants its lineage cut, writes it as
Parquet below ``spark.checkpoint.dir`` and reads it back. A lost executor then costs only the
tasks it was running. The folder is read from the session; only where it is unset is one made and set: a
temporary one in tests on one machine, else one in the warehouse, which a cluster shares.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


BATCH_ROWS, BATCH_BYTES = 2000, "16m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches kept to BATCH_ROWS rows and BATCH_BYTES: texts can be long, and a batch is held whole on both sides.

    These are two settings of the session. They are read when a result is asked for, after an operator has returned,
    so they stay set; a lower number of rows that the caller chose stays the caller's.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        else:
            local = spark.sparkContext.master.startswith("local")
            found = tempfile.mkdtemp(prefix="quillrank-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillrank-tables"
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillrank/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clean)
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables there are; see :func:`clean`."""
    return len(_WRITTEN)


def clean(since: int = 0, latest: int = 0) -> None:
    """Remove the tables written since a :func:`mark` but for the ``latest``, where the session still runs."""
    until = len(_WRITTEN) - latest
    own = _WRITTEN[since:until]
    del _WRITTEN[since:until]
    for spark, path in own:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its files go with the folder
            return
