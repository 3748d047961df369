"""Tables kept in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from toponexus.deploy import ship


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is set in a local session, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="toponexus-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rows that an Arrow batch holds at most, unless the session says otherwise: texts are large rows, and
#: batches of the engine's own default size take hundreds of megabytes outside the heap.
BATCH_ROWS = 2000
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(frame: DataFrame) -> DataFrame:
    """``frame``, its session set to small Arrow batches where the setting is the default one, and the package sent to its workers. Results do not depend on it."""
    ship(frame.sparkSession)
    conf = frame.sparkSession.conf
    if conf.get(_SETTING) == _DEFAULT:
        conf.set(_SETTING, str(BATCH_ROWS))
    return frame


def keep(frame: DataFrame) -> DataFrame:
    """Compute a small ``frame`` once and cut its lineage by a reliable checkpoint."""
    context = frame.sparkSession.sparkContext
    folder = shared_folder(frame.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


def table(frame: DataFrame) -> DataFrame:
    """Write ``frame`` once as a table in the shared folder, until the session ends, and read it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/toponexus-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(frame.schema).parquet(path)
