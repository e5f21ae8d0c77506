"""Session helpers: builder for local runs, shared-folder checkpoints."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tamiz", master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE, UTC and Arrow; cluster settings win when already given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a private one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tamiz-checkpoint-")
    sc.setCheckpointDir(named)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; what is written there is removed when the program ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tamiz-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``cut``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _TABLES:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                drop(spark, path)
        except Exception:  # the session is gone; the folder goes with it
            return


_TABLES: list[tuple[SparkSession, str]] = []
atexit.register(_drop_all)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Its lineage is cut, executors may be lost afterwards, and the optimiser knows the true size. Compressed columns take
    less room there than a checkpoint's rows. The tables are removed when the program ends.
    """
    return _written(df)[0]


def cut_in_turn(df: DataFrame, before: str | None) -> tuple[DataFrame, str]:
    """Like ``cut``, and drop the table ``before`` of the previous round; gives the new table and its path."""
    new, path = _written(df)
    if before:
        drop(df.sparkSession, before)
    return new, path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
