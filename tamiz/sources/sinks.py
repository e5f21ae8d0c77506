"""Writers: ordered tables, fingerprints, upserts, stale rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet in global order of the keys: ranges over tasks, sorted within each."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row ``(n, checksum)`` that tells tables apart, whatever the order of their rows."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("checksum"))


def same_order(a: DataFrame, b: DataFrame, position: str, key: str) -> DataFrame:
    """Positions at which two tables hold different keys; empty where they agree."""
    j = a.select(position, F.col(key).alias("a")).join(b.select(position, F.col(key).alias("b")), position, "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))


def upsert(old: DataFrame, new: DataFrame, key: str, required: list[str]) -> DataFrame:
    """The new row of every key, else the old one; a new row without a required value raises."""
    for c in required:
        new = new.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is required")).cast(new.schema[c].dataType)).otherwise(F.col(c)))
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__v"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__v")


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that exist and are no longer current."""
    return existing.select(key).distinct().join(current.select(key), key, "left_anti")


def write_texts(df: DataFrame, path: str) -> None:
    """One folder with one text file for each ``doc_id``, whose offsets are those of ``texto``; a line feed ends the file."""
    df.where("doc_id is not null and texto is not null").select("doc_id", "texto").repartition("doc_id").write.mode("append").partitionBy("doc_id").text(path)


def retire_texts(current: DataFrame, path: str) -> list[str]:
    """Remove the folders of ``write_texts`` whose document is no longer current; gives their ids."""
    spark = current.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory() and x.getPath().getName().startswith("doc_id=")]
    held = spark.createDataFrame([(n.removeprefix("doc_id="),) for n in names], "doc_id string")
    gone = sorted(r.doc_id for r in stale(held, current, "doc_id").collect())  # names of folders that are to go
    for d in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, f"doc_id={d}"), True)
    return gone


def cached(df: DataFrame, path: str, signature: str) -> DataFrame:
    """The stored result of the same signature, else ``df``, which is then computed and stored under it."""
    spark = df.sparkSession
    where = f"{path}/firma={signature}"
    try:
        return spark.read.parquet(where)
    except AnalysisException:
        df.write.mode("overwrite").parquet(where)
        return spark.read.parquet(where)


def append_events(events: DataFrame, path: str) -> None:
    """Append ``(tipo, detalle)`` with the time of writing to a log; earlier rows are never touched."""
    events.select("tipo", "detalle", F.current_timestamp().alias("ts")).write.mode("append").json(path)


def append_items(items: DataFrame, path: str, work, schema: str, key: str = "id") -> int:
    """Work on the items whose key is not in the checkpoint under ``path`` and append their rows; gives how many were pending.

    A task that is lost leaves nothing, as the commit of its file fails; what was committed is not done again.
    """
    spark = items.sparkSession
    try:
        pending = items.join(spark.read.schema(schema).json(path).select(key), key, "left_anti")
    except AnalysisException:
        pending = items
    n = pending.count()
    if n:
        work(pending).write.mode("append").json(path)
    return n
