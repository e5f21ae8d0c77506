"""Stored indexes: postings by bucket of their term, vectors, and a guard that ties them to the rows they were built on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.operators.lexical import ranked
from tamiz.session import cut

#: Folders that postings are spread over; a search reads those of its terms alone.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """Number and order-free checksum of rows, as one text."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return f"{r.n}-{r.h}"


def save_lexical(rows: DataFrame, tokens: Column, path: str) -> None:
    """Write ``postings``, ``terms``, ``stats`` and ``guard`` of ``(row_id, text columns)`` under ``path``.

    Postings are sorted by term and row over tasks of equal size, so that a word of every row fills no single task, and
    stand in one folder per bucket. Rows without tokens count in the statistics and have no postings.
    """
    spark = rows.sparkSession
    # Written once: postings are sampled for their ranges and written, and lengths are read, all from the same tokens.
    toks = cut(rows.where("row_id is not null").select("row_id", tokens.alias("toks")).select("row_id", "toks", F.size("toks").alias("dl")))
    exploded = toks.select("row_id", "dl", F.explode_outer("toks").alias("term")).where("term is not null")
    counted = exploded.groupBy("term", "row_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("bucket", _bucket(F.col("term")))
    counted.repartitionByRange("bucket", "term", "row_id").sortWithinPartitions("bucket", "term", "row_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    saved = spark.read.parquet(f"{path}/postings")
    saved.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    spark.createDataFrame([(fingerprint(rows, "row_id"),)], "huella string").write.mode("overwrite").parquet(f"{path}/guard")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write ``(row_id, v)`` in the order of its rows, and its guard."""
    vectors.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(fingerprint(vectors, "row_id"),)], "huella string").write.mode("overwrite").parquet(f"{path}/guard")


def guard(rows: DataFrame, path: str) -> None:
    """Raise if the index under ``path`` was built on other rows than these."""
    held, now = rows.sparkSession.read.parquet(f"{path}/guard").first().huella, fingerprint(rows, "row_id")
    if held != now:
        raise RuntimeError(f"{path} was built on other rows ({held}, not {now}); build it again")


def rebuild(rows: DataFrame, tokens: Column, path: str) -> bool:
    """Build the lexical index only where there is none for these rows; tells whether it was built."""
    try:
        guard(rows, path)
        return False
    except Exception:  # noqa: BLE001 - no index, a broken or an old one are all built anew
        save_lexical(rows, tokens, path)
        return True


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, tokens: Column, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(qid, row_id, score, rank)``: BM25 top-k of all queries over a stored index.

    Only the folders of the queries' terms are read, and of these only the parts that hold one (a filter on the sorted
    terms reaches the scan where there are few of them). A query's term counts once; queries without a known term get
    no rows; ties go to the smaller id.
    """
    terms = queries.where("qid is not null").select("qid", F.explode(F.array_distinct(tokens)).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    asked = terms.select("bucket", "term").distinct()
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    read = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(wanted))
    totals = spark.read.parquet(f"{path}/stats").first()
    idf = F.log(F.lit(1.0) + (F.lit(totals.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = read("terms").join(asked, ["bucket", "term"]).select("bucket", "term", idf.alias("idf"))
    gain = F.col("idf") * F.col("tf") / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(totals.avgdl)))
    hits = read("postings").join(weights, ["bucket", "term"]).select("bucket", "term", "row_id", gain.alias("gain"))
    scored = hits.join(terms, ["bucket", "term"]).groupBy("qid", "row_id").agg(F.round(F.sum("gain"), 6).alias("score"))
    return ranked(scored.where("score > 0"), k)
