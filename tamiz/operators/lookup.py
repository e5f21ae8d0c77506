"""Look-ups of named norms in a catalog of rows: exact articles, ranked rows of a norm, rows that support a citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _base(c: str) -> Column:
    return F.split(F.col(c), "#")[0]


def direct_rows(named: DataFrame, catalog: DataFrame, ranking: DataFrame, per_id: int = 2, most: int = 4) -> DataFrame:
    """``(qid, row_id, n)``: rows to put first for the norms a question names, at most ``most`` of them.

    ``named`` is ``(qid, n, ident)`` in the order of naming, ``catalog`` ``(row_id, canon)``, ``ranking`` ``(qid, row_id,
    rank)``. An article that the catalog holds gives its first rows; anything else the best ranked rows of its norm; a
    norm that is not there gives none. A row counts once, where it came first.
    """
    rows = catalog.where("canon is not null").select("row_id", "canon", _base("canon").alias("base"))
    asked = named.select("qid", "n", "ident", _base("ident").alias("base"))
    # The first rows of an article are found before the join, so that an article named by many brings these alone.
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("canon").orderBy("row_id"))).where(F.col("k") <= per_id).select(F.col("canon").alias("ident"), "row_id", "k")
    exact = asked.where(F.col("ident").contains("#")).join(first, "ident").select("qid", "n", "ident", "row_id", "k")
    rest = asked.join(exact.select("qid", "n").distinct(), ["qid", "n"], "left_anti")
    ranked = rest.join(ranking.join(rows.select("row_id", "base"), "row_id"), ["qid", "base"])
    near = ranked.withColumn("k", F.row_number().over(Window.partitionBy("qid", "n").orderBy("rank", "row_id"))).where(F.col("k") <= per_id).select("qid", "n", "ident", "row_id", "k")
    once = exact.unionByName(near).groupBy("qid", "row_id").agg(F.min(F.struct("n", "k")).alias("o"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("o", "row_id"))
    return once.withColumn("n", order).where(F.col("n") <= most).select("qid", "row_id", "n")


def named_in_corpus(named: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(qid, nombradas, en_corpus, sin_corpus)``: how many of the named norms the catalog holds."""
    held = catalog.where("canon is not null").select(_base("canon").alias("base")).distinct().withColumn("held", F.lit(True))
    j = named.select("qid", "ident", _base("ident").alias("base")).join(held, "base", "left")
    return j.groupBy("qid").agg(F.count(F.lit(1)).alias("nombradas"), F.count("held").alias("en_corpus"), (F.count(F.lit(1)) - F.count("held")).alias("sin_corpus"))


def supporting_row(cited: DataFrame, catalog: DataFrame, most: int = 30) -> DataFrame:
    """``(qid, cuerpo, row_id)``: for each cited norm the first row that names it itself.

    ``cited`` is ``(qid, cuerpo, n, ident)``, articles before the whole norm; ``catalog`` is ``(row_id, canon, nombra)``
    with the norms that a row's text names. Of each id the first ``most`` rows are looked at.
    """
    top = catalog.where("canon is not null").withColumn("k", F.row_number().over(Window.partitionBy("canon").orderBy("row_id"))).where(F.col("k") <= most).withColumnRenamed("canon", "ident")
    hits = cited.join(top, "ident").where(F.array_contains("nombra", F.col("cuerpo")))
    return hits.groupBy("qid", "cuerpo").agg(F.min_by("row_id", F.struct("n", "k")).alias("row_id"))


def covered(keys: DataFrame, exact: DataFrame, slugs: DataFrame, equivalent: dict[str, str]) -> DataFrame:
    """Adds ``cubierta`` to ``(clave)``: the key itself is held, or the name that its number stands for."""
    alias = F.lit(None).cast("string")
    for number, slug in equivalent.items():
        alias = F.when(F.col("clave").rlike(f"^{number}_"), F.lit(slug)).otherwise(alias)
    a = exact.select(F.col("clave")).distinct().withColumn("__a", F.lit(True))
    b = slugs.select(F.col("clave").alias("__slug")).distinct().withColumn("__b", F.lit(True))
    j = keys.join(a, "clave", "left").withColumn("__slug", F.coalesce(alias, F.col("clave"))).join(b, "__slug", "left")
    return j.withColumn("cubierta", F.coalesce("__a", "__b", F.lit(False))).drop("__a", "__b", "__slug")
