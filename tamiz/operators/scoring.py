"""Scores of delivered answers against a key: choices, citations, abstention, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: points of the components, weight of a hit without support and of an abstention
POINTS = {"cerradas": 20.0, "citas": 20.0, "abstencion": 10.0, "correccion": 30.0}
UNSUPPORTED, ABSTAINED = 0.5, 0.5


def with_answers(key: DataFrame, answers: DataFrame) -> DataFrame:
    """Every row of the key with its answer, if one was delivered: ``enviada`` tells."""
    return key.join(answers.withColumn("enviada", F.lit(True)), "id", "left").withColumn("enviada", F.coalesce("enviada", F.lit(False))).withColumn("abstencion", F.coalesce("abstencion", F.lit(False)))


def closed(rows: DataFrame) -> DataFrame:
    """``(n, aciertos, exactitud, puntos)`` of ``(correcta, letra, enviada, abstencion)``; an answer that is missing or abstains is wrong."""
    right = F.col("enviada") & ~F.col("abstencion") & F.coalesce(F.col("letra") == F.col("correcta"), F.lit(False))
    g = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("aciertos"))
    share = F.when(F.col("n") > 0, F.col("aciertos") / F.col("n")).otherwise(F.lit(0.0))
    return g.select("n", "aciertos", F.round(share, 4).alias("exactitud"), F.round(F.lit(POINTS["cerradas"]) * share, 2).alias("puntos"))


def citations(rows: DataFrame) -> DataFrame:
    """One row of counts, rates and points of ``(ref, dadas, evidencia, enviada, abstencion)`` with arrays of ids.

    Rows without a reference do not count; of missing and abstaining answers only the reference does.
    """
    said = F.col("enviada") & ~F.col("abstencion")
    n = lambda c: F.coalesce(F.sum(F.when(said, F.size(c)).otherwise(0)), F.lit(0))
    hits, other = F.array_intersect("dadas", "ref"), F.array_except("dadas", "ref")
    g = rows.where(F.size("ref") > 0).agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("ref")), F.lit(0)).alias("n_ref"), n(F.col("dadas")).alias("n_citadas"), n(hits).alias("aciertos"), n(F.array_intersect(hits, "evidencia")).alias("aciertos_respaldados"),
        n(F.array_except(hits, "evidencia")).alias("aciertos_sin_respaldo"), n(F.array_intersect(other, "evidencia")).alias("incorrectas"), n(F.array_except(other, "evidencia")).alias("citas_sin_respaldo"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(F.lit(0.0))
    recall, loose = rate(F.col("aciertos_respaldados") + F.lit(UNSUPPORTED) * F.col("aciertos_sin_respaldo"), "n_ref"), rate(F.col("citas_sin_respaldo"), "n_citadas")
    index = F.greatest(F.lit(0.0), recall - 2 * loose)
    return g.select("*", F.round(recall, 4).alias("recall"), F.round(loose, 4).alias("tasa_sin_respaldo"), F.round(index, 4).alias("indice"), F.round(F.lit(POINTS["citas"]) * index, 2).alias("puntos"))


def abstention(rows: DataFrame, right: Column) -> DataFrame:
    """Confusion of abstaining and being right, and its calibration; a missing answer is a wrong one."""
    right = F.coalesce(right, F.lit(False))
    sent, abst = F.col("enviada"), F.col("abstencion")
    g = rows.agg(F.count_if(sent & abst & ~right).alias("abstuvo_bien"), F.count_if(sent & abst & right).alias("abstuvo_de_mas"), F.count_if(sent & ~abst & right).alias("respondio_bien"), F.count_if(~sent | (~abst & ~right)).alias("respondio_mal"))
    total = F.col("abstuvo_bien") + F.col("abstuvo_de_mas") + F.col("respondio_bien") + F.col("respondio_mal")
    share = F.when(total > 0, (F.col("respondio_bien") + F.lit(ABSTAINED) * (F.col("abstuvo_bien") + F.col("abstuvo_de_mas"))) / total).otherwise(F.lit(0.0))
    return g.select("*", F.round(share, 4).alias("calibracion"), F.round(F.lit(POINTS["abstencion"]) * share, 2).alias("puntos"))


def total(parts: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """``(obtenidos, posibles)`` over the components that were scored; one that was not counts on neither side."""
    union = None
    for name, df in parts:
        if df is not None:
            part = df.select(F.lit(POINTS[name]).alias("posibles"), "puntos")
            union = part if union is None else union.unionByName(part)
    return union.where("puntos is not null").agg(F.round(F.sum("puntos"), 2).alias("obtenidos"), F.sum("posibles").alias("posibles"))


def judge_noise(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two runs' scores ``(id, texto, nota)``: all common rows, and those with equal texts, whose difference is the judge's own."""
    j = a.select("id", F.col("texto").alias("ta"), F.col("nota").alias("na")).join(b.select("id", F.col("texto").alias("tb"), F.col("nota").alias("nb")), "id")
    same, d = F.col("ta").eqNullSafe(F.col("tb")), F.col("nb") - F.col("na")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 4).alias("diferencia"), F.count_if(same).alias("n_iguales"), F.round(F.avg(F.when(same, F.abs(d))), 4).alias("ruido"), F.round(F.avg(F.when(same, d)), 4).alias("sesgo"))


def letter_measures(p: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Accuracy of the mean and of single permutations, mean log loss with a floor and mean probability of the right letter.

    ``p`` is ``(id, perm, letra, correcta, p)``; ties go to the first letter.
    """
    mean = p.groupBy("id", "correcta", "letra").agg(F.avg("p").alias("p"))
    best = mean.groupBy("id", "correcta").agg(F.min_by("letra", F.struct(-F.col("p"), "letra")).alias("ens"), F.max(F.when(F.col("letra") == F.col("correcta"), F.col("p"))).alias("p_gold"))
    perms = p.groupBy("id", "correcta", "perm").agg(F.min_by("letra", F.struct(-F.greatest("p", F.lit(floor)), "letra")).alias("mejor"), F.max(F.when(F.col("letra") == F.col("correcta"), F.col("p"))).alias("g"))
    a = best.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ens") == F.col("correcta")).cast("double")), 4).alias("exactitud"), F.round(F.avg("p_gold"), 4).alias("p_gold_medio"))
    b = perms.agg(F.round(F.avg((F.col("mejor") == F.col("correcta")).cast("double")), 4).alias("exactitud_por_permutacion"), F.round(F.avg(-F.log(F.greatest("g", F.lit(floor)))), 4).alias("nll_medio"))
    return a.join(b)  # one row each


def policy_accuracy(rows: DataFrame, policies: list[str]) -> DataFrame:
    """``(politica, n, aciertos, exactitud)`` of the letters in several columns against ``correcta``."""
    long = rows.select("correcta", F.explode(F.array(*[F.struct(F.lit(p).alias("politica"), F.col(p).alias("letra")) for p in policies])).alias("x")).select("correcta", "x.*")
    right = F.coalesce(F.col("letra") == F.col("correcta"), F.lit(False))
    return long.groupBy("politica").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("aciertos"), F.round(F.avg(right.cast("double")), 4).alias("exactitud"))


def throughput(rows: DataFrame, planned: int) -> DataFrame:
    """``(n, s_por_item, horas, validas, abstenciones)`` of ``(segundos, valida, abstencion)`` and the hours for ``planned`` items."""
    g = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("segundos").alias("s"), F.count_if("valida").alias("validas"), F.count_if("abstencion").alias("abstenciones"))
    return g.select("n", F.round("s", 3).alias("s_por_item"), F.round(F.col("s") * planned / 3600, 3).alias("horas"), "validas", "abstenciones")
