"""Lines, pages and paragraphs of texts, relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_MARK = r"<!-- pagina \d+ -->"


def join_lines(texts: DataFrame) -> DataFrame:
    """``(id, k, text)`` of ``(id, text)``: lines joined to the one before unless that ends a sentence or this does not begin in lower case.

    Blank lines separate and are dropped. Gaps and islands: a running sum of breaks numbers the islands.
    """
    lines = texts.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.btrim("line"))
    w = Window.partitionBy("id").orderBy("n")
    prev = F.lag("line").over(w)
    breaks = prev.isNull() | (prev == "") | (F.col("line") == "") | prev.rlike("[.:;?!]$") | ~F.col("line").rlike("^[a-záéíóúñü]")
    islands = lines.withColumn("b", breaks.cast("int")).withColumn("grp", F.sum("b").over(w)).where("line != ''")
    merged = islands.groupBy("id", "grp").agg(F.expr("listagg(line, ' ') within group (order by n)").alias("text"))
    return merged.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("grp")) - 1).alias("k"), "text")


def repeated_lines(texts: DataFrame, longest: int = 80, least_pages: int = 4) -> DataFrame:
    """``(id, line, n_pages, pages)``: short lines on more than half of the pages of a part of at least ``least_pages`` pages."""
    pages = texts.where("text is not null").select("id", F.posexplode(F.split("text", PAGE_MARK)).alias("p", "page")).where(F.length(F.regexp_replace("page", r"[ \n]", "")) > 0)
    total = pages.groupBy("id").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    lines = pages.select("id", "p", F.explode(F.split("page", "\n")).alias("line")).withColumn("line", F.btrim("line")).where((F.col("line") != "") & (F.length("line") <= longest))
    return lines.groupBy("id", "line").agg(F.countDistinct("p").alias("n_pages")).join(total, "id").where("n_pages * 2 > pages")


def blocks(texts: DataFrame) -> DataFrame:
    """``(id, k, inicio, fin, text)``: parts between blank lines with their half-open offsets."""
    parts = texts.where("text is not null").select("id", F.posexplode(F.split("text", "\n\n")).alias("k", "text"))
    before = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return parts.withColumn("inicio", at.cast("int")).withColumn("fin", (F.col("inicio") + F.length("text")).cast("int")).where("text != ''")


def pack(pieces: DataFrame, budget: int) -> DataFrame:
    """``(id, chunk, first, last, words)`` of ``(id, k, words)``: consecutive pieces joined while their words fit the budget.

    A piece above the budget is a chunk of its own. The fold runs over one array per id; an id's pieces are those of one
    document.
    """
    rows = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "words"))).alias("p"))
    start = F.expr("named_struct('done', cast(array() as array<struct<first:int,last:int,words:bigint>>), 'first', cast(null as int), 'last', cast(null as int), 'words', 0L)")

    def step(acc, x):
        fits = acc["first"].isNotNull() & (acc["words"] + x["words"] <= budget)
        closed = F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["words"].alias("words")))))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, acc["first"]).otherwise(x["k"]).alias("first"), x["k"].alias("last"), F.when(fits, acc["words"] + x["words"]).otherwise(x["words"].cast("bigint")).alias("words"))

    end = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["words"].alias("words"))))
    return rows.select("id", F.posexplode(F.aggregate("p", start, step, end)).alias("chunk", "c")).select("id", "chunk", "c.*")


def part_of(parts, offset):
    """Address of the last part that begins at or before an offset; of the first part where none does. ``parts`` is an array of ``(inicio, url)``."""
    before = F.filter(parts, lambda p: p["inicio"] <= offset)
    return F.when(F.size(before) > 0, F.element_at(before, -1)["url"]).otherwise(F.element_at(parts, 1)["url"])


def outside(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points ``(id, at)`` in none of the half-open ``spans (id, a, b)``: an interval anti-join by id, so it stays an equi-join."""
    held = spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    j = points.join(held, "id", "left")
    return j.where(~F.exists(F.coalesce("spans", F.array()), lambda s: (s["a"] <= F.col("at")) & (F.col("at") < s["b"]))).drop("spans")
