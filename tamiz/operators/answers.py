"""Texts of questions and answers: options, model output, citations in answers, context for a prompt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import citations as C
from tamiz.functions import text as T


class Scorer(Protocol):
    """Gives a score to each pair of query and passage."""

    def __call__(self, query: pd.Series, passage: pd.Series) -> pd.Series: ...


class Generator(Protocol):
    """Gives one output text for each prompt."""

    def __call__(self, prompts: pd.Series) -> pd.Series: ...


def parse_options(text: Column) -> Column:
    """Options ``A) ... B) ...`` of a question as a map, one a line or in line; null unless A, B and C are there."""
    marked = F.regexp_replace(text, r"(?:^|\s)\(?([A-F])[).]\s+", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: x.contains("\u0002"))
    entries = F.transform(parts, lambda x: F.struct(F.substring_index(x, "\u0002", 1).alias("k"), F.trim(F.substring_index(x, "\u0002", -1)).alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    whole = F.forall(F.array(F.lit("A"), F.lit("B"), F.lit("C")), lambda k: F.array_contains(keys, k)) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(whole, F.map_from_entries(entries))


def option_kind(option: Column) -> Column:
    """Struct of an option's kind (all, none, combination, simple) and the letters a combination names."""
    low = F.lower(T.fold(option))
    letters = F.array_distinct(F.regexp_extract_all(option, F.lit(r"\b([A-F])\b"), 1))
    kind = F.when(low.rlike(r"todas las anteriores|all of the above"), "all").when(low.rlike(r"ninguna de las anteriores|none of the above"), "none").when((F.size(letters) >= 2) & low.rlike(r"\b(y|and|e)\b") & (T.word_count(option) <= 8), "combination").otherwise("simple")
    return F.struct(kind.alias("kind"), F.when(kind == "combination", letters).otherwise(F.array().cast("array<string>")).alias("letters"))


def normalised_output(raw: Column, schema: str) -> Column:
    """Struct of the first JSON object in a model's output; null where there is none that fits."""
    return F.from_json(T.json_object(raw), schema)


def letter_of(text: Column) -> Column:
    """Letter of an answer: the one alone, or the first that is followed by a bracket, point or colon."""
    up = F.upper(F.trim(text))
    return F.when(up.rlike(r"^[A-F]$"), up).otherwise(F.nullif(F.regexp_extract(up, r"\b([A-F])\s*[).:]", 1), F.lit("")))


def distinct_ignoring_case(words: Column, most: int) -> Column:
    """The first ``most`` words that differ by more than case, in order."""
    keep = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.slice(F.transform(words, F.lower), 1, i).alias("before"))), lambda x: ~F.array_contains(x["before"], F.lower(x["w"])))
    return F.slice(F.transform(keep, lambda x: x["w"]), 1, most)


def drop_citing_sentences(text: Column, bad: Column) -> Column:
    """A text without the sentences that cite one of the ids in ``bad``."""
    return F.array_join(F.filter(T.simple_sentences(text), lambda s: ~F.arrays_overlap(C.bodies(s), bad)), " ")


def add_evidence(text: Column, cited: Column, evidence: Column, most: int = 8) -> Column:
    """A text with the ids of the evidence that it does not cite yet, at most ``most``; unchanged where there are none."""
    new = F.slice(F.array_except(evidence, cited), 1, most)
    return F.when(F.size(new) > 0, F.concat(F.coalesce(text, F.lit("")), F.lit(" ["), F.array_join(new, "; "), F.lit("]"))).otherwise(text)


def expand_aliases(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``(qid, q)`` with the names of cited norms that a query lacks added; ``names`` is ``(canon, name)``, of which the longest counts."""
    longest = names.where(F.length("name") > 5).groupBy("canon").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))
    cited = queries.select("qid", "q", F.explode_outer(C.bodies(F.col("q"))).alias("canon")).join(longest, "canon", "left")
    new = F.when(F.col("name").isNotNull() & ~F.contains(T.normal(F.col("q")), T.normal(F.col("name"))), F.col("name"))
    g = cited.groupBy("qid", "q").agg(F.array_sort(F.collect_set(new)).alias("names"))
    return g.select("qid", F.concat_ws(" ", "q", F.array_join("names", " ")).alias("q"), F.size("names").alias("added"))


def keyword_areas(rows: DataFrame, text: str, areas: list[tuple[str, list[str]]], most: int = 3, otherwise: str = "general") -> DataFrame:
    """Adds ``areas``: up to ``most`` areas by the number of their keywords in a text, ties in the given order."""
    low = T.normal(F.col(text))
    scores = F.array(*[F.struct((-sum((low.contains(k).cast("int") for k in words), F.lit(0))).alias("n"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, (a, words) in enumerate(areas)])
    best = F.transform(F.slice(F.array_sort(F.filter(scores, lambda x: x["n"] < 0)), 1, most), lambda x: x["a"])
    return rows.withColumn("areas", F.when(F.size(best) > 0, best).otherwise(F.array(F.lit(otherwise))))


def passage_block(passages: DataFrame) -> DataFrame:
    """``(qid, block)``: the passages of a query as one text, ``[P1] document`` and so on, in order of rank."""
    line = F.concat(F.lit("[P"), F.col("rank").cast("string"), F.lit("] "), F.col("doc_id"), F.lit("\n"), F.col("texto"))
    return passages.withColumn("__l", line).groupBy("qid").agg(F.expr("listagg(__l, '\n\n') within group (order by rank)").alias("block"))


def scored(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds ``puntaje`` to ``(qid, row_id, q, texto)`` with a given scorer, in Arrow batches."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return scorer(q, t)

    return pairs.withColumn("puntaje", run("q", "texto"))


def overlap_scorer(query: pd.Series, passage: pd.Series) -> pd.Series:
    """Stand-in without a model: share of the query's words that the passage has."""
    return pd.Series([len(a & b) / len(a) if (a := set((q or "").lower().split())) and (b := set((t or "").lower().split())) is not None else 0.0 for q, t in zip(query, passage)])


def generated(prompts: DataFrame, generator: Generator, valid: Callable[[str], bool], tries: int = 2) -> DataFrame:
    """``(id, output, ok)`` of ``(id, prompt)``: outputs that are not valid are asked for again; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            todo = list(range(len(batch)))
            for _ in range(tries):
                if not todo:
                    break
                try:
                    got = list(generator(batch["prompt"].iloc[todo]))
                except Exception:  # noqa: BLE001 - a failing model gives rows without output
                    break
                for i, t in zip(todo, got):
                    out[i] = t
                todo = [i for i in todo if not (out[i] is not None and valid(out[i]))]
            yield pd.DataFrame({"id": batch["id"], "output": out, "ok": [i not in todo for i in range(len(batch))]})

    return prompts.mapInPandas(run, "id bigint, output string, ok boolean")


def query_rows(items: DataFrame) -> DataFrame:
    """``(qid, kind, opcion, q)``: the statement with its options, and one query for each option."""
    options = F.array_sort(F.map_entries("opciones"))
    base = items.select(F.col("id").alias("qid"), F.lit("base").alias("kind"), F.lit(None).cast("string").alias("opcion"), F.concat_ws("\n", "pregunta", F.array_join(F.transform(options, lambda e: e["value"]), "\n")).alias("q"))
    each = items.where("opciones is not null").select(F.col("id").alias("qid"), "pregunta", F.explode("opciones").alias("opcion", "o")).select("qid", F.lit("opcion").alias("kind"), "opcion", F.concat_ws("\n", "pregunta", "o").alias("q"))
    return base.unionByName(each)


def copies_among(passages: DataFrame) -> DataFrame:
    """``(qid, copies)``: passages whose norm entered before from another document."""
    w = Window.partitionBy("qid", "canon").orderBy("rank")
    marked = passages.withColumn("__first", F.first("doc_id").over(w))
    return marked.groupBy("qid").agg(F.count_if((F.col("__first") != F.col("doc_id")) & F.col("canon").isNotNull()).alias("copies"))


def option_coverage(passages: DataFrame, items: DataFrame, top: int = 8) -> DataFrame:
    """``(qid, coverage)``: share of a question's options that have a passage among the first ``top``; null without options."""
    have = passages.where((F.col("rank") <= top) & (F.col("via") == "opcion")).groupBy("qid").agg(F.collect_set("opcion").alias("o"))
    j = items.select(F.col("id").alias("qid"), F.map_keys("opciones").alias("all")).join(have, "qid", "left")
    return j.select("qid", F.when(F.size("all") > 0, F.round(F.size(F.array_intersect("all", F.coalesce("o", F.array().cast("array<string>")))) / F.size("all"), 4)).alias("coverage"))
