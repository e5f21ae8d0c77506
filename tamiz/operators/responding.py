"""Answering as one function over tables: retrieval alone or with a generator, by strategy, in two phases, with letters' probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Thinker(Protocol):
    """Gives a thought to each prompt, and an answer to each prompt with its thought."""

    def think(self, prompts: pd.Series) -> pd.Series: ...

    def answer(self, prompts: pd.Series, thoughts: pd.Series) -> pd.Series: ...


class LetterScorer(Protocol):
    """Gives one row of scores, one for each letter, to each prompt."""

    def __call__(self, prompts: pd.Series, letters: list[str]) -> list[list[float]]: ...


def two_phases(prompts: DataFrame, thinker: Thinker, longest: int = 4000) -> DataFrame:
    """``(id, pensado, respuesta, cortado)`` of ``(id, prompt)``: a thought, cut at ``longest`` characters and marked so, then the answer to both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            thoughts = thinker.think(batch["prompt"])
            short = thoughts.str.slice(0, longest)
            yield pd.DataFrame({"id": batch["id"], "pensado": short, "respuesta": thinker.answer(batch["prompt"], short), "cortado": thoughts.str.len() > longest})

    return prompts.select("id", "prompt").mapInPandas(run, "id bigint, pensado string, respuesta string, cortado boolean")


def letter_probabilities(prompts: DataFrame, scorer: LetterScorer, letters: list[str]) -> DataFrame:
    """``(id, letra, p)`` of ``(id, prompt)``: scores of the letters as probabilities that sum to one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, x, float(v)) for i, vs in zip(batch["id"], scorer(batch["prompt"], letters)) for x, v in zip(letters, vs)]
            yield pd.DataFrame(rows, columns=["id", "letra", "s"])

    raw = prompts.select("id", "prompt").mapInPandas(run, "id bigint, letra string, s double")
    best = raw.groupBy("id").agg(F.max("s").alias("m"))
    e = raw.join(best, "id").select("id", "letra", F.exp(F.col("s") - F.col("m")).alias("e"))
    total = e.groupBy("id").agg(F.sum("e").alias("t"))
    return e.join(total, "id").select("id", "letra", (F.col("e") / F.col("t")).alias("p"))


def routed(items: DataFrame, by: Column, branches: dict[str, Step], otherwise: Step, failed: Column, fallback: Step) -> DataFrame:
    """Items through the strategy of their kind; rows that ``failed`` marks go through ``fallback`` by their ``id``.

    Every item takes one branch; a null or unknown kind takes ``otherwise``. All steps give the same columns.
    """
    rest = F.coalesce(by.isin(*branches), F.lit(False))
    out = otherwise(items.where(~rest))
    for name, step in branches.items():
        out = out.unionByName(step(items.where(by == name)))
    again = fallback(items.join(out.where(failed).select("id"), "id", "left_semi"))
    return out.where(~F.coalesce(failed, F.lit(False))).unionByName(again)


def respond(items: DataFrame, retrieve: Step, generate: Callable[[DataFrame, DataFrame], DataFrame] | None = None, render: Step | None = None) -> DataFrame:
    """From items to passages and, with a generator, to rendered answers; without one the passages are the result."""
    passages = retrieve(items)
    if generate is None:
        return passages
    made = generate(items, passages)
    return render(made) if render else made


def rendered(kind: Column, letter: Column, answer: Column, basis: Column) -> Column:
    """Readable answer by format: letter with its reason, short answer with its reference, or basis, analysis and conclusion under headings."""
    blank = F.lit("")
    closed = F.concat(F.lit("Respuesta: "), F.coalesce(letter, blank), F.lit("\n"), F.coalesce(answer, blank))
    semi = F.concat(F.coalesce(answer, blank), F.when(basis.isNotNull(), F.concat(F.lit("\nReferencia: "), basis)).otherwise(blank))
    whole = F.concat(F.when(basis.isNotNull(), F.concat(F.lit("Marco normativo\n"), basis, F.lit("\n\n"))).otherwise(blank), F.lit("Análisis\n"), F.coalesce(answer, blank))
    return F.when(kind == "multiple_choice", closed).when(kind == "semi_open", semi).otherwise(whole)
