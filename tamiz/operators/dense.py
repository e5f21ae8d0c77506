"""Exact dense search by inner product, in blocks of queries; encoders and scorers as plug-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.operators.lexical import ranked

#: Numbers that one block of query vectors may hold on the driver and in a task.
BLOCK_NUMBERS = 4_000_000


class Encoder(Protocol):
    """Gives one vector for each text."""

    def __call__(self, texts: pd.Series) -> np.ndarray: ...


def hashing_encoder(texts: pd.Series, size: int = 64) -> np.ndarray:
    """Stand-in without a model: signed word hashes, unit length."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(qid, row_id, score, rank)``: the ``k`` rows with the largest inner product for each query.

    ``vectors`` is ``(row_id, v array<float>)``, ``queries`` is ``(qid, v)``. Queries are read in blocks of a checked
    size; each task multiplies its batch with a block and keeps ``k`` rows a query before anything is shuffled. Null
    vectors match nothing; ties go to the smaller id; scores are rounded to six places before they are ranked.
    """
    found, block, held = None, [], 0

    def search(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                v = np.stack(batch["v"].to_numpy()).astype(np.float64)
                rows = batch["row_id"].to_numpy(np.int64)
                scores = np.round(matrix @ v.T, 6)
                parts = []
                for q, s in zip(ids, scores):
                    top = np.lexsort((rows, -s))[:k]
                    parts.append(pd.DataFrame({"qid": q, "row_id": rows[top], "score": s[top]}))
                yield pd.concat(parts)

        return vectors.where("v is not null and row_id is not null").select("row_id", "v").mapInPandas(run, "qid bigint, row_id bigint, score double")

    for r in queries.where("v is not null and qid is not null").select("qid", "v").toLocalIterator():
        block.append((r.qid, r.v))
        held += len(r.v)
        if held >= BLOCK_NUMBERS:
            part = search(np.array([q for q, _ in block]), np.array([v for _, v in block], np.float64))
            found, block, held = part if found is None else found.unionByName(part), [], 0
    if block or found is None:
        dims = len(block[0][1]) if block else 0
        part = search(np.array([q for q, _ in block]), np.array([v for _, v in block], np.float64).reshape(len(block), dims)) if block else vectors.sparkSession.createDataFrame([], "qid bigint, row_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def encode_distinct(rows: DataFrame, key: str, text: str, encoder: Callable[[pd.Series], np.ndarray]) -> DataFrame:
    """Adds ``v``: every distinct text, told by ``key``, is encoded once and its vector joined back to all its rows."""

    @F.pandas_udf("array<float>")
    def encode(t: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(t)))

    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("__text")).select(key, encode("__text").alias("v"))
    return rows.join(once, key, "left")


def cosine(a, b):
    """Cosine of two array columns; null where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)
