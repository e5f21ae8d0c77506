"""Filling containers of fixed capacity: harmonic classes, with the rest of each container topped up.

Sizes are whole tokens, so a table of items is described by a histogram with at most as many rows as the capacity. A
plan made on that histogram alone says for every run of ranks within a size which containers it fills: items of class
``k`` (sizes above C/(k+1) and up to C/k) go ``k`` to a container, and before a size opens containers of its own, its
items are placed in the smallest leftover that takes them. Tasks then place their items independently: the rank of an
item is the offset of its partition plus its place in the partition, found without moving the texts.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.session import cut

CAPACITY = 4096
#: The words of this public tokenizer; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-level BPE of a rank file, once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(texts: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, pieza, desde, hasta, tokens)`` of ``(doc_id, text)``: offsets in tokens; only texts above the capacity have several.

    Null and empty texts have one piece of no tokens. Texts are counted where they lie, whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for batch in batches:
            n = np.array([len(e.encode_ordinary(t)) if t else 0 for t in batch["text"]], np.int64)
            pieces = np.maximum(1, -(-n // capacity))
            at = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            end = np.minimum((k + 1) * capacity, n[at])
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "pieza": k.astype(np.int32), "desde": (k * capacity).astype(np.int32), "hasta": end.astype(np.int32), "tokens": (end - k * capacity).astype(np.int32)})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id bigint, pieza int, desde int, hasta int, tokens int")


def plan(histogram: dict[int, int], capacity: int, top_up: bool = True) -> tuple[np.ndarray, int]:
    """Rows ``(size, first rank, first container, items a container)`` by size and rank, and the number of containers.

    Sizes are taken from the largest. Leftovers are kept by room as runs of containers; a run takes one item each, or
    as many as its room allows.
    """
    rows: list[tuple[int, int, int, int]] = []
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def free(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, count))

    for size in sorted((s for s in histogram if 0 < s <= capacity), reverse=True):
        left, rank = histogram[size], 0
        while top_up and left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                break
            room = rooms[at]
            first, count = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            each = min(room // size, left)
            used = min(count, left // each)
            rows.append((size, rank, first, each))
            left, rank = left - used * each, rank + used * each
            free(room - each * size, first, used)
            free(room, first + used, count - used)
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            rows.append((size, rank, opened, each))
            free(capacity - each * size, opened, full)
            free(capacity - rest * size if rest else 0, opened + full, 1)
            opened += full + (rest > 0)
    return np.array(rows, np.int64).reshape(-1, 4), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, top_up: bool = True) -> DataFrame:
    """Adds ``contenedor`` to pieces with a column ``tokens`` of at most the capacity.

    Pieces of no or null tokens belong to no container (null). Repeated rows are items of their own. No container
    holds more than the capacity. What reaches the driver is the histogram: one row per size, at most ``capacity``
    rows. Without ``top_up`` the containers are those of plain harmonic packing. Other columns are kept.
    """
    held = cut(pieces.withColumn("__part", F.spark_partition_id()).withColumn("tokens", F.col("tokens").cast("int")))
    counts = cut(held.where(f"tokens between 1 and {capacity}").groupBy("__part", "tokens").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.tokens: r.n for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).toLocalIterator()}
    rows, _ = plan(histogram, capacity, top_up)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    top = max([1, *histogram.values()])
    if top * (capacity + 1) >= 2**63:
        raise ValueError("more than 2^50 items of one size")
    code = rows[:, 0] * top + rows[:, 1]
    before = Window.partitionBy("tokens").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    names = [c for c in held.columns if c != "__part"]
    inner = Window.partitionBy("__part", "tokens").orderBy("__row")
    local = held.withColumn("__row", F.monotonically_increasing_id()).withColumn("__rank", F.row_number().over(inner) - 1)
    # The offsets are keyed like the window above, so this join needs no further shuffle of the items.
    ranked = local.join(offsets, ["__part", "tokens"], "left").withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))

    @F.pandas_udf("bigint")
    def container(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        t, r = tokens.fillna(0).to_numpy(np.int64), rank.to_numpy(np.int64)
        ok = (t > 0) & (t <= capacity)
        out = np.full(len(t), -1, np.int64)
        if ok.any():
            at = np.searchsorted(code, t[ok] * top + r[ok], "right") - 1
            _, first, start, each = rows[at].T
            out[ok] = start + (r[ok] - first) // each
        return pd.Series(out)

    placed = ranked.withColumn("contenedor", container("tokens", "__rank"))
    return placed.select(*names, F.when(F.col("contenedor") >= 0, F.col("contenedor")).alias("contenedor"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row ``(contenedores, minimo, tokens, llenado)`` of ``(tokens, contenedor)``; an empty table uses no container and fills nothing.

    Containers are pre-aggregated; only their number and sum reach the last task.
    """
    each = packed.where("contenedor is not null").groupBy("contenedor").agg(F.sum("tokens").alias("t"))
    g = each.agg(F.count(F.lit(1)).alias("contenedores"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    share = F.when(F.col("contenedores") > 0, F.round(F.col("tokens") / (F.col("contenedores") * capacity), 4))
    return g.select("contenedores", F.ceil(F.col("tokens") / capacity).alias("minimo"), "tokens", share.alias("llenado"))
