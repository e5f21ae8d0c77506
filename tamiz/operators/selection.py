"""Choice of passages under several constraints at once: greedy by nature, so one fold per query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A query's candidates are the few hundred rows of its rankings; a fold sees only those.
CANDIDATE = "qid bigint, row_id bigint, via string, opcion string, puntaje double, canon string, doc_id string"


def candidates(direct: DataFrame, hybrid: DataFrame, per_option: DataFrame, hashes: DataFrame, k: int = 50, extra: int = 2) -> DataFrame:
    """``(qid, row_id, via, opcion)``: directs, then the head of the hybrid ranking, then up to ``extra`` new rows an option.

    ``direct`` and ``hybrid`` are ``(qid, row_id, rank)``, ``per_option`` has ``opcion`` too, ``hashes`` is
    ``(row_id, hash)``. A row enters once, and one of each hash. The hybrid head is ``k`` less ``extra`` for each
    option, counted by list positions.
    """
    options = per_option.groupBy("qid").agg(F.countDistinct("opcion").alias("n_options"))
    tagged = (
        direct.select("qid", "row_id", "rank", F.lit("directo").alias("via"), F.lit(None).cast("string").alias("opcion"))
        .unionByName(hybrid.select("qid", "row_id", "rank", F.lit("hibrido").alias("via"), F.lit(None).cast("string").alias("opcion")))
        .unionByName(per_option.select("qid", "row_id", "rank", F.lit("opcion").alias("via"), "opcion"))
        .join(hashes.select("row_id", "hash"), "row_id")
        .join(options, "qid", "left")
    )

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["n_options"].fillna(0).iloc[0]
        stage = {"directo": 0, "hibrido": 1, "opcion": 2}
        rows = sorted(frame.itertuples(index=False), key=lambda r: (stage[r.via], r.opcion or "", r.rank))
        seen, texts, taken, out = set(), set(), {}, []
        for r in rows:
            if r.via == "hibrido" and r.rank > k - extra * n:
                continue
            if r.via == "opcion" and taken.get(r.opcion, 0) >= extra:
                continue
            if r.row_id in seen or r.hash in texts:
                continue
            seen.add(r.row_id)
            texts.add(r.hash)
            taken[r.opcion] = taken.get(r.opcion, 0) + 1
            out.append((r.qid, r.row_id, r.via, r.opcion))
        return pd.DataFrame(out, columns=["qid", "row_id", "via", "opcion"])

    return tagged.groupBy("qid").applyInPandas(fold, "qid bigint, row_id bigint, via string, opcion string")


def choose(scored: DataFrame, final: int = 10, per_norm: int = 2, judgments: int = 5, head: int = 8) -> DataFrame:
    """``(qid, row_id, rank)`` of candidates with score, canon and document.

    Kept: all directs, the best row of each option, at most ``per_norm`` of a norm and one document of it, at most
    ``judgments`` judgments; places left are filled with what was passed over; reserved rows come into the first
    ``head``. Order: score down, id up; null scores count as zero.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(puntaje=frame["puntaje"].fillna(0.0)).sort_values(["puntaje", "row_id"], ascending=[False, True])
        rows = list(frame.itertuples(index=False))
        reserved = [r for r in rows if r.via == "directo"]
        for o in sorted({r.opcion for r in rows if r.via == "opcion" and r.opcion}):
            best = next(r for r in rows if r.opcion == o)
            if best not in reserved:
                reserved.append(best)
        norms, docs, courts, kept, passed = {}, {}, 0, [], []
        ids = {r.row_id for r in reserved}
        for r in rows:
            base = (r.canon or "").split("#")[0]
            court = base.startswith("sentencia_")
            fits = norms.get(base, 0) < per_norm and docs.get(base, r.doc_id) == r.doc_id and not (court and courts >= judgments) if base else True
            if r.row_id in ids or (fits and len(kept) < final):
                kept.append(r)
                norms[base] = norms.get(base, 0) + 1
                docs.setdefault(base, r.doc_id)
                courts += court
            else:
                passed.append(r)
        kept += passed[: max(0, final - len(kept))]
        order = {r.row_id: i for i, r in enumerate(rows)}
        kept = sorted({r.row_id for r in kept}, key=lambda i: (i not in ids, order[i]))[:final]
        first = sorted(kept[:head], key=order.get)
        rest = sorted(kept[head:], key=order.get)
        qid = rows[0].qid
        return pd.DataFrame([(qid, i, n) for n, i in enumerate(first + rest, 1)], columns=["qid", "row_id", "rank"])

    return scored.groupBy("qid").applyInPandas(fold, "qid bigint, row_id bigint, rank int")


def reorder_by_support(passages: DataFrame, top: int = 10) -> DataFrame:
    """``(qid, row_id, rank)``: passages that support a cited norm first, then inserted ones that add a new norm, then the rest.

    ``passages`` is ``(qid, row_id, rank, inserted boolean, supports array<string>)``.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("rank").itertuples(index=False))
        covered: set[str] = set()
        first, added, rest = [], [], []
        for r in rows:
            if not r.inserted and len(r.supports):
                first.append(r)
                covered |= set(r.supports)
        for r in rows:
            if r.inserted and set(r.supports) - covered:
                added.append(r)
                covered |= set(r.supports)
            elif not r.inserted and not len(r.supports):
                rest.append(r)
        out = [r.row_id for r in first + added + rest][:top]
        return pd.DataFrame([(rows[0].qid, i, n) for n, i in enumerate(out, 1)], columns=["qid", "row_id", "rank"])

    return passages.groupBy("qid").applyInPandas(fold, "qid bigint, row_id bigint, rank int")
