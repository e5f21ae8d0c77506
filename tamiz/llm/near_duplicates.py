"""Groups of near-duplicate records: universal hash minima, banding, verification, large-star/small-star components.

Elements of a record are word shingles of a text or canonical addresses of a list. 192 universal minima are cut
into bands; records that share a band key meet in a bucket. Buckets are sorted by further minima and each record is
rated against the neighbours behind it, which is linear in the members and splits a hot bucket over tasks. In buckets
that hold more records than neighbours, all pairs between parts that are not yet joined are rated afterwards, by pairs
of blocks spread over tasks, so that every pair that shares a bucket is decided. Signatures decide clear cases (at least four standard deviations from the threshold), everything
between is verified exactly on the elements. Records with equal elements are one node before any bucket is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.words import mix, odd_constants, shingles, word_ids
from tamiz.operators.components import connected_components
from tamiz.session import cut

HASHES = 192
#: Minima that a pair is rated by.
RATED = 128
#: Four standard deviations of the share of equal minima at a similarity of one half.
SLACK = 0.18
_A = odd_constants(HASHES, 11).astype(np.uint32)[:, None] | np.uint32(1)
_B = odd_constants(HASHES, 13).view(np.uint32)[:HASHES][:, None]
#: Rows of its bucket that a record is rated against at first: those behind it when the bucket is sorted by further minima. Buckets of one row more
#: are so rated whole; in larger ones, what this does not join is rated by all pairs of blocks.
NEIGHBOURS = 128
#: Records of a block of a larger bucket, and those rated at once against another block.
BLOCK, _AT_ONCE = 8192, 64


def minima(elements: np.ndarray) -> np.ndarray:
    """192 universal hash minima (ax + b modulo 2^32) of 64-bit elements."""
    x, best = (elements >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(best, (x[None, k : k + 1024] * _A + _B).min(axis=1), out=best)
    return best


def sketch(signature: np.ndarray) -> bytes:
    """Eight mixed bits of every rated minimum; two of different minima are equal in one of 256 cases."""
    return (mix(signature[:RATED].astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` minima; the band's number is part of the key."""
    parts = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(rows):
        key = mix(key ^ (parts[:, k] + np.uint64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))))
    return key.astype(np.int64)


def text_shingles(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingles(word_ids(text), width))


def _signer(width: int, rows: int, bands: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, text in zip(batch["node"], batch["text"]):
                ids = word_ids(text)
                if len(ids) < width:
                    out.append((node, None, None, None))
                    continue
                s = minima(shingles(ids, width))
                x = mix(ids * odd_constants(1, 3)[0] + mix(np.arange(len(ids), dtype=np.uint64)))
                out.append((node, f"{int(x.sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(x)):016x}{len(ids):x}", sketch(s), band_keys(s, rows, bands)))
            yield pd.DataFrame(out, columns=["node", "same", "sig", "keys"])

    return sign


def sign_texts(texts: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """``(node, same, sig, keys)`` of ``(node, text)``; texts of fewer than ``width`` words get nulls."""
    return texts.mapInPandas(_signer(width, rows, bands), "node string, same string, sig binary, keys array<bigint>")


def sign_sets(sets: DataFrame, rows: int, bands: int) -> DataFrame:
    """The same of ``(node, items array<string>)`` with distinct, sorted items."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, same, hashes in zip(batch["node"], batch["same"], batch["hashes"]):
                s = minima(mix(np.asarray(hashes, np.int64).view(np.uint64)))
                out.append((node, same, sketch(s), band_keys(s, rows, bands)))
            yield pd.DataFrame(out, columns=["node", "same", "sig", "keys"])

    hashed = sets.select("node", F.sha2(F.concat_ws("\u0001", "items"), 256).alias("same"), F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    return hashed.mapInPandas(sign, "node string, same string, sig binary, keys array<bigint>")


class _Neighbours:
    """Rates every row of sorted buckets against the ``NEIGHBOURS`` rows behind it; sure pairs only as far as they join parts, doubtful ones between parts."""

    def __init__(self, low: float, high: float):
        self.low, self.high, self.fresh = low, high, 0
        self.keys, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.sigs, self.part = np.empty((0, RATED), np.uint8), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int, float]]:
        """Pairs of the rows that follow the earlier ones."""
        old = len(self.keys)
        self.keys, self.ids, self.sigs = np.concatenate([self.keys, keys]), np.concatenate([self.ids, ids]), np.concatenate([self.sigs, sigs])
        self.part = np.concatenate([self.part, np.arange(self.fresh, self.fresh + len(keys))])
        self.fresh += len(keys)
        n, out, doubtful = len(self.keys), [], []
        for d in range(1, NEIGHBOURS + 1):
            i = np.arange(max(old - d, 0), n - d)
            i = i[self.keys[i] == self.keys[i + d]]
            if not len(i):
                break
            i = i[self.part[i] != self.part[i + d]]
            share = (self.sigs[i] == self.sigs[i + d]).mean(axis=1)
            sure = i[share >= self.high]
            if d == 1:
                # Alike neighbours are chained at once, so that a bucket of copies costs one comparison a row.
                begin = np.ones(n, bool)
                begin[sure + 1] = False
                self.part = self.part[np.maximum.accumulate(np.where(begin, np.arange(n), 0))]
                out += list(zip(self.ids[sure], self.ids[sure + 1], share[share >= self.high]))
            else:
                for j, s in zip(sure, share[share >= self.high]):
                    if self.part[j] != self.part[j + d]:
                        out.append((self.ids[j], self.ids[j + d], s))
                        self.part[self.part == self.part[j + d]] = self.part[j]
            open_ = (share >= self.low) & (share < self.high)
            doubtful += list(zip(i[open_], i[open_] + d, share[open_]))
        out += [(self.ids[i], self.ids[j], s) for i, j, s in doubtful if self.part[i] != self.part[j]]
        for name in ("keys", "ids", "sigs", "part"):
            setattr(self, name, getattr(self, name)[-NEIGHBOURS:])
        return [(min(a, b), max(a, b), float(s)) for a, b, s in out]


_RATED = "a bigint, b bigint, share double, key bigint, turn bigint, id bigint, sig binary"


def _rate(low: float, high: float, edges: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rated pairs of sorted rows ``(key, turn, id, sig)``; with ``edges`` also the first and last rows of a task whose bucket may go on in another."""
    columns = ["key", "turn", "id", "sig"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = _Neighbours(low, high)
        head: pd.DataFrame | None = None
        tail: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            found = near.add(batch["key"].to_numpy(), batch["id"].to_numpy(), np.frombuffer(b"".join(batch["sig"]), np.uint8).reshape(-1, RATED))
            yield pd.DataFrame(found, columns=["a", "b", "share"]).drop_duplicates(["a", "b"]).reindex(columns=["a", "b", "share", *columns])
            if edges:
                head = batch if head is None else head if len(head) >= NEIGHBOURS else pd.concat([head, batch])
                tail = (batch if tail is None else pd.concat([tail, batch])).iloc[-NEIGHBOURS:]
                head = head.iloc[:NEIGHBOURS]
        if head is not None and tail is not None:
            rows = pd.concat([head[head["key"] == head["key"].iloc[0]], tail[tail["key"] == tail["key"].iloc[-1]]]).drop_duplicates(["key", "id"])
            yield rows.reindex(columns=["a", "b", "share", *columns])

    return run


def _rated(members: DataFrame, low: float, high: float) -> DataFrame:
    """Rated pairs ``(a, b, share)`` of bucket members ``(key, turn, id, sig)``.

    Rows are sorted by bucket and turn and cut into tasks of equal size, so that no bucket, however large, fills one
    task; the edges of the tasks, at most twice ``NEIGHBOURS`` rows each, are rated afterwards. Work is linear in rows.
    """
    tasks = members.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = members.repartitionByRange(int(tasks), "key", "turn", "id").sortWithinPartitions("key", "turn", "id")
    first = cut(ranged.mapInPandas(_rate(low, high, True), _RATED))
    edges = first.where("a is null").select("key", "turn", "id", "sig")
    rest = edges.repartition("key").sortWithinPartitions("key", "turn", "id").mapInPandas(_rate(low, high, False), _RATED)
    return first.where("a is not null").select("a", "b", "share").unionByName(rest.where("a is not null").select("a", "b", "share")).dropDuplicates(["a", "b"])


class _Parts:
    """Parts that records belong to, as far as a task knows; joined by the smaller name."""

    def __init__(self, part: np.ndarray):
        self.names, self.at = np.unique(part, return_inverse=True)
        self.root = np.arange(len(self.names))

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.at[rows]]

    def join(self, i: int, j: int) -> bool:
        """Whether the parts of two rows were apart; they no longer are."""
        a, b = self.root[self.at[i]], self.root[self.at[j]]
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        return True


def _equal_minima(sigs: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Numbers of equal minima of all rows with all others; ``sigs`` holds one row a minimum."""
    total, same = np.zeros((len(rows), len(others)), np.uint8), np.empty((len(rows), len(others)), bool)
    for s in sigs:
        np.equal(s[rows, None], s[None, others], out=same)
        total += same.view(np.uint8)
    return total


def _block_pairs(side: np.ndarray, parts: _Parts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and those to rate them against: all pairs of one block or between two, but for those of one part."""
    order = np.argsort(parts.at, kind="stable")
    a = order if side.min() == side.max() else order[side[order] == side.min()]
    b = order if side.min() == side.max() else order[side[order] != side.min()]
    for k in range(0, len(a), _AT_ONCE):
        rows = a[k : k + _AT_ONCE]
        others = b[k + 1 :] if b is order else b
        mine = parts.of(rows)
        if mine.min() == mine.max():
            others = others[parts.of(others) != mine[0]]
        if len(others):
            yield rows, others


def _rate_block(low: float, high: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sure pairs ``(a, b)`` between parts of the members of two blocks, and as ``(a, null)`` those members that are in a doubtful one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, parts = group["id"].to_numpy(), _Parts(group["part"].to_numpy())
        sigs = np.ascontiguousarray(np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, RATED).T)
        out, open_ = [], np.zeros(len(ids), bool)
        for rows, others in _block_pairs(group["side"].to_numpy(), parts):
            total = _equal_minima(sigs, rows, others)
            i, j = np.nonzero(total >= low * RATED)
            share, i, j = total[i, j] / RATED, rows[i], others[j]
            sure = (share >= high) & (parts.of(i) != parts.of(j))
            out += [(ids[x], ids[y]) for x, y in zip(i[sure], j[sure]) if parts.join(x, y)]
            left = (share < high) & (parts.of(i) != parts.of(j))
            open_[i[left]] = open_[j[left]] = True
        found = pd.DataFrame(out + [(x, None) for x in ids[open_]], columns=["a", "b"]).astype("Int64")
        return found.assign(**{c: group[c].iloc[0] for c in ("key", "x", "y")})

    return run


def _verify_block(low: float, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """True pairs ``(a, b)`` between parts of the members of two blocks, by their elements."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, parts = group["id"].to_numpy(), _Parts(group["part"].to_numpy())
        sigs = np.ascontiguousarray(np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, RATED).T)
        held = [np.frombuffer(e, np.uint64) for e in group["elements"]]
        size = np.array([len(e) for e in held])
        names, codes = np.unique(np.concatenate(held), return_inverse=True)
        held = np.split(codes, np.cumsum(size)[:-1])
        mark, out = np.zeros(len(names), bool), []
        for rows, others in _block_pairs(group["side"].to_numpy(), parts):
            total = _equal_minima(sigs, rows, others)
            for k, i in enumerate(rows):
                j = others[total[k] >= low * RATED]
                j = j[(parts.of(j) != parts.of(i)) & (np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]))]
                if not len(j):
                    continue
                mark[held[i]] = True
                both = np.add.reduceat(mark[np.concatenate([held[x] for x in j])], np.cumsum(size[j]) - size[j], dtype=np.int64)
                mark[held[i]] = False
                out += [(ids[i], ids[x]) for x in j[both >= threshold * (size[i] + size[j] - both)] if parts.join(i, x)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _crowded(members: DataFrame, elements: Callable[[DataFrame], DataFrame], sure: DataFrame, low: float, high: float, threshold: float) -> DataFrame:
    """True pairs ``(a, b)`` that join what ``sure`` pairs leave apart in buckets ``(key, n, id, node, sig)`` of more members than neighbours.

    Members are dealt into blocks, every pair of blocks is one group, and a group holds at most about twice ``BLOCK``
    records, whatever the size of a bucket. Elements go only to groups where signatures leave pairs doubtful, and no
    doubtful pair is stored, so that what moves grows with the members and their blocks, not with the pairs.
    """
    parts = connected_components(sure, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("part"))
    placed = cut(members.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")))
    apart = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least != most").select("key")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    sided = placed.join(apart, "key").withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = sided.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "id", "node", "part", "sig")
    rated = cut(dealt.drop("node").groupBy("key", "x", "y").applyInPandas(_rate_block(low, high), "a bigint, b bigint, key bigint, x int, y int"))
    found = rated.where("b is not null").select("a", "b")
    open_ = rated.where("b is null").select("key", "x", "y", F.col("a").alias("id"))
    if open_.isEmpty():
        return found
    doubtful = cut(dealt.join(open_, ["key", "x", "y", "id"]))
    held = cut(elements(doubtful.select("node").distinct()))
    return found.unionByName(doubtful.join(held, "node").groupBy("key", "x", "y").applyInPandas(_verify_block(low, threshold), "a bigint, b bigint"))


def links(signed: DataFrame, exact: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame], threshold: float, costly: bool) -> DataFrame:
    """Links ``(src, dst)`` between nodes whose components are the groups of the signed records.

    ``exact`` gets doubtful pairs of contents ``(a, b, node_a, same_a, node_b, same_b)``, where a node is one that holds
    the content, and keeps ``(a, b)`` of the true links; where it is ``costly``, only pairs between components of sure
    links are asked for. ``elements`` gives ``(node, elements)``, 64-bit hashes as bytes, of all versions of the nodes asked for. A node may come with several versions; it is then linked if any version is. Nodes without
    elements are left out.
    """
    signed = cut(signed.where("node is not null and same is not null").dropDuplicates(["node", "same"]))
    low, high = threshold - SLACK, threshold + SLACK
    reps = signed.groupBy("same").agg(F.min("node").alias("rep"))
    contents = cut(signed.join(reps, "same").where("node = rep").select("node", "same", "sig", "keys").withColumn("id", F.monotonically_increasing_id()))
    names = contents.select("id", "node", "same")
    equal = signed.select("node", "same").join(reps, "same").where("node != rep").select(F.col("node").alias("src"), F.col("rep").alias("dst"))
    members = contents.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(members.join(sizes, "key"))
    # Within a bucket, records stand by two further minima, others in every band, so that like ones are neighbours.
    turn = F.expr(f"xxhash64(substring(sig, 1 + (band * 2) % {RATED - 1}, 2))")
    rated = cut(_rated(shared.join(contents.select("id", "sig"), "id").select("key", turn.alias("turn"), "id", "sig"), low, high))
    sure, open_ = rated.where(F.col("share") >= high).select("a", "b"), rated.where(F.col("share") < high).select("a", "b")
    crowded = shared.where(F.col("n") > NEIGHBOURS + 1).select("key", "n", "id")
    if not crowded.isEmpty():
        sure = cut(sure.unionByName(_crowded(crowded.join(contents.select("id", "node", "sig"), "id"), elements, sure, low, high, threshold)).distinct())
    if costly:
        first = cut(connected_components(sure, "a", "b"))
        side = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        open_ = open_.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    named = lambda c: names.select(F.col("id").alias(c), F.col("node").alias(f"node_{c}"), F.col("same").alias(f"same_{c}"))
    checked = exact(open_.join(named("a"), "a").join(named("b"), "b"))
    pairs = sure.unionByName(checked)
    return equal.unionByName(pairs.join(named("a"), "a").join(named("b"), "b").select(F.col("node_a").alias("src"), F.col("node_b").alias("dst")))


def text_links(texts: DataFrame, width: int = 5, threshold: float = 0.5, rows: int = 3, bands: int = 64) -> DataFrame:
    """Links of ``(node, text)`` by the Jaccard similarity of distinct word runs.

    Null texts and texts of fewer than ``width`` words link nothing; a node that comes repeatedly is one node; equal
    texts (case, accents, punctuation aside) are one content before buckets are formed; an empty table gives no rows.
    With 64 bands of three minima, a pair at similarity one half shares no bucket with probability 0.0002.
    """

    def exact(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("a", "b", "node_a", "node_b"))

        def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for a, b, s, t in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                    x, y = text_shingles(s, width), text_shingles(t, width)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and both >= threshold * (len(x) + len(y) - both):
                        out.append((a, b))
                yield pd.DataFrame(out, columns=["a", "b"])

        # Only the texts of doubtful pairs move.
        needed = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b")).distinct()
        held = texts.join(needed, "node", "left_semi").dropDuplicates(["node", "text"])
        x, y = held.select(F.col("node").alias("node_a"), F.col("text").alias("x")), held.select(F.col("node").alias("node_b"), F.col("text").alias("y"))
        return pairs.join(x, "node_a").join(y, "node_b").mapInPandas(same, "a bigint, b bigint").distinct()

    def elements(nodes: DataFrame) -> DataFrame:
        def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(n, e.tobytes()) for n, t in zip(batch["node"], batch["text"]) if len(e := text_shingles(t, width))]
                yield pd.DataFrame(out, columns=["node", "elements"])

        return texts.join(nodes, "node", "left_semi").dropDuplicates(["node", "text"]).select("node", "text").mapInPandas(shingled, "node string, elements binary")

    return links(sign_texts(texts.select("node", "text"), width, rows, bands), exact, elements, threshold, costly=True)


def set_links(sets: DataFrame, threshold: float = 0.5, rows: int = 2, bands: int = 64, least: int = 3) -> DataFrame:
    """Links of ``(node, items array<string>)`` by the Jaccard similarity of their distinct items.

    Null items and lists with fewer than ``least`` distinct items link nothing. 64 bands of two minima, so a pair
    at similarity one half is missed with probability 1e-8.
    """
    clean = cut(sets.select("node", F.sort_array(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).where(F.size("items") >= least).distinct())

    def exact(pairs: DataFrame) -> DataFrame:
        named = clean.select("node", F.sha2(F.concat_ws("\u0001", "items"), 256).alias("same"), "items")
        side = lambda c, x: named.select(F.col("node").alias(f"node_{c}"), F.col("same").alias(f"same_{c}"), F.col("items").alias(x))
        j = pairs.join(side("a", "x"), ["node_a", "same_a"]).join(side("b", "y"), ["node_b", "same_b"])
        both = F.size(F.array_intersect("x", "y"))
        return j.where(both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")

    def elements(nodes: DataFrame) -> DataFrame:
        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"node": batch["node"], "elements": [np.asarray(h, np.int64).tobytes() for h in batch["hashes"]]})

        return clean.join(nodes, "node", "left_semi").select("node", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes")).mapInPandas(packed, "node string, elements binary")

    return links(sign_sets(clean, rows, bands), exact, elements, threshold, costly=False)


def canonical_url(url):
    """Address without scheme, leading ``www.``, letter case of the host, fragment and a final slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    host, rest = F.regexp_extract(bare, "^[^/?]*", 0), F.regexp_replace(bare, "^[^/?]*", "")
    return F.regexp_replace(F.concat(F.regexp_replace(F.lower(host), "^www\\.", ""), rest), "/$", "")


def norm_groups(fuentes: DataFrame, leer: DataFrame) -> DataFrame:
    """``(doc_id, grupo)``: documents linked by their texts or by their alternative addresses, directly or through others."""
    texts = leer.where("doc_id is not null").select(F.col("doc_id").alias("node"), F.col("texto").alias("text"))
    urls = fuentes.where("doc_id is not null and urls_alternativas is not null").select(F.col("doc_id").alias("node"), F.transform("urls_alternativas", canonical_url).alias("items"))
    both = text_links(texts).unionByName(set_links(urls))
    return connected_components(both).select(F.col("node").alias("doc_id"), F.col("component").alias("grupo"))
