"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

1. Documents with the same set of n-grams are one row of the matrix.
2. Size-derived bounds choose the rows that can have a partner: if |x & y| >= t |x | y|, x and y share at
   least k of the first |x| - ceil(t |x|) + k n-grams of each, in any common order. Rows with fewer n-grams
   there that other rows have too can't link.
3. Of the remaining rows, those that share one of their rarest |x| - ceil(t |x|) + 1 n-grams form groups;
   links can't leave a group. Large groups are cut by size into bands and these into blocks, where only
   equal or neighbouring bands can link.
4. Each pair of blocks is multiplied in one task, which adds up the overlaps, discards pairs below the
   bound, and returns a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from tagsmith.llm.common import add_columns, map_arrow, ship, stored
from tagsmith.llm.graph import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of a block; most bands that may be cut into blocks; keys that may be broadcast.
BLOCK, MOST_BANDS, MOST_KEYS = 512, 1 << 16, 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def rolling(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, of which there is one at least."""
    from xxhash import xxh3_64_intdigest

    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h * _MIX[0] + w[k : len(w) - size + 1 + k])
    return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of all words, if there are fewer but some."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.int64)
    return np.unique(rolling(words, min(n, len(words))).view(np.int64))


def least_overlap(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _first(size: int, percent: int) -> tuple[int, int]:
    """How many n-grams of a row are looked at for partners, and how many of them others must have."""
    prefix = size - least_overlap(size, percent) + 1
    # rows of unlike size have an unlike k; from 60 % on the smaller of them is never under k - 1
    k = -(-prefix // 2) if percent >= 60 else 1
    return min(size, prefix + k - 1), max(1, k - 1)


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, sig (of the set; null if empty), need, first n-grams."""

    def make() -> Callable:
        def task(b: dict) -> dict:
            out: dict[str, list] = {"n_shingles": [], "sig": [], "need": [], "grams": []}
            for t in b["text"]:
                g = shingles(t, n)
                length, need = _first(len(g), percent)
                out["n_shingles"].append(len(g))
                out["sig"].append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                out["need"].append(need)
                out["grams"].append(g[:length])
            return out

        return task

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    made = add_columns(rows, ["text"], make, "n_shingles bigint, sig binary, need int, grams array<bigint>")
    return stored(made.drop("text"), "sets")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast, if a count has shown that it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= MOST_KEYS else df


def _candidates(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """node (least doc_id and sig, ordered like the id), n, grams (all) of rows that can have a partner."""
    key = F.xxhash64("sig")
    first = sets.where("sig is not null").select(key.alias("key"), "need", F.explode("grams").alias("gram"))
    shared = stored(first.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("gram"), "shared")
    found = first.join(shared, "gram").distinct().groupBy("key", "need").count().where(F.col("count") >= F.col("need"))
    alive = stored(found.select("key"), "alive")
    # every distinct set that is alive, by one of its texts
    chosen = stored(
        sets.where("sig is not null").withColumn("key", key).join(_few(alive), "key", "left_semi").groupBy("sig").agg(
            F.min("doc_id").alias("id"), F.min("text_hash").alias("text_hash")),
        "chosen")
    texts = docs.select("text").withColumn("text_hash", F.xxhash64("text")).join(_few(chosen.select("text_hash", "sig", "id")), "text_hash")

    def full(batches: Iterator[dict]) -> Iterator[dict]:
        done: set[bytes] = set()
        for b in batches:
            out: dict[str, list] = {"node": [], "n": [], "grams": []}
            for t, sig, i in zip(b["text"], b["sig"], b["id"], strict=True):
                if sig in done:
                    continue
                g = shingles(t, n)
                if hashlib.blake2b(g.tobytes(), digest_size=16).digest() == sig:
                    done.add(sig)
                    out["node"].append(((i if i is not None else 2**63 - 1) + 2**63).to_bytes(8, "big") + sig)
                    out["n"].append(len(g))
                    out["grams"].append(g)
            if len(done) > MOST_KEYS:
                done.clear()
            yield out

    rows = map_arrow(texts.select("text", "sig", "id"), full, "node binary, n bigint, grams array<bigint>")
    return stored(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "rows")


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """node, n, grams, grp of rows that share one of their rarest n-grams; links stay within a group."""
    each = rows.select("node", "n", F.explode("grams").alias("gram"))
    common = stored(each.groupBy("gram").count().where("count > 1"), "common")
    own = each.join(common, "gram")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("count", "gram"))
    size = F.count("*").over(Window.partitionBy("node"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # n-grams that no other row has come first in the order of rarity, so they use up the prefix
    rare = own.withColumns({"rank": rank, "size": size}).where(F.col("rank") <= prefix - (F.col("n") - F.col("size")))
    links = rare.select("node", F.concat(F.lit(b"\xff"), F.unhex(F.lpad(F.hex("gram"), 16, "0"))).alias("gram"))
    grouped = components(links.select(F.col("gram").alias("u"), F.col("node").alias("v")))
    grouped = stored(grouped.where(F.length("node") == 24).select("node", F.xxhash64("label").alias("grp")).unionByName(
        grouped.where(F.length("label") == 24).select(F.col("label").alias("node"), F.xxhash64("label").alias("grp")).distinct()), "grouped")
    return stored(rows.join(_few(grouped), "node"), "grouped-rows")


def _product(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between the rows of a block, or between its two sides."""
    block = block.drop_duplicates("node").sort_values("node")
    m = len(block)
    n, side, nodes = block["n"].to_numpy(), block["side"].to_numpy(), block["node"].to_numpy()
    row = np.repeat(np.arange(m), n)
    _, column, count = np.unique(np.concatenate(block["grams"].to_list()), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], column[keep]
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    overlap = np.zeros((m, m), np.float32)
    of = count[column]
    for c in np.unique(of):
        r = row[of == c].reshape(-1, c)
        if c <= 16:  # few rows have the n-gram: its pairs one by one
            flat = np.concatenate([r[:, i] * m + r[:, j] for i in range(c) for j in range(i + 1, c)])
            overlap += np.bincount(flat, minlength=m * m).reshape(m, m)
        else:  # many rows: dense slices of the incidence matrix
            for s in range(0, len(r), 2048):
                part = r[s : s + 2048]
                x = np.zeros((m, len(part)), np.float32)
                x[part.ravel(), np.repeat(np.arange(len(part)), c)] = 1
                overlap += np.triu(x @ x.T, 1)
    i, j = np.nonzero(overlap)
    both = overlap[i, j].astype(np.int64)
    linked = 100 * both >= percent * (n[i] + n[j] - both)
    if len(np.unique(side)) > 1:
        linked &= side[i] != side[j]
    i, j = i[linked], j[linked]
    label = np.arange(m)
    while True:  # least row that each can reach
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    below = np.flatnonzero(label != np.arange(m))
    return pd.DataFrame({"u": nodes[below], "v": nodes[label[below]]})


def _links(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v): forests of the links of all groups."""
    spark = rows.sparkSession
    ship(spark)
    most = max(block, -(-rows.count() // MOST_BANDS))
    large = rows.groupBy("grp").count().where(F.col("count") > most).select("grp")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    # groups with more than `most` rows, of which there are at most MOST_BANDS
    wide = [r["grp"] for r in large.collect()]
    counted = rows.join(F.broadcast(spark.createDataFrame([(g,) for g in wide], "grp bigint")), "grp").groupBy("grp", band.alias("band")).count()
    bands: dict[int, dict[int, int]] = {g: {} for g in wide}
    for r in counted.collect():
        bands[r["grp"]][r["band"]] = -(-r["count"] // most)
    shared = spark.sparkContext.broadcast(bands)

    def dealt(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("block", "side", "node", "n", "grams")}
            for grp, own, node, n, grams in zip(b["grp"], b["band"], b["node"], b["n"], b["grams"], strict=True):
                blocks = shared.value.get(grp)
                if blocks is None:
                    keys = [(f"{grp}", 0)]
                else:
                    k = crc32(node) % blocks[own]
                    keys = [(f"{grp}|{own}|{min(k, o)}|{max(k, o)}", int(k > o)) for o in range(blocks[own])]
                    keys += [(f"{grp}|{own}|{k}|up{o}", 0) for o in range(blocks.get(own + 1, 0))]
                    keys += [(f"{grp}|{own - 1}|{o}|up{k}", 1) for o in range(blocks.get(own - 1, 0))]
                for key, side in keys:
                    out["block"].append(key), out["side"].append(side), out["node"].append(node)
                    out["n"].append(n), out["grams"].append(grams)
            yield out

    placed = map_arrow(rows.withColumn("band", band).select("grp", "band", "node", "n", "grams"), dealt, "block string, side int, node binary, n bigint, grams array<bigint>")
    return placed.groupBy("block").applyInPandas(lambda x: _product(x, percent), "u binary, v binary")


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """Each row of `docs` (doc_id, text) as doc_id, text_hash, n_shingles, component_id.

    Words are what white space (space, tab to carriage return) separates, A-Z in lower case. Documents link
    when 100 * |x & y| >= percent * |x | y| for their sets of n-word shingles (all words, if fewer than n).
    component_id is the least doc_id that links reach, the own one included. Null and empty texts have no
    shingles and no links. Rows without an id may link others; they get the component's id, null if there
    is none. Texts are read whole; repeated rows and ids come as often as in the input; empty tables and
    further columns do no harm. text_hash tells rows of one id apart.
    """
    sets = _sets(docs, n, percent)
    rows = _groups(_candidates(docs, sets, n, percent), percent)
    linked = components(stored(_links(rows, percent, block), "links"))
    sig, least = F.expr("substring(node, 9, 16)"), F.expr("substring(label, 9, 16)")
    ident = F.expr("cast(conv(hex(substring(label, 1, 8)), 16, 10) as decimal(20,0)) - 9223372036854775808").cast("bigint")
    reached = linked.select(sig.alias("sig"), ident.alias("to")).unionByName(linked.select(least.alias("sig"), ident.alias("to")).distinct())
    same = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # sets that stand for several rows or link: the others are components of their own
    known = stored(
        same.join(reached, "sig", "left").where("copies > 1 or to is not null").select(
            "sig", F.coalesce(F.nullif("to", F.lit(2**63 - 1)), "least").alias("component")),
        "known")
    return sets.select("doc_id", "text_hash", "n_shingles", "sig").join(known, "sig", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without those that link to a document with a smaller id, all columns kept.

    Of each component the document with the least id stays (all its rows, if the id is repeated with the same
    text); rows without an id stay only where the component has no id at all.
    """
    found = link_documents(docs, n, percent)
    gone = found.where("component_id is not null and (doc_id is null or doc_id != component_id)").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = _few(stored(gone, "copies"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["_hash"])
    return docs.join(gone, same, "left_anti")
