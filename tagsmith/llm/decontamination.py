"""Benchmark decontamination by suffix arrays of the training texts.

Each task indexes its documents in shards of bounded size: a suffix array over the words that occur in
the benchmark (any other word ends a match, so it is one separator). Every suffix of every test item is
binary-searched in each shard, one word deeper at a time; where a whole window is found, all its places
are extended to the longest verbatim match. The benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tagsmith.llm.common import add_columns, fresh

#: Lower-cases A-Z and turns all that isn't a digit, letter or beyond ASCII into a space.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of documents in a shard; bytes of benchmark text in a block.
SHARD_WORDS, BLOCK_BYTES = 400_000, 4_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Suffixes:
    """The suffixes of a block of test items, ready to be searched."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        """items: (item id, text). Equal texts are searched once for all their ids."""
        by_text: dict[tuple[bytes, ...], set[str]] = {}
        for i, text in items:
            if w := tuple(words(text)):
                by_text.setdefault(w, set()).add(i)
        self.ids = [sorted(x) for x in by_text.values()]
        self.vocab: dict[bytes, int] = {}
        flat, start, item, place, need = [], [], [], [], []
        for k, w in enumerate(by_text):
            size = min(window, len(w))
            for p in range(len(w) - size + 1):
                start.append(len(flat) + p), item.append(k), place.append(p), need.append(size)
            flat += [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w] + [0]
        self.flat = np.array(flat or [0], np.int64)
        self.start, self.item = np.array(start, np.int64), np.array(item, np.int64)
        self.place, self.need = np.array(place, np.int64), np.array(need, np.int64)
        self.shortest = int(self.need.min()) if need else 0
        self.longest = max(map(len, by_text), default=0)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, place in text, words that match) wherever a suffix matches at least a window.

        text: word ids of the shard's documents, 0 for other words and between documents.
        """
        none = (np.empty(0, np.int64),) * 3
        if not self.shortest:
            return none
        # only stretches of benchmark words as long as the shortest window can hold a match
        edge = np.flatnonzero(np.diff(np.concatenate([[0], text > 0, [0]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        long = b - a >= self.shortest
        a, size = a[long], (b - a)[long]
        if not a.size:
            return none
        ends = np.cumsum(size + 1)
        own = np.zeros(int(ends[-1]), np.int64)
        at = np.arange(own.size) - np.repeat(ends - size - 1, size + 1) + np.repeat(a, size + 1)
        inside = np.ones(own.size, bool)
        inside[ends - 1] = False
        own[inside] = text[at[inside]]
        order = self._suffix_array(own)
        low, high = np.zeros(self.start.size, np.int64), np.full(self.start.size, own.size, np.int64)
        for depth in range(int(self.need.max())):
            live = np.flatnonzero((high > low) & (depth < self.need))
            if not live.size:
                break
            word = self.flat[self.start[live] + depth]
            l, h = low[live], high[live]
            low[live] = self._bound(own, order, depth, word, l, h)
            high[live] = self._bound(own, order, depth, word + 1, l, h)
        n = np.maximum(high - low, 0)
        if not n.sum():
            return none
        suffix = np.repeat(np.arange(n.size), n)
        place = order[np.arange(suffix.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        length = self.need[suffix].copy()
        live = np.arange(suffix.size)
        while live.size:
            x = self.flat[self.start[suffix[live]] + length[live]]
            y = own[np.minimum(place[live] + length[live], own.size - 1)]
            live = live[(x > 0) & (x == y)]
            length[live] += 1
        return suffix, at[place], length

    def _suffix_array(self, own: np.ndarray) -> np.ndarray:
        """Suffixes in order of their first `longest` words or more, by prefix doubling."""
        rank, span = own, 1
        while span < self.longest:
            ahead = np.zeros_like(rank)
            ahead[:-span] = rank[span:] if span < rank.size else 0
            _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
            if rank.max() == rank.size - 1:
                break
            span *= 2
        return np.argsort(rank, kind="stable")

    @staticmethod
    def _bound(own: np.ndarray, order: np.ndarray, depth: int, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in order[low:high] whose word at `depth` isn't below `word`."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            below = open_ & (own[np.minimum(order[np.minimum(mid, own.size - 1)] + depth, own.size - 1)] < word)
            low = np.where(below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Each row of `docs` (doc_id, text) as doc_id, n_words, n_hit, item_ids, matches.

    A window is `window` consecutive words of an item (all its words, if it has fewer, but some). n_hit
    counts the document's words that lie in an occurrence of a window; item_ids are the sorted ids (as
    text) of items with such occurrences; matches has the longest verbatim match of each item: item_id,
    item_pos, doc_pos, n_words (places count words from 0; of equally long ones the first).
    Texts of any length are taken whole; null or empty ones have no words. Items without id or words
    match nothing; several rows of one item id count as one item. Repeated documents and null ids give a
    row each. Empty tables and further columns do no harm.
    """
    found, name = _with_matches(docs.select("doc_id", "text"), benchmark, window)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), f"{name}.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, all columns kept; see `find_matches`."""
    found, name = _with_matches(docs, benchmark, window)
    return found.where(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


def _with_matches(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, str]:
    """The rows with one more column: struct of n_words, n_hit, item_ids, matches. Blocks follow each other."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    out, names = docs, []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        side = spark.sparkContext.broadcast(Suffixes([(r["i"], r["t"]) for r in block.collect()], window))
        names.append(name := fresh(out, f"match{k}"))
        kind = (
            "struct<n_words:bigint,spans:array<struct<a:int,b:int>>,item_ids:array<string>,"
            "matches:array<struct<item_id:string,item_pos:int,doc_pos:int,n_words:int>>>")
        out = add_columns(out, ["text"], lambda side=side, name=name: lambda b: {name: _search(b["text"], side.value)}, f"`{name}` {kind}")
    if len(names) > 1:
        name = fresh(out, "merged")
        out = add_columns(out, names, lambda names=names, name=name: lambda b: {name: [_merged(x) for x in zip(*(b[n] for n in names), strict=True)]}, f"`{name}` {kind}")
        names = [name]

    def part(name: str) -> Column:
        return F.col(f"{names[0]}.{name}")

    covered = F.aggregate(
        F.array_sort(part("spans")), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"].cast("bigint"))
    name = fresh(docs, "found")
    return out.select(*docs.columns, F.struct(
        part("n_words").alias("n_words"), covered.alias("n_hit"),
        F.array_sort(part("item_ids")).alias("item_ids"), part("matches").alias("matches")).alias(name)), name


def _search(texts: list, side: Suffixes) -> list[dict]:
    """The struct of `_with_matches` for each text; shard after shard."""
    get, out, ids, n = side.vocab.get, [], [], 0
    for k, t in enumerate(texts):
        w = words(t)
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
        n += len(w)
        if n >= SHARD_WORDS or k == len(texts) - 1:
            out += _shard(ids, side)
            ids, n = [], 0
    return out


def _shard(ids: list[np.ndarray], side: Suffixes) -> list[dict]:
    sizes = np.array([x.size for x in ids])
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum() + sizes.size), np.int64)
    for b, x in zip(begins, ids, strict=True):
        text[b : b + x.size] = x
    out = [{"n_words": n, "spans": [], "item_ids": [], "matches": []} for n in sizes.tolist()]
    suffix, place, length = side.find(text)
    if not suffix.size:
        return out
    doc = np.searchsorted(begins, place, side="right") - 1
    edge = np.zeros(text.size + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + side.need[suffix], -1)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)))
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        d = int(np.searchsorted(begins, a, side="right") - 1)
        out[d]["spans"].append({"a": a - int(begins[d]), "b": b - int(begins[d])})
    item, pos = side.item[suffix], side.place[suffix]
    order = np.lexsort((place, pos, -length, item, doc))
    first = np.ones(order.size, bool)
    first[1:] = (doc[order[1:]] != doc[order[:-1]]) | (item[order[1:]] != item[order[:-1]])
    for k in order[first].tolist():
        d = int(doc[k])
        for i in side.ids[int(item[k])]:
            out[d]["matches"].append({"item_id": i, "item_pos": int(pos[k]), "doc_pos": int(place[k] - begins[d]), "n_words": int(length[k])})
    for x in out:
        if x["matches"]:
            x["matches"] = _longest(x["matches"])
            x["item_ids"] = [m["item_id"] for m in x["matches"]]
    return out


def _longest(matches: list[dict]) -> list[dict]:
    """The longest match of each item id, the first of equally long ones; by item id."""
    rank = lambda m: (m["item_id"], -m["n_words"], m["item_pos"], m["doc_pos"])
    return list({m["item_id"]: m for m in sorted(matches, key=rank, reverse=True)}.values())[::-1]


def _merged(found: list[dict]) -> dict:
    """What several blocks of the benchmark found in one document; rows of an item id may lie in any of them."""
    matches = _longest([m for x in found for m in x["matches"]])
    return {"n_words": found[0]["n_words"], "spans": [a for x in found for a in x["spans"]],
            "item_ids": [m["item_id"] for m in matches], "matches": matches}
