"""Token counts of documents from piece counts of distinct pre-tokens; ids are never made.

1. One pass finds the pre-tokens that hold more than about 1/HEAVY of all occurrences (once for each
   document and word). There can't be more than HEAVY of them, so their piece counts may be broadcast at
   any size of corpus.
2. A second pass makes each document's pre-token frequencies. The heavy ones are summed on the spot;
   the rest go, by pre-token and packed, to the tasks that count each distinct pre-token once and join the
   count to the frequencies. No key that is left can hold more than 2/HEAVY of all occurrences.
3. The products are summed by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tagsmith.llm.common import map_arrow, stored, text_key
from tagsmith.llm.pretokens import PreTokenizer

#: At most so many pre-tokens are broadcast.
HEAVY = 1 << 19
#: Distinct strings, and bytes of packed frequencies, that a task keeps at once.
KEPT, PACKED = 300_000, 24_000_000
#: Places of the bitmap of ids that come more than once.
PLACES = 1 << 24
#: One frequency: document, 64 bits of its text's hash if its id comes again, times; the highest bit of times marks a null id.
_POST = np.dtype([("id", "<i8"), ("key", "<i8"), ("times", "<u4")])
_NULL = 1 << 31


class _Frequencies:
    """Pre-token frequencies of texts; each distinct word between spaces is cut once while it is kept."""

    def __init__(self, path: str) -> None:
        self.pre = PreTokenizer(path)
        self.known: dict[str, list[str]] = {}

    def of(self, text: str) -> tuple[dict[str, int], int]:
        """{pre-token: times}, and how many added tokens the text holds."""
        out: dict[str, int] = {}
        parts, known, cut = self.pre.parts(text), self.known, self.pre.cut
        if len(known) > KEPT:
            known.clear()
        for part in parts[::2]:
            words = self.pre.words(part)
            if words is None:
                for t, n in Counter(cut(part)).items():
                    out[t] = out.get(t, 0) + n
                continue
            for t in cut(words[0]):
                out[t] = out.get(t, 0) + 1
            for w, n in Counter(words[1:]).items():
                tokens = known.get(w)
                if tokens is None:
                    tokens = known[w] = cut(" " + w)
                for t in tokens:
                    out[t] = out.get(t, 0) + n
        return out, len(parts) // 2


def heavy_pretokens(docs: DataFrame, path: str, most: int = HEAVY) -> DataFrame:
    """(token, n_pieces) of the heavy pre-tokens; at most `most` rows.

    A pre-token with a share of 2/most of all occurrences has a share of 1/most in tasks that hold half of
    them or more, so counting where it is heavy is enough to find it.
    """

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        pre, after_space, tokens = PreTokenizer(path), Counter(), Counter()

        def flush() -> dict:
            for w, n in after_space.items():
                for t in pre.cut(" " + w):
                    tokens[t] += n
            rows = tokens.total()
            own = [(t, n) for t, n in tokens.items() if n * most >= rows]
            after_space.clear(), tokens.clear()
            return {"token": [None, *(t for t, _ in own)], "n": [rows, *(n for _, n in own)]}

        for b in batches:
            for text in b["text"]:
                for part in pre.parts(text or "")[::2]:
                    words = pre.words(part)
                    tokens.update(set(pre.cut(part if words is None else words[0])))
                    if words is not None:
                        after_space.update(set(words[1:]))
                if len(after_space) + len(tokens) > KEPT * 2:
                    yield flush()
        yield flush()

    counted = stored(map_arrow(docs.select("text"), count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "heavy")
    total = counted.where("token is null").agg(F.sum("n")).first()[0] or 0
    heavy = counted.where("token is not null").where(F.col("n") * F.lit(most) >= F.lit(total)).select("token")

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        pre = PreTokenizer(path)
        for b in batches:
            yield {"token": b["token"], "n_pieces": [pre.pieces(t) for t in b["token"]]}

    return map_arrow(heavy, pieces, "token string, n_pieces bigint")


def _repeated(docs: DataFrame) -> bytes:
    """A bitmap of the places of all ids that come more than once. Places that ids share only make it fuller: a row
    whose place is marked carries its text's hash, and needs it or not."""
    places = docs.groupBy("doc_id", "place").agg(F.count("*").alias("n")).where("n > 1")
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")).toArrow()
    out = np.zeros(PLACES >> 6, "<i8")
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def token_counts(docs: DataFrame, path: str, heavy: int = HEAVY, doc_id: str | Column = "doc_id") -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens.

    A null or empty text has no bytes and no tokens. Rows with the same id, null ids too, are told apart
    by their text; rows equal in both come as often as in the input. Other columns don't matter. An empty
    table gives an empty result. `path` is a byte-level vocabulary file of the tokenizers library.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[doc_id].cast("bigint").alias("doc_id") if isinstance(doc_id, str) else doc_id.alias("doc_id"), "text")
    docs = docs.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int"))
    again = spark.sparkContext.broadcast(_repeated(docs))
    pieces = heavy_pretokens(docs, path, heavy).toArrow()
    common = spark.sparkContext.broadcast(dict(zip(pieces["token"].to_pylist(), pieces["n_pieces"].to_pylist(), strict=True)))

    def frequencies(batches: Iterator[dict]) -> Iterator[dict]:
        bits = np.frombuffer(again.value, np.uint8)
        freq, light, small = _Frequencies(path), common.value, [n.to_bytes(4, "little") for n in range(256)]
        posts: dict[str, bytearray] = {}
        size = 0
        for b in batches:
            whole: dict[str, list] = {c: [] for c in ("doc_id", "text_key", "n_bytes", "n_tokens")}
            repeated = np.unpackbits(bits[np.array(b["place"], np.int64) >> 3][:, None], axis=1, bitorder="little")
            repeated = repeated[np.arange(len(repeated)), np.array(b["place"], np.int64) & 7]
            for i, text, twice in zip(b["doc_id"], b["text"], repeated.tolist(), strict=True):
                text = text or ""
                key = text_key(text) if twice else 0
                found, done = freq.of(text)
                head, flag = (i or 0).to_bytes(8, "little", signed=True) + key.to_bytes(8, "little", signed=True), _NULL * (i is None)
                for t, n in found.items():
                    p = light.get(t)
                    if p is not None:
                        done += p * n
                        continue
                    post = head + (small[n] if n < 256 and not flag else (n | flag).to_bytes(4, "little"))
                    size += _POST.itemsize
                    if t in posts:
                        posts[t] += post
                    else:
                        posts[t] = bytearray(post)
                whole["doc_id"].append(i), whole["text_key"].append(key), whole["n_bytes"].append(len(text.encode())), whole["n_tokens"].append(done)
            none = [None] * len(whole["doc_id"])
            yield whole | {"token": none, "posts": none}
            if size > PACKED:
                yield packed(posts)
                size = 0
        yield packed(posts)

    def packed(posts: dict[str, bytearray]) -> dict:
        none = [None] * len(posts)
        out = {"token": list(posts), "posts": [bytes(p) for p in posts.values()]} | dict.fromkeys(("doc_id", "text_key", "n_bytes", "n_tokens"), none)
        posts.clear()
        return out

    def join(batches: Iterator[dict]) -> Iterator[dict]:
        pre, known = PreTokenizer(path), {}
        for b in batches:
            if len(known) > KEPT:
                known.clear()
            at = [k for k, t in enumerate(b["token"]) if t is None]
            if at:
                yield {c: [b[c][k] for k in at] for c in ("doc_id", "text_key", "n_bytes", "n_tokens")}
            tokens, posts = [t for t in b["token"] if t is not None], [p for p in b["posts"] if p is not None]
            if not tokens:
                continue
            for t in set(tokens) - known.keys():
                known[t] = pre.pieces(t)
            each = np.frombuffer(b"".join(posts), _POST)
            pieces = np.repeat(np.array([known[t] for t in tokens], np.int64), np.array([len(p) // _POST.itemsize for p in posts]))
            null = each["times"] >= _NULL
            ids = each["id"] if not null.any() else [None if x else i for i, x in zip(each["id"].tolist(), null.tolist(), strict=True)]
            yield {"doc_id": ids, "text_key": each["key"], "n_bytes": [None] * len(each), "n_tokens": pieces * (each["times"] % _NULL)}

    rows = map_arrow(docs, frequencies, "doc_id bigint, text_key bigint, n_bytes bigint, n_tokens bigint, token string, posts binary")
    by = F.when(F.col("token").isNotNull(), F.xxhash64("token")).otherwise(F.xxhash64("doc_id", "text_key"))
    joined = map_arrow(rows.repartition(by), join, "doc_id bigint, text_key bigint, n_bytes bigint, n_tokens bigint")
    summed = joined.groupBy("doc_id", "text_key").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n"), F.count("n_bytes").alias("copies"))
    return summed.select(
        "doc_id", "n_bytes", (F.col("n") / F.col("copies")).cast("bigint").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
