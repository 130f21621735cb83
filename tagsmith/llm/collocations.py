"""Phrases that occur often, scored by how much more often than their parts would by chance.

Which n-grams occur `threshold` times is found with Misra-Gries summaries, one for each slice of the n-grams' hashes.
A task counts the n-grams of a few million words; its counts, which have lost nothing yet, go to their slices in
packed form. A slice's masses arrive before its counts, so its summary is given more places than mass / threshold
before the first count is added. What a summary subtracts is then less than the threshold, hence every n-gram that
occurs often enough is still in it. N-grams that reach the threshold within one task are known at once and don't
count towards the mass, so one very frequent phrase doesn't enlarge its slice's summary.

First words and pairs are found that way, then phrases of three to five words all of whose pairs were. The survivors
mark places of their hashes in a bitmap of fixed size, which is broadcast. A further pass counts the n-grams that all
bitmaps let through exactly, by their text, again slice by slice: hashes and bitmaps only let too much through, never
too little, and what occurs too seldom goes then. Everything else are joins and groupings of these phrases.

Defined results: a null or empty text has no words; a null lang is `und`; rows repeat their counts when repeated; an
empty table gives no phrases; columns other than text and lang are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from tagsmith.llm.common import map_arrow, partitions, stored

#: Bytes of text that a task takes at once; entries and phrases it adds up before they are sent; bytes of text for each slice.
BYTES, ENTRIES, PHRASES, SLICE_BYTES = 4_000_000, 1 << 21, 1 << 19, 1 << 26
#: Bits of an n-gram's hash that are sent, of them those that tell slices apart, and those that a bitmap has a place for.
HASH_BITS, SLICE_BITS, MAP_BITS = 40, 20, 27
#: Longest phrase, in words.
LONGEST = 5
#: A-Z in lower case; ends of pieces (full stop, comma, semicolon, colon, exclamation and question marks, line ends)
#: become a byte that UTF-8 doesn't have.
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class MisraGries:
    """Counts of hashes with at most `places` of them kept. A kept count is too low by at most `error`, and what isn't
    kept has occurred at most `error` times; `error` is at most the mass added, divided by places + 1."""

    def __init__(self, places: int) -> None:
        self.places, self.error = places, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(keys) > self.places:
            cut = int(np.partition(counts, len(counts) - self.places - 1)[len(counts) - self.places - 1])
            self.error += cut
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.keys, self.counts = keys, counts

    def merge(self, other: "MisraGries") -> None:
        self.error += other.error
        self.add(other.keys, other.counts)

    def at_least(self, threshold: int) -> np.ndarray:
        """All keys that may have occurred so often."""
        return self.keys[self.counts + self.error >= threshold]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _pack(keys: np.ndarray) -> bytes:
    """Rising numbers as the bytes of their gaps: the first number, then as many bytes a gap as the largest needs."""
    gaps = np.diff(keys)
    width = max((int(gaps.max()).bit_length() + 7) // 8, 1) if len(gaps) else 1
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width = data[8]
    columns = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((columns.shape[1], 8), np.uint8)
    gaps[:, :width] = columns.T
    out = np.empty(len(gaps) + 1, np.int64)
    out[0] = int.from_bytes(data[:8], "little")
    out[1:] = gaps.view("<u8").ravel()
    return np.cumsum(out)


class _Words:
    """The words of some texts of one language, end to end; a piece's end has the number 0."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        tokens = b" \xff ".join([*texts, b""]).translate(_TABLE).replace(b"\xff", b" \xff ").split()
        known = {b"\xff": 0}
        self.lang = lang
        self.at = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))
        self.known = list(known)
        ends = np.flatnonzero(self.at == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(tokens)))] - np.arange(len(tokens))
        self.n_words = len(tokens) - len(ends)
        seed = zlib.crc32(lang.encode())
        own = np.fromiter((xxh3_64_intdigest(w, seed) for w in self.known), np.uint64, len(self.known))
        self.hash = own[self.at]

    def longer(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of k words from those of k - 1; right where `left` is at least k."""
        x = h * _A
        x[: 1 - k] += self.hash[k - 1 :]
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


def _blocks(batches: Iterator[dict]) -> Iterator[list[_Words]]:
    """Words of about BYTES of text, or of one longer text, by language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if text:
                data = text.encode()
                if size and size + len(data) > BYTES:
                    yield [_Words(k, v) for k, v in held.items()]
                    held, size = {}, 0
                held.setdefault(lang, []).append(data)
                size += len(data)
    if held:
        yield [_Words(k, v) for k, v in held.items()]


class _Bitmap:
    """Which hashes may be among the survivors."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class _Slice:
    """One slice of the hashes while its rows come in: all masses, then hashes known to be frequent, then counts."""

    def __init__(self, threshold: int) -> None:
        self.threshold, self.mass = threshold, 0
        self.sure = np.zeros(0, np.int64)
        self.summary: MisraGries | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def take(self, keys: np.ndarray, counts: np.ndarray | None) -> None:
        if counts is None:
            self.sure = np.union1d(self.sure, keys)
            return
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= ENTRIES:
            self._add()

    def _add(self) -> None:
        if self.waiting:
            self.summary = self.summary or MisraGries(self.mass // self.threshold + 1)
            self.summary.add(*(np.concatenate(x) for x in zip(*self.waiting)))
            self.waiting, self.n_waiting = [], 0

    def marked(self) -> dict[str, list]:
        """The slice's part of the bitmap, from its first byte with a mark."""
        self._add()
        kept = np.union1d(self.sure, self.summary.at_least(self.threshold)) if self.summary else self.sure
        at = np.unique(kept >> (HASH_BITS - MAP_BITS))
        low = int(at[0]) >> 3 if len(at) else 0
        part = np.zeros((int(at[-1]) >> 3) - low + 1 if len(at) else 0, np.uint8)
        np.bitwise_or.at(part, (at >> 3) - low, (1 << (at & 7)).astype(np.uint8))
        return {"start": [low], "bits": [zlib.compress(part.tobytes(), 1)]}


def _levels(w: _Words, pairs: _Bitmap | None, rest: _Bitmap | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the n-grams to look at: without bitmaps words and pairs; with the one of words and
    pairs phrases of three and more words; with both all."""
    h, fits, good = w.hash, w.left >= 1, None
    for k in range(1, longest + 1):
        if k > 1:
            if len(h) < k:
                return
            h, fits = w.longer(h, k), w.left >= k
        if k == 1:
            good = fits & pairs.has(h) if pairs else fits
        elif k == 2:
            good[:-1] &= good[1:]
            good &= fits
            if pairs:
                good &= pairs.has(h)
            both = good
        else:
            # the first k - 1 words and the last pair are good
            good = good & fits
            good[: 2 - k] &= both[k - 2 :]
            if rest:
                good &= rest.has(h)
        if (k <= 2) == (pairs is None) or rest:
            at = np.flatnonzero(good)
            if at.size:
                yield k, at, h[at]


def _slices(docs: DataFrame) -> int:
    """Into how many slices hashes go: each has the share of about SLICE_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(partitions(docs.sparkSession), 1 + total // SLICE_BYTES), 1 << SLICE_BITS)


def _survivors(docs: DataFrame, threshold: int, pairs: bytes | None, longest: int) -> bytes:
    """The bitmap of all n-grams that occur `threshold` times, and of some that don't."""
    spark = docs.sparkSession
    slices = _slices(docs)
    sent = spark.sparkContext.broadcast(pairs) if pairs is not None else None
    small = "<u1" if threshold <= 256 else "<u8"

    def slice_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> (HASH_BITS - SLICE_BITS)) * slices >> SLICE_BITS

    def packed(keys: np.ndarray, counts: np.ndarray) -> dict[str, list]:
        """Masses (kind 0), hashes known to be frequent (1), hashes with counts (2)."""
        out: dict[str, list] = {"slice": [], "kind": [], "mass": [], "hashes": [], "counts": []}
        for kind, mask in ((1, counts >= threshold), (2, counts < threshold)):
            k, c = keys[mask], counts[mask]
            s = slice_of(k)
            for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(s)) + 1) if len(k) else ():
                rows = [(kind, 0, _pack(k[part]), c[part].astype(small).tobytes() if kind == 2 else None)]
                if kind == 2:
                    rows.append((0, int(c[part].sum()), None, None))
                for row in rows:
                    for column, value in zip(out, (int(s[part[0]]), *row)):
                        out[column].append(value)
        return out

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        bitmap = _Bitmap(sent.value) if sent else None
        keys, counts, held = [], [], 0
        for block in _blocks(batches):
            for w in block:
                own = [h for _, _, h in _levels(w, bitmap, None, longest if bitmap else 2)]
                if own:
                    k = (np.concatenate(own) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
                    k, c = summed(k, np.ones(len(k), np.int64))
                    keys.append(k)
                    counts.append(c)
                    held += len(k)
            if held >= ENTRIES:
                yield packed(*summed(np.concatenate(keys), np.concatenate(counts)))
                keys, counts, held = [], [], 0
        if held:
            yield packed(*summed(np.concatenate(keys), np.concatenate(counts)))

    def summarise(batches: Iterator[dict]) -> Iterator[dict]:
        now, own = -1, _Slice(threshold)
        for batch in batches:
            for s, kind, mass, hashes, counts in zip(*(batch[c] for c in ("slice", "kind", "mass", "hashes", "counts"))):
                if s != now:
                    if now >= 0:
                        yield own.marked()
                    now, own = s, _Slice(threshold)
                if kind == 0:
                    own.mass += mass
                else:
                    own.take(_unpack(hashes), np.frombuffer(counts, small).astype(np.int64) if kind == 2 else None)
        if now >= 0:
            yield own.marked()

    rows = map_arrow(docs, count, "slice int, kind int, mass bigint, hashes binary, counts binary")
    # a slice's rows in the order of their kind: its mass is known before the first count comes
    rows = rows.repartition(slices, "slice").sortWithinPartitions("slice", "kind")
    bitmap = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for row in map_arrow(rows, summarise, "start bigint, bits binary").collect():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        bitmap[row["start"] : row["start"] + len(part)] |= part
    if sent:
        sent.destroy()
    return bitmap.tobytes()


def phrase_counts(docs: DataFrame, threshold: int = 100, longest: int = LONGEST) -> DataFrame:
    """lang, phrase (words joined by a space), size, f: all n-grams of up to `longest` words that occur `threshold`
    times within pieces, exactly counted, and for each lang one row of size 0 with all its word occurrences."""
    if threshold < 1 or longest < 2:
        raise ValueError("a threshold of at least 1 and phrases of at least 2 words are needed")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    pairs = _survivors(docs, threshold, None, longest)
    rest = _survivors(docs, threshold, pairs, longest) if longest > 2 else bytes(1 << MAP_BITS - 3)
    sent = spark.sparkContext.broadcast((pairs, rest))

    slices = _slices(docs)

    def sent_rows(held: dict[tuple[str, str, int], int]) -> dict[str, list]:
        """One row for each slice of the phrases' hashes: its phrases and their counts."""
        parts: dict[int, list[tuple[str, str, int, int]]] = {}
        for (lang, phrase, size), n in held.items():
            at = xxh3_64_intdigest(phrase, zlib.crc32(lang.encode())) * slices >> 64
            parts.setdefault(at, []).append((lang, phrase, size, n))
        columns = [list(zip(*rows)) for rows in parts.values()]
        return {"slice": list(parts)} | {c: [x[i] for x in columns] for i, c in enumerate(("lang", "phrase", "size", "n"))}

    def add_up(batches: Iterator[dict]) -> Iterator[dict]:
        now, sums = -1, {}

        def known() -> dict[str, list]:
            rows = [(*key, f) for key, f in sums.items() if f >= threshold or not key[2]]
            return dict(zip(("lang", "phrase", "size", "f"), zip(*rows))) if rows else {c: [] for c in ("lang", "phrase", "size", "f")}

        for batch in batches:
            for s, *columns in zip(*(batch[c] for c in ("slice", "lang", "phrase", "size", "n"))):
                if s != now:
                    yield known()
                    now, sums = s, {}
                for *key, n in zip(*columns):
                    key = tuple(key)
                    sums[key] = sums.get(key, 0) + n
        yield known()

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        pairs, rest = map(_Bitmap, sent.value)
        held: dict[tuple[str, str, int], int] = {}
        for block in _blocks(batches):
            for w in block:
                held[w.lang, "", 0] = held.get((w.lang, "", 0), 0) + w.n_words
                rank = np.zeros(len(w.at), np.int64)  # equal for equal n-grams, among those looked at
                for k, at, _ in _levels(w, pairs, rest, longest):
                    # an n-gram that is let through starts with one that was
                    _, first, own, n = np.unique(rank[at] * len(w.known) + w.at[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                    rank[at] = own
                    for span, m in zip(w.at[at[first][:, None] + np.arange(k)].tolist(), n.tolist()):
                        key = w.lang, b" ".join([w.known[i] for i in span]).decode(), k
                        held[key] = held.get(key, 0) + m
            if len(held) >= PHRASES:
                yield sent_rows(held)
                held = {}
        if held:
            yield sent_rows(held)

    counted = map_arrow(docs, count, "slice int, lang array<string>, phrase array<string>, size array<int>, n array<bigint>")
    counted = counted.repartition(slices, "slice").sortWithinPartitions("slice")
    return stored(map_arrow(counted, add_up, "lang string, phrase string, size int, f bigint"), "phrase-counts")


def scored(counts: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two and more words in `counts` (see phrase_counts).

    Of the ways to cut a phrase in two the one with the lowest score counts, then the earliest. Without phrases that
    lie inside a longer one with at least `share` hundredths of their occurrences. All arithmetic is on decimals of 38 digits.
    """
    whole = F.col("size") >= 2
    phrases = counts.where(whole).select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda name: counts.where("size >= 1").select("lang", F.col("phrase").alias(f"{name}_text"), F.col("f").alias(name))
    cuts = phrases.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("l_text"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("r_text"))
    # one lang may have most of the phrases, so its total is there once for each salt
    salts = partitions(counts.sparkSession)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    cuts = cuts.join(part("l"), ["lang", "l_text"]).join(part("r"), ["lang", "r_text"])
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")).join(totals, ["lang", "salt"])
    exact = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(38,0)") * exact["a"] * exact["n"]).withColumn("below", exact["l"] * exact["r"])
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("top div below").alias("score"), "k", "l", "r")).alias("best"))
    # a phrase one word longer suffices: it lies between a phrase and any longer one, and so does its count
    longer = phrases.where("size > 2").select("lang", F.col("a").alias("around"), F.explode(F.array(
        F.array_join(F.slice("words", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("around"), F.lit(0)) * 100 < F.col("a") * share)
    return kept.select("lang", "phrase", "a", F.col("best.l"), F.col("best.r"), "n", F.col("best.score"))


def collocations(docs: DataFrame, threshold: int = 100, longest: int = LONGEST, share: int = 100, top: int = 2000) -> DataFrame:
    """The `top` phrases of each lang by score, then count, then text in the order of its bytes: lang, rank, phrase, a
    (occurrences), l, r (of its two parts), n (of all words), score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrase_counts(docs, threshold, longest), share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
