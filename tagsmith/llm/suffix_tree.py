"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words of a text, A-Z in lower case, and one end. Contexts are the last one to three words.
A context is kept as a state if what follows it diverges from what follows its longest kept suffix by more
bits than its entries cost to write down. Followers of a state are smoothed towards that suffix; all words
that aren't listed share the rest of the state's mass in the suffix's proportions. The empty context is the
add-one unigram model, so every word has a probability, and every distribution adds up to one.

Words and n-grams are known by 64-bit hashes. All of them are counted: a task adds up its own, the sums meet by
slices of the hashes, and only those sums are held against LEAST. States are found by grouped aggregates, order
by order. For scoring, documents are dealt to blocks, which ask the slices for the n-grams they have; a filter
of fixed size spares them most questions about n-grams that no state lists, and changes no result.

What is shuffled is many times the input, so each step goes in rounds: by hashes of n-grams while counting, by hashes
of contexts while finding states, by documents while scoring. A round is stored and its shuffle files go before the
next begins; tables go when nothing reads them any more. Rounds change no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagsmith.llm.common import map_arrow, partitions, shared_folder, ship

#: Longest n-gram (context and follower); cells of 64 bits in the filter that is broadcast.
ORDER, MOST = 4, 1 << 22
#: A follower occurs so often at least; weight of the suffix in smoothing.
LEAST, SMOOTHING = 2, 2.0
#: Characters that are hashed at once, of a block of documents, and for each slice of the hashes.
CHARS, BLOCK_CHARS, SLICE_CHARS = 4_000_000, 16_000_000, 4_000_000
#: Rounds of a large table while counting, finding states and scoring; a smaller one has one for so many characters.
COUNT_ROUNDS, STATE_ROUNDS, SCORE_ROUNDS, ROUND_CHARS = 8, 2, 3, 4_000_000
#: Words of so many bytes at most are hashed side by side.
SHORT = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b" "  # no word holds a space, so this stands for the end of a text
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_COLUMNS = [*(f"x{k}" for k in range(1, ORDER + 1)), *(f"y{k}" for k in range(1, ORDER))]


def words(text: str | None) -> list[bytes]:
    """Words of a text, and its end."""
    return [*(text.encode().translate(_LOWER).split() if text else ()), _END]


def hashes(tokens: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _text_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the symbols of all texts, and how many each text has. Eight bytes of all words are taken at once."""
    coded = [t.encode().translate(_LOWER) if t else b"" for t in texts]
    data = b"".join([b" ", *(x for c in coded for x in (c, b" ")), bytes(8)])
    raw = np.frombuffer(data, np.uint8, len(data) - 8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h, at, left = lengths.astype(np.uint64) * _FACTOR, np.arange(len(starts)), lengths
    for k in range(0, SHORT, 8):
        some = left > 0
        if k:
            at, left = at[some], left[some]
        if not at.size:
            break
        x = eight[starts[at] + k] & (_ALL >> (np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3)))
        x = (h[at] ^ x) * _MIX
        x = (x ^ (x >> np.uint64(32))) * _FACTOR
        h[at] = x ^ (x >> np.uint64(29))
        left = left - 8
    long = np.flatnonzero(lengths > SHORT)
    h[long] = hashes([data[a : a + n] for a, n in zip(starts[long].tolist(), lengths[long].tolist())])
    behind = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in coded]))
    sizes = np.diff(behind, prepend=0) + 1
    out, word = np.full(len(h) + len(texts), hashes([_END])[0]), np.ones(len(h) + len(texts), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = h
    return out, sizes


def ngrams(texts: list[list[bytes]]) -> dict[str, np.ndarray]:
    """For each place: x1..x4, hashes of the last 1 to 4 symbols, the own one included; y1..y3, of those before it.

    0 where the text doesn't reach back so far. As signed numbers, which Spark has too.
    """
    return _chained(hashes([t for text in texts for t in text]), np.array([len(t) for t in texts]))


def _chained(w: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The n-grams of symbols by their hashes; `sizes` has the symbols of each text."""
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, x = {"x1": w.view(np.int64)}, w
    for k in range(1, ORDER):
        before = np.zeros_like(x)
        before[1:] = x[:-1]
        before[at < k] = 0
        out[f"y{k}"] = before.view(np.int64)
        x = (before ^ (before >> np.uint64(29))) * _FACTOR + w
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x[at < k] = 0
        out[f"x{k + 1}"] = x.view(np.int64)
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once."""
    keys = np.sort(keys)
    return keys[np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]])]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of keys."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


@dataclass
class Level:
    """States of one context length: their hashes, log10 of what the rest is scaled by; n-grams and their log10 probabilities."""

    states: np.ndarray
    rest: np.ndarray
    grams: np.ndarray
    logs: np.ndarray


@dataclass
class SuffixTree:
    levels: list[Level] = field(default_factory=list)

    def logs(self, g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log10, root): of each place under its longest kept context. Where root holds, the word isn't listed on
        the way down to the empty context, and its unigram log10 has to be added."""
        n = len(g["x1"])
        log, root = np.zeros(n), np.ones(n, bool)
        for k, level in enumerate(self.levels, 2):
            state, s = _find(level.states, g[f"y{k - 1}"])
            at = np.flatnonzero(state & (g[f"y{k - 1}"] != 0))
            if not at.size:
                continue
            listed, e = _find(level.grams, g[f"x{k}"][at])
            log[at] = np.where(listed, level.logs[e] if len(level.logs) else 0.0, log[at] + level.rest[s[at]])
            root[at] &= ~listed
        return log, root


def build(grams: dict[str, np.ndarray], order: np.ndarray, n: np.ndarray, context_n: np.ndarray, unigram: np.ndarray, places: int) -> SuffixTree:
    """The tree from candidate n-grams: their hashes, order, count, count of their context, and unigram log10 of their last word."""
    tree = SuffixTree()
    for k in range(2, ORDER + 1):
        at = np.flatnonzero((order == k) & (n >= LEAST))
        own = {c: grams[c][at] for c in _COLUMNS}
        log, root = tree.logs(own)
        parent = 10.0 ** np.where(root, log + unigram[at], log)
        states, row = np.unique(own[f"y{k - 1}"], return_inverse=True)
        c, total = n[at].astype(float), np.zeros(len(states))
        total[row] = context_n[at]
        p = (c + SMOOTHING * parent) / (total[row] + SMOOTHING)
        listed, below = np.bincount(row, p, len(states)), np.bincount(row, parent, len(states))
        rest = np.maximum(1 - listed, 1e-12) / np.maximum(1 - below, 1e-12)
        unlisted = np.maximum(total - np.bincount(row, c, len(states)), 0)
        gain = np.bincount(row, c * np.log2(p / parent), len(states)) + unlisted * np.log2(rest)
        keep = gain > 0.5 * (np.bincount(row, minlength=len(states)) + 1) * np.log2(max(places, 2))
        e = np.flatnonzero(keep[row])
        e = e[np.argsort(own[f"x{k}"][e], kind="stable")]
        tree.levels.append(Level(states[keep], np.log10(rest[keep]), own[f"x{k}"][e], np.log10(p[e])))
    return tree


def _blocks(texts: list[str | None]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(n-grams, symbols of each text) of about CHARS characters at once."""
    first, n = 0, 0
    for i, t in enumerate(texts, 1):
        n += len(t or "")
        if n > CHARS or i == len(texts):
            w, sizes = _text_hashes(texts[first:i])
            yield _chained(w, sizes), sizes
            first, n = i, 0


def _round(keys: np.ndarray, rounds: int) -> np.ndarray:
    """The round of each hash, by its high bits."""
    return ((keys.view(np.uint64) >> np.uint64(40)) * np.uint64(rounds)) >> np.uint64(24)


def _sliced(keys: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, places of its keys) for each slice that has some."""
    own = np.mod(keys, slices)
    order = np.argsort(own, kind="stable")
    found, first = np.unique(own[order], return_index=True)
    for k, at in zip(found.tolist(), np.split(order, first[1:]), strict=False):
        yield k, at


def _column(table: pa.Table, name: str, kind: str = "<i8") -> np.ndarray:
    """The packed arrays of a column, one behind the other."""
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), kind)


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them has ended."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def _in_rounds(spark: SparkSession, make: Callable[[int], DataFrame], rounds: int, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The rows of make(0), make(1), ..., each written to the shared folder before the next is made; and their folder.
    With `by`, a column whose values have folders of their own."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for r in range(rounds):
        made = make(r)
        (made.write.partitionBy(by) if by else made.write).parquet(f"{folder}/round={r}")
    return spark.read.schema(made.schema).parquet(folder).select(*made.columns), folder


def _drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder; its name may stand for several by `*`."""
    fs = (target := spark._jvm.org.apache.hadoop.fs.Path(folder)).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(target) or []:
        fs.delete(found.getPath(), True)


def _counted(train: DataFrame, slices: int, rounds: int) -> tuple[DataFrame, str]:
    """Exact counts of all words, and of all longer n-grams that occur LEAST times: ord, x, n, and the n-grams
    without the first word (shorter) and without the last (y)."""

    def counter(r: int) -> Callable[[Iterator[dict]], Iterator[dict]]:
        def count(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                for g, _ in _blocks(b["text"]):
                    for k in range(1, ORDER + 1):
                        own = _round(g[f"x{k}"], rounds) == r
                        own = np.flatnonzero(own & (g[f"x{k}"] != 0) if k > 1 else own)
                        x, first, n = np.unique(g[f"x{k}"][own], return_index=True, return_counts=True)
                        first = own[first]
                        shorter, y = (g[f"x{k - 1}"][first], g[f"y{k - 1}"][first]) if k > 1 else (x[:0], x[:0])
                        rows: dict[str, list] = {c: [] for c in ("slice", "ord", "x", "shorter", "y", "n")}
                        for own_slice, at in _sliced(x, slices):
                            packed = (x[at], shorter[at], y[at]) if k > 1 else (x[at], shorter, y)
                            for c, v in zip(rows, (own_slice, k, *(v.tobytes() for v in packed), n[at].astype("<i4").tobytes()), strict=True):
                                rows[c].append(v)
                        yield rows

        return count

    def add(group: pa.Table) -> pa.Table:
        out = []
        for k in range(1, ORDER + 1):
            own = group.filter(pa.array(group["ord"].to_numpy() == k))
            x, n = _column(own, "x"), _column(own, "n", "<i4")
            keys, first, row = np.unique(x, return_index=True, return_inverse=True)
            total = np.bincount(row, n, len(keys)).astype(np.int64)
            at = np.flatnonzero(total >= (LEAST if k > 1 else 1))
            shorter, y = (_column(own, c)[first[at]] if k > 1 else np.zeros(len(at), np.int64) for c in ("shorter", "y"))
            out.append(pa.table({"ord": np.full(len(at), k, np.int32), "x": keys[at], "shorter": shorter, "y": y, "n": total[at]}))
        return pa.concat_tables(out)

    def make(r: int) -> DataFrame:
        parts = map_arrow(train, counter(r), "slice int, ord int, x binary, shorter binary, y binary, n binary")
        return parts.groupBy("slice").applyInArrow(add, "ord int, x bigint, shorter bigint, y bigint, n bigint")

    return _in_rounds(train.sparkSession, make, rounds, "counts", "ord")


def _entries(counts: DataFrame, folder: str, places: int, bottom: float, rounds: int) -> tuple[DataFrame, list[str]]:
    """The tree as rows: ord, h, log (of a word, or of an n-gram that a state lists) or rest (of a state).

    A context is followed wherever it occurs, by the end if by nothing else, so its total is its own count; an
    n-gram that occurs LEAST times has parts that do, so all joins find their row. A stored level has a state's y
    and rest in the row of one of its n-grams only. The counts go as they are used; the folders that hold the rows come with them.
    """
    spark = counts.sparkSession
    n, p, parent, total = F.col("n"), F.col("p"), F.col("parent"), F.col("total")
    words = counts.where("ord = 1").select(F.col("x").alias("h"), "n", (F.log10(n + 1) - bottom).alias("log"))
    words, held = _in_rounds(spark, lambda r, made=words: made, 1, "order-1")
    _drop(spark, f"{folder}/round=*/ord=1")
    folders = [held]
    none = F.lit(None).cast("double")
    out, level = words.select(F.lit(1).alias("ord"), "h", "log", none.alias("rest")), words.where(n >= LEAST)
    cost = 0.5 * (F.col("listed") + 1) * float(np.log2(max(places, 2)))
    for k in range(2, ORDER + 1):

        def make(r: int, k: int = k, level: DataFrame = level) -> DataFrame:
            in_round = lambda c: F.pmod(F.shiftright(c, 20), F.lit(rounds)) == r
            own = counts.where((F.col("ord") == k) & in_round("y")).select("x", "shorter", "y", "n")
            own = own.join(level.select(F.col("h").alias("shorter"), F.col("log").alias("below")), "shorter").drop("shorter")
            own = own.join(level.where(in_round("h")).select(F.col("h").alias("y"), n.alias("total")), "y")
            own = own.withColumn("parent", F.pow(F.lit(10.0), "below")).withColumn("p", (n + SMOOTHING * parent) / (total + SMOOTHING))
            states = own.groupBy("y").agg(
                F.greatest(F.max("total") - F.sum("n"), F.lit(0)).alias("unlisted"), F.count("*").alias("listed"),
                F.sum(n * F.log2(p / parent)).alias("gain"), F.min("x").alias("one"),
                (F.greatest(1 - F.sum("p"), F.lit(1e-12)) / F.greatest(1 - F.sum("parent"), F.lit(1e-12))).alias("rest"))
            kept = states.where(F.col("gain") + F.col("unlisted") * F.log2("rest") > cost).select("y", "one", F.log10("rest").alias("rest"))
            listed, one = F.col("rest").isNotNull(), F.col("x") == F.col("one")
            return own.join(kept, "y", "left").select(
                F.col("x").alias("h"), "n", F.when(listed, F.log10("p")).otherwise(F.col("below")).alias("log"), listed.alias("listed"),
                F.when(one, F.col("y")).alias("y"), F.when(one, F.col("rest")).alias("rest"))

        level, held = _in_rounds(spark, make, rounds, f"order-{k}")
        _drop(spark, f"{folder}/round=*/ord={k}")
        folders.append(held)
        out = out.union(level.where("listed").select(F.lit(k), "h", "log", none))
        out = out.union(level.where("y is not null").select(F.lit(k - 1), "y", none, "rest"))
    return out, folders


def _filter(entries: DataFrame, cells: int) -> np.ndarray:
    """Two bits in one of the cells for each hash."""
    rows = entries.select(
        F.pmod(F.shiftright("h", 12), F.lit(cells).cast("bigint")).alias("cell"),
        F.expr("shiftleft(1L, cast(h & 63 as int)) | shiftleft(1L, cast(shiftright(h, 6) & 63 as int))").alias("bits"))
    rows = rows.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(cells, np.int64)
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _maybe(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False only where the hash isn't in the filter."""
    one = np.int64(1)
    bits = (one << (h & 63)) | (one << ((h >> 6) & 63))
    return cells[np.mod(h >> 12, len(cells))] & bits == bits


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, most: int = MOST) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod `modulus` = `held` are held out; all others, those without an id
    too, are learned from, whole. Tokens are the words and one end, so a null or empty text has one token.
    base_score is the add-one unigram score, score the suffix tree's; both are log10. n_known counts tokens
    that training has. Equal rows come as often as in the input. Without training documents both scores are 0 a
    token. `most` is the size of a filter and changes no result. Empty tables and further columns do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", out.alias("held_out"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    count_rounds, state_rounds, score_rounds = (min(n, chars // ROUND_CHARS + 1) for n in (COUNT_ROUNDS, STATE_ROUNDS, SCORE_ROUNDS))
    slices = max(partitions(spark), -(-chars // SLICE_CHARS))
    # a round has blocks for all cores, also where the table is small
    blocks = max(partitions(spark), -(-chars // BLOCK_CHARS), min(8 * score_rounds, -(-chars // SLICE_CHARS)))
    with _freeing(spark):
        counts, folder = _counted(
            docs.where("not held_out").select("text"), max(min(partitions(spark), 16), -(-chars // (SLICE_CHARS * count_rounds))), count_rounds)
        total, distinct = counts.where("ord = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        bottom = float(np.log10(total + distinct + 1))
        entries, folders = _entries(counts, folder, total, bottom, state_rounds)
        # dealt to the slices once, in buckets, so that no round shuffles the tree again
        name = f"lm_tree_{uuid.uuid4().hex}"
        sliced = entries.withColumn("slice", F.pmod("h", F.lit(slices).cast("bigint")).cast("int")).repartition(slices, "slice")
        tree = f"{shared_folder(spark).rstrip('/')}/{name}"
        sliced.write.option("path", tree).bucketBy(slices, "slice").saveAsTable(name)
        for f in (folder, *folders):
            _drop(spark, f)
        scores = _scored(docs, spark.table(name), most, total, bottom, slices, blocks, score_rounds)
        spark.sql(f"DROP TABLE {name}")
        _drop(spark, tree)
    return scores


def _scored(
    docs: DataFrame, entries: DataFrame, most: int, total: int, bottom: float, slices: int, blocks: int, rounds: int,
) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter(entries, most))

    def ask(group: pa.Table) -> pa.Table:
        block, rows = group["block"][0].as_py(), {c: [] for c in ("slice", "ord", "h")}
        asked: dict[int, list[np.ndarray]] = {k: [] for k in range(1, ORDER + 1)}
        for g, _ in _blocks(group["text"].to_pylist()):
            for k, own in asked.items():
                x = _distinct(g[f"x{k}"])
                own.append(x[_maybe(shared.value, x)])
        for k, own in asked.items():
            x = _distinct(np.concatenate(own))
            for s, at in _sliced(x, slices):
                for c, v in zip(rows, (s, k, x[at].tobytes()), strict=True):
                    rows[c].append(v)
        n = len(rows["slice"])
        return pa.table({"slice": pa.array(rows["slice"], pa.int32()), "asker": pa.array([block] * n, pa.int32()),
                         "ord": pa.array(rows["ord"], pa.int32()), "h": pa.array(rows["h"], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        order, h = known["ord"].to_numpy(), known["h"].to_numpy()
        tables = {}
        for k in range(1, ORDER + 1):
            for c in ("log", "rest"):
                v = known[c].to_numpy()
                at = np.flatnonzero((order == k) & ~np.isnan(v))
                at = at[np.argsort(h[at])]
                tables[k, c] = h[at], v[at]
        rows: dict[str, list] = {c: [] for c in ("asker", "ord", "h", "log", "rest")}
        for block, k, x in zip(asked["asker"].to_pylist(), asked["ord"].to_pylist(), asked["h"].to_pylist(), strict=True):
            x, values = np.frombuffer(x, "<i8"), []
            for c in ("log", "rest"):
                found, at = _find(tables[k, c][0], x)
                values.append(np.where(found, tables[k, c][1][at], np.nan) if len(tables[k, c][0]) else np.full(len(x), np.nan))
            some = ~(np.isnan(values[0]) & np.isnan(values[1]))
            for c, v in zip(rows, (block, k, x[some].tobytes(), *(v[some].tobytes() for v in values)), strict=True):
                rows[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c in ("asker", "ord") else pa.binary()) for c, v in rows.items()})

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for k in range(1, ORDER + 1):
            own = answers.filter(pa.array(answers["ord"].to_numpy() == k))
            h = _column(own, "h")
            order = np.argsort(h)
            # one row more, which stands for all that isn't there
            tables.append((h[order], *(np.append(_column(own, c, "<f8")[order], np.nan) for c in ("log", "rest"))))
        sums: dict[str, list[np.ndarray]] = {c: [np.zeros(0)] for c in ("n_tokens", "n_known", "base_score", "score")}
        for g, sizes in _blocks(group["text"].to_pylist()):
            for k, (h, logs, rests) in enumerate(tables, 1):
                found, at = _find(h, g[f"x{k}"])
                at[~found] = len(h)
                if k == 1:
                    found = ~np.isnan(logs[at])
                    word = np.where(found, logs[at], -bottom)
                    log, root, known = np.zeros(len(at)), np.ones(len(at), bool), found
                else:
                    # a context ends one place before; where the text doesn't reach back so far, y is 0
                    state = np.flatnonzero(~np.isnan(before) & (g[f"y{k - 1}"] != 0))
                    own = logs[at[state]]
                    listed = ~np.isnan(own)
                    log[state] = np.where(listed, own, log[state] + before[state])
                    root[state] &= ~listed
                before = np.append(np.nan, rests[at[:-1]])
            begins = np.cumsum(sizes) - sizes
            for c, v in (("n_known", known.astype(np.int64)), ("base_score", word), ("score", np.where(root, log + word, log))):
                sums[c].append(np.add.reduceat(v, begins))
            sums["n_tokens"].append(sizes)
        made = {c: np.concatenate(v) for c, v in sums.items()}
        return pa.table({
            "doc_id": group["doc_id"], "held_out": group["held_out"], "n_tokens": made["n_tokens"].astype(np.int64),
            "n_known": made["n_known"].astype(np.int64), "train_tokens": np.full(group.num_rows, total, np.int64),
            "base_score": made["base_score"], "score": made["score"]})

    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def make(r: int) -> DataFrame:
        own = dealt.where(F.pmod("block", F.lit(rounds)) == r)
        asked = own.groupBy("block").applyInArrow(ask, "slice int, asker int, ord int, h binary")
        answers = asked.groupBy("slice").cogroup(entries.groupBy("slice")).applyInArrow(
            answer, "asker int, ord int, h binary, log binary, rest binary")
        return own.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(score, (
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))

    return _in_rounds(spark, make, rounds, "scores")[0]
