"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more component that makes all norms equal, so that
the nearest by distance are those of the largest inner product. Each of a few tables cuts the space by
random projections into cells of one width. A query visits cells around its own in the order of the
estimated chance that a neighbour at the usual distance lies there, until the chance of having met it in
some table reaches the target. The vectors of visited cells are then compared exactly.

A cell with many vectors or many visits is dealt out in a grid of blocks, so no task gets it whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from tagsmith.llm.common import map_arrow, ship, stored

#: Vectors that the usual neighbour distance is estimated from.
SAMPLE = 2048
#: Most cells that may be dealt out in blocks, which bounds what is broadcast.
MOST_CELLS = 1 << 16


@dataclass
class Hashing:
    """Random projections of all tables, and how far neighbours usually are (in scaled space)."""

    tables: int
    projections: int
    norm: float
    width: float
    distance: float
    chance: float
    size: int

    def __post_init__(self) -> None:
        rng = np.random.default_rng(20)
        self.a = rng.standard_normal((self.tables, self.size + 1, self.projections))
        self.b = rng.random((self.tables, self.projections)) * self.width
        self.mix = rng.integers(1, 1 << 62, (self.tables, self.projections)) | 1
        self.steps = np.array(list(product((-1, 0, 1), repeat=self.projections)))

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Scaled places on each projection: tables x rows x projections, in cell widths."""
        n = np.sqrt((x * x).sum(1))
        if query:
            y = np.c_[x / n[:, None], np.zeros(len(x))]
        else:
            y = np.c_[x / self.norm, np.sqrt(np.maximum(0, 1 - (n / self.norm) ** 2))]
        return (np.einsum("nd,tdk->tnk", y, self.a) + self.b[:, None]) / self.width

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row in each table: tables x rows."""
        with np.errstate(over="ignore"):
            return (np.floor(self.place(x, False)).astype(np.int64) * self.mix[:, None]).sum(2)

    def visits(self, q: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(query row, table, cells) in the order of their chance, until the target is reached."""
        at = self.place(q, True)
        home = np.floor(at).astype(np.int64)
        inside = at - home
        share = 1 - (1 - self.chance) ** (1 / self.tables)
        cut = self.width / self.distance
        erf = np.frompyfunc(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), 1, 1)
        phi = lambda v: erf(v).astype(float)
        below, above = phi(-inside * cut), phi((1 - inside) * cut)
        chances = np.stack([below - phi(-(1 + inside) * cut), above - below, phi((2 - inside) * cut) - above])
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                moved = (self.steps * self.mix[t]).sum(1)
                own = (home[t] * self.mix[t]).sum(1)
                p = np.ones((len(q), len(self.steps)))
                for k in range(self.projections):
                    p *= chances[self.steps[:, k] + 1, t, :, k].T
                order = np.argsort(-p, axis=1, kind="stable")
                reached = np.cumsum(np.take_along_axis(p, order, 1), 1)
                n = np.minimum((reached < share).sum(1) + 1, len(self.steps))
                for i in range(len(q)):
                    yield i, t, (own[i] + moved[order[i, : n[i]]]).tolist()


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part.

    Left out are null ids and vectors that are null, empty, zero or hold null or non-finite components,
    and those of another length than the most common one (of equally common ones, the longest).
    """
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of a query with rows, added up in one fixed order."""
    return (x * q).sum(1)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest of x for each query, ties to the smaller id."""
    for s in range(0, len(q), 1024):
        near = q[s : s + 1024] @ x.T
        for r, row in enumerate(near):
            own = q_ids[s + r]
            row[ids == own] = -np.inf
            some = row > -np.inf if len(row) <= k + 1 else (row >= np.partition(row, -k)[-k] - 1e-9 * max(1.0, np.abs(row[row > -np.inf]).max(initial=1.0))) & (row > -np.inf)
            c = np.flatnonzero(some)
            score = _exact(q[s + r], x[c])
            order = np.lexsort((ids[c], -score))[:k]
            yield from zip([int(own)] * len(order), ids[c][order].tolist(), score[order].tolist(), strict=True)


def fit(rows: DataFrame, k: int, tables: int = 2, chance: float = 0.97, sample: int = SAMPLE) -> tuple[Hashing | None, int]:
    """Projections for (vec_id, v), and the number of rows.

    The usual distance of the k-th neighbour comes from at most `sample` rows (least hash of the id); with
    more rows neighbours are nearer than that, so more cells are visited than needed. All rows are indexed.
    """
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return None, 0
    x = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scaled = (unit[:256] @ x.T) / norm
    kth = np.sort(scaled, axis=1)[:, -min(k + 1, scaled.shape[1])]
    distance = float(np.sqrt(np.maximum(2 - 2 * np.median(kth), 1e-4)))
    projections = min(8, max(2, round(math.log2(n) / 5)))
    return Hashing(tables, projections, float(norm), 1.6 * distance, distance, chance, x.shape[1]), n


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, block: int = 2048, tables: int = 2, chance: float = 0.97) -> DataFrame:
    """The k nearest rows of `rows` to each of `queries`, both as `vectors` gives them.

    query_id, rank (from 1), vec_id, score: the inner product in double precision; nearest first, ties to
    the smaller id; a query's own id is no candidate. Rows with an id that occurs more than once count
    once for each different score. Queries for which fewer than k were met are compared with all rows, in
    blocks, so a query gets fewer than k only if there are fewer. No rows or no queries: an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    hashing, n = fit(rows, k, tables, chance)
    if hashing is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def index(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = np.array(b["v"])
            cells, packed = hashing.cells(x), [v.tobytes() for v in x]
            for t in range(hashing.tables):
                yield {"t": [t] * len(x), "cell": cells[t], "id": b["vec_id"], "v": packed}

    def probe(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for s in range(0, len(b["v"]), 500):
                q, ids = np.array(b["v"][s : s + 500]), b["vec_id"][s : s + 500]
                packed = [v.tobytes() for v in q]
                out: dict[str, list] = {"t": [], "cell": [], "id": [], "v": []}
                for i, t, cells in hashing.visits(q):
                    out["t"] += [t] * len(cells)
                    out["cell"] += cells
                    out["id"] += [ids[i]] * len(cells)
                    out["v"] += [packed[i]] * len(cells)
                yield out

    # vectors travel as the bytes of their doubles
    kind = "t int, cell bigint, id bigint, v binary"
    indexed, visits = map_arrow(rows, index, kind), map_arrow(queries, probe, kind)
    visits = stored(visits, "visits")

    def large(side: DataFrame, total: int) -> tuple[dict, int]:
        """Blocks of the cells that have more than one; there are at most MOST_CELLS of them."""
        most = max(block, -(-total // MOST_CELLS))
        counts = side.groupBy("t", "cell").count().where(F.col("count") > most)
        return {(r["t"], r["cell"]): -(-r["count"] // most) for r in counts.collect()}, most

    many = spark.sparkContext.broadcast((large(indexed, n * tables)[0], large(visits, visits.count())[0]))

    def dealt(side: DataFrame, own: int) -> DataFrame:
        """Each row goes to one block of its side and to all blocks of the other."""

        def task(batches: Iterator[dict]) -> Iterator[dict]:
            mine, other = many.value[own], many.value[1 - own]
            for b in batches:
                keep, grid = [], []
                for i, (t, c, vec) in enumerate(zip(b["t"], b["cell"], b["id"], strict=True)):
                    a = crc32(b"%d" % vec) % mine.get((t, c), 1)
                    for o in range(other.get((t, c), 1)):
                        keep.append(i)
                        grid.append(a << 31 | o if own == 0 else o << 31 | a)
                yield {x: [b[x][i] for i in keep] for x in ("t", "cell", "id", "v")} | {"grid": grid}

        return map_arrow(side, task, f"{kind}, grid bigint")

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        unpack = lambda v: np.frombuffer(b"".join(v)).reshape(len(v), -1)
        found = _best(q["id"].to_numpy(), unpack(q["v"]), x["id"].to_numpy(), unpack(x["v"]), k) if len(q) and len(x) else ()
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    by = ("t", "cell", "grid")
    met = dealt(visits, 1).groupBy(*by).cogroup(dealt(indexed, 0).groupBy(*by)).applyInPandas(compare, "query_id bigint, vec_id bigint, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id", "score").agg(F.lit(1).alias("one"))
        return once.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = stored(ranked(met), "nearest")
    short = queries.join(out.groupBy("query_id").count().where(F.col("count") >= min(k, max(n - 1, 0))), F.col("vec_id") == F.col("query_id"), "left_anti")
    rest = stored(short.select("vec_id", "v"), "short")
    if not rest.count():
        return out
    again = None
    turn = rest.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(-(-rest.count() // 2048))))
    for part in [r["part"] for r in turn.select("part").distinct().orderBy("part").collect()]:
        own = turn.where(F.col("part") == part).collect()
        side = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in own]), np.array([r["v"] for r in own])))

        def all_rows(batches: Iterator[dict], side=side) -> Iterator[dict]:
            for b in batches:
                found = list(_best(*side.value, np.array(b["vec_id"]), np.array(b["v"]), k))
                yield {"query_id": [f[0] for f in found], "vec_id": [f[1] for f in found], "score": [f[2] for f in found]}

        more = ranked(map_arrow(rows, all_rows, "query_id bigint, vec_id bigint, score double"))
        again = more if again is None else again.unionByName(more)
    return out.join(rest.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*out.columns).unionByName(again)
