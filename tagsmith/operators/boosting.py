"""Leaf-wise boosted regression trees, grown by Spark jobs over histograms.

Every feature is cut into bins once, at quantiles of one sketch pass. From then on a row is its bin
numbers and its residual, a whole number of millionths, so sums are exact and a model does not depend
on partitions, retries or the order of rows.

A tree grows best first: of all leaves the one whose best split gains most is split next, until the
tree has `leaves` of them. Which split is best for a leaf follows from its histograms, counts and
residual sums by (leaf, feature, bin), which tasks add up for their own rows before anything is
shuffled. One pass serves many leaves: it looks at the children of all leaves that may still be split,
so a tree takes about as many passes as it is deep. Only the best split of each leaf comes to the
driver. A node's number is 1 for the root, 2k and 2k + 1 for the children of k.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.sources.tables import remove, shared_folder

#: Parts of a unit that residuals and leaf values are whole numbers of.
UNIT = 1_000_000
#: Rounds after which the rows are written anew, so that no plan holds more trees than that.
ROUNDS_IN_A_PLAN = 6
#: A sum of residuals is kept as two long ones, of their high parts and their low 24 bits.
_LOW = 24
_FEATURES = "feature int, name string, edges array<double>, base bigint"
_NODES = "tree int, node bigint, feature int, bin int, gain double, n_rows bigint, value bigint"


@dataclass(frozen=True)
class BoostingParams:
    """The usual names; `leaves` bounds a tree's leaves, `max_depth` (at most 60) its depth."""

    n_estimators: int = 300
    learning_rate: float = 0.05
    num_leaves: int = 31
    max_depth: int = 6
    min_child_samples: int = 20
    max_bin: int = 255

    def __post_init__(self) -> None:
        if not (self.n_estimators >= 0 and self.num_leaves >= 1 and 1 <= self.max_depth <= 60
                and self.min_child_samples >= 1 and self.max_bin >= 2):
            raise ValueError(f"parameters out of range: {self}")


@dataclass(frozen=True)
class Split:
    feature: int
    bin: int  # rows of this bin and lower ones go left
    gain: float


@dataclass
class Tree:
    """Splits by node, and of each leaf the rows and the value in millionths."""

    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, tuple[int, int]] = field(default_factory=dict)

    def choose(self, bins: list[Column], at_leaf, node: int = 1) -> Column:
        """`at_leaf(node)` of the leaf that a row falls into, as nested conditions on its bins."""
        split = self.splits.get(node)
        if split is None:
            return at_leaf(node)
        return F.when(bins[split.feature] <= split.bin, self.choose(bins, at_leaf, 2 * node)
                      ).otherwise(self.choose(bins, at_leaf, 2 * node + 1))


@dataclass
class BoostedModel:
    """Bin edges of each feature, the starting value in millionths, and the trees."""

    features: list[str]
    edges: list[list[float]]
    base: int
    trees: list[Tree]

    def threshold(self, split: Split) -> float:
        """Values below it go left."""
        return self.edges[split.feature][split.bin]

    def gains(self) -> dict[str, float]:
        """What the splits on each feature have gained."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for split in tree.splits.values():
                total[self.features[split.feature]] += split.gain
        return total

    def nodes(self, spark: SparkSession) -> DataFrame:
        """tree, node, feature, threshold, n_rows, value: splits have the first two, leaves the others."""
        rows = []
        for i, tree in enumerate(self.trees):
            rows += [(i, n, self.features[s.feature], self.threshold(s), None, None)
                     for n, s in tree.splits.items()]
            rows += [(i, n, None, None, count, value / UNIT) for n, (count, value) in tree.leaves.items()]
        return spark.createDataFrame(
            rows, "tree int, node bigint, feature string, threshold double, n_rows bigint, value double")


    def save(self, path: str, spark: SparkSession) -> None:
        """Two small tables: a row for each feature, and one for each node."""
        features = [(i, c, own, self.base) for i, (c, own) in enumerate(zip(self.features, self.edges))]
        rows = [(t, n, s.feature, s.bin, s.gain, None, None) for t, tree in enumerate(self.trees) for n, s in tree.splits.items()]
        rows += [(t, n, None, None, None, *own) for t, tree in enumerate(self.trees) for n, own in tree.leaves.items()]
        spark.createDataFrame(features, _FEATURES).write.mode("overwrite").parquet(f"{path}/features")
        spark.createDataFrame(rows, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> BoostedModel:
        features = spark.read.parquet(f"{path}/features").orderBy("feature").collect()
        rows = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
        trees = [Tree() for _ in range(max((r["tree"] for r in rows), default=-1) + 1)]
        for r in rows:
            if r["feature"] is None:
                trees[r["tree"]].leaves[r["node"]] = r["n_rows"], r["value"]
            else:
                trees[r["tree"]].splits[r["node"]] = Split(r["feature"], r["bin"], r["gain"])
        return cls([r["name"] for r in features], [list(r["edges"]) for r in features], features[0]["base"], trees)


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Ascending edges of each feature from one pass of a quantile sketch (exact below a million rows)."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, 1_000_000).alias(c) for c in features]).first()
    return [sorted(set(found[c] or [])) for c in features]


def _binned(rows: DataFrame, features: list[str], edges: list[list[float]], target: str) -> DataFrame:
    """b0, b1, ...: how many edges a value has reached; residual: the target in millionths."""
    out = rows.select(F.round(F.col(target) * UNIT).cast("bigint").alias("residual"),
                      *[F.col(c).alias(f"x{i}") for i, c in enumerate(features)])
    for i, own in enumerate(edges):
        if own:
            cut = Bucketizer(splits=[-math.inf, *own, math.inf], inputCol=f"x{i}", outputCol=f"b{i}")
            out = cut.transform(out).withColumn(f"b{i}", F.col(f"b{i}").cast("smallint"))
        else:
            out = out.withColumn(f"b{i}", F.lit(0).cast("smallint"))
    return out.select("residual", *[f"b{i}" for i in range(len(features))])


def _best_splits(rows: DataFrame, node: Column, n_features: int, least: int) -> dict[int, dict]:
    """By node (NULL: not asked for): rows, sum of residuals, and the best split if there is one."""
    each = rows.select(node.alias("node"), "residual", F.posexplode(
        F.array(*[f"b{i}" for i in range(n_features)])).alias("feature", "bin")).where("node IS NOT NULL")
    sums = each.groupBy("node", "feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("residual", _LOW)).alias("high"),
        F.sum(F.col("residual").bitwiseAND((1 << _LOW) - 1)).alias("low"))
    sums = sums.withColumn("g", F.col("high").cast("decimal(38,0)") * (1 << _LOW) + F.col("low"))
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(
        "node", "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("n").over(whole).alias("n"),
        F.sum("g").over(upto).alias("gl"), F.sum("g").over(whole).alias("g"))
    nr, gl = F.col("n") - F.col("nl"), F.col("gl").cast("double")
    gr, g = (F.col("g") - F.col("gl")).cast("double"), F.col("g").cast("double")
    gain = gl * gl / F.col("nl") + gr * gr / nr - g * g / F.col("n")
    allowed = (F.col("nl") >= least) & (nr >= least)
    best = F.struct(F.when(allowed, gain).alias("gain"), (-F.col("feature")).alias("feature"),
                    (-F.col("bin")).alias("bin"), "nl", F.col("gl").cast("decimal(38,0)").alias("gl"))
    found = sums.groupBy("node").agg(
        F.first("n").alias("n"), F.first("g").cast("decimal(38,0)").alias("g"),
        F.max(F.when(allowed & (gain > 0), best)).alias("best"))
    return {r["node"]: r.asDict(recursive=True) for r in found.collect()}


def _grow(rows: DataFrame, p: BoostingParams, n_features: int) -> Tree:
    """One tree, best gain first; of equal gains the lower node."""
    bins = [F.col(f"b{i}") for i in range(n_features)]
    tree = Tree()
    known = _best_splits(rows, F.lit(1).cast("bigint"), n_features, p.min_child_samples)
    if not known:
        return tree
    stats = {1: (known[1]["n"], int(known[1]["g"]))}

    def split_of(node: int) -> dict | None:
        return known[node]["best"] if node in known else None

    while len(stats) < p.num_leaves:
        open_leaves = sorted((n for n in stats if split_of(n)), key=lambda n: (-split_of(n)["gain"], n))
        if not open_leaves:
            break
        now = open_leaves[0]
        if now.bit_length() < p.max_depth and 2 * now not in known:
            # the children of every leaf that may be split before the tree is full
            asked = [n for n in open_leaves[: p.num_leaves - len(stats)]
                     if n.bit_length() < p.max_depth and 2 * n not in known]
            ahead = Tree(tree.splits | {n: _split(split_of(n)) for n in asked})
            children = {c for n in asked for c in (2 * n, 2 * n + 1)}
            wanted = ahead.choose(bins, lambda n: F.lit(n if n in children else None).cast("bigint"))
            known |= _best_splits(rows, wanted, n_features, p.min_child_samples)
        best, (n, g) = split_of(now), stats.pop(now)
        tree.splits[now] = _split(best)
        stats[2 * now] = (best["nl"], int(best["gl"]))
        stats[2 * now + 1] = (n - best["nl"], g - int(best["gl"]))
    rate = Fraction(str(p.learning_rate))
    tree.leaves = {n: (count, rate.numerator * g // (rate.denominator * count))
                   for n, (count, g) in sorted(stats.items())}
    return tree


def _split(best: dict) -> Split:
    return Split(-best["feature"], -best["bin"], best["gain"])


@dataclass(frozen=True)
class BinnedRows:
    """Training rows in a folder of their own, as bin numbers and the target in millionths; fits only read them."""

    features: list[str]
    edges: list[list[float]]
    n: int
    base: int
    folder: str


def bin_rows(df: DataFrame, features: list[str] | None = None, target: str = "demand_qty",
             max_bin: int = BoostingParams.max_bin) -> BinnedRows:
    """The rows of `df` whose features and target are numbers, binned once for all fits to them."""
    spark, names = df.sparkSession, list(features or fv.MODEL_FEATURES)
    columns = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in (*names, target)]
    complete = df.select(*columns).dropna()
    edges = quantile_edges(complete, names, max_bin)
    folder = f"{shared_folder(spark)}/boosting_{uuid.uuid4().hex}"
    _binned(complete, names, edges, target).write.parquet(folder)
    rows = spark.read.parquet(folder)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("residual").cast("decimal(38,0)")).alias("g")).first()
    return BinnedRows(names, edges, size["n"], int(size["g"]) // size["n"] if size["n"] else 0, folder)


def fit_binned(spark: SparkSession, binned: BinnedRows, params: BoostingParams) -> BoostedModel:
    """Fits boosted trees to binned rows; `max_bin` is that of the rows."""
    n_features = len(binned.features)
    kept = f"{shared_folder(spark)}/boosting_{uuid.uuid4().hex}"
    rows = spark.read.parquet(binned.folder).withColumn("residual", F.col("residual") - binned.base)
    bins, trees = [F.col(f"b{i}") for i in range(n_features)], []
    for k in range(params.n_estimators if binned.n else 0):
        if k and k % ROUNDS_IN_A_PLAN == 0:
            rows.write.parquet(f"{kept}/{k}")
            rows = spark.read.parquet(f"{kept}/{k}")
            remove(spark, f"{kept}/{k - ROUNDS_IN_A_PLAN}")
        tree = _grow(rows, params, n_features)
        trees.append(tree)
        value = tree.choose(bins, lambda n, own=tree.leaves: F.lit(own[n][1]).cast("bigint"))
        rows = rows.withColumn("residual", F.col("residual") - value)
    remove(spark, kept)
    return BoostedModel(binned.features, binned.edges, binned.base, trees)


def fit_boosted(df: DataFrame, features: list[str] | None = None, target: str = "demand_qty",
                params: BoostingParams = BoostingParams()) -> BoostedModel:
    """Fits boosted trees to the rows of `df` whose features and target are numbers.

    Without such rows the model predicts zero. A constant feature is never split on; a tree without a
    gain is a single leaf.
    """
    binned = bin_rows(df, features, target, params.max_bin)
    model = fit_binned(df.sparkSession, binned, params)
    remove(df.sparkSession, binned.folder)
    return model
