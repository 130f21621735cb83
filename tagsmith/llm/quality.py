"""Quality classifier by co-training: one view of the text, one of the page's metadata.

Both views are logistic models, trained in rounds: each gives its most confident verdicts on unlabelled
documents to the other as pseudo-labels. Scores are calibrated on labelled documents that were held
back, and combined there too. Fitting uses bounded samples (parameters); scoring covers every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tagsmith.llm.common import add_columns, fresh

#: Labelled and unlabelled documents that the models are fitted on, at most.
LABELLED, POOL = 20_000, 20_000
ROUNDS, GROWTH, CONFIDENT = 4, 500, 0.95
SOURCES, LANGUAGES = 32, 16

_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_STOPS, _MARKS = np.frombuffer(b".,;:?'-()", np.uint8), np.frombuffer(b"!\"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_BARE = re.compile(r"\w")


def text_features(text: str | None) -> list[float]:
    """Shares and spreads of characters, words and lines; a null or empty text gives zeros."""
    if not text:
        return [0.0] * 19
    n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, upper, lower = len(text), n[_UPPER].sum(), n[_LOWER].sum() + n[128:].sum()
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    count = Counter(words)
    k = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:]))
    ends = Counter(w[-1] for w in words)
    odd = sum(c for e, c in ends.items() if not e.isalnum() and e not in ".,;:?")
    bare = sum(c for w, c in count.items() if len(w) < 3 and not _BARE.search(w))
    marks = n[_MARKS].sum()
    log = lambda a, b: float(np.log((a + 0.5) / (b + 1.0)))
    return [
        float(np.log1p(size)), float(np.log1p(k)), log(upper, upper + lower), log(lower, size), log(n[48:58].sum(), size),
        log(n[_STOPS].sum(), size), log(marks, size), log(n[33], size), log(n[124], size), log(odd, k), log(bare, k), log(again, k),
        log(count.most_common(1)[0][1] if count else 0, k), log(len(count), k), size / k if k else 0.0,
        log(len(lines) - len(set(lines)), len(lines)), float(np.log1p(k / len(lines))), log(ends.get("!", 0), k), log(ends.get(".", 0), k)]


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Language and source as hashed indicators, and the stated length; nulls have their own indicator."""
    out = [0.0] * (LANGUAGES + SOURCES + 3)
    out[crc32((lang or "").encode()) % LANGUAGES] = 1.0
    out[LANGUAGES + crc32((source or "").encode()) % SOURCES] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    out[-3:] = [float(n_chars is None), float(size), float(size * size / 10)]
    return out


@dataclass
class Logistic:
    """Logistic regression by Newton's method, on standardised features."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w, mean, scale)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


@dataclass
class CoTrained:
    """Both views, their calibrations (a logit's offset and slope) and how they are combined."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic
    exchanged: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, labelled: list[np.ndarray], y: np.ndarray, held: np.ndarray, pool: list[np.ndarray]) -> CoTrained | None:
        """labelled, pool: features of each view; held: rows kept back to calibrate. None without both classes."""
        train = ~held
        if any(len(set(y[s].tolist())) < 2 for s in (train, held)):
            return None
        own = [(x[train], y[train]) for x in labelled]
        left, exchanged = np.ones(len(pool[0]), bool), []
        for turn in range(ROUNDS + 1):
            views = [Logistic.fit(*s) for s in own]
            calibrations = [Logistic.fit(v.logit(x[held])[:, None], y[held], 1e-3) for v, x in zip(views, labelled, strict=True)]
            if turn == ROUNDS or not left.any():
                break
            share = y[train].mean()
            taken = np.zeros(len(left), bool)
            for k in (0, 1):
                p = 1 / (1 + np.exp(-calibrations[k].logit(views[k].logit(pool[k])[:, None])))
                gifts = []
                for label, sure, most in ((1.0, p, GROWTH * share), (0.0, 1 - p, GROWTH * (1 - share))):
                    at = np.flatnonzero(left & (sure >= CONFIDENT))
                    at = at[np.argsort(-sure[at], kind="stable")][: int(most)]
                    gifts.append((at, np.full(len(at), label)))
                at, label = (np.concatenate(x) for x in zip(*gifts, strict=True))
                own[1 - k] = (np.r_[own[1 - k][0], pool[1 - k][at]], np.r_[own[1 - k][1], label])
                taken[at] = True
            exchanged.append(int(taken.sum()))
            left &= ~taken
        calibrated = np.c_[tuple(c.logit(v.logit(x[held])[:, None]) for v, c, x in zip(views, calibrations, labelled, strict=True))]
        return cls(views, calibrations, Logistic.fit(calibrated, y[held], 1e-2), exchanged)

    def score(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and by both."""
        own = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, features, strict=True)]
        return tuple(1 / (1 + np.exp(-x)) for x in (*own, self.combined.logit(np.c_[tuple(own)])))


def _features(b: dict) -> list[np.ndarray]:
    return [
        np.array([text_features(t) for t in b["text"]]).reshape(-1, 19),
        np.array([metadata_features(*r) for r in zip(b["lang"], b["source"], b["n_chars"], strict=True)]).reshape(-1, LANGUAGES + SOURCES + 3)]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """Fits on at most `labelled` labelled and `pool` unlabelled documents, those with the least hash of their id.

    A document's label is the majority of its rows in `labels` (doc_id, quality), good on a tie; rows with a
    null id or quality don't count, and labels without a document neither. None if a class is missing.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(
        (F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    others = docs.select(F.col("doc_id").cast("bigint").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(pool)
    # both sides are bounded by the limits, whatever the corpus
    wanted = F.broadcast(known.unionByName(others.withColumn("_y", F.lit(None).cast("int"))).groupBy("_id").agg(F.max("_y").alias("_y")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars")).join(wanted, "_id")

    def make() -> Callable:
        return lambda b: dict(zip(("f0", "f1"), (x.tolist() for x in _features(b)), strict=True))

    made = add_columns(rows, ["text", "lang", "source", "n_chars"], make, "f0 array<double>, f1 array<double>")
    # one row of each id, the same whatever the order of the rows; so the limits bound what is collected
    rank = F.struct(F.xxhash64("text"), "lang", "source", "n_chars")
    made = made.groupBy("_id").agg(F.min_by(F.struct("_y", "f0", "f1"), rank).alias("row")).select("_id", "row.*")
    got = sorted((r["_id"], r) for r in made.collect())
    known_rows, pool_rows = [r for _, r in got if r["_y"] is not None], [r for _, r in got if r["_y"] is None]
    if not known_rows:
        return None
    y = np.array([float(r["_y"]) for r in known_rows])
    held = np.array([crc32(b"held%d" % r["_id"]) % 4 == 0 for r in known_rows])
    views = [np.array([r[f] for r in known_rows]) for f in ("f0", "f1")]
    free = [np.array([r[f] for r in pool_rows]).reshape(len(pool_rows), views[k].shape[1]) for k, f in enumerate(("f0", "f1"))]
    return CoTrained.fit(views, y, held, free)


def scored(docs: DataFrame, model: CoTrained | None, name: str = "quality_score") -> DataFrame:
    """The rows of `docs` with a struct column: text_score, metadata_score, score (probabilities of good quality).

    Needs text, lang, source and n_chars; nulls in them are features of their own. Without a model all
    scores are null. Each row is scored alone, so repeated rows score alike; nothing is shuffled.
    """
    kind = f"`{name}` struct<text_score:double,metadata_score:double,score:double>"

    def make() -> Callable:
        def task(b: dict) -> dict:
            if model is None:
                return {name: [None] * len(b["text"])}
            got = [x.tolist() for x in model.score(_features(b))]
            return {name: [{"text_score": t, "metadata_score": m, "score": s} for t, m, s in zip(*got, strict=True)]}

        return task

    return add_columns(docs, ["text", "lang", "source", "n_chars"], make, kind)


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is at least `least`, all columns kept; all rows if there is no model."""
    name = fresh(docs, "quality_score")
    out = scored(docs, fit(docs, labels), name)
    return out.where(F.coalesce(F.col(f"`{name}`.score"), F.lit(1.0)) >= least).select(*docs.columns)
