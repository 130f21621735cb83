"""Runs of words that repeat periodically, found with string synchronising sets.

A run is a stretch of words with smallest period q, as long as possible, of at least max(6, 4q) words. Periods
below SMALL come straight from comparing the text with itself moved by q. For the others, each scale t = SMALL,
2 SMALL, ... looks for periods from t to 2t - 1: a place belongs to the scale's synchronising set if, of the t-word
strings that start at it and at the t places behind it, the least hash is the first or the last one's. Whether it
does depends on its next 2t words alone, so a run holds the same places again after each period, and a place and
the next one with equal 2t words propose their distance. Strings inside highly periodic regions (a period of at most
t/4, found at smaller scales) don't take part, or every place of such a region could belong to the set.

Why no run is missed: with t <= q < 2t and 4q words, the first t places of a run hold one of the set, unless its next
3t - 1 words have a period of at most t/4; then, as these are at least q + t/4 words, that period would divide q and
be the run's own. The place's 2t words and their repetition after q words fit into 4q words. No nearer place has the
same 2t words, or the run's period would be smaller. Proposals are verified word by word, so hashes only cost work.

All of it is done on the words of many texts laid end to end, as array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tagsmith.llm.common import map_arrow

#: Periods below it are found by comparing directly, and it is the first scale (a power of two).
SMALL = 8
#: Shortest run, in words and in periods.
WORDS, PERIODS = 6, 4
#: Characters of the texts laid end to end; a longer text comes alone.
CHARS = 4_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Changes a document's words before runs are looked for: (doc_id, words) -> words.
Change = Callable[[int | None, list[bytes]], list[bytes]]


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _doubled(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of 2t words from those of t words; right where 2t words follow in the same text."""
    out = h * _A
    out[:-t] += h[t:]
    return _mixed(out)


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of x[i : i + k] for each i from 0 to len(x) - k."""
    n = len(x)
    rows = np.full(-(-n // k) * k, _NONE)
    rows[:n] = x
    rows = rows.reshape(-1, k)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[: n - k + 1], behind[k - 1 : n])


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _extended(w: np.ndarray, lo: int, hi: int, at: int, q: int) -> tuple[int, int]:
    """The longest stretch around `at`, within w[lo:hi], that has period q; steps double, so the work follows its length."""
    step, end = 64, at
    while end + q < hi:
        n = min(step, hi - q - end)
        same = w[end : end + n] == w[end + q : end + q + n]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + n, 2 * step
    step, start = 64, at
    while start > lo:
        n = min(step, start - lo)
        same = w[start - n : start] == w[start - n + q : start + q]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start, step = start - n, 2 * step
    return start, end + q


def find_runs(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    `w` holds numbers that stand for words, the texts' one after another; `sizes` their lengths.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found: list[tuple[np.ndarray, np.ndarray, int]] = []  # starts and ends in w, period
    for q in range(1, SMALL):
        if len(w) > q:
            equal = w[:-q] == w[q:]
            last = (ends[:, None] - 1 - np.arange(q)).ravel()
            equal[last[(last >= 0) & (last < len(equal))]] = False
            a, b = _stretches(equal)
            long = b - a >= (PERIODS - 1) * q
            found.append((a[long], b[long] + q, q))
    runs = np.concatenate([np.stack([a, b, np.full(len(a), q)], 1) for a, b, q in found]) if found else np.zeros((0, 3), np.int64)

    t, h, place = 1, None, None
    while True:
        long = sizes >= PERIODS * t
        if not long.any():
            break
        if h is None:
            h, place, size, keep = _mixed(w.astype(np.uint64) * _A + _B), None, None, long
        if t >= SMALL:
            own = sizes[long]
            if place is None or len(own) < len(size):
                # the texts that are long enough, laid end to end anew
                mask = np.repeat(long if place is None else long[keep], sizes if place is None else size)
                h = h[mask]
                place = np.flatnonzero(mask) if place is None else place[mask]
                size, keep = own, long
            runs = np.concatenate([runs, _at_scale(w, h, place, size, runs, t, starts, ends)])
        h, t = _doubled(h, t), 2 * t
    if not len(runs):
        return np.zeros((0, 4), np.int64)
    # one stretch has one smallest period
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(1)])]
    length = runs[:, 1] - runs[:, 0]
    runs, length = runs[length >= WORDS], length[length >= WORDS]
    text = np.searchsorted(ends, runs[:, 0], side="right")
    out = np.stack([text, runs[:, 0] - starts[text], length, runs[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _at_scale(w: np.ndarray, h: np.ndarray, place: np.ndarray, size: np.ndarray, runs: np.ndarray, t: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) with periods from t to 2t - 1; h: hashes of t words at the places of w."""
    n = len(h)
    own_ends = np.repeat(np.cumsum(size), size)
    left = own_ends - np.arange(n)  # words up to the end of the text
    ids = np.where(left >= t, h, _NONE)
    periodic = runs[(4 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    if len(periodic):
        # where a highly periodic region covers all t words
        cover = np.zeros(len(w) + 1, np.int32)
        np.add.at(cover, periodic[:, 0], 1)
        np.add.at(cover, periodic[:, 1] - t + 1, -1)
        ids[np.cumsum(cover)[place] > 0] = _NONE
    least = _least(ids, t + 1)
    whole = left[: len(least)] >= 2 * t
    member = np.flatnonzero(whole & (least != _NONE) & ((least == ids[: len(least)]) | (least == ids[t:])))
    if not member.size:
        return np.zeros((0, 3), np.int64)
    context = _doubled(h, t)[member]
    order = np.argsort(context, kind="stable")
    a, b = member[order[:-1]], member[order[1:]]
    gap = b - a
    paired = (context[order[:-1]] == context[order[1:]]) & (own_ends[a] == own_ends[b]) & (gap >= t) & (gap < 2 * t)
    a, gap = place[a[paired]], gap[paired]
    order = np.lexsort((a, gap))
    out, last, done = [], 0, -1
    for i, q in zip(a[order].tolist(), gap[order].tolist()):
        if q == last and i < done:
            continue  # inside the stretch just found
        text = int(np.searchsorted(ends, i, side="right"))
        start, end = _extended(w, int(starts[text]), int(ends[text]), i, q)
        last, done = q, end - q
        if end - start >= PERIODS * q:
            out.append((start, end, q))
    return np.array(out, np.int64).reshape(-1, 3)


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for text in texts for w in text], np.int64)


def collapse(docs: DataFrame, change: Change | None = None, doc_id: str | Column = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words joined by one
    space, without those that lie in a run behind its first period.

    One row for each input row, repeated rows and null ids included; a null or empty text has no words and no runs;
    columns other than doc_id and text are not looked at. Nothing is shuffled: a task holds the texts of about CHARS
    characters, or one longer text.
    """
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id

    def block(ids: list, texts: list[list[bytes]]) -> dict[str, list]:
        sizes = np.array([len(x) for x in texts], np.int64)
        found = find_runs(_numbers(texts), sizes)
        cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).tolist()
        out: dict[str, list] = {"doc_id": ids, "n_words": sizes.tolist(), "runs": [], "collapsed": []}
        for text, a, b in zip(texts, cuts, cuts[1:]):
            runs = found[a:b, 1:].tolist()
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            if runs:
                drop = np.zeros(len(text), bool)
                for s, n, q in runs:
                    drop[s + q : s + n] = True
                text = [text[i] for i in np.flatnonzero(~drop).tolist()]
            out["collapsed"].append(b" ".join(text).decode())
        return out

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                if ids and held + len(text or "") > CHARS:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(change(i, words(text)) if change else words(text))
                held += len(text or "")
            if ids:
                yield block(ids, texts)

    return map_arrow(
        docs.select(key.cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), task,
        "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
