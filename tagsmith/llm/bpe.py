"""Byte-pair encoding by segment trees, and decoding.

Each pre-token is a row of a segment tree whose leaves are its adjacent pairs, valued by merge rank and
place. The root is then the leftmost pair of lowest rank. A merge changes two or three leaves and the
path above them; it goes on until no pair is mergeable. Pre-tokens of similar length share one array of
trees, so that one numpy step merges a pair in each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from tagsmith.llm.common import map_arrow
from tagsmith.llm.pretokens import PreTokenizer, byte_letters

#: Distinct words that a task keeps at once, and cells of the trees that are worked on at once.
KEPT, CELLS = 300_000, 1 << 20
_NONE = np.int64(1) << 60


class SegmentTreeBPE:
    """Encodes and decodes with the vocabulary and merges of a byte-level `tokenizers` file."""

    def __init__(self, path: str) -> None:
        self.pre = PreTokenizer(path)
        model = self.pre.spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"{path} isn't a plain BPE vocabulary")
        vocab, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        n = max([*vocab.values(), *self.pre.added.values()]) + 1
        self.piece = [b""] * n
        for t, i in vocab.items():
            self.piece[i] = bytes(byte_of[c] for c in t)
        for t, i in self.pre.added.items():
            self.piece[i] = t.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; _NONE where they don't merge or a side is missing (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.rank[at], _NONE)

    def _merge(self, ids: np.ndarray) -> None:
        """Merges each row of ids (-1: nothing there) in place; a merged pair leaves its right cell at -1.

        tree[:, width + p] is the leaf of the pair that starts at p; tree[:, 1] is the root. A node holds
        rank * width + place, so the least is the lowest rank and, of these, the leftmost.
        """
        rows, width = ids.shape
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        after = np.full((rows, width), -1, np.int64)
        before = np.full((rows, width), -1, np.int64)
        place = np.arange(width)
        real = ids >= 0
        after[:, :-1] = np.where(real[:, 1:], place[1:], -1)
        before[:, 1:] = np.where(real[:, 1:], place[:-1], -1)

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank < _NONE, rank * width + at, _NONE)

        tree[:, width:-1] = leaf(self._ranks(ids[:, :-1], ids[:, 1:]), place[:-1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.arange(rows)
        while (live := live[tree[live, 1] < _NONE]).size:
            root = tree[live, 1]
            rank, at = root // width, root % width
            right = after[live, at]
            ids[live, at] = self.into[rank]
            ids[live, right] = -1
            beyond, ahead = after[live, right], before[live, at]
            after[live, at] = beyond
            has = beyond >= 0
            before[live[has], beyond[has]] = at[has]
            none = np.full(live.size, -1, np.int64)
            new = leaf(self._ranks(ids[live, at], np.where(has, ids[live, beyond], none)), at)
            had = ahead >= 0
            old = leaf(self._ranks(np.where(had, ids[live, ahead], none), ids[live, at]), ahead)
            self._set(tree, live, right + width, np.full(live.size, _NONE))
            self._set(tree, live, at + width, new)
            self._set(tree, live[had], ahead[had] + width, old[had])

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Sets a leaf in each row, and the path above it; as many steps as the tree is high."""
        tree[rows, at] = value
        for _ in range(tree.shape[1].bit_length() - 2):
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def encode_pretokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in tokens]
        out: list[bytes] = [b""] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                size = np.array([len(raw[i]) for i in part])
                ids = np.full((len(part), width), -1, np.int64)
                filled = np.arange(width) < size[:, None]
                ids[filled] = self.first[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                self._merge(ids)
                left = ids >= 0
                flat = ids[left].astype("<u4").tobytes()
                ends = np.cumsum(left.sum(1)).tolist()
                for i, a, b in zip(part, [0, *ends], ends):
                    out[i] = flat[4 * a : 4 * b]
        return out

    def _learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        self.known.update(zip(new, self.encode_pretokens(new), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pre, known, spaced = self.pre, self.known, self.spaced
        if len(known) > KEPT or len(spaced) > KEPT:
            known.clear()
            spaced.clear()
        plans: list[list] = []
        words_new: set[str] = set()
        tokens_new: set[str] = set()
        for text in texts:
            plan: list = []
            for k, part in enumerate(pre.parts(text)):
                if k % 2:
                    plan.append(pre.added[part].to_bytes(4, "little"))
                elif (words := pre.words(part)) is None:
                    plan.append((None, tokens := pre.cut(part)))
                    tokens_new.update(tokens)
                else:
                    plan.append((first := pre.cut(words[0]), words[1:]))
                    tokens_new.update(first)
                    words_new.update(plan[-1][1])
            plans.append(plan)
        cuts = {w: pre.cut(" " + w) for w in words_new if w not in spaced}
        for tokens in cuts.values():
            tokens_new.update(tokens)
        self._learn(tokens_new)
        for w, tokens in cuts.items():
            spaced[w] = known[tokens[0]] if len(tokens) == 1 else b"".join([known[t] for t in tokens])
        out = []
        for plan in plans:
            got: list[bytes] = []
            for x in plan:
                if isinstance(x, bytes):
                    got.append(x)
                elif x[0] is None:
                    got.extend(map(known.__getitem__, x[1]))
                else:
                    got.extend(map(known.__getitem__, x[0]))
                    got.extend(map(spaced.__getitem__, x[1]))
            out.append(b"".join(got))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _blocks(batches: Iterator[dict], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) with about `chars` characters at once; null texts are empty."""
    for b in batches:
        ids, texts, n = [], [], 0
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            ids.append(i), texts.append(t or "")
            n += len(texts[-1])
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts


def encode_documents(docs: DataFrame, path: str, doc_id: str | Column = "doc_id") -> DataFrame:
    """doc_id, ids (array of int), for each row of `docs`; null or empty texts have no ids."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = SegmentTreeBPE(path)
        for ids, texts in _blocks(batches, 4_000_000):
            yield {"doc_id": ids, "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts)]}

    return map_arrow(_columns(docs, doc_id), task, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, for each row of (doc_id, ids); null ids give an empty text."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = SegmentTreeBPE(path)
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b["ids"]]}

    return map_arrow(encoded.select("doc_id", "ids"), task, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str | Column = "doc_id") -> DataFrame:
    """Encodes and decodes each row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row for each input row, in any order, repeated rows and null ids included; a null text counts as
    empty. Strings of added tokens inside a text become their ids. Other columns don't matter. Nothing is
    shuffled: memory is bounded by the words kept and the longest text.
    """

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = SegmentTreeBPE(path)
        for ids, texts in _blocks(batches, 4_000_000):
            encoded = bpe.encode(texts)
            yield {
                "doc_id": ids, "n_tokens": [len(x) // 4 for x in encoded],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in encoded],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded],
            }

    return map_arrow(_columns(docs, doc_id), task, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _columns(docs: DataFrame, doc_id: str | Column) -> DataFrame:
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id") if isinstance(doc_id, str) else doc_id.alias("doc_id"), "text")
