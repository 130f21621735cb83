"""Phrase collocations, periodic runs and files of token ids against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tagsmith.llm import collocations, periodic_runs, queries, range_coder, token_files
from tagsmith.llm.queries import vocabulary

LOWER = {c: c + 32 for c in range(65, 91)}


# Phrases

def _phrase_counts(rows, longest):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for p in range(len(w) - k + 1):
                    key = (lang, " ".join(w[p : p + k]))
                    counts[key] = counts.get(key, 0) + 1
    return counts, words


def _collocations(rows, threshold, longest=5, share=100, top=2000):
    f, n = _phrase_counts(rows, longest)
    frequent = {k: a for k, a in f.items() if a >= threshold and " " in k[1]}
    out = {}
    for (lang, phrase), a in frequent.items():
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(g == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " and 100 * b >= share * a for (g, q), b in frequent.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right, n[lang]))
    return {(lang, i, p.decode(), -a, left, right, m, -score)
            for lang, xs in out.items() for i, (score, a, p, left, right, m) in enumerate(sorted(xs)[:top], 1)}


def _texts(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "York", "city", "é", "Éa", "日本", "a-b", "x\x00y", " z"]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(vocabulary) if rng.random() < 0.7 else "new york city hall tower")
            parts.append(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "!? ", " ; ", "\x0b", "\x0c"]) if rng.random() < 0.3 else " ")
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(parts)))
    return rows + [(None, None), ("en", ""), ("en", " \t "), ("fr", "..,,!"), ("long", "ab cd " * 30_000), ("one", "word")]


@pytest.mark.parametrize("threshold,top", [(2, 2000), (25, 7)])
def test_collocations_equal_brute_force(spark, threshold, top):
    rows = _texts(threshold)
    docs = spark.createDataFrame([(lang, text, i, "x") for i, (lang, text) in enumerate(rows)], "lang string, text string, n long, phrase string")
    for parts in (1, 7):
        got = collocations.collocations(docs.repartition(parts), threshold, top=top).collect()
        assert set(map(tuple, got)) == _collocations(rows, threshold, top=top) and len(got) == len(set(got))


def test_phrase_counts_are_exact_and_share_and_length_count(spark):
    rows = _texts(3)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    f, n = _phrase_counts(rows, 3)
    counts = collocations.phrase_counts(docs, 4, 3)
    assert {(r["lang"], r["phrase"]): r["f"] for r in counts.where("size > 0").collect()} == {k: a for k, a in f.items() if a >= 4}
    assert {r["lang"]: r["f"] for r in counts.where("size = 0").collect()} == {k: v for k, v in n.items() if v or k in ("en", "fr")} | {"fr": 0}
    got = collocations.scored(counts, 60).select("lang", "phrase", "score").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(x[0], x[2], x[7]) for x in _collocations(rows, 4, 3, 60, 10**9)}
    with pytest.raises(ValueError):
        collocations.phrase_counts(docs, 0)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right, n = 9_000_000_000_000_007, 9_000_000_000_000_011, 9_100_000_000_000_003, 800_000_000_000_000_029
    counts = spark.createDataFrame(
        [("en", "", 0, n), ("en", "a", 1, left), ("en", "b", 1, right), ("en", "a b", 2, a)], "lang string, phrase string, size int, f bigint")
    assert collocations.scored(counts).first()["score"] == 1000 * a * n // (left * right)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_summaries_keep_what_is_frequent_in_any_order():
    rng = np.random.default_rng(5)
    for trial in range(60):
        keys = rng.zipf(1.2, 5000) % 700
        threshold = int(rng.integers(2, 300))
        places = len(keys) // threshold + 1
        parts = [collocations.MisraGries(places) for _ in range(int(rng.integers(1, 6)))]
        for i, chunk in enumerate(np.array_split(keys, 23)):
            parts[i % len(parts)].add(*collocations.summed(chunk.astype(np.int64), np.ones(len(chunk), np.int64)))
        whole = parts[0]
        for other in parts[1:]:
            whole.merge(other)
        true = Counter(keys.tolist())
        assert whole.error * (places + 1) <= len(keys) and whole.error < threshold and len(whole.keys) <= places
        assert all(c <= true[k] <= c + whole.error for k, c in zip(whole.keys.tolist(), whole.counts.tolist()))
        assert {k for k, c in true.items() if c >= threshold} <= set(whole.at_least(threshold).tolist())


def test_packed_hashes_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        assert (collocations._unpack(collocations._pack(keys)) == keys).all()


# Runs

def _runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _periodic(rng):
    kind, n, k = rng.randrange(6), rng.randrange(500), rng.choice([1, 2, 3, 20])
    w = [rng.randrange(k) for _ in range(n)]
    if kind == 1 and n:
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
        w = (w[:a] + w[a : a + p] * n)[:n]
    elif kind == 2:
        w = []
        while len(w) < n:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 9)
    elif kind == 3:  # words of Fibonacci, full of runs
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
    elif kind == 4:  # runs of runs
        u = [rng.randrange(k) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 6)
        w = ((u + [rng.randrange(k) for _ in range(rng.randrange(1, 20))]) * rng.randrange(1, 7) + [rng.randrange(k)]) * rng.randrange(1, 5)
    elif kind == 5:  # long periods that hold highly periodic regions
        w = ([0] * rng.randrange(40) + [1] * rng.randrange(1, 20) + [0, 1] * rng.randrange(20)) * rng.randrange(3, 7)
    return w


def test_runs_equal_brute_force():
    rng, n = random.Random(11), 0
    for _ in range(150):
        texts = [_periodic(rng) for _ in range(rng.randrange(1, 6))]
        got = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]))
        want = [(i, *r) for i, t in enumerate(texts) for r in _runs(t)]
        assert list(map(tuple, got.tolist())) == want
        n += len(want)
    assert n > 500


def test_long_text_and_long_period():
    rng = np.random.default_rng(3)
    root = rng.integers(0, 50_000, 20_011)
    w = np.concatenate([rng.integers(0, 9, 777), np.tile(root, 5)[:90_000], rng.integers(0, 9, 99_999), [7] * 50_000])
    got = periodic_runs.find_runs(w, np.array([len(w)])).tolist()
    assert [0, 777, 90_000, 20_011] in got and [0, len(w) - 50_000 - (w[-50_001] == 7), 50_000 + (w[-50_001] == 7), 1] in got


def test_collapsed_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 7, "x " + "ab cd " * 4 + "ab y", "é\x1cé " * 9, "very long " * 40_000]
    texts += [" ".join("w%d" % x for x in _periodic(rng)) for _ in range(40)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(5, texts[5], "y", 1), (None, texts[5], "y", 1), (None, texts[5], "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int").repartition(4)
    got = periodic_runs.collapse(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text, _, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = _runs(w) if len(w) < 5000 else [(0, len(w), 2)]
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want[i, len(w), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got) == want
    assert periodic_runs.collapse(docs.where("false")).count() == 0


def test_periodic_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, sf, "documents").collect()}
    planted = 0
    for r in queries.op12_periodic_runs(spark, sf).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 1200:
            continue
        runs = _runs(w)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), s, m, q, 1000 * m // q if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 5


# Files of token ids

def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    cases = [
        [], [np.zeros(0, np.int64)], [np.array([5])], [np.array([2**32 - 1, 0, 3]), np.zeros(100, int), np.arange(3000) * 7, np.zeros(0, int)],
        [rng.zipf(1.3, int(rng.integers(0, 3000))) % 50_257 for _ in range(40)], [rng.integers(0, 50_257, range_coder.BLOCK) for _ in range(3)],
        [np.tile(rng.integers(0, 9, 50), 80)], [rng.integers(0, 2, 1) for _ in range(range_coder.LANES + 3)], [np.arange(range_coder.MOST)]]
    for blocks in cases:
        coded = range_coder.encode_blocks(blocks)
        assert [b.tolist() for b in range_coder.decode_blocks(coded)] == [b.tolist() for b in blocks]
        # a block needs none of the others
        for k in range(0, len(coded), max(1, len(coded) // 3)):
            assert range_coder.decode_blocks([coded[k]])[0].tolist() == blocks[k].tolist()
    with pytest.raises(ValueError):
        range_coder.encode_blocks([np.zeros(range_coder.MOST + 1, int)])


def test_repetition_is_predicted():
    rng = np.random.default_rng(1)
    once = rng.integers(0, 50_000, 200)
    order0 = sum(map(len, range_coder.encode_blocks([rng.permutation(np.tile(once, 20))])))
    assert sum(map(len, range_coder.encode_blocks([np.tile(once, 20)]))) < order0 / 4 < 2 * 4000 / 4


def test_damage_is_noticed():
    block = range_coder.encode_blocks([np.arange(500) % 17])[0]
    for k in range(0, len(block), 7):
        with pytest.raises(range_coder.CorruptBlock):
            range_coder.decode_blocks([block[:k] + bytes([block[k] ^ 1]) + block[k + 1 :]])
    with pytest.raises(range_coder.CorruptBlock):
        range_coder.decode_blocks([block[:-1]])


def _library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


AWKWARD = [
    None, "", " ", "a", "  two  spaces ", "line\n\n  next\tand\x0bmore\nx y\nz", "it's <|endoftext|> here <|endoftext|>", "日本語　テスト 😀😀", "x" * 3000,
    "\xa0no\xa0break \x85 ", "Ünï cödé ÉÉ", "͸՘ new", "the cat sat", "the cat sat", "word " * 60_000, "a\n b\n\n c", "\n", "end\n"]


def test_files_equal_the_library(spark, tmp_path):
    rows = [(i * 3 - 20, t, i, "s") for i, t in enumerate(AWKWARD)] + [(1, "same", 0, "")] * 5 + [(1, "other", 0, "")] + [(None, "no id", 0, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, part string").repartition(5)
    files = token_files.write(docs, vocabulary(), f"file://{tmp_path}/ids")
    got = token_files.read(files).orderBy("start", "n_tokens").collect()
    ids = {t: x + [0] for t, x in zip({r[1] for r in rows}, _library({r[1] for r in rows}))}
    want = sorted(((r[0] is not None, r[0] or 0, r[1]) for r in rows), key=lambda r: r[:2])
    assert [r["doc_id"] for r in got] == [i if known else None for known, i, _ in want]
    assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter((r[0], np.array(ids[r[1]], "<u4").tobytes()) for r in rows)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    assert [r["n_ids"] for r in files.agg(F.sum("n_ids").alias("n_ids")).collect()] == [at]
    # equal rows stay together
    assert len({r["ids"] for r in got[[r["doc_id"] for r in got].index(1) :][:5]} | set()) <= 2
    again = token_files.read(token_files.write(docs, vocabulary(), end_id=None)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in again) == Counter((r[0], len(ids[r[1]]) - 1) for r in rows)


def test_damaged_file_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text here"), (2, "more of it")], "doc_id bigint, text string").coalesce(1)
    path = token_files.write(docs, vocabulary(), f"file://{tmp_path}/ids").first()["path"]
    local = path.removeprefix("file://")
    data = open(local, "rb").read()
    assert [i for i, _ in token_files.read_file(path)] == [1, 2]
    for damaged in (data[:-1], data[:20] + bytes([data[20] ^ 4]) + data[21:], b"", b"x" * 100, data[:-50] + bytes([data[-50] ^ 1]) + data[-49:]):
        with open(f"{tmp_path}/bad", "wb") as f:
            f.write(damaged)
        with pytest.raises(range_coder.CorruptBlock):
            list(token_files.read_file(f"file://{tmp_path}/bad"))
    files = token_files.write(docs.where("false"), vocabulary())
    assert files.count() == 0 and token_files.read(files).count() == 0


def test_document_longer_than_the_blocks_coded_at_once():
    size = range_coder.BLOCK * range_coder.LANES
    ids = (np.arange(size + 12_345) * 7919 % 50_257).astype("<u4")
    writer = token_files._FileWriter("file:///tmp/tagsmith-long.ids")
    writer.add(1, b"")
    writer.add(2, ids.tobytes())
    writer.add(3, ids[:5].tobytes())
    assert writer.close()[:2] == (3, len(ids) + 5)
    got = list(token_files.read_file("file:///tmp/tagsmith-long.ids"))
    assert [i for i, _ in got] == [1, 2, 3] and (got[1][1] == ids).all() and got[2][1].tolist() == ids[:5].tolist() and not len(got[0][1])
    pa.fs.LocalFileSystem().delete_file("/tmp/tagsmith-long.ids")
