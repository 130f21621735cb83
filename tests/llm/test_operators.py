"""The training-data operators against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tagsmith.llm import ann, bpe, decontamination, graph, licenses, ngram_join, pii, pretokens, quality, suffix_tree, token_counts, urls
from tagsmith.llm.queries import vocabulary

LOWER = {c: c + 32 for c in range(65, 91)}
AWKWARD = [
    None, "", " ", "a", "  two  spaces ", "line\n\n  next\tand\x0bmore", "it's <|endoftext|> here <|endoftext|>", "日本語　テスト 😀😀", "x" * 3000,
    "ab" * 1500 + " 12345678901234567890", "\xa0no\xa0break \x85 ", "Ünï cödé ÉÉ", "\u0378\u0558 new", "the cat sat on the mat", "the cat sat on the mat"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i * 7) for i, t in enumerate(AWKWARD)] + [(3, "a", 1), (3, "other text", 2), (None, "no id", 3), (None, "no id", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, token long").repartition(3)


def _library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    return [e.ids for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)], own


def test_pretoken_classes_agree_with_the_library():
    pre = pretokens.PreTokenizer(vocabulary())
    cut = pre.tokenizer.pre_tokenizer.pre_tokenize_str
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))):
        if unicodedata.category(c) != "Cn":
            text = f"a{c}{c}1"
            assert [text[a:b] for _, (a, b) in cut(text)] == pre.cut(text), hex(ord(c))


def test_encoding_equals_the_library():
    rng = random.Random(1)
    texts = [t or "" for t in AWKWARD] + ["".join(rng.choice("ab \n'sé1🙂.") for _ in range(rng.randrange(60))) for _ in range(300)]
    ids, own = _library(texts)
    tree = bpe.SegmentTreeBPE(vocabulary())
    got = tree.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids
    assert [tree.decode(x) for x in got] == [own.decode(i, skip_special_tokens=False) for i in ids] == texts


def test_round_trip_and_counts(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids, _ = _library([t for _, t in rows])
    want = Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(rows, ids))
    assert Counter(map(tuple, bpe.round_trip(docs, vocabulary()).collect())) == want
    counted = token_counts.token_counts(docs, vocabulary(), heavy=16)
    assert Counter(map(tuple, counted.collect())) == Counter((i, len((t or "").encode()), len(x)) for (i, t), x in zip(rows, ids))
    encoded = bpe.encode_documents(docs, vocabulary())
    assert Counter(map(tuple, bpe.decode_documents(encoded, vocabulary()).collect())) == Counter((i, t or "") for i, t in rows)
    assert token_counts.token_counts(docs.where("false"), vocabulary()).count() == 0


def test_counts_of_rows_whose_texts_share_half_a_hash(spark):
    """Rows without an id are told apart by 64 bits of their text's hash, so equal upper or lower halves don't merge them."""
    from tagsmith.llm.common import text_key

    for half in (lambda k: k >> 32, lambda k: k & 0xFFFFFFFF):
        seen, pair = {}, None
        for i in range(2_000_000):
            text = f"word {i} " * (1 + i % 3)
            if (at := half(text_key(text))) in seen:
                pair = seen[at], text
                break
            seen[at] = text
        ids, _ = _library(pair)
        docs = spark.createDataFrame([(None, t) for t in pair], "doc_id bigint, text string")
        got = token_counts.token_counts(docs, vocabulary(), heavy=4).collect()
        assert sorted(map(tuple, got)) == sorted((None, len(t), len(x)) for t, x in zip(pair, ids))


def _windows(items, size):
    out = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        k = min(size, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            out.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    return out


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 40)
    rng = random.Random(2)
    word = lambda: rng.choice("aa bb Cc dd é9".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 7])))) for i in range(12)] + [(5, "aa bb cc dd"), (50, None), (None, "aa")]
    texts = [" ".join(rng.choice([word(), word(), "zz", "yy,"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", items[3][1]]
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, match0 string")
    got = decontamination.find_matches(docs, spark.createDataFrame(items, "item_id bigint, text string"), 4).collect()
    windows = _windows([x for x in items if x[0] is not None], 4)
    want = Counter()
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= ids
        want[i % 50, len(w), len(hit), tuple(sorted(found))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got) == want
    for r in got:
        assert sorted(m["item_id"] for m in r["matches"]) == r["item_ids"]
    left = decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"), 4)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in want.items() if k[2] == 0)


@pytest.mark.parametrize("block", [4_000_000, 10])
def test_decontamination_counts_an_item_of_several_rows_once(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    texts = [" ".join(f"w{k}x{j}" for j in range(4 + k)) for k in range(6)]
    docs = spark.createDataFrame([(1, " and ".join(texts)), (2, texts[0]), (3, "none")], "doc_id bigint, text string")
    items = spark.createDataFrame([*((7, t) for t in texts), (8, texts[5])], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.find_matches(docs, items, 4).collect()}
    assert [got[k]["item_ids"] for k in (1, 2, 3)] == [["7", "8"], ["7"], []]
    assert [(m["item_id"], m["n_words"]) for m in got[1]["matches"]] == [("7", 9), ("8", 9)]
    assert [got[k]["n_hit"] for k in (1, 2, 3)] == [sum(map(len, map(str.split, texts))), 4, 0]


def test_license_scan(spark):
    one = "Released under the MIT License."
    texts = [None, "", "short", one, f"{'w ' * 200}{one.upper()} tail", "released under the license", "Licensed under CC BY-NC 4.0.", licenses.TEMPLATES[1][1][:-9]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, found string")
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in licenses.scan(docs).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["MIT"], 4: ["MIT"], 5: [], 6: ["CC-BY-NC-4.0"], 7: ["Apache-2.0"]}
    assert licenses.Templates(licenses.TEMPLATES).bands > 40


def _jaccard_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return Counter((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 512), (2, 80, 3), (3, 50, 4)])
def test_ngram_join(spark, n, percent, block):
    rng = random.Random(n)
    shared = "this passage stands in very many of these documents without making them alike".split()
    texts = [None, "", "A", "a", "one two", "One TWO", " ".join(shared)]
    for _ in range(9):
        base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([6, 25, 60]))]
        for _ in range(rng.choice([1, 3, 14])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(["new", "other", "x"])
            texts.append(" ".join(own + (shared if rng.random() < 0.4 else [])))
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts, 100)] + [(105, "something else entirely here")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, sig int").repartition(4)
    got = ngram_join.link_documents(docs, n, percent, block).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _jaccard_components(rows, n, percent)


def test_one_document_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(60)]
    texts = {1: " ".join(words), 2: " ".join([*words[:59], "end"]), 3: "quite another text with words of its own", 4: None, 5: "", 6: " ".join(words)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in ngram_join.without_copies(docs).collect()) == [1, 3, 4, 5]
    assert ngram_join.without_copies(docs.where("false")).count() == 0


def test_components_of_long_chains(spark):
    pairs = [(k, k + 1) for k in range(120) if k % 40 != 39] + [(200, 201), (201, 200)]
    edges = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in pairs], "u binary, v binary").repartition(5)
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["label"], "big") for r in graph.components(edges).collect()}
    assert got == {k: k // 40 * 40 for k in range(120) if k % 40} | {201: 200}


def test_language_model(spark):
    rng = random.Random(3)
    after = {w: [rng.choice("abcdefgh") for _ in range(2)] for w in "abcdefgh"}
    texts = []
    for _ in range(300):
        w = [rng.choice("abcdefgh")]
        while len(w) < 30:
            w.append(rng.choice(after[w[-1]]))
        texts.append(" ".join(w))
    rows = [*enumerate([*texts, None, "", "Unseen words"]), (3, texts[3]), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffix_tree.score_documents(docs, most=64).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    total, distinct = sum(count.values()), len(count)
    want = Counter((i, held(i), len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t), 6)) for i, t in tokens)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    # every state has two followers: close to one bit a word, where the unigram model needs three
    assert sum(r["score"] for r in out) > 0.6 * sum(r["base_score"] for r in out)


@pytest.mark.parametrize(("parts", "most"), [(1, 1 << 10), (40, 1)])
def test_language_model_counts_all_ngrams(spark, monkeypatch, parts, most):
    """Equals the tree built in one piece, also where an n-gram occurs once in each partition and is a small share of all."""
    monkeypatch.setattr(suffix_tree, "SLICE_CHARS", 5_000)
    rng = random.Random(5)
    texts = []
    for i in range(160):
        w = rng.choices(range(5), k=3)  # the next word depends on the two before it, or on the three
        while len(w) < 40:
            w.append((sum(w[-2 - i % 2 :]) + (rng.random() < 0.1)) % 5)
        texts.append(" ".join([*("abcde"[x] for x in w), *(["rare passage of words"] if i % 4 == 0 else []), f"only{i}"]))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(160)]
    train = [suffix_tree.words(t) for t, h in zip(texts, held) if not h]
    g = suffix_tree.ngrams(train)
    count = Counter(w for t in train for w in t)
    total = sum(count.values())
    log = lambda w: math.log10((count[w] + 1) / (total + len(count) + 1))
    flat = [w for t in train for w in t]
    cols, order, n, context, unigram = {c: [] for c in suffix_tree._COLUMNS}, [], [], [], []
    for k in (2, 3, 4):
        y, yn = np.unique(g[f"y{k - 1}"], return_counts=True)
        for key, at, m in zip(*np.unique(g[f"x{k}"], return_index=True, return_counts=True)):
            if key:
                order.append(k), n.append(m), unigram.append(log(flat[at])), context.append(yn[np.searchsorted(y, g[f"y{k - 1}"][at])])
                for c in cols:
                    cols[c].append(g[c][at])
    tree = suffix_tree.build({c: np.array(v) for c, v in cols.items()}, np.array(order), np.array(n), np.array(context), np.array(unigram), total)
    assert all(len(x.states) for x in tree.levels)
    want = {}
    for i, t in enumerate(texts):
        logs, root = tree.logs(suffix_tree.ngrams([suffix_tree.words(t)]))
        want[i] = logs.sum() + sum(log(w) for w, r in zip(suffix_tree.words(t), root) if r)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(parts)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, most=most).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_language_model_in_rounds(spark, monkeypatch, tmp_path):
    """Rounds change no score; of what they write only the scores stay, and shuffle files are freed only meanwhile."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefg", k=60)) for _ in range(40)] + [None, "", "one"]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(suffix_tree, "shared_folder", lambda _: f"file://{tmp_path}")
    tables = {t.name for t in spark.catalog.listTables()}
    one = Counter(tuple(r) for r in suffix_tree.score_documents(docs).collect())
    monkeypatch.setattr(suffix_tree, "ROUND_CHARS", 100)
    many = Counter(tuple(r) for r in suffix_tree.score_documents(docs).collect())
    assert {t.name for t in spark.catalog.listTables()} == tables
    rounded = lambda rows: Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in rows.elements())
    assert rounded(one) == rounded(many) and sum(many.values()) == len(texts) + 1
    kept = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert kept == ["scores", "scores"]
    assert sorted(len(list(p.glob("round=*"))) for p in tmp_path.iterdir()) == [1, suffix_tree.SCORE_ROUNDS]
    assert spark.conf.get(suffix_tree._FREED, "false") == "false"


def test_language_model_words_side_by_side():
    """The hashes of whole texts tell exactly those words apart that `words` does."""
    texts = ["Aa aA\tb\n\x0bb\x0c c\r", None, "", " ", "x" * 63 + " " + "x" * 64 + " " + "X" * 65 + " " + "x" * 65, "\0 \0\0 a\0 \0a a",
             "é É ü\u00a0v \x1c 漢字漢字漢字 漢字漢字漢", "abcdefgh abcdefghi abcdefg abcdefghabcdefgh", "end"]
    h, sizes = suffix_tree._text_hashes(texts)
    want = [suffix_tree.words(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_states_add_up_to_one():
    texts = [suffix_tree.words(t) for t in ["a b a b a b c"] * 30 + ["b a c"] * 9]
    g = suffix_tree.ngrams(texts)
    count = Counter(w for t in texts for w in t)
    total, distinct = sum(count.values()), len(count)
    root = {w: math.log10((n + 1) / (total + distinct + 1)) for w, n in count.items()}
    flat = [w for t in texts for w in t]
    cols = {c: [] for c in suffix_tree._COLUMNS}
    order, n, context, unigram = [], [], [], []
    for k in (2, 3, 4):
        keys, first, times = np.unique(g[f"x{k}"], return_index=True, return_counts=True)
        y, yn = np.unique(g[f"y{k - 1}"], return_counts=True)
        for key, at, m in zip(keys, first, times):
            if key:
                order.append(k), n.append(m), unigram.append(root[flat[at]]), context.append(yn[np.searchsorted(y, g[f"y{k - 1}"][at])])
                for c in cols:
                    cols[c].append(g[c][at])
    tree = suffix_tree.build({c: np.array(v) for c, v in cols.items()}, np.array(order), np.array(n), np.array(context), np.array(unigram), total)
    assert len(tree.levels[0].states)
    unknown = 1 - sum(10**v for v in root.values())
    for before in (["a"], ["a", "b"], ["b", "a", "b"]):
        p = 0.0
        for w, mass in [*((w, None) for w in count), (b"never seen", unknown)]:
            x = suffix_tree.ngrams([[x.encode() for x in before] + [w]])
            log, free = (v[-1] for v in tree.logs(x))
            p += 10 ** (log + (root[w] if w in root else math.log10(mass))) if free else 10**log
        assert abs(p - 1) < 1e-9


def test_surrogates():
    key = b"secret" * 6
    text = "Mary Smith (mary.smith@Example.com, +1 (743) 555-3824, 743-555-3824) 10.1.2.3 8.8.4.4 4111 1111 1111 1111 DE89 3704 0044 0532 0130 00 127.0.0.1"
    new, pairs = pii.replace(text, key)
    kinds = [k for k, _, _ in pairs]
    assert kinds == ["name", "email", "phone", "phone", "ip", "ip", "card", "iban"]
    assert all(a != b and re.sub(r"\w", "x", a) == re.sub(r"\w", "x", b) for k, a, b in pairs if k not in ("ip", "name"))
    assert new.endswith("127.0.0.1") and new == pii.replace(text, key)[0] != pii.replace(text, b"other" * 8)[0]
    assert pairs[0][2].split()[0] in pii.FIRST_NAMES["latin", "f"]
    assert re.sub(r"\D", "", pairs[2][2])[-10:] == re.sub(r"\D", "", pairs[3][2])
    assert pairs[4][2].startswith("10.") and all(pii.normal(k, b) for k, _, b in pairs)
    assert pii.replace("order 1234567890123456 of 2024-05-06, v1.2.3.4.5", key)[1] == []
    assert pii.replace(None, key) == (None, []) and pii.replace("", key) == ("", [])


@pytest.mark.parametrize("name", [
    "Anna Smith", "John McDonald", "Mary O'Brien", "John Michael Smith", "Jean-Pierre Dupont", "Anna Smith-Jones", "ANNA SMITH",
    "John F. Kennedy", "Peter van der Berg", "Laura Li", "Анна Петрова", "Anna-Lena Vogt", "Julia O’Neill-Page"])
@pytest.mark.parametrize("before", ["Dear ", "Call ", "By ", "", "“", "New York "])
def test_names_behind_any_word(name, before):
    new, pairs = pii.replace(f"{before}{name}'s answer", b"k" * 32)
    assert [(k, e) for k, e, _ in pairs] == [("name", name)] and new == f"{before}{pairs[0][2]}'s answer"
    assert pii.normal("name", pairs[0][2]) and not set(re.findall(r"\w{3,}", name)) - {"van", "der"} & set(re.findall(r"\w+", new))


def test_parts_of_a_name_keep_their_surrogates():
    text = "McDonald called. John McDonald and Dear Anna Smith met; Smith's car, SMITH, Anna, John and mcdonald farms. The Smithson, Hannah, Berlin"
    new, pairs = pii.replace(text, b"k" * 32)
    to = {e: s for _, e, s in pairs}
    assert [e for _, e, _ in pairs] == ["McDonald", "John McDonald", "Anna Smith", "Smith", "SMITH", "Anna", "John"]
    assert to["John McDonald"] == f"{to['John']} {to['McDonald']}" and to["Anna Smith"] == f"{to['Anna']} {to['Smith']}"
    assert to["SMITH"] == to["Smith"].upper() and new.endswith("and mcdonald farms. The Smithson, Hannah, Berlin")
    assert pii.entities("Anna The dog. The Smith house") == []


def test_permutations_are_one_to_one():
    for radices in ([10], [10, 10], [7, 10, 3], [256, 4]):
        every = [[]]
        for r in radices:
            every = [[*e, v] for e in every for v in range(r)]
        for key in (b"k" * 32, b"other"):
            new = [tuple(pii.permute(e, radices, key, "t")) for e in every]
            assert len(set(new)) == len(every)
            assert len(every) == 1 or all(list(n) != list(e) for n, e in zip(new, every))


def test_pseudonymised_rows(spark):
    rows = [(k, f"call +1 (743) 555-{k:04d} now", "m") for k in range(400)] + [(7, None, None), (None, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mentions string")
    out = pii.pseudonymised(docs, "k", found="found")
    assert out.drop("found").columns == docs.columns and out.count() == len(rows)
    assert out.select(F.explode("found.surrogate")).distinct().count() == 400
    assert pii.collisions(out.select(F.col("found").alias("mentions"))).count() == 0


def test_quality_on_held_out_labels(spark):
    rng = random.Random(5)
    good = lambda: ". ".join(" ".join(rng.choice(["river", "tree", "of", "the", "stone", "in"]) + rng.choice(["", "s", "ly"]) for _ in range(9)).capitalize() for _ in range(4)) + "."
    bad = lambda: rng.choice(["BUY!! NOW!! ", "Home | About | Login | ", "for for for for ", "ab$$$ cd%%% "]) * 12
    rows = [(k, (bad if k % 5 == 0 else good)(), rng.choice(["en", "de", None]), f"s{k % 4}", 200) for k in range(500)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (600, "", "en", None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    left = {r["doc_id"] for r in quality.kept(docs, labels).collect()}
    assert all((k in left) == (k % 5 != 0) for k in range(500))
    assert quality.kept(docs, labels.where("false")).count() == docs.count()
    assert quality.fit(docs.where("false"), labels) is None


def test_quality_fit_takes_the_same_row_of_an_id(spark):
    text = lambda k, v: f"The river {v}, and the {'tree' * (k % 7)} in it." if (k + v) % 3 else "BUY!! NOW!! " * (1 + v + k % 5)
    rows = [(k, text(k, v), "en", f"s{v}", 10 * v) for k in range(120) for v in range(3)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(80)], "doc_id bigint, quality int")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    one, two = (quality.fit(spark.createDataFrame(x, schema).coalesce(1), labels) for x in (rows, rows[::-1]))
    features = quality._features({"text": [r[1] for r in rows], "lang": ["en"] * 360, "source": [r[3] for r in rows], "n_chars": [r[4] for r in rows]})
    assert all(np.array_equal(x, y) for x, y in zip(one.score(features), two.score(features)))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[40:60] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, [None] * 16), (None, x[0].tolist())]
    table = ann.vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5))
    assert table.count() == 1500
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), 20, block=64).collect()
    hit = 0
    for q in range(0, 1500, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        score = x @ x[q]
        order = [k for k in np.lexsort((np.arange(1500), -np.round(score, 9))) if k != q][:20]
        hit += len({v for _, v, _ in own} & set(order))
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
    assert hit / (30 * 20) >= 0.9
    few = ann.vectors(spark.createDataFrame(rows[:8], "vec_id bigint, embedding array<double>"))
    assert ann.nearest(few, few.where("vec_id = 0"), 20).count() == 7
    assert ann.nearest(few.where("false"), few.where("false"), 20).count() == 0


def test_urls(spark):
    given = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme xxx": ("", "", None, "block"),
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://org": ("org", "", None, "allow"),
        "http://x.com/fr/casino": ("x.com", "/fr/casino", "com/fr/", "allow"), "http://x.net/free-bonus": ("x.net", "/free-bonus", None, "block"),
        "http://x.net/free/free": ("x.net", "/free/free", None, "allow"), "http://x.net/freedom?casinos": ("x.net", "/freedom", None, "allow"),
        "HTTP://Spam-Farm.example.net#a://b": ("spam-farm.example.net", "", None, "block")}
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given)], "page_id bigint, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got == dict(enumerate(given.values()))
