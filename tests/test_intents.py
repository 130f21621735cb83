"""Intent classification against plain multinomial Bayes."""

import math
import random
from collections import Counter

from tagsmith.operators import intents

SCHEMA = "id bigint, search_query string, standard_attribute_key string, _known int"


def _plain(rows, texts):
    known = [(t or "", k) for _, t, k, _ in rows if k is not None]
    counts = Counter((k, w) for t, k in known for w in t.split(" ") if w)
    terms, names = {w for _, w in counts}, sorted({k for _, k in known})
    micro = lambda x: round(math.log(x) * 1e6)
    out = []
    for text in texts:
        words = [w for w in (text or "").split(" ") if w in terms]
        scores = []
        for k in names:
            total = sum(n for (q, _), n in counts.items() if q == k)
            score = micro(sum(q == k for _, q in known) / len(known)) - len(words) * micro(total + max(len(terms), 1))
            scores.append(score + sum(micro(counts[k, w] + 1) for w in words if counts[k, w]))
        top = max(scores)
        out.append((names[scores.index(top)], 1 / sum(math.exp((s - top) / 1e6) for s in scores)))
    return out


def test_intents_equal_plain_bayes(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=[j + 1 if i % 3 else 30 - j for j in range(30)], k=rng.randrange(9))),
             rng.choice(["b", "a", "size"]) if i % 7 else ("b" if i % 3 else "a"), i) for i in range(200)]
    rows += [(500, None, "a", 0), (501, "", "b", 0), (502, "w1  w2", None, 0), (503, "never w1", "only here", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = rows + [(600, "unknown words", None, 1), (601, "w3 w3 w3", None, 1), (601, "w3 w3 w3", None, 1)]
    queries = spark.createDataFrame(asked, SCHEMA).repartition(5)
    for parts in (1, 6):
        model = intents.train_intents(frame.repartition(parts))
        model.save(f"{tmp_path}/{parts}")
        model = intents.IntentModel.load(spark, f"{tmp_path}/{parts}")
        got = intents.predict_intents(model, queries)
        assert got.columns == ["id", "search_query", "_known", "standard_attribute_key", "confidence_score"]
        got = sorted((r["id"], r["search_query"] or "", r["standard_attribute_key"], round(r["confidence_score"], 9)) for r in got.collect())
        want = [(i, t or "", k, round(c, 9)) for (i, t, _, _), (k, c) in zip(asked, _plain(rows, [r[1] for r in asked]))]
        assert got == sorted(want)


def test_a_model_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = intents.train_intents(empty)
    got = intents.predict_intents(model, spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)).collect()
    assert [(r["standard_attribute_key"], r["confidence_score"]) for r in got] == [(None, None)]
    assert intents.predict_intents(model, empty).count() == 0


def test_many_terms_are_summed_by_query(spark, monkeypatch):
    """With many terms nothing is added up before a query's words are together, and nothing else changes."""
    texts = spark.createDataFrame(
        [(i, f"w{i % 3} w{i % 5} same", f"a{i % 2}") for i in range(40)],
        "user_pseudo_id int, search_query string, standard_attribute_key string")
    model = intents.train_intents(texts)
    few = sorted(intents.predict_intents(model, texts).collect())
    monkeypatch.setattr(intents, "FEW_TERMS", 0)
    many = intents.predict_intents(model, texts)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert sorted(many.collect()) == few
