"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tagsmith.llm import pii, queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.registered()] == [str(n) for n in range(1, 14)]
    assert [s[0] for s in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.registered()[name](spark, SF)
        assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())


def test_quality_beside_a_column_of_its_name(spark, tmp_path):
    queries.read(spark, SF, "documents").withColumn("quality_score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    queries.read(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op8_quality(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, queries.op8_quality(spark, SF).collect()))


def test_pipeline(spark):
    docs = queries.read(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in queries.read(spark, SF, "labels").collect()}
    now, steps = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, SF), "test")
        steps.append({r["doc_id"]: r for r in now.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    good, single, clean, private, coded = steps
    right = sum((i in good) == (q == 1) for i, q in labels.items())
    assert right >= 0.95 * len(labels)
    texts = Counter(r["text"] for r in single.values())
    assert max(texts.values()) == 1 and {r["text"] for r in good.values()} >= set(texts)
    hit = {r["doc_id"] for r in queries.op2_decontamination(spark, SF).where("contaminated").collect()}
    assert set(clean) == set(single) - hit
    assert set(private) == set(clean) == set(coded)
    for i, r in private.items():
        found = pii.entities(before[i])
        assert (r["text"] == before[i]) == (not found) and not any(before[i][a:b] in r["text"] for a, b, _ in found)
