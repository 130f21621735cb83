"""The queries opN_<name> and their SQL. Each applies its operator to the whole of its table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagsmith.llm import ann, bpe, collocations, decontamination, licenses, ngram_join, periodic_runs, pii, quality, suffix_tree, token_counts, token_files, urls
from tagsmith.llm.common import fresh
from tagsmith.llm.oracles import oracle_sql  # noqa: F401 (the entry reads it here)

#: Whoever runs this on real data passes a secret of their own to `pii.pseudonymised`.
PII_KEY = "tagsmith-demonstration-key"
Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("bigint").alias("longest_match"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda x: x["containment"])).alias("best_containment"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read(spark, sf_dir, "documents"), 4, 85).drop("text_hash")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, found="mentions")
    return done.select(
        "doc_id", "text", F.size("mentions").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("mentions", lambda m: m["kind"]))), ",").alias("kinds"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    name = fresh(docs, "quality_score")
    done = quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")), name)
    return done.select("doc_id", f"{name}.*", (F.col(f"{name}.score") < 0.5).alias("rejected"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.vectors(read(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(read(spark, sf_dir, "pages"))
    return judged.withColumn("soft_terms", F.array_join("soft_terms", ","))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words that repeat periodically from some place on, in one of ten documents; a null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(read(spark, sf_dir, "documents"), with_planted_period)
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("up"), (-r["period"]).alias("low"), r["start"], r["period"]))
    best = F.array_max(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(read(spark, sf_dir, "documents"), vocabulary())
    return token_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def registered() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_license_scan": op4_license_scan,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_lm_scores": op6_lm_scores,
        "op7_pii": op7_pii,
        "op8_quality": op8_quality,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_url_filter": op10_url_filter,
        "op11_collocations": op11_collocations,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_token_files": op13_token_files,
    }
