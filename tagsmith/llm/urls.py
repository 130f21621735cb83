"""URL filter: a weighted vocabulary found by Aho-Corasick, below rules for hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from tagsmith.llm.common import map_arrow

# The vocabulary. One strict term rejects a url, or SOFT_NEEDED distinct soft ones.
STRICT = ("casino", "cheap-pills", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "crypto", "dating", "deal", "free", "loan", "pills", "poker", "promo", "spam", "win")
SOFT_NEEDED = 2

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the path's start."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def count_terms(pages: DataFrame, strict: tuple = STRICT, soft: tuple = SOFT) -> DataFrame:
    """Adds n_strict, n_soft (occurrences) and soft_terms (distinct, sorted) to (page_id, url, ...).

    A term counts where no letter a-z or digit touches it; A-Z count as a-z. Null urls hold none.
    """
    columns = pages.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes) + ", n_strict bigint, n_soft bigint, soft_terms array<string>"

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in {*strict, *soft}:
            found.add_word(t, t)
        found.make_automaton()
        upper = {c: c + 32 for c in range(65, 91)}
        letters, hard, easy = frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), frozenset(strict), frozenset(soft)
        for b in batches:
            n_strict, n_soft, terms = [], [], []
            for url in b["url"]:
                text = (url or "").translate(upper)
                hits = [t for end, t in found.iter(text) if text[end + 1 : end + 2] not in letters and (end < len(t) or text[end - len(t)] not in letters)]
                n_strict.append(sum(t in hard for t in hits))
                n_soft.append(sum(t in easy for t in hits))
                terms.append(sorted({t for t in hits if t in easy}))
            yield {c: b[c] for c in columns} | {"n_strict": n_strict, "n_soft": n_soft, "soft_terms": terms}

    return map_arrow(pages, task, schema)


def judge_urls(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """One row for each row of `pages` (page_id, url): page_id, host, path, rule, verdict, n_strict, n_soft, soft_terms.

    The longest rule that fits decides; without one, the vocabulary: block on one strict term or on
    `soft_needed` distinct soft ones, else allow. A null url, or one without `://`, has an empty host and
    path, so no rule fits; the vocabulary still reads it whole. Empty urls, repeated rows, null ids, empty
    tables and further columns do no harm.
    """
    host, path = host_and_path(F.col("url"))
    judged = count_terms(pages.select("page_id", "url"), strict, soft).withColumns({
        "host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule = best_rule(F.col("host"), F.col("path"), rules)
    bad = (F.col("n_strict") > 0) | (F.size("soft_terms") >= soft_needed)
    return judged.withColumn("r", rule).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "n_strict", "n_soft", "soft_terms")


def oracle_sql() -> str:
    """The same in DuckDB's SQL, for the production rules and vocabulary."""
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # a word boundary of its own, so that neighbouring terms may share one
    spaced = f"regexp_replace({lower}, '([^a-z0-9])', '\\1\\1', 'g')"

    def times(t: str) -> str:
        term = t.replace("-", "--")
        return f"len(regexp_extract_all(u, '(?:^|[^a-z0-9]){term}(?:$|[^a-z0-9])'))"

    def rule(what: str) -> str:
        cases = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in cases) + " END"

    soft = ", ".join(f"CASE WHEN {times(t)} > 0 THEN '{t}' END" for t in SOFT)
    return f"""
        WITH a AS (SELECT page_id, {spaced} AS u, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        c AS (SELECT *, {' + '.join(map(times, STRICT))} AS n_strict, {' + '.join(map(times, SOFT))} AS n_soft,
            list_sort([x FOR x IN [{soft}] IF x IS NOT NULL]) AS terms FROM b)
        SELECT page_id, host, path, {rule('rule')} AS rule,
            coalesce({rule('verdict')}, CASE WHEN n_strict > 0 OR len(terms) >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict,
            CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft, array_to_string(terms, ',') AS soft_terms
        FROM c"""
