"""SQL twin of leaf-wise boosting: one split after the other, each from the histograms of all leaves."""

from __future__ import annotations

FEATURES = ["price", "competitor_price", "inventory_level", "price_diff_pct"]


def _floor_div(a: str, b: str) -> str:
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"


def _steps(rounds: int, leaves: int, depth: int, least: int, bins: int, name: str = "", own: str = "true") -> list[str]:
    """Tables e (edges), r<t>_<s> (rows before split s of tree t), p<t>_<s> (the split), v<t> (leaf values), their
    names led by `name`. Trees are grown from the rows that meet `own`, and all rows walk through them."""
    shares = ", ".join(f"CAST({k} AS DOUBLE) / {bins}" for k in range(1, bins))
    cut = "\n UNION ALL ".join(
        f"SELECT {i} AS f, unnest(quantile_disc(x{i}, [{shares}])) AS edge FROM {name}x WHERE own" for i in range(len(FEATURES)))
    binned = ", ".join(f"(SELECT count(*) FROM {name}e WHERE f = {i} AND edge <= x{i}) AS b{i}" for i in range(len(FEATURES)))
    names = ", ".join(f"b{i}" for i in range(len(FEATURES)))
    chosen = "CASE p.f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(FEATURES))) + " END"
    out = [
        f"{name}x AS MATERIALIZED (SELECT sku_id, {own} AS own, " + ", ".join(f"{c} AS x{i}" for i, c in enumerate(FEATURES))
        + ", CAST(round(demand_qty * 1000000) AS BIGINT) AS y FROM clean)",
        f"{name}e AS MATERIALIZED (SELECT DISTINCT f, edge FROM ({cut}))",
        f"{name}base AS MATERIALIZED (SELECT {_floor_div('g', 'n')} AS base FROM (SELECT sum(y) AS g, count(*) AS n FROM {name}x WHERE own))",
        f"{name}r0_0 AS MATERIALIZED (SELECT sku_id, own, {binned}, CAST(y - base AS BIGINT) AS residual, CAST(1 AS BIGINT) AS node FROM {name}x, {name}base)"]
    for t in range(rounds):
        for s in range(leaves - 1):
            rows = f"{name}r{t}_{s}"
            out.append(f"""{name}p{t}_{s} AS MATERIALIZED (
              WITH h AS (SELECT node, f, b, count(*) AS n, sum(residual) AS g FROM (
                  SELECT node, residual, unnest([{', '.join(map(str, range(len(FEATURES))))}]) AS f, unnest([{names}]) AS b FROM {rows} WHERE own)
                GROUP BY node, f, b),
              c AS (SELECT node, f, b, sum(n) OVER w AS nl, sum(n) OVER a AS n, CAST(sum(g) OVER w AS DOUBLE) AS gl,
                  CAST(sum(g) OVER a - sum(g) OVER w AS DOUBLE) AS gr, CAST(sum(g) OVER a AS DOUBLE) AS g FROM h
                WINDOW a AS (PARTITION BY node, f), w AS (PARTITION BY node, f ORDER BY b))
              SELECT node, f, b, gl * gl / nl + gr * gr / (n - nl) - g * g / n AS gain FROM c
              WHERE nl >= {least} AND n - nl >= {least} AND gl * gl / nl + gr * gr / (n - nl) - g * g / n > 0
                AND node < {1 << depth} ORDER BY gain DESC, node, f, b LIMIT 1)""")
            out.append(f"""{name}r{t}_{s + 1} AS MATERIALIZED (SELECT sku_id, own, {names}, residual,
              CASE WHEN r.node = p.node THEN 2 * r.node + CAST({chosen} > p.b AS BIGINT) ELSE r.node END AS node
              FROM {rows} AS r LEFT JOIN {name}p{t}_{s} AS p ON true)""")
        last = f"{name}r{t}_{leaves - 1}"
        out.append(f"{name}v{t} AS MATERIALIZED (SELECT node, n, {_floor_div('g', '20 * n')} AS value FROM (SELECT node, count(*) AS n, sum(residual) AS g FROM {last} WHERE own GROUP BY node))")
        out.append(f"{name}r{t + 1}_0 AS MATERIALIZED (SELECT sku_id, own, {names}, CAST(residual - value AS BIGINT) AS residual, CAST(1 AS BIGINT) AS node FROM {last} JOIN {name}v{t} USING (node))")
    return out


def nodes(rounds: int, leaves: int = 31, depth: int = 6, least: int = 20, bins: int = 255) -> str:
    """tree, node, feature, threshold, n_rows, value of every split and leaf."""
    listed = "[" + ", ".join(f"'{c}'" for c in FEATURES) + "]"
    splits = [f"SELECT {t} AS tree, * FROM p{t}_{s}" for t in range(rounds) for s in range(leaves - 1)]
    ends = [f"SELECT {t} AS tree, * FROM v{t}" for t in range(rounds)]
    return f"""WITH {', '.join(_steps(rounds, leaves, depth, least, bins))},
      numbered AS (SELECT f, edge, row_number() OVER (PARTITION BY f ORDER BY edge) - 1 AS b FROM e)
      SELECT CAST(tree AS INTEGER) AS tree, node, {listed}[f + 1] AS feature, edge AS threshold,
          CAST(NULL AS BIGINT) AS n_rows, CAST(NULL AS DOUBLE) AS value
        FROM ({' UNION ALL '.join(splits)}) JOIN numbered USING (f, b)
      UNION ALL SELECT CAST(tree AS INTEGER), node, NULL, NULL, n, CAST(value AS DOUBLE) / 1000000 FROM ({' UNION ALL '.join(ends)})"""


def predicted(rounds: int, leaves: int = 31, depth: int = 6, least: int = 20, bins: int = 255) -> str:
    """sku_id, actual, predicted: what the trees have left of the target is the residual."""
    return f"""WITH {', '.join(_steps(rounds, leaves, depth, least, bins))}
      SELECT sku_id, CAST(y AS DOUBLE) / 1000000 AS actual, CAST(y - residual AS DOUBLE) / 1000000 AS predicted
      FROM x JOIN r{rounds}_0 USING (sku_id)"""


def importances(rounds: int, leaves: int = 31, depth: int = 6, least: int = 20, bins: int = 255) -> str:
    """feature, importance: the gain of a feature's splits as a share of all gains."""
    listed = "[" + ", ".join(f"'{c}'" for c in FEATURES) + "]"
    splits = " UNION ALL ".join(f"SELECT f, gain FROM p{t}_{s}" for t in range(rounds) for s in range(leaves - 1))
    return f"""WITH {', '.join(_steps(rounds, leaves, depth, least, bins))},
      g AS (SELECT f, sum(gain) AS gain FROM ({splits}) GROUP BY f)
      SELECT {listed}[i + 1] AS feature, round_even(coalesce(gain, 0) / (SELECT sum(gain) FROM g) * 1e9, 0) / 1e9 AS importance
      FROM range({len(FEATURES)}) AS t(i) LEFT JOIN g ON f = i"""


def grid_errors(leaves: list[int], rounds: list[int], folds: int, depth: int = 6, least: int = 20, bins: int = 255) -> str:
    """num_leaves, n_estimators, mae, is_best of every point of the grid, by cross-validation."""
    fold = f"CAST('0x' || substr(md5(sku_id), 1, 8) AS BIGINT) % {folds}"
    steps, means = [], []
    for n in leaves:
        for k in range(folds):
            name = f"l{n}f{k}_"
            steps += _steps(max(rounds), n, depth, least, bins, name, f"{fold} <> {k}")
            means += [f"SELECT {n} AS num_leaves, {t} AS n_estimators, avg(abs(CAST(residual AS DOUBLE))) / 1000000 AS mae FROM {name}r{t}_0 WHERE NOT own"
                      for t in rounds]
    return f"""WITH {', '.join(steps)},
      m AS (SELECT num_leaves, n_estimators, avg(mae) AS mae FROM ({' UNION ALL '.join(means)}) GROUP BY 1, 2)
      SELECT CAST(num_leaves AS BIGINT) AS num_leaves, CAST(n_estimators AS BIGINT) AS n_estimators,
        round_even(mae * 1e6, 0) / 1e6 AS mae, mae = (SELECT min(mae) FROM m) AS is_best FROM m"""
