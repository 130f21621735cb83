"""SQL twins of the registered queries, written for DuckDB over the same tables.

Named parts below are common table expressions; each query pulls in the ones it mentions.
"""

from __future__ import annotations

import re

from tagsmith.workload import boosted_oracle


def rnd(x: str, places: int = 2) -> str:
    scale = f"1e{places}"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def total(x: str) -> str:
    return f"(CAST(sum(CAST(round_even(({x}) * 1e6, 0) AS HUGEINT)) AS DOUBLE) / 1e6)"


def zero_pct(change: str, base: str) -> str:
    return f"CASE WHEN {base} = 0 THEN 0.0 ELSE ({change}) / nullif({base}, 0) * 100.0 END"


def champion(p: str, c: str, v: str, g: str) -> str:
    return f"(1500.0 + 0.1 * {c} + 0.02 * {v} + -1.0 * {g} + -0.5 * {p})"


def challenger(p: str, c: str, v: str, g: str) -> str:
    return f"(1400.0 + 0.05 * {c} + 0.01 * {v} + -2.0 * {g} + -0.4 * {p})"


SQUEEZE = r"[ \t\n\x0B\f\r]+"
SITE_JSON = ("'{' || coalesce(string_agg('\"site_' || site_no || '\":\"' || CAST(@ AS VARCHAR)"
             " || '\"', ',' ORDER BY site_no), '') || '}'").replace("@", rnd("price"))

PARTS: dict[str, str] = {
    "sku": "SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS display_name FROM part",
    "price": "SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_retailprice AS list_price FROM part",
    "sales": """SELECT CAST(l_partkey AS VARCHAR) AS sku_id, sum(l_quantity) AS total_sales
        FROM lineitem GROUP BY 1""",
    "inv": """SELECT *, CASE WHEN total_inventory > 1000 THEN 'VERY_HIGH'
          WHEN total_inventory > 400 THEN 'HIGH' WHEN total_inventory > 100 THEN 'MED'
          ELSE 'LOW' END AS inventory_bucket
        FROM (SELECT CAST(l_partkey AS VARCHAR) AS sku_id,
                     sum(l_quantity * (l_suppkey % 10 - 4)) AS total_inventory
              FROM lineitem GROUP BY 1)""",
    "web": """SELECT regexp_extract(props, '"k": *([0-9]+)', 1) AS sku_id, event_type
        FROM events WHERE event_type IN ('view', 'click')""",
    "counts": """SELECT sku_id, count(*) FILTER (WHERE event_type = 'view') AS views,
          count(*) FILTER (WHERE event_type = 'click') AS add_to_cart FROM web GROUP BY 1""",
    "signals": """SELECT s.sku_id, total_sales, CAST(coalesce(views, 0) AS DOUBLE) AS views,
          CAST(coalesce(add_to_cart, 0) AS DOUBLE) AS add_to_cart
        FROM sales s LEFT JOIN counts c ON s.sku_id = c.sku_id""",
    "tops": """SELECT max(total_sales) AS s, max(add_to_cart) AS c, max(views) AS v
        FROM signals""",
    "demand": """SELECT *, CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.4 THEN 'MED'
          ELSE 'LOW' END AS demand_bucket
        FROM (SELECT signals.*,
                0.5 * (CASE WHEN s > 0 THEN total_sales / s ELSE total_sales END)
                + 0.3 * (CASE WHEN c > 0 THEN add_to_cart / c ELSE add_to_cart END)
                + 0.2 * (CASE WHEN v > 0 THEN views / v ELSE views END) AS score
              FROM signals, tops)""",
    "offers": """SELECT DISTINCT l_partkey AS p, l_suppkey AS site_no, CASE WHEN l_partkey % 9 <> 0
          THEN p_retailprice * (74 + l_partkey * 7 % 53 + (l_partkey + l_suppkey * 13) % 5) / 100
          END AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cheapest": """SELECT CAST(p AS VARCHAR) AS sku_id, price AS competitor_price,
          CASE WHEN price IS NOT NULL THEN 'site_' || site_no END AS competitor_name
        FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY price, site_no) AS rn
              FROM offers) WHERE rn = 1""",
    "maps": f"""SELECT CAST(p AS VARCHAR) AS sku_id, {SITE_JSON} AS all_competitors_json
        FROM offers GROUP BY p""",
    "comp": f"""SELECT c.*, m.all_competitors_json,
          CASE WHEN competitor_price IS NULL THEN 'NO_COMPETITOR'
               WHEN competitor_price < list_price THEN 'COMPETITOR_CHEAPER'
               WHEN competitor_price > list_price THEN 'WE_CHEAPER' ELSE 'SAME' END
            AS competitor_bucket,
          {rnd('(list_price - competitor_price) / competitor_price * 100.0')} AS price_diff_pct
        FROM cheapest c JOIN maps m ON c.sku_id = m.sku_id JOIN price p ON c.sku_id = p.sku_id""",
    "master": """SELECT p.sku_id, display_name, list_price, list_price AS current_price,
          total_inventory, inventory_bucket, coalesce(demand_bucket, 'LOW') AS demand_bucket,
          competitor_price, competitor_name,
          coalesce(competitor_bucket, 'NO_COMPETITOR') AS competitor_bucket, price_diff_pct,
          all_competitors_json
        FROM price p JOIN inv i ON p.sku_id = i.sku_id LEFT JOIN sku s ON p.sku_id = s.sku_id
        LEFT JOIN demand d ON p.sku_id = d.sku_id LEFT JOIN comp c ON p.sku_id = c.sku_id
        WHERE total_inventory > 0""",
    "sold": """SELECT m.*, coalesce(total_sales, 0.0) AS demand_qty
        FROM master m LEFT JOIN sales s ON m.sku_id = s.sku_id""",
    "golden": """SELECT sku_id, current_price AS price, competitor_price,
          total_inventory AS inventory_level, price_diff_pct, demand_qty FROM sold""",
    "clean": """SELECT sku_id, price, coalesce(competitor_price, price) AS competitor_price,
          inventory_level, coalesce(price_diff_pct, 0.0) AS price_diff_pct, demand_qty
        FROM golden""",
    "rule_no": """SELECT *, CASE
          WHEN price_diff_pct > 5 OR price_diff_pct < -5 THEN 1
          WHEN price_diff_pct BETWEEN -2 AND 2 AND competitor_price <> 0 THEN 2
          WHEN inventory_bucket = 'VERY_HIGH' AND demand_bucket = 'LOW' THEN 3
          WHEN competitor_bucket = 'NO_COMPETITOR' AND demand_bucket = 'HIGH'
            AND inventory_bucket IN ('LOW', 'MED') THEN 4
          WHEN demand_bucket = 'HIGH' AND inventory_bucket = 'LOW'
            AND competitor_bucket = 'WE_CHEAPER' THEN 5
          WHEN demand_bucket = 'HIGH' AND inventory_bucket = 'LOW'
            AND competitor_bucket = 'SAME' THEN 6
          WHEN competitor_bucket = 'COMPETITOR_CHEAPER' AND competitor_price <> 0 THEN 7
          ELSE 8 END AS rule FROM sold""",
    "ruled": """SELECT *, rule = 1 AS alert_flag,
          CASE rule WHEN 2 THEN competitor_price * 0.999 WHEN 3 THEN current_price * 0.70
            WHEN 4 THEN current_price * 1.25 WHEN 5 THEN current_price * 1.20
            WHEN 6 THEN current_price * 1.10 WHEN 7 THEN competitor_price * 0.99
            ELSE current_price END AS new_price,
          CASE rule WHEN 1 THEN 'Manual review required (large price gap)'
            WHEN 2 THEN 'Auto match competitor (0.1% lower)' WHEN 3 THEN 'Stock clearance 30%'
            WHEN 4 THEN 'Monopoly premium 25%' WHEN 5 THEN 'Big increase' WHEN 6 THEN 'Increase'
            WHEN 7 THEN 'Match ' || coalesce(competitor_name, '') ELSE 'No change' END
            AS decision_reason
        FROM rule_no""",
    "points": """SELECT sku_id, current_price AS bp, demand_qty AS bd FROM sold
        WHERE demand_qty > 0""",
    "samples": """SELECT sku_id, bp, bd, x, bd * bp / x AS y
        FROM (SELECT *, bp * 0.7 + k * (bp * 1.3 - bp * 0.7) / 11 AS x
              FROM points, range(12) AS t(k))""",
    "line": """SELECT sku_id, any_value(bp) AS bp, any_value(bd) AS bd,
          regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2
        FROM samples GROUP BY sku_id""",
    "fits": f"""SELECT l.sku_id, any_value(l.bp) AS base_price, any_value(l.bd) AS base_demand,
          any_value(slope) AS slope, any_value(intercept) AS intercept,
          {rnd('any_value(r2)', 4)} AS elasticity_r2,
          {rnd('avg(abs(y - (intercept + slope * x)))')} AS elasticity_mae,
          {rnd('avg(abs((y - (intercept + slope * x)) / (y + 1))) * 100')} AS elasticity_mape
        FROM line l JOIN samples s ON l.sku_id = s.sku_id GROUP BY l.sku_id""",
    "feature_rows": """SELECT 'p' || m.sku_id AS sku_id, m.* EXCLUDE (sku_id),
          coalesce(total_sales, 0.0) AS demand_qty, coalesce(views, 0) AS ga4_views,
          coalesce(add_to_cart, 0) AS ga4_add_to_cart
        FROM master m LEFT JOIN sales s ON m.sku_id = s.sku_id
        LEFT JOIN counts c ON s.sku_id = c.sku_id""",
    "typed_ids": """SELECT o_orderkey AS pos, CASE substr(o_orderpriority, 1, 1)
          WHEN '1' THEN '  p' || o_custkey || ' ' WHEN '2' THEN 'P' || o_custkey
          WHEN '3' THEN '   ' WHEN '4' THEN 'x' || o_custkey ELSE 'p' || o_custkey END AS raw
        FROM orders""",
    "wanted": """SELECT trim(raw) AS sku_id, min(pos) AS pos FROM typed_ids
        WHERE trim(raw) <> '' GROUP BY 1""",
    "found": """SELECT w.sku_id AS requested_id, w.pos, f.*
        FROM wanted w JOIN feature_rows f ON f.sku_id = (
          CASE WHEN w.sku_id IN (SELECT sku_id FROM feature_rows) THEN w.sku_id
               ELSE lower(w.sku_id) END)""",
    "lost": """SELECT sku_id, 'SKU not found in feature store' AS error FROM wanted
        WHERE sku_id NOT IN (SELECT requested_id FROM found)""",
    "asked": f"""SELECT * REPLACE (coalesce({rnd('(list_price - competitor_price) / competitor_price * 100.0')}, 0.0)
          AS price_diff_pct) FROM found""",
    "service": f"""SELECT *, step = 1 AS alert_flag,
          CASE step WHEN 2 THEN {rnd('competitor_price')} WHEN 3
            THEN {rnd('competitor_price * 0.999')} ELSE current_price END AS new_price,
          CASE step WHEN 1 THEN 'Manual review required (large price gap)'
            WHEN 2 THEN 'Auto match competitor (0.1% lower)'
            WHEN 3 THEN 'Match ' || coalesce(competitor_name, '')
            ELSE 'No competitor data available' END AS decision_reason,
          CASE step WHEN 1 THEN 'RULE_OVERRIDE_ALERT' WHEN 2 THEN 'RULE_AUTO_MATCH'
            WHEN 3 THEN 'RULE_MATCH_COMPETITOR' ELSE 'NO_COMPETITOR' END AS rule_reason
        FROM (SELECT *, CASE
            WHEN competitor_price > 0 AND abs(price_diff_pct) > 20 THEN 1
            WHEN competitor_price > 0 AND
              abs((current_price - competitor_price) / competitor_price * 100) <= 0.1 THEN 2
            WHEN competitor_price > 0 THEN 3 ELSE 4 END AS step FROM {{source}})""",
    "versions": """SELECT o_orderpriority AS model_name, 'v' || o_custkey AS model_version,
          o_orderstatus AS environment,
          'models/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS model_path,
          '["price", "competitor_price", "inventory_level", "price_diff_pct"]'
            AS feature_columns, o_orderdate AS created_at, o_orderkey % 3 = 0 AS is_active,
          CASE WHEN o_orderkey % 50 = 0 THEN 'Production' ELSE 'None' END AS stage
        FROM orders""",
    "shops": """SELECT p_name, site_no, min(price) AS price
        FROM offers JOIN part ON p = p_partkey GROUP BY 1, 2""",
    "name_items": f"""SELECT p_name, min(price) AS competitor_price,
          'site_' || arg_min(site_no, (price, site_no)) FILTER (WHERE price IS NOT NULL)
            AS competitor_name,
          {SITE_JSON} AS all_competitors_json FROM shops GROUP BY 1""",
    "unmet": """SELECT CAST(doc_id AS VARCHAR) AS user_pseudo_id, text AS search_query,
          source AS sku, lang AS standard_attribute_key,
          n_chars / (n_chars + 1000.0) AS confidence_score, 'v1' AS model_version,
          TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS event_timestamp
        FROM documents d WHERE n_chars / (n_chars + 1000.0) >= 0.70
          AND NOT EXISTS (SELECT 1 FROM documents g JOIN labels l ON g.doc_id = l.doc_id
            WHERE l.quality = 1 AND g.source = d.source AND g.lang = d.lang)""",
    "judged": """SELECT quality AS actual, CAST(n_chars >= 1000 AS INTEGER) AS predicted,
          n_chars / (n_chars + 1000.0) AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}
PARTS["service_master"] = PARTS["service"].format(source="master")
PARTS["service"] = PARTS["service"].format(source="asked")


def sweep(source: str, demand: str, base: str, tolerance: float) -> str:
    """Select of all source columns plus ai_optimal_price and pricing_reason.

    `demand` is an expression over p, rival, stock and gap; `base` the credited demand.
    """
    return f"""
      WITH inputs AS (
        SELECT *, coalesce(nullif(competitor_price, 0), current_price) AS rival,
          total_inventory AS stock, coalesce(price_diff_pct, 0.0) AS gap,
          current_price * ({base}) AS base_revenue FROM {source}),
      grid AS (
        SELECT *, CASE WHEN k = 14 THEN current_price * 1.3 ELSE
            k * ((current_price * 1.3 - current_price * 0.7) / 14) + current_price * 0.7 END AS p
        FROM inputs, range(15) AS t(k)),
      tried AS (SELECT *, p * greatest({demand}, 0.0) AS revenue FROM grid WHERE p <= rival),
      best AS (
        SELECT sku_id AS best_id, p AS best_price, revenue AS best_revenue FROM tried
        QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY revenue DESC, k) = 1),
      chosen AS (
        SELECT inputs.*, best_price, coalesce(best_revenue > base_revenue, false) AS better,
          greatest(coalesce(best_revenue, base_revenue), base_revenue) AS top_revenue
        FROM inputs LEFT JOIN best ON sku_id = best_id),
      verdict AS (SELECT *, CASE WHEN alert_flag THEN 'RULE_OVERRIDE_ALERT'
          WHEN base_revenue > 0
            AND (top_revenue - base_revenue) / base_revenue < -({tolerance})
            THEN 'REJECTED_LOW_REVENUE'
          WHEN better THEN 'AI_REVENUE_OPTIMIZED' ELSE 'NO_IMPROVEMENT' END AS pricing_reason
        FROM chosen)
      SELECT *, CASE pricing_reason WHEN 'RULE_OVERRIDE_ALERT' THEN new_price
          WHEN 'REJECTED_LOW_REVENUE' THEN current_price
          WHEN 'AI_REVENUE_OPTIMIZED' THEN {rnd('best_price')}
          ELSE {rnd('current_price')} END AS ai_optimal_price
      FROM verdict"""


_MODEL = champion("p", "rival", "stock", "gap")
_BATCH_BASE = "coalesce(nullif(demand_qty, 0), 1)"
PARTS["swept"] = sweep("ruled", _MODEL, _BATCH_BASE, 0.05)
PARTS["swept_strict"] = sweep("ruled", _MODEL, _BATCH_BASE, -0.5)
PARTS["swept_service"] = sweep(
    "(SELECT * EXCLUDE (sku_id), requested_id AS sku_id, sku_id AS feature_id FROM service)",
    _MODEL, "demand_qty", 0.05)
PARTS["lined"] = """SELECT r.*, slope, intercept FROM ruled r
    LEFT JOIN fits f ON r.sku_id = f.sku_id"""
PARTS["swept_lines"] = sweep("lined", "(intercept + slope * p)", _BATCH_BASE, 0.05)
_FEATURES = ("current_price", "coalesce(competitor_price, current_price)", "total_inventory",
             "coalesce(price_diff_pct, 0.0)")
PARTS["paired"] = f"""SELECT *, champion_demand * current_price AS champion_revenue,
      challenger_demand * current_price AS challenger_revenue
    FROM (SELECT *, {champion(*_FEATURES)} AS champion_demand,
            {challenger(*_FEATURES)} AS challenger_demand FROM sold)"""
_HYBRID = """CASE WHEN alert_flag THEN {alert}
    WHEN elasticity_r2 >= 0.75 AND elasticity_mape <= 2.9 THEN {ai} ELSE {rule} END"""
_AI_COLUMNS = f"""sku_id, current_price, new_price, ai_optimal_price, pricing_reason,
    CASE WHEN alert_flag THEN 'RULE_OVERRIDE' ELSE 'AI_OPTIMIZED' END AS ai_strategy,
    {rnd('(ai_optimal_price - current_price) / current_price * 100.0')} AS price_change_pct"""
_RULE_COLUMNS = """sku_id, current_price, competitor_price, price_diff_pct, new_price,
    decision_reason, alert_flag"""
_PUNCT = r"[!-/:-@\[-`{-~]"
_WORDS = (f"trim(regexp_replace(regexp_replace(lower(text), '{_PUNCT}', '', 'g'), "
          f"'{SQUEEZE}', ' ', 'g'))")
_RESULT = f"""
  SELECT feature_id AS sku_id, display_name, list_price, current_price, competitor_price,
    competitor_name,
    CASE WHEN competitor_price IS NULL OR competitor_price <= 0 THEN 'NO_COMPETITOR'
      WHEN abs(our_gap) <= 2 THEN 'SAME' WHEN our_gap < -2 THEN 'WE_CHEAPER'
      ELSE 'COMPETITOR_CHEAPER' END AS competitor_bucket,
    {rnd('price_diff_pct')} AS price_diff_pct, all_competitors_json, total_inventory,
    CASE WHEN total_inventory >= 500 THEN 'VERY_HIGH' WHEN total_inventory >= 200 THEN 'HIGH'
      WHEN total_inventory >= 50 THEN 'MED' ELSE 'LOW' END AS inventory_bucket,
    {rnd('demand_qty', 4)} AS demand_qty,
    CASE WHEN demand_qty > 5 THEN 'HIGH' ELSE 'LOW' END AS demand_bucket,
    {rnd('ai_optimal_price')} AS new_price, {rnd('ai_optimal_price')} AS ai_optimal_price,
    price_change_pct, confidence_score,
    CASE WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.40 THEN 'MEDIUM'
      ELSE 'LOW' END AS confidence_label,
    pricing_reason, CASE WHEN alert_flag THEN 'RULE_OVERRIDE' ELSE 'AI_OPTIMISED' END
      AS ai_strategy, decision_reason, alert_flag, '2024-01-31_120000' AS run_date,
    'A1B2C3' AS run_id, 'v1.0' AS model_version
  FROM (SELECT *, {rnd('''least(
        (CASE WHEN competitor_price > 0 THEN 0.25::DOUBLE ELSE 0 END)
        + (CASE WHEN total_inventory >= 50 THEN 0.20::DOUBLE ELSE 0 END)
        + (CASE WHEN demand_qty > 1 THEN 0.20::DOUBLE ELSE 0 END)
        + (CASE WHEN ga4_views > 0 OR ga4_add_to_cart > 0 THEN 0.15::DOUBLE ELSE 0 END)
        + (CASE WHEN abs(price_change_pct) < 10 THEN 0.20::DOUBLE ELSE 0 END), 1.0)''', 4)}
        AS confidence_score,
      (current_price - competitor_price) / competitor_price * 100 AS our_gap
    FROM (SELECT *, CASE WHEN current_price > 0 THEN
            {rnd('(ai_optimal_price - current_price) / current_price * 100.0')} ELSE 0.0 END
            AS price_change_pct FROM swept_service))"""


def _least_squares(name: str, condition: str) -> None:
    """Parts for an ordinary least-squares fit on the rows of `clean` that meet a condition.

    Features are made orthogonal one after the other; <name>_coef is one row with the means, the
    projections a.. and the weights g.. of the orthogonal features.
    """
    PARTS[f"{name}_c"] = f"""SELECT sku_id, price - avg(price) OVER () AS z1,
        competitor_price - avg(competitor_price) OVER () AS x2,
        inventory_level - avg(inventory_level) OVER () AS x3,
        price_diff_pct - avg(price_diff_pct) OVER () AS x4, demand_qty AS y
      FROM clean WHERE {condition}"""
    PARTS[f"{name}_m"] = f"""SELECT avg(price) AS m1, avg(competitor_price) AS m2,
        avg(inventory_level) AS m3, avg(price_diff_pct) AS m4, avg(demand_qty) AS my
      FROM clean WHERE {condition}"""
    PARTS[f"{name}_s1"] = f"""SELECT sum(x2 * z1) / sum(z1 * z1) AS a21,
        sum(x3 * z1) / sum(z1 * z1) AS a31, sum(x4 * z1) / sum(z1 * z1) AS a41,
        sum(y * z1) / sum(z1 * z1) AS g1 FROM {name}_c"""
    PARTS[f"{name}_d"] = f"SELECT *, x2 - a21 * z1 AS z2 FROM {name}_c, {name}_s1"
    PARTS[f"{name}_s2"] = f"""SELECT sum(x3 * z2) / sum(z2 * z2) AS a32,
        sum(x4 * z2) / sum(z2 * z2) AS a42, sum(y * z2) / sum(z2 * z2) AS g2 FROM {name}_d"""
    PARTS[f"{name}_e"] = f"SELECT *, x3 - a31 * z1 - a32 * z2 AS z3 FROM {name}_d, {name}_s2"
    PARTS[f"{name}_s3"] = f"""SELECT sum(x4 * z3) / sum(z3 * z3) AS a43,
        sum(y * z3) / sum(z3 * z3) AS g3 FROM {name}_e"""
    PARTS[f"{name}_f"] = f"""SELECT *, x4 - a41 * z1 - a42 * z2 - a43 * z3 AS z4
      FROM {name}_e, {name}_s3"""
    PARTS[f"{name}_s4"] = f"SELECT sum(y * z4) / sum(z4 * z4) AS g4 FROM {name}_f"
    PARTS[f"{name}_coef"] = f"""SELECT * FROM {name}_m, {name}_s1, {name}_s2, {name}_s3,
        {name}_s4"""


def _predicted(p: str, c: str, v: str, g: str) -> str:
    z1 = f"({p} - m1)"
    z2 = f"({c} - m2 - a21 * {z1})"
    z3 = f"({v} - m3 - a31 * {z1} - a32 * {z2})"
    z4 = f"({g} - m4 - a41 * {z1} - a42 * {z2} - a43 * {z3})"
    return f"(my + g1 * {z1} + g2 * {z2} + g3 * {z3} + g4 * {z4})"


_IN_TEST = "substr(md5('42:' || sku_id), 1, 8) < '33333333'"
_least_squares("tr", f"NOT ({_IN_TEST})")
_least_squares("al", "true")
_least_squares("t7", f"NOT ({_IN_TEST.replace('42:', '7:')})")
PARTS["pairs"] = f"""SELECT sku_id, demand_qty AS actual,
    {_predicted('price', 'competitor_price', 'inventory_level', 'price_diff_pct')} AS predicted
  FROM clean, tr_coef WHERE {_IN_TEST}"""
PARTS["ruled_coef"] = "SELECT * FROM ruled, al_coef"
PARTS["swept_ml"] = sweep("ruled_coef", _predicted("p", "rival", "stock", "gap"), _BATCH_BASE, 0.05)
PARTS["ruled_train"] = "SELECT * FROM ruled, tr_coef"
PARTS["swept_registered"] = sweep(
    "ruled_train", _predicted("p", "rival", "stock", "gap"), _BATCH_BASE, 0.05)


def _metrics(y: str, p: str, source: str) -> str:
    return f"""
      WITH m AS (SELECT {y} AS y, {p} AS p FROM {source}),
      s AS (SELECT {rnd('1 - avg((y - p) * (y - p)) / var_pop(y)', 6)} AS r2,
          {rnd('avg(abs(y - p))', 6)} AS mae, {rnd('avg(abs((y - p) / (y + 1))) * 100', 6)} AS mape,
          {rnd('sqrt(avg((y - p) * (y - p)))', 6)} AS rmse,
          CASE WHEN count(*) FILTER (WHERE y = 0) = 0 THEN
            {rnd('100 - avg(abs((y - p) / nullif(y, 0))) * 100', 6)} END AS pseudo_accuracy,
          count(*) FILTER (WHERE y = 0) AS zero_actuals FROM m)
      SELECT *, r2 >= 0.70 AND mae <= 50 AS passes_gate FROM s"""


def _compare(old: str, new: str, names: tuple[str, str, str, str], source: str) -> str:
    o, n, d, p = names
    return f"""SELECT {rnd('o')} AS {o}, {rnd('n')} AS {n}, {rnd('n - o')} AS {d},
        {rnd(zero_pct('n - o', 'o'))} AS {p}
      FROM (SELECT {total(old)} AS o, {total(new)} AS n FROM {source})"""


def _rows(old: str, new: str, names: tuple[str, str, str, str], source: str) -> str:
    o, n, d, p = names
    return f"""SELECT sku_id, o AS {o}, n AS {n}, n - o AS {d},
        {rnd(zero_pct('n - o', 'o'))} AS {p}
      FROM (SELECT sku_id, {old} AS o, {new} AS n FROM {source})"""


_CUR, _NEW, _AIR = "current_price * demand_qty", "new_price * demand_qty", \
    "ai_optimal_price * demand_qty"
_DASH = {
    "current_revenue": "cur", "chosen_revenue": "ai", "chosen_vs_current_change": "ai - cur",
    "chosen_vs_current_pct": zero_pct("ai - cur", "cur"), "rule_revenue": "rul",
    "rule_vs_current_change": "rul - cur", "rule_vs_current_pct": zero_pct("rul - cur", "cur"),
    "ai_revenue": "ai",
    "ai_vs_rule_lift": "ai - rul", "ai_vs_rule_pct": zero_pct("ai - rul", "rul"),
    "ai_vs_current_lift": "ai - cur", "ai_vs_current_pct": zero_pct("ai - cur", "cur"),
    "champion_revenue": "champ", "challenger_revenue": "chall",
    "challenger_lift": "chall - champ", "challenger_lift_pct": zero_pct("chall - champ", "champ"),
}

BODIES: dict[str, str] = {
    "sku_sales": "SELECT * FROM sales",
    "ga4_signal_counts": "SELECT * FROM counts",
    "ga4_preagg_counts": """SELECT regexp_extract(props, '"k": *([0-9]+)', 1) AS sku_id,
        count(*) FILTER (WHERE event_type = 'view') AS views,
        count(*) FILTER (WHERE event_type = 'click') AS add_to_cart FROM events GROUP BY 1""",
    "inventory_totals": "SELECT * FROM inv",
    "demand_score": """SELECT sku_id, total_sales, views, add_to_cart, score, demand_bucket
        FROM demand""",
    "lowest_competitor": "SELECT * FROM cheapest",
    "competitor_map": "SELECT * FROM maps",
    "competitor_position": f"""
      SELECT CAST(p_partkey AS VARCHAR) AS sku_id, competitor_price, competitor_name,
        CASE WHEN competitor_price IS NULL THEN 'NO_COMPETITOR'
          WHEN competitor_price < p_retailprice THEN 'COMPETITOR_CHEAPER'
          WHEN competitor_price > p_retailprice THEN 'WE_CHEAPER' ELSE 'SAME' END
          AS competitor_bucket,
        {rnd('(p_retailprice - competitor_price) / competitor_price * 100.0')} AS price_diff_pct,
        all_competitors_json
      FROM name_items JOIN part USING (p_name)""",
    "master_dataset": "SELECT * FROM master",
    "master_dataset_batch": """SELECT * FROM master QUALIFY row_number() OVER (
        PARTITION BY display_name, current_price ORDER BY sku_id) = 1""",
    "sku_dedup": """SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_retailprice AS current_price,
          p_name AS display_name FROM part QUALIFY row_number() OVER (
          PARTITION BY p_name, p_retailprice ORDER BY CAST(p_partkey AS VARCHAR)) = 1""",
    "last_line_per_sku": """SELECT CAST(l_partkey AS VARCHAR) AS sku_id,
          l_orderkey * 8 + l_linenumber AS line_no, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY line_no DESC) = 1""",
    "null_report": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        "count(*) AS row_count FROM golden"
        for c in ["sku_id", "price", "competitor_price", "inventory_level", "price_diff_pct",
                  "demand_qty"]),
    "golden_clean": "SELECT * FROM clean",
    "golden_pricing_frame": """SELECT sku_id, price AS current_price, price AS list_price,
        competitor_price, inventory_level AS total_inventory, price_diff_pct, demand_qty,
        CASE WHEN inventory_level > 1000 THEN 'VERY_HIGH' WHEN inventory_level > 400 THEN 'HIGH'
          WHEN inventory_level > 100 THEN 'MED' ELSE 'LOW' END AS inventory_bucket,
        CASE WHEN demand_qty / top > 0.7 THEN 'HIGH' WHEN demand_qty / top > 0.4 THEN 'MED'
          ELSE 'LOW' END AS demand_bucket,
        CASE WHEN competitor_price < price THEN 'COMPETITOR_CHEAPER'
          WHEN competitor_price > price THEN 'WE_CHEAPER' ELSE 'SAME' END AS competitor_bucket
      FROM clean, (SELECT max(demand_qty) AS top FROM clean)""",
    "alias_columns": """SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS display_name,
        p_retailprice AS list_price__base, p_retailprice * p_size AS current_price FROM part""",
    "numeric_coercion": """SELECT p_partkey,
        CASE p_partkey % 8 WHEN 4 THEN CAST(p_size AS DOUBLE) WHEN 6 THEN p_retailprice
          WHEN 7 THEN p_retailprice END AS parsed,
        CASE WHEN p_partkey % 8 < 3 THEN 0.0 ELSE p_retailprice END AS cleaned FROM part""",
    "clean_requests": "SELECT * FROM wanted",
    "price_rules_batch": f"SELECT {_RULE_COLUMNS} FROM ruled",
    "price_rules_service": f"""SELECT {_RULE_COLUMNS}, rule_reason AS pricing_reason
        FROM service_master""",
    "elasticity_fit": f"""SELECT * REPLACE ({rnd('slope', 6)} AS slope,
        {rnd('intercept', 3)} AS intercept) FROM fits""",
    "elasticity_price": f"""
      WITH grid AS (SELECT m.sku_id, current_price, slope, intercept, k,
          CASE WHEN k = 19 THEN current_price * 1.3 ELSE
            k * ((current_price * 1.3 - current_price * 0.7) / 19) + current_price * 0.7 END AS p
        FROM master m LEFT JOIN fits f ON m.sku_id = f.sku_id, range(20) AS t(k))
      SELECT sku_id, current_price,
        CASE WHEN slope IS NULL THEN current_price
          WHEN revenue > 0 THEN {rnd('p')} ELSE {rnd('current_price')} END AS elasticity_price
      FROM (SELECT *, p * greatest(intercept + slope * p, 0) AS revenue FROM grid)
      QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY revenue DESC, k) = 1""",
    "price_sweep_linear": """SELECT sku_id, current_price, ai_optimal_price, pricing_reason
        FROM swept_lines""",
    "ai_output": f"SELECT {_AI_COLUMNS} FROM swept",
    "ai_output_rejections": f"SELECT {_AI_COLUMNS} FROM swept_strict",
    "hybrid_price": f"""SELECT s.sku_id, new_price, ai_optimal_price, elasticity_r2,
        elasticity_mape,
        {_HYBRID.format(alert='current_price', ai='ai_optimal_price', rule='new_price')}
          AS final_price,
        {_HYBRID.format(alert="'Manual review (alert triggered)'",
                        ai="'AI optimized pricing'", rule="'Rule-based pricing'")}
          AS pricing_strategy
      FROM swept s LEFT JOIN fits f ON s.sku_id = f.sku_id""",
    "priced_output_stamped": f"""SELECT s.sku_id,
        {_HYBRID.format(alert='current_price', ai='ai_optimal_price', rule='new_price')}
          AS final_price,
        {_HYBRID.format(alert="'Manual review (alert triggered)'",
                        ai="'AI optimized pricing'", rule="'Rule-based pricing'")}
          AS pricing_strategy, '2024-01-31_120000' AS run_date, 'v1.0' AS model_version,
        'A1B2C3' AS run_id
      FROM swept s LEFT JOIN fits f ON s.sku_id = f.sku_id""",
    "predicted_demand": f"""SELECT sku_id, current_price,
        greatest({champion(*_FEATURES)}, 0.0) AS predicted_demand FROM master""",
    "request_pricing": _RESULT,
    "missing_requests": "SELECT * FROM lost",
    "request_summary": """
      WITH n AS (SELECT (SELECT count(*) FROM wanted) AS requested, count(*) AS found,
          (SELECT count(*) FROM lost) AS missing,
          count(*) FILTER (WHERE NOT alert_flag) AS ai_optimised,
          count(*) FILTER (WHERE alert_flag) AS rule_overrides,
          count(*) FILTER (WHERE alert_flag) AS alerts FROM service)
      SELECT *, CASE WHEN missing = 0 THEN 'SUCCESS' WHEN found > 0 THEN 'PARTIAL_SUCCESS'
          ELSE 'FAILURE' END AS status,
        found || ' of ' || requested || ' SKUs priced. ' || ai_optimised || ' AI optimised, '
          || rule_overrides || ' rule overrides, ' || alerts || ' flagged for review.' AS summary
      FROM n""",
    "published_features": """SELECT *, CAST(0 AS DOUBLE) AS demand_qty, CAST(0 AS BIGINT) AS ga4_views,
        CAST(0 AS BIGINT) AS ga4_add_to_cart FROM master""",
    "feature_table_info": """SELECT (SELECT count(*) FROM feature_rows) AS sku_count, sku_id
        FROM feature_rows ORDER BY sku_id LIMIT 20""",
    "revenue_rows": _rows(_CUR, _NEW, ("current_revenue", "simulated_revenue", "revenue_change",
                                       "revenue_change_pct"), "ruled"),
    "revenue_current_vs_new": _compare(
        _CUR, _NEW, ("current_revenue", "new_revenue", "revenue_change", "revenue_change_pct"),
        "ruled"),
    "revenue_current_vs_ai": _compare(
        _CUR, _AIR, ("current_revenue", "ai_revenue", "revenue_change", "revenue_change_pct"),
        "swept"),
    "revenue_ai_vs_rule": _compare(
        _NEW, _AIR, ("rule_revenue", "ai_revenue", "revenue_lift", "lift_pct"), "swept"),
    "revenue_ai_vs_rule_rows": _rows(
        _NEW, _AIR, ("rule_revenue", "ai_revenue", "revenue_lift", "revenue_lift_pct"), "swept"),
    "revenue_lift": _compare(
        _CUR, _NEW, ("current_revenue", "new_revenue", "revenue_lift", "lift_pct"), "ruled"),
    "champion_challenger_rows": """SELECT sku_id, champion_demand, challenger_demand,
        champion_revenue, challenger_revenue FROM paired""",
    "champion_vs_challenger": f"""SELECT {rnd('a', 4)} AS champion_revenue,
        {rnd('b', 4)} AS challenger_revenue, {rnd('b - a', 4)} AS revenue_lift,
        {rnd('CASE WHEN a > 0 THEN (b - a) / a * 100.0 ELSE 0 END', 4)} AS lift_pct
      FROM (SELECT {total('champion_revenue')} AS a, {total('challenger_revenue')} AS b
            FROM paired)""",
    "strategy_dashboard": f"""
      WITH t AS (SELECT {total(_CUR)} AS cur, {total(_NEW)} AS rul, {total(_AIR)} AS ai
          FROM swept),
      c AS (SELECT {total('champion_revenue')} AS champ, {total('challenger_revenue')} AS chall
          FROM paired)
      """ + "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, {rnd(x)} AS value FROM t, c" for m, x in _DASH.items()),
    "hash_split": """SELECT o_orderkey,
        substr(md5('42:' || o_orderkey), 1, 8) < '33333333' AS in_test FROM orders""",
    "time_split": """SELECT o_orderkey, o_orderdate,
        CASE WHEN row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC)
          <= (SELECT count(*) // 6 FROM orders) THEN 'test' ELSE 'train' END AS part
      FROM orders""",
    "regression_metrics": _metrics("demand_qty", "total_inventory * 0.4 + 500.0", "sold"),
    "train_linear": _metrics("actual", "predicted", "pairs"),
    "actual_vs_predicted": f"SELECT sku_id, actual, {rnd('predicted', 4)} AS predicted FROM pairs",
    "sweep_mllib": f"SELECT {_AI_COLUMNS} FROM swept_ml",
    "registered_model_price": f"SELECT {_AI_COLUMNS} FROM swept_registered",
    "elasticity_training_rows": """SELECT sku_id, current_price, demand_qty, competitor_price,
        inventory_bucket FROM sold WHERE demand_qty > 0""",
    "date_texts": """SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') AS run_date,
        strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS response_time FROM events""",
    "classification_metrics": f"""
      WITH classes AS (SELECT DISTINCT actual AS label FROM judged
          UNION SELECT DISTINCT predicted FROM judged),
      f AS (SELECT label,
          (SELECT count(*) FROM judged WHERE actual = label) AS support,
          (SELECT count(*) FROM judged WHERE predicted = label) AS guessed,
          (SELECT count(*) FROM judged WHERE actual = label AND predicted = label) AS hits
        FROM classes),
      ranked AS (SELECT actual, rank() OVER (ORDER BY score)
          + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM judged),
      auc AS (SELECT (sum(CASE WHEN actual = 1 THEN rk ELSE 0 END)
          - sum(actual) * (sum(actual) + 1) / 2.0) / (sum(actual) * sum(1 - actual)) AS area
        FROM ranked)
      SELECT {rnd('sum(hits) / sum(support)', 6)} AS accuracy,
        {rnd('sum(hits * 2.0 / (support + guessed) * support) / sum(support)', 6)} AS f1,
        {rnd('(SELECT area FROM auc)', 6)} AS roc_auc FROM f""",
    "registry_register": """
      SELECT * REPLACE (CASE WHEN model_name = '1-URGENT' AND environment = 'F' THEN false
          ELSE is_active END AS is_active) FROM versions
      UNION ALL SELECT '1-URGENT', 'v999999999', 'F', 'models/new', '[]',
        (SELECT max(created_at) FROM versions), true, 'None'""",
    "registry_resolve": """SELECT * FROM versions QUALIFY row_number() OVER (
        PARTITION BY model_name, environment ORDER BY
          CASE WHEN is_active AND model_version = 'v100' THEN 1 WHEN is_active THEN 2 ELSE 3 END,
          created_at DESC, model_path DESC) = 1""",
    "registry_resolve_latest": """SELECT * EXCLUDE (model_path) FROM (
        SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY model_name, environment
          ORDER BY CASE WHEN is_active THEN 2 ELSE 3 END, created_at DESC, model_path DESC) = 1)""",
    "registry_champion": """SELECT * EXCLUDE (n),
        CASE WHEN n = 1 THEN 'champion' ELSE 'challenger' END AS role
      FROM (SELECT *, row_number() OVER (PARTITION BY model_name, environment
            ORDER BY created_at DESC, model_path DESC) AS n FROM versions) WHERE n <= 2""",
    "registry_promote": """SELECT v.* EXCLUDE (n) REPLACE (
        CASE WHEN n = 1 THEN 'Production' WHEN stage = 'Production' THEN 'Archived'
          ELSE stage END AS stage)
      FROM (SELECT *, row_number() OVER (PARTITION BY model_name
            ORDER BY CAST(substr(model_version, 2) AS BIGINT) DESC, created_at DESC,
              model_path DESC) AS n FROM versions) v""",
    "registry_rollback": """SELECT * REPLACE (
        CASE WHEN model_name = '2-HIGH' AND model_version = 'v10' THEN 'Production'
          WHEN model_name = '2-HIGH' AND stage = 'Production' AND EXISTS (
            FROM versions WHERE model_name = '2-HIGH' AND model_version = 'v10') THEN 'Archived'
          ELSE stage END AS stage) FROM versions""",
    "query_text_clean": f"""SELECT CAST(doc_id AS VARCHAR) AS user_pseudo_id,
        trim(regexp_replace(regexp_replace(' ' || replace({_WORDS}, ' ', '  ') || ' ',
          ' (personally|tbh|in  my  opinion) ', ' ', 'g'), '{SQUEEZE}', ' ', 'g'))
          AS search_query FROM documents""",
    "gap_rows": "SELECT * FROM unmet",
    "gap_counts": """SELECT standard_attribute_key, count(*) AS gap_queries,
        count(DISTINCT sku) AS skus_affected FROM unmet GROUP BY 1""",
    "sku_csv_feed": "SELECT * FROM sku",
    "price_csv_feed": "SELECT sku_id, list_price, list_price AS current_price FROM price",
    "price_csv_feed_batch": "SELECT * FROM price",
    "orders_csv_feed": "SELECT * FROM sales",
    "inventory_csv_feed": "SELECT * FROM inv",
    "events_json_feed": "SELECT * FROM counts",
    "competitor_json_feed": """SELECT p_name AS name, competitor_price, competitor_name
        FROM name_items""",
    "feeds_to_master": f"""SELECT m.sku_id, m.display_name, m.list_price, m.current_price,
        m.total_inventory, m.inventory_bucket, m.demand_bucket, n.competitor_price,
        n.competitor_name, CASE WHEN n.competitor_price IS NULL THEN 'NO_COMPETITOR'
          WHEN n.competitor_price < list_price THEN 'COMPETITOR_CHEAPER'
          WHEN n.competitor_price > list_price THEN 'WE_CHEAPER' ELSE 'SAME' END
          AS competitor_bucket,
        {rnd('(list_price - n.competitor_price) / n.competitor_price * 100.0')} AS price_diff_pct,
        n.all_competitors_json
      FROM master m LEFT JOIN name_items n ON m.display_name = n.p_name""",
    "golden_table": "SELECT * FROM clean",
    "golden_csv_fallback": "SELECT *, 'x' AS note FROM clean",
    "file_as_table": """SELECT p_partkey AS part_key, p_name AS name_en, p_retailprice AS price_eur
        FROM part""",
    "priced_table": f"""SELECT s.sku_id,
        {_HYBRID.format(alert='current_price', ai='ai_optimal_price', rule='new_price')}
          AS final_price,
        {_HYBRID.format(alert="'Manual review (alert triggered)'",
                        ai="'AI optimized pricing'", rule="'Rule-based pricing'")}
          AS pricing_strategy, champion_revenue, challenger_revenue,
        '2024-01-31_120000' AS run_date, 'v1.0' AS model_version, 'A1B2C3' AS run_id
      FROM swept s LEFT JOIN fits f ON s.sku_id = f.sku_id JOIN (SELECT sku_id, champion_revenue, challenger_revenue FROM paired) p
        ON s.sku_id = p.sku_id""",
    "registry_table": """
      SELECT * REPLACE (CASE WHEN model_name = '5-LOW' AND environment = 'O' THEN false
          ELSE is_active END AS is_active) FROM versions
      UNION ALL SELECT '5-LOW', 'v999999999', 'O', 'models/new', '[]',
        (SELECT max(created_at) FROM versions), true, 'None'""",
    "sanitized_master": """SELECT sku_id, list_price / nullif(total_inventory - 500.0, 0)
          AS per_unit, CASE WHEN abs(price_diff_pct) > 5 THEN 0.0 ELSE price_diff_pct END AS gap
        FROM master""",
    "stream_ga4_windows": """
      WITH timed AS (SELECT ts, event_type, regexp_extract(props, '"k": *([0-9]+)', 1) AS sku_id
        FROM events WHERE event_type IN ('view', 'click'))
      SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, sku_id,
        count(*) FILTER (WHERE event_type = 'view') AS views,
        count(*) FILTER (WHERE event_type = 'click') AS add_to_cart
      FROM timed GROUP BY date_trunc('hour', ts), sku_id""",
    "stream_ga4_counts": "SELECT * FROM counts",
    "rule_outcomes": f"""SELECT decision_reason, count(*) AS skus,
        {rnd(total(_CUR))} AS current_revenue, {rnd(total(_NEW))} AS new_revenue
      FROM ruled GROUP BY 1""",
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    """Parts mentioned in the text, each after the parts it mentions itself."""
    for name, part in PARTS.items():
        if name not in seen and re.search(rf"(?:FROM|JOIN|,|IN \(SELECT \w+ FROM)\s+{name}\b", sql):
            for inner in _needed(part, seen):
                if inner not in seen:
                    seen.append(inner)
            seen.append(name)
    return seen


BODIES["feature_snapshot"] = f"""SELECT *, CAST(0 AS DOUBLE) AS demand_qty,
    CAST(0 AS BIGINT) AS ga4_views, CAST(0 AS BIGINT) AS ga4_add_to_cart
  FROM ({BODIES['feeds_to_master']})"""
BODIES["sku_csv_feed_batch"] = BODIES["sku_csv_feed"]
BODIES["orders_csv_feed_batch"] = BODIES["orders_csv_feed"]
BODIES["competitor_results_feed"] = BODIES["competitor_json_feed"]
BODIES["price_csv_feed_gaps"] = """SELECT sku_id, list_price, CASE CAST(sku_id AS BIGINT) % 3
    WHEN 2 THEN list_price * 0.9 ELSE list_price END AS current_price FROM master"""
BODIES["priced_csv_output"] = """SELECT 'p' || sku_id AS sku_id, current_price,
    all_competitors_json FROM master"""
BODIES["train_rf"] = BODIES["train_gbt"] = f"""
  WITH t AS (SELECT demand_qty AS y FROM clean WHERE NOT ({_IN_TEST})),
  s AS (SELECT demand_qty AS y FROM clean WHERE {_IN_TEST})
  SELECT (SELECT count(*) FROM t) AS train_rows, true AS closer_than_mean, count(*) AS test_rows,
    count(*) AS finite_scores, {rnd('avg(abs(y - (SELECT avg(y) FROM t)))', 6)} AS mean_model_mae
  FROM s"""
_EACH = _predicted(*_FEATURES)
BODIES["registered_champions"] = f"""
  WITH a AS (SELECT sku_id, {_EACH} AS champion_demand, current_price FROM sold, t7_coef),
  b AS (SELECT sku_id, {_EACH} AS challenger_demand FROM sold, tr_coef)
  SELECT sku_id, {rnd('champion_demand', 4)} AS champion_demand,
    {rnd('challenger_demand', 4)} AS challenger_demand,
    {rnd('champion_demand * current_price')} AS champion_revenue,
    {rnd('challenger_demand * current_price')} AS challenger_revenue FROM a JOIN b USING (sku_id)"""
BODIES["train_leafwise"] = boosted_oracle.nodes(3)
BODIES["written_null_report"] = BODIES["null_report"]
BODIES["leafwise_importances"] = boosted_oracle.importances(3)
BODIES["tune_leafwise"] = boosted_oracle.grid_errors([4, 8], [1, 2, 3], 3)
BODIES["leafwise_demand"] = boosted_oracle.predicted(3)
BODIES["tune_random"] = """SELECT CAST(20 AS BIGINT) AS trials, true AS in_space,
    true AS best_is_least"""
BODIES["tune_grid"] = """SELECT CAST(4 AS BIGINT) AS trials, true AS in_space,
    true AS best_is_least"""
BODIES["feature_importances"] = """SELECT CAST(4 AS BIGINT) AS features,
    CAST(4 AS BIGINT) AS shares, CAST(1 AS DOUBLE) AS total"""


def _bayes(condition: str) -> str:
    """Tables best (doc_id, intent, confidence): multinomial Bayes trained on the texts that meet a condition."""
    return f"""
  t AS (SELECT doc_id, lang, unnest([x FOR x IN string_split(search_query, ' ') IF x <> '']) AS term
      FROM ({BODIES['query_text_clean']}) JOIN documents ON user_pseudo_id = CAST(doc_id AS VARCHAR)),
  c AS (SELECT lang AS intent, term, count(*) AS n FROM t WHERE {condition} AND lang IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT lang AS intent, CAST(round(ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM documents WHERE {condition} AND lang IS NOT NULL)) * 1000000) AS BIGINT) AS prior
      FROM documents WHERE {condition} AND lang IS NOT NULL GROUP BY 1),
  u AS (SELECT intent, -CAST(round(ln(coalesce(sum(n), 0) + CAST((SELECT count(DISTINCT term) FROM c) AS DOUBLE)) * 1000000) AS BIGINT) AS unseen
      FROM k LEFT JOIN c USING (intent) GROUP BY 1),
  known AS (SELECT doc_id, count(*) AS n FROM t WHERE term IN (SELECT term FROM c) GROUP BY 1),
  seen AS (SELECT doc_id, intent, sum(CAST(round(ln(c.n + 1.0::DOUBLE) * 1000000) AS BIGINT)) AS weight FROM t JOIN c USING (term) GROUP BY 1, 2),
  s AS (SELECT d.doc_id, k.intent, prior + unseen * coalesce(known.n, 0) + coalesce(weight, 0) AS score
      FROM documents d CROSS JOIN k JOIN u USING (intent) LEFT JOIN known ON known.doc_id = d.doc_id
      LEFT JOIN seen ON seen.doc_id = d.doc_id AND seen.intent = k.intent),
  best AS (SELECT doc_id, arg_max(intent, (score, 0)) FILTER (WHERE place = 1) AS intent, 1 / sum(exp((score - top) / 1000000.0::DOUBLE)) AS confidence
      FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent) AS place FROM s)
      GROUP BY doc_id)"""


BODIES["intent_classifier"] = f"""WITH {_bayes('true')}
  SELECT CAST(doc_id AS VARCHAR) AS user_pseudo_id, intent AS standard_attribute_key, {rnd('confidence', 6)} AS confidence_score FROM best"""
BODIES["gap_chain"] = f"""WITH {_bayes('doc_id % 2 = 0')}
  SELECT CAST(d.doc_id AS VARCHAR) AS user_pseudo_id, q.search_query, source AS sku, intent AS standard_attribute_key,
    {rnd('confidence', 6)} AS confidence_score, 'v1' AS model_version, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS event_timestamp
  FROM best JOIN documents d USING (doc_id) JOIN ({BODIES['query_text_clean']}) q ON q.user_pseudo_id = CAST(doc_id AS VARCHAR)
  WHERE confidence >= 0.70 AND NOT EXISTS (SELECT 1 FROM documents g JOIN labels l ON g.doc_id = l.doc_id
    WHERE l.quality = 1 AND g.source = d.source AND g.lang = best.intent)"""
BODIES["event_counts_json_feed"] = BODIES["ga4_preagg_counts"]


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, body in BODIES.items():
        parts = _needed(body, [])
        prefix = ", ".join(f"{n} AS ({PARTS[n]})" for n in parts)
        out[key] = f"WITH {prefix} SELECT * FROM ({body})" if parts else body
    return out
