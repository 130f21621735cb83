"""Names, labels, messages and thresholds that outputs must agree on."""

# --- column aliases, in order of preference -------------------------------------------
SKU_ID_ALIASES = [
    "sku", "skuid", "sku_code", "product_id", "productid", "item_id", "itemid",
    "product_sku", "article_id", "style_id", "variant_id", "catalog_ref_id", "id",
]
DISPLAY_NAME_ALIASES = ["name", "product_name", "title"]
BATCH_PRICE_ALIASES = ["list_price", "price", "selling_price", "mrp"]
LIST_PRICE_ALIASES = ["price", "mrp"]
CURRENT_PRICE_ALIASES = ["selling_price", "sale_price"]
QUANTITY_ALIASES = [
    "quantity", "qty", "order_qty", "units_sold", "quantity_ordered", "demand_qty",
]
STOCK_ALIASES = [
    "stock_level", "stock", "stock_qty", "quantity_on_hand", "inventory", "qty",
    "total_inventory",
]

# --- table contracts -------------------------------------------------------------------
GOLDEN_COLUMNS = [
    "sku_id", "price", "competitor_price", "inventory_level", "price_diff_pct", "demand_qty",
]
MODEL_FEATURES = ["price", "competitor_price", "inventory_level", "price_diff_pct"]
RESULT_COLUMNS = [
    "sku_id", "display_name", "list_price", "current_price", "competitor_price",
    "competitor_name", "competitor_bucket", "price_diff_pct", "all_competitors_json",
    "total_inventory", "inventory_bucket", "demand_qty", "demand_bucket", "new_price",
    "ai_optimal_price", "price_change_pct", "confidence_score", "confidence_label",
    "pricing_reason", "ai_strategy", "decision_reason", "alert_flag", "run_date", "run_id",
    "model_version",
]
GAP_COLUMNS = [
    "user_pseudo_id", "search_query", "sku", "standard_attribute_key", "confidence_score",
    "model_version", "event_timestamp",
]

# --- patterns and formats --------------------------------------------------------------
UNSAFE_NAME_PATTERN = r"[ ,;{}()\n\t=?]"
RUN_DATE_FORMAT = "%Y-%m-%d_%H%M%S"
RUN_DATE_SPARK_FORMAT = "yyyy-MM-dd_HHmmss"
RESPONSE_TIME_SPARK_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FILLER_PHRASES = ["personally", "tbh", "in my opinion"]

# --- decision messages -----------------------------------------------------------------
REVIEW_GAP = "Manual review required (large price gap)"
AUTO_MATCH = "Auto match competitor (0.1% lower)"
CLEARANCE = "Stock clearance 30%"
MONOPOLY = "Monopoly premium 25%"
BIG_INCREASE = "Big increase"
INCREASE = "Increase"
MATCH_PREFIX = "Match "
NO_CHANGE = "No change"
NO_COMPETITOR_DATA = "No competitor data available"
REVIEW_ALERT = "Manual review (alert triggered)"
AI_PRICING = "AI optimized pricing"
RULE_PRICING = "Rule-based pricing"

# --- thresholds ------------------------------------------------------------------------
SWEEP_LOW, SWEEP_HIGH, SWEEP_STEPS = 0.7, 1.3, 15
ELASTICITY_FIT_STEPS, ELASTICITY_PRICE_STEPS = 12, 20
SERVICE_ALERT_GAP = 20.0
MAX_REQUESTED_IDS = 500
HYBRID_MIN_R2, HYBRID_MAX_MAPE = 0.75, 20.0
TOLERANCE = 0.05
GATE_MIN_R2, GATE_MAX_MAE = 0.70, 50.0
INTENT_MIN_CONFIDENCE = 0.70
