"""The batch pricing job: choose prices by mode, stamp, write, compare."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators.elasticity import with_own_fit
from tagsmith.operators.hybrid import choose_price
from tagsmith.operators.quality import require_columns
from tagsmith.operators.revenue import (
    champion_challenger_summary, score_champion_challenger, strategy_dashboard,
)
from tagsmith.operators.rules import batch_rules
from tagsmith.operators.sweep import ai_output
from tagsmith.sources.tables import read_priced, write_priced

MODES = ("rule", "ai", "hybrid")


@dataclass(frozen=True)
class Run:
    """Identity of one run; the same literals go on every row."""

    run_date: str
    model_version: str
    run_id: str


def new_run(model_version: str, now: datetime | None = None) -> Run:
    """A batch run: local time, six upper-case hex digits."""
    stamp = (now or datetime.now()).strftime(fv.RUN_DATE_FORMAT)
    return Run(stamp, model_version, uuid.uuid4().hex[:6].upper())


def new_request_run(model_version: str, now: datetime | None = None) -> Run:
    """A request run: UTC time, eight hex digits."""
    stamp = (now or datetime.now(timezone.utc)).strftime(fv.RUN_DATE_FORMAT)
    return Run(stamp, model_version, uuid.uuid4().hex[:8])


@dataclass(frozen=True)
class PricingSettings:
    """`fit_elasticity` gives hybrid pricing the fit quality of each SKU's own price line, in the row;
    without it the frame must carry elasticity_r2 and elasticity_mape, or rules decide."""

    tolerance: float = fv.TOLERANCE
    min_r2: float = fv.HYBRID_MIN_R2
    max_mape: float = fv.HYBRID_MAX_MAPE
    fit_elasticity: bool = True
    enabled: tuple[str, ...] = field(default=MODES)


def price(master: DataFrame, mode: str, model=None,
          settings: PricingSettings = PricingSettings()) -> DataFrame:
    """Rule, model-driven or hybrid prices. All three run in one lazy plan."""
    require_columns(master, ["demand_qty"])
    if mode not in MODES:
        raise ValueError(f"invalid mode {mode!r}: choose one of {', '.join(MODES)}")
    if mode not in settings.enabled:
        raise ValueError(f"mode {mode!r} is disabled")
    ruled = batch_rules(master)
    if mode == "rule":
        return ruled
    if model is None:
        raise ValueError(f"mode {mode!r} needs a demand model")
    swept = ai_output(ruled, model, "batch", settings.tolerance)
    if mode == "ai":
        return swept
    if settings.fit_elasticity and "elasticity_r2" not in swept.columns:
        swept = with_own_fit(swept)
    return choose_price(swept, settings.min_r2, settings.max_mape)


def stamp(priced: DataFrame, run: Run) -> DataFrame:
    return priced.withColumns({
        "run_date": F.lit(run.run_date), "model_version": F.lit(run.model_version),
        "run_id": F.lit(run.run_id),
    })


def run_pricing(master: DataFrame, mode: str, folder: str, model=None, champion=None,
                challenger=None, model_version: str = "v1.0",
                settings: PricingSettings = PricingSettings(), run: Run | None = None):
    """Write one priced run and return its comparison tables.

    The priced rows are written once; the dashboard reads the written partition back, so prices
    are not computed a second time and a lost executor costs a re-read, not a re-run.
    """
    this = run or new_run(model_version)
    priced = stamp(price(master, mode, model, settings), this)
    scored = score_champion_challenger(priced, champion, challenger)
    write_priced(scored, folder, mode)
    kept = read_priced(master.sparkSession, folder, scored.schema, mode, this.run_id)
    return {"run": this, "priced": kept, "dashboard": strategy_dashboard(kept),
            "champion_challenger": champion_challenger_summary(kept)}
