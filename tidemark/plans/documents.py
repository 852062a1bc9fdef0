"""Result documents: several small queries put together as one JSON text, computed at once or kept block by block."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import caches, floors, gaps, levels, models, panels, reports, runs, scans, selections
from tidemark.sources.artifacts import payload
from tidemark.sources.store import Store

LEVEL = ["venue", "level", "period"]
#: Document -> block -> (query, keys of its tree).
DOCUMENTS: dict[str, dict[str, tuple[Callable[[SparkSession, str], DataFrame], Sequence[str]]]] = {
    # floor shares by venue, window, phase and period, with the hidden-premium quantiles
    "floors": {
        "venues": (floors.floor_counts, ["venue"]),
        "spans": (floors.span_floor_counts, ["span", "venue"]),
        "phases": (floors.floor_share_by_phase, ["venue", "phase"]),
        "periods": (floors.floor_by_period, ["level", "period", "venue"]),
        "quantiles": (floors.censored_quantiles, ["venue", "p"]),
    },
    # the rule's eras and switch, the venues' shares in every window and period, and their order block by block
    "history": {
        "eras": (floors.rule_eras, ["venue", "era"]),
        "switch": (floors.rule_switch, ["venue"]),
        "levels": (levels.floor_levels, LEVEL),
        "partial_periods": (levels.partial_periods, ["level", "side"]),
        "ranks": (floors.rank_of_venues, ["period"]),
        "ranking": (levels.ranking, ["venue"]),
        "majority": (gaps.month_majority, ["venue"]),
        "order": (levels.order_levels, LEVEL),
        "quantile_gaps": (levels.quantile_gap_levels, [*LEVEL, "p"]),
        "shift": (levels.shift_levels, LEVEL),
        "data": (caches.series_fingerprints, ["venue"]),
    },
    # the gap between venues: statistics, bins, persistence, intervals, checks and the split of the difference
    "gap": {
        "gap": (gaps.gap_stats, ["venue"]),
        "levels": (levels.gap_levels, LEVEL),
        "bins": (gaps.binned, ["venue", "bin"]),
        "missing_hours": (panels.hour_gaps, ["venue"]),
        "persistence": (runs.acf, ["k", "lag"]),
        "half_life": (runs.ar1, ["k"]),
        "rolling": (runs.rolling_stats, ["k"]),
        "spells": (runs.spells, ["k", "first_day"]),
        "phases": (gaps.quarter_phases, ["venue", "period"]),
        "intervals": (selections.bootstrap_counts, ["venue"]),
        "split": (gaps.shapley, ["k", "factor"]),
        "settlements": (gaps.fit_errors, ["venue"]),
        "pricing": (reports.pricing_check, ["venue"]),
        "level_shift": (runs.level_shift, ["k"]),
    },
    # every venue's premiums: moments, band, quantiles, and what the scans over whole series find
    "series": {
        "location": (floors.premium_location, ["venue"]),
        "describe": (floors.describe, ["venue"]),
        "quantiles": (selections.record_quantiles, ["venue", "i"]),
        "chain": (scans.chain_em_step, ["venue"]),
        "residuals": (scans.chain_residuals, ["venue"]),
        "variance": (scans.variance_loglik, ["venue"]),
        "segments": (scans.sign_segments, ["venue"]),
    },
    # model selection, the switching fit and GARCH, with residual tests
    "models": {
        "selection": (models.hmm_selection, ["venue", "k"]),
        "switching": (models.switching_best, ["venue"]),
        "ratio": (models.switching_ratio, ["venue", "covariance"]),
        "garch": (models.garch, ["venue", "dist"]),
        "ljung_box": (runs.ljung_box, ["venue", "lag"]),
    },
    # the switching fit on rolling windows, on variants of the series and of its upper tail, and where values are injected
    "windows": {
        "rolling": (models.switching_rolling, ["venue", "window"]),
        "sensitivity": (models.switching_sensitivity, ["venue", "variant"]),
        "upper_tail": (models.switching_upper_tail, ["venue", "variant"]),
        "injections": (reports.injection_times, ["venue", "position"]),
    },
    # residual tests, the ranking of models, and what the bootstrap says of the chain
    "diagnostics": {
        "residuals": (models.residual_battery, ["venue", "model", "test", "lag"]),
        "ranking": (models.model_ranking, ["venue", "model"]),
        "bootstrap": (models.hmm_bootstrap, ["venue", "labels", "parameter"]),
        "power": (models.hmm_power, ["venue", "value"]),
    },
}


def document(spark: SparkSession, d: str, name: str) -> str:
    """A whole document as JSON, computed now."""
    return payload({block: (query(spark, d), keys) for block, (query, keys) in DOCUMENTS[name].items()})


def floor_document(spark: SparkSession, d: str) -> str:
    return document(spark, d, "floors")


def history_document(spark: SparkSession, d: str) -> str:
    return document(spark, d, "history")


def gap_document(spark: SparkSession, d: str) -> str:
    return document(spark, d, "gap")


def model_document(spark: SparkSession, d: str) -> str:
    return document(spark, d, "models")


def windows_document(spark: SparkSession, d: str) -> str:
    return document(spark, d, "windows")


def diagnostics_document(spark: SparkSession, d: str) -> str:
    return document(spark, d, "diagnostics")


def refresh(spark: SparkSession, d: str, folder: str, name: str, blocks: Sequence[str] | None = None) -> int:
    """Computes the named blocks of a document (all) and publishes them as the next version of its store; its other blocks stay as they were."""
    known = DOCUMENTS[name]
    lacking = [b for b in blocks or () if b not in known]
    if lacking:
        raise ValueError(f"{name} has no blocks {lacking}")
    return Store(spark, folder).publish({b: known[b][0](spark, d) for b in (known if blocks is None else blocks)})


def stored(spark: SparkSession, folder: str, name: str, version: int | None = None) -> str:
    """The document as JSON, of the blocks that its store's version (the last) holds."""
    store = Store(spark, folder)
    held = store.blocks(version)
    return payload({block: (store.read(block, version), keys) for block, (_, keys) in DOCUMENTS[name].items() if block in held})
