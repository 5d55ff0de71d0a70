"""Walk-forward choice of an indicator's parameter by its past rank correlation with money."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.windows import ew_zscore, ordered_scan, rolling_rank, with_ewma
from tempo.operators.features import RULES, rule_score
from tempo.operators.labels import build_labels

SPANS = (5, 10, 20, 40, 60, 120, 250)
WINDOWS = (20, 30, 60, 90, 180, 250)


@dataclass(frozen=True)
class TuningConfig:
    horizon: int = 10
    execution_offset: int = 1
    refit_every: int = 21
    min_train: int = 500
    lookback: int = 750
    min_pairs: int = 30


def zscore_candidates(panel: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Adds ``span=<k>`` scores and dev_<k>, the percentage above the exponential mean."""
    df = with_ewma(panel, "rub_per_unit", spans)
    found = {f"span={s}": -ew_zscore("rub_per_unit", s) for s in spans} | {f"dev_{s}": (F.col("rub_per_unit") / F.col(f"mean_{s}") - 1) * 100 for s in spans}
    return df.withColumns(found).drop(*[f"{n}_{s}" for s in spans for n in ("mean", "var")])


def percentile_candidates(panel: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Adds ``window=<n>`` scores."""
    return panel.withColumns({f"window={n}": 1 - rolling_rank("rub_per_unit", n, max(20, n // 4)) for n in windows})


def rule_candidates(features: DataFrame) -> DataFrame:
    return features.select("quote_date", "available_on", "iso", "rub_per_unit", *[rule_score(r).alias(f"rule={r}") for r in RULES])


def with_spearman(pairs: DataFrame, keys: list[str], min_pairs: int = 30) -> DataFrame:
    """Rank correlation of x and y per group of ``keys``; null under ``min_pairs`` pairs or where one is constant."""
    pairs = pairs.filter("x is not null and y is not null")

    def average_rank(c: str):
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (ties - 1) / 2

    ranked = pairs.withColumns({"rx": average_rank("x"), "ry": average_rank("y")})
    varied = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")) & (F.count(F.lit(1)) >= min_pairs)
    return ranked.groupBy(*keys).agg(F.when(varied, F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("rho"))


def _rank_correlations(x: np.ndarray, y: np.ndarray, min_pairs: int) -> np.ndarray:
    """Rank correlation of each column of ``x`` with ``y`` over the pairs both have; nan where ``with_spearman`` is null."""

    def ranks(v: np.ndarray) -> np.ndarray:
        _, place, many = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(many) - (many - 1) / 2)[place]

    out = np.full(x.shape[1], np.nan)
    for i in range(x.shape[1]):
        both = ~(np.isnan(x[:, i]) | np.isnan(y))
        if both.sum() >= min_pairs:
            a, b = ranks(x[both, i]), ranks(y[both])
            a, b = a - a.mean(), b - b.mean()
            if (scale := a @ a * (b @ b)) > 0:
                out[i] = round(a @ b / np.sqrt(scale), 12)
    return out


def calibrated(scored: DataFrame, names: list[str], config: TuningConfig = TuningConfig()) -> DataFrame:
    """The rows with ``score`` and ``chosen`` from the candidate columns ``names``; rows without a score are left out.

    A candidate is judged on the last ``lookback`` labels known when it is chosen, every ``refit_every`` rows from
    the first with ``min_train`` of them; the best (the first on ties) holds until the next choice. A choice that
    finds no correlation is tried again on the next row. Rows are streamed along each series: the state is the
    labels of the lookback and those not known yet, so nothing is joined or repeated per choice.
    """
    labels = build_labels(scored.select("iso", "quote_date", "available_on", "rub_per_unit"), config.horizon, config.execution_offset)
    rows = scored.join(labels.select("iso", "quote_date", F.col("currency_gain_bps").alias("_gain"), "label_available_on"), ["iso", "quote_date"])

    def start() -> dict:
        return {"open": deque(), "latest": None, "train": deque(maxlen=config.lookback), "k": 0, "best": None, "since": 0}

    def step(state: dict, part: pd.DataFrame) -> dict:
        score, chosen = np.full(len(part), np.nan), np.full(len(part), None, dtype=object)
        for i, (x, y, known, now) in enumerate(zip(part[names].to_numpy(float), part["_gain"].to_numpy(float), part["label_available_on"], part["available_on"], strict=True)):
            # a label counts once it and all before it are known; one that never is holds up those after it
            never = pd.isna(known) or state["latest"] == "never"
            state["latest"] = "never" if never else max(known, state["latest"] or known)
            state["open"].append((state["latest"], x, y))
            while state["open"] and state["open"][0][0] != "never" and state["open"][0][0] <= now:
                _, a, b = state["open"].popleft()
                state["train"].append((a, b))
                state["k"] += 1
            if state["k"] < config.min_train:
                continue
            if state["best"] is None or state["since"] >= config.refit_every:
                rho = _rank_correlations(np.array([a for a, _ in state["train"]]), np.array([b for _, b in state["train"]]), config.min_pairs)
                if not np.isnan(rho).all():
                    state["best"], state["since"] = int(np.nanargmax(rho)), 0
            state["since"] += 1
            if state["best"] is not None and not np.isnan(x[state["best"]]):
                score[i], chosen[i] = x[state["best"]], names[state["best"]]
        return {"score": score, "chosen": chosen}

    kept = [c for c in scored.columns if c not in names]
    done = ordered_scan(rows, [("score", "double"), ("chosen", "string")], start, step)
    return done.filter("chosen is not null").select(*kept, "score", "chosen")
