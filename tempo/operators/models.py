"""Fitted scores: ridge refitted at every row, and utility and risk heads refitted walk-forward."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage
from tempo.functions.windows import o, one_row_each, ordered_scan
from tempo.operators.features import FEATURES, rule_matrix
from tempo.operators.labels import build_labels, make_target, matured_before

RAW = FEATURES
RULE_COLUMNS = ("percentile", "zscore", "momentum", "drawdown", "seasonal", "near_min", "turned_up")


def ridge_from_sums(n: float, sx: np.ndarray, sxx: np.ndarray, sy: float, sxy: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the plain columns of a ridge over standardised ones, from moment sums."""
    mean = sx / n
    cov = sxx - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
    scale[scale < 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    z = cov / np.outer(scale, scale)
    w = np.linalg.solve(z + alpha * np.eye(len(mean)), (sxy - mean * sy) / scale) / scale
    return w, float(sy / n - w @ mean)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Newton steps on standardised columns; coefficients on the plain ones.

    With one class only the coefficients are zero and the intercept gives the base rate, kept off 0 and 1.
    """
    rate = float(y.mean()) if len(y) else 0.0
    if not 0.0 < rate < 1.0:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([l2] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        v = np.maximum(p * (1 - p), 1e-8)
        move = np.linalg.solve(z.T @ (v[:, None] * z) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + move
        if np.abs(move).max() < tolerance:
            break
    coef = w[:-1] / scale
    return coef, float(w[-1] - coef @ mean)


_SUMS = "n: long, sx: array<double>, sxx: array<double>, sy: double, sxy: array<double>"


def ridge_rows(features: DataFrame, panel: DataFrame, horizon: int, columns: tuple[str, ...]) -> DataFrame:
    """Features without a gap, with the target and the day it is known; null where that is not yet so."""
    rows = one_row_each(features, ["iso", "quote_date"], "features")
    return rows.join(make_target(panel, horizon), ["iso", "quote_date"], "left").dropna(subset=list(columns))


def _ridge_scan(data: DataFrame, alpha: float, min_train: int, columns: tuple[str, ...], every: int = 0) -> DataFrame:
    """Adds ``prediction`` and, every ``every`` rows, ``sums``: the moment sums as they stood after the row was seen.

    The state of a series is moment sums and the rows that are not known yet, so memory does not grow with it. A column
    ``resumed`` (sums, on the first row of a series) starts it from there; rows marked ``seen`` are not predicted.
    """
    k, resumes = len(columns), "resumed" in data.columns

    def start() -> dict:
        return {"n": 0, "sx": np.zeros(k), "sxx": np.zeros((k, k)), "sy": 0.0, "sxy": np.zeros(k), "open": deque(), "rows": 0}

    def step(state: dict, part: pd.DataFrame) -> dict:
        if resumes and not state["rows"] and part["resumed"].iloc[0] is not None:
            held = part["resumed"].iloc[0]
            state |= {"n": held["n"], "sx": np.array(held["sx"], dtype=float), "sxx": np.array(held["sxx"], dtype=float).reshape(k, k), "sy": held["sy"], "sxy": np.array(held["sxy"], dtype=float)}
        out, sums = [], []
        seen = part["seen"] if resumes else [False] * len(part)
        for x, y, known, now, old in zip(part[list(columns)].to_numpy(float), part["target"].to_numpy(float), part["target_available_on"], part["available_on"], seen, strict=True):
            while not old and state["open"] and state["open"][0][0] <= now:
                _, a, b = state["open"].popleft()
                state["n"] += 1
                state["sx"] += a
                state["sxx"] += np.outer(a, a)
                state["sy"] += b
                state["sxy"] += a * b
            if not old and state["n"] >= min_train:
                w, c = ridge_from_sums(state["n"], state["sx"], state["sxx"], state["sy"], state["sxy"], alpha)
                out.append(float(x @ w + c))
            else:
                out.append(np.nan)
            if not pd.isna(known) and np.isfinite(y):
                state["open"].append((known, x, y))
            state["rows"] += 1
            keep = every and state["rows"] % every == 0
            sums.append({"n": state["n"], "sx": state["sx"].tolist(), "sxx": state["sxx"].ravel().tolist(), "sy": state["sy"], "sxy": state["sxy"].tolist()} if keep else None)
        return {"prediction": out} | ({"sums": sums} if every else {})

    fields = [("prediction", "double")] + ([("sums", f"struct<{_SUMS}>")] if every else [])
    done = ordered_scan(data, fields, start, step)
    return done.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def walk_forward_ridge(features: DataFrame, panel: DataFrame, horizon: int = 20, alpha: float = 1.0, min_train: int = 500, columns: tuple[str, ...] = RAW) -> DataFrame:
    """Adds ``prediction``: a ridge on all rows whose target was known, refitted at every row."""
    done = _ridge_scan(ridge_rows(features, panel, horizon, columns), alpha, min_train, columns)
    return done.filter("prediction is not null").select("quote_date", "available_on", "iso", "rub_per_unit", "prediction")


def ridge_snapshots(features: DataFrame, panel: DataFrame, horizon: int = 20, every: int = 63, columns: tuple[str, ...] = RAW) -> DataFrame:
    """iso, quote_date, available_on, sums: the ridge's moment sums after every ``every``-th row, to be stored as a table."""
    done = _ridge_scan(ridge_rows(features, panel, horizon, columns), 1.0, 10**18, columns, every)
    return done.filter("sums is not null").select("iso", "quote_date", "available_on", "sums")


def ridge_asof(snapshots: DataFrame, features: DataFrame, panel: DataFrame, date: str, horizon: int = 20, alpha: float = 1.0, min_train: int = 500, columns: tuple[str, ...] = RAW) -> DataFrame:
    """Each series' last prediction that could be made on a date, as in the full run, from the last snapshot before it.

    Only rows since that snapshot are fed to the sums, and those before it whose target was not known then: the targets
    that a snapshot lacks are those that became known after its own row.
    """
    day = F.lit(date).cast("date")
    rows = ridge_rows(features, panel, horizon, columns).filter(F.col("available_on") <= day)
    ends = rows.groupBy("iso").agg(F.max("quote_date").alias("end"))
    before = snapshots.join(ends, "iso").filter("quote_date < end")
    last = before.groupBy("iso").agg(F.max_by(F.struct(F.col("quote_date").alias("at"), F.col("available_on").alias("then"), "sums"), "quote_date").alias("s"))
    rows = rows.join(last, "iso", "left")
    seen = F.coalesce(F.col("quote_date") <= F.col("s.at"), F.lit(False))
    # a target that is known after the date would be unknown there, and is not needed: none of its row's followers is predicted
    rows = rows.withColumn("seen", seen).filter(~F.col("seen") | (F.col("target_available_on") > F.col("s.then")))
    rows = rows.withColumn("resumed", F.when(F.row_number().over(o()) == 1, F.col("s.sums"))).drop("s")
    done = _ridge_scan(rows, alpha, min_train, columns).filter("prediction is not null and not seen")
    row = F.max_by(F.struct("quote_date", "available_on", "rub_per_unit", "prediction"), "quote_date")
    return done.groupBy("iso").agg(row.alias("r")).select("iso", "r.*", (F.col("r.prediction") * 10_000).alias("predicted_advantage_bps"))


@dataclass(frozen=True)
class UtilityRiskConfig:
    horizon: int = 10
    execution_offset: int = 1
    min_train: int = 750
    refit_every: int = 21
    ridge_alpha: float = 1.0
    logit_l2: float = 1.0
    lam: float = 2.0
    feature_set: str = "raw"

    def __post_init__(self):
        if self.feature_set not in ("raw", "rules", "both") or min(self.horizon, self.min_train, self.refit_every) < 1 or self.lam < 0:
            raise ValueError("not a configuration of the heads")

    @property
    def columns(self) -> tuple[str, ...]:
        return {"raw": RAW, "rules": RULE_COLUMNS, "both": RAW + RULE_COLUMNS}[self.feature_set]


def heads_data(panel: DataFrame, features: DataFrame, config: UtilityRiskConfig) -> DataFrame:
    """Features, outcomes, position and number of known labels of all rows without a gap in the columns."""
    rules = rule_matrix(features).drop("available_on", "rub_per_unit")
    wide = one_row_each(features, ["iso", "quote_date"], "features").join(rules, ["iso", "quote_date"]).dropna(subset=list(config.columns))
    outcomes = build_labels(one_row_each(panel, ["iso", "quote_date"], "panel"), config.horizon, config.execution_offset).select("iso", "quote_date", "fwd_advantage_bps", "bad_push", "is_local_min", "adverse_bps", "label_available_on")
    known = matured_before(cut_lineage(wide.join(outcomes, ["iso", "quote_date"])))
    return known.withColumn("pos", F.row_number().over(o()) - 1)


_FIT = "training_observations: long, mean_bad_move_bps: double, base_utility_bps: double, base_risk_bps: double, base_rate_local_min: double, base_rate_bad_push: double, u: array<double>, m: array<double>, b: array<double>"


def with_refits(data: DataFrame, config: UtilityRiskConfig) -> DataFrame:
    """``data`` from the first refit on, with ``turn`` and, on the rows that refit the heads, ``fit``; null on others.

    Rows are streamed along each series once. The state is the series' own past, a few hundred bytes a day, which the
    heads need whole; no refit reads it anew.
    """
    columns = list(config.columns)

    def start() -> dict:
        return {"x": [], "y": [], "n": 0, "first": None}

    def step(state: dict, part: pd.DataFrame) -> dict:
        outcome = part[["fwd_advantage_bps", "adverse_bps", "bad_push", "is_local_min"]].astype(float).to_numpy()
        state["x"].append(part[columns].to_numpy(float))
        state["y"].append(outcome)
        turns, fits = [], []
        for i, k in enumerate(part["k"]):
            at = state["n"] + i
            if state["first"] is None and k >= config.min_train:
                state["first"] = at
            turn, late = divmod(at - state["first"], config.refit_every) if state["first"] is not None else (-1, -1)
            turns.append(turn)
            fits.append(None if late else fitted(state, int(k)))
        state["n"] += len(part)
        return {"turn": turns, "fit": fits}

    def fitted(state: dict, k: int) -> dict:
        if len(state["x"]) > 1:
            state["x"], state["y"] = [np.concatenate(state["x"])], [np.concatenate(state["y"])]
        x, (u, adverse, bad, low) = state["x"][0][:k], state["y"][0][:k].T
        wu, bu = ridge_from_sums(len(x), x.sum(0), x.T @ x, u.sum(), x.T @ u, config.ridge_alpha)
        wm, bm = logistic(x, low, config.logit_l2)
        wb, bb = logistic(x, bad, config.logit_l2)
        return {
            "training_observations": len(x), "mean_bad_move_bps": float(adverse[bad > 0.5].mean()) if (bad > 0.5).any() else 0.0,
            "base_utility_bps": float(u.mean()), "base_risk_bps": float((adverse * (bad > 0.5)).mean()), "base_rate_local_min": float(low.mean()),
            "base_rate_bad_push": float(bad.mean()), "u": [*wu, bu], "m": [*wm, bm], "b": [*wb, bb],
        }

    return ordered_scan(data, [("turn", "int"), ("fit", f"struct<{_FIT}>")], start, step).filter("turn >= 0")


def walk_forward_coefficients(data: DataFrame, config: UtilityRiskConfig) -> DataFrame:
    """One row per series and refit: coefficients of the three heads and baselines."""
    return with_refits(data, config).filter("fit is not null").select("iso", "turn", F.col("quote_date").alias("fitted_on"), "fit.*")


def walk_forward_heads(panel: DataFrame, features: DataFrame, config: UtilityRiskConfig = UtilityRiskConfig()) -> DataFrame:
    """p_min, p_bad, u_bps, risk_bps, baselines and the net score of every row from the first refit on."""
    scored = with_refits(heads_data(panel, features, config), config).withColumn("fit", F.last("fit", ignorenulls=True).over(o()))
    x = F.array(*[F.col(c).cast("double") for c in config.columns], F.lit(1.0))

    def linear(w: str):
        return F.aggregate(F.zip_with(x, F.col(f"fit.{w}"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def chance(w: str):
        return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), linear(w)))))

    scored = scored.select(
        "quote_date", "available_on", "iso", "rub_per_unit", chance("m").alias("p_min"), chance("b").alias("p_bad"), linear("u").alias("u_bps"), "fit.mean_bad_move_bps",
        F.col("fit.base_utility_bps").alias("base_u_bps"), "fit.base_risk_bps", "fit.training_observations",
    )
    return rescore(scored.withColumn("risk_bps", F.col("p_bad") * F.col("mean_bad_move_bps")).drop("mean_bad_move_bps"), config.lam)


def net_score(lam: float) -> Column:
    return (F.col("u_bps") - lam * F.col("risk_bps")) - (F.col("base_u_bps") - lam * F.col("base_risk_bps"))


def rescore(scores: DataFrame, lam: float) -> DataFrame:
    """The net score for another price of risk; no head is fitted again."""
    return scores.withColumn("score", net_score(lam))


def scores_asof(panel: DataFrame, asof: str, build, config: UtilityRiskConfig = UtilityRiskConfig()) -> DataFrame:
    """Scores from the quotes usable on a date; ``build(panel)`` gives the features."""
    known = panel.filter(F.col("available_on") <= F.lit(asof).cast("date"))
    return walk_forward_heads(known, build(known), config)
