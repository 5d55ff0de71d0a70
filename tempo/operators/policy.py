"""Budgeted sequential send policy: which scored days become signals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.windows import o, ordered_scan, window_id


@dataclass(frozen=True)
class PolicyConfig:
    window: str = "week"
    max_signals_per_window: int = 2
    cooldown_observations: int = 3
    threshold_lookback: int = 250
    minimum_threshold_history: int = 20
    minimum_score: float | None = None
    expected_override: int | None = None

    def __post_init__(self):
        if self.window not in ("week", "month") or self.max_signals_per_window < 1 or self.cooldown_observations < 0 or self.threshold_lookback < 1 or self.minimum_threshold_history < 1:
            raise ValueError("not a policy")

    @property
    def expected(self) -> int:
        return self.expected_override or {"week": 5, "month": 21}[self.window]

    def levels(self) -> list[float]:
        """Quantile levels by (slots left, observations expected), in the order of ``level_index``."""
        return [min(1.0, max(0.0, 1 - s / r)) for s in range(self.max_signals_per_window + 1) for r in range(1, self.expected + 1)]


SCORES = ("quote_date", "available_on", "iso", "rub_per_unit", "score")


def check_scores(scores: DataFrame) -> None:
    """Raise ValueError if a column that a policy reads is missing or there are no rows."""
    if missing := [c for c in SCORES if c not in scores.columns]:
        raise ValueError(f"scores lack the columns {missing}")
    if scores.isEmpty():
        raise ValueError("there are no scores")


def with_thresholds(scores: DataFrame, config: PolicyConfig) -> DataFrame:
    """Adds decision_date, window_id, observation_position, seen, history count and a threshold per number of free slots.

    All of it is known without the decisions; today's score is not part of its own history. Null scores are left out.
    A column ``minimum_score`` takes the place of the policy's own.
    """
    df = scores.filter("score is not null and not isnan(score)").withColumn("decision_date", F.coalesce("available_on", "quote_date"))
    df = df.withColumn("window_id", window_id("decision_date", config.window)).withColumn("observation_position", F.row_number().over(o()) - 1)
    seen = F.row_number().over(Window.partitionBy("iso", "window_id").orderBy("quote_date"))
    history = o().rowsBetween(-config.threshold_lookback, -1)
    levels = ", ".join(f"{q!r}D" for q in config.levels())
    df = df.withColumns({"seen": seen, "score_history_count": F.count("score").over(history), "_q": F.expr(f"percentile(score, array({levels}))").over(history)})
    left = F.greatest(F.lit(1), config.expected - F.col("seen") + 1)
    own = "minimum_score" in scores.columns
    floor = config.minimum_score

    def threshold(slots: int):
        q = F.get(F.col("_q"), slots * config.expected + left - 1)
        q = F.when(F.col("score_history_count") >= config.minimum_threshold_history, q)
        if own:  # null where a row's strategy has no floor
            return F.greatest(q, F.when(q.isNotNull(), F.col("minimum_score")))
        return q if floor is None else F.greatest(q, F.when(q.isNotNull(), F.lit(float(floor))))

    return df.withColumn("thresholds", F.array(*[threshold(s) for s in range(config.max_signals_per_window + 1)])).drop("_q")


def decide(state: dict, config: PolicyConfig, window: str, at: int, score: float, limits: list, history: int) -> tuple[str, int, int]:
    """(reason, slots before, cooldown remaining) of one day; ``state`` keeps the window, what it has used and the last day sent."""
    if window != state.get("window"):
        state |= {"window": window, "used": 0}
    slots = config.max_signals_per_window - state["used"]
    rest = max(0, config.cooldown_observations - (at - state["last"]) + 1) if "last" in state else 0
    if history < config.minimum_threshold_history:
        return "threshold_warmup", slots, rest
    if slots <= 0:
        return "window_budget_exhausted", slots, rest
    if rest > 0:
        return "cooldown", slots, rest
    if score < limits[slots]:
        return "below_threshold", slots, rest
    state["used"] += 1
    state["last"] = at
    return "selected", slots, rest


def apply_policy(scores: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Every scored day with slots, threshold, decision and its reason.

    Reasons in order of precedence: threshold_warmup, window_budget_exhausted, cooldown, below_threshold, selected.
    """
    most = config.max_signals_per_window

    def step(state: dict, part: pd.DataFrame) -> dict:
        out = {k: [] for k in ("slots_before", "slots_after", "cooldown_remaining", "threshold", "pacing_quantile", "decision", "decision_reason")}
        for window, at, seen, score, limits, history in zip(part["window_id"], part["observation_position"], part["seen"], part["score"], part["thresholds"], part["score_history_count"], strict=True):
            reason, slots, rest = decide(state, config, window, at, score, limits, history)
            limit = limits[slots]
            out["slots_before"].append(slots)
            out["slots_after"].append(most - state["used"])
            out["cooldown_remaining"].append(rest)
            out["threshold"].append(np.nan if limit is None else limit)
            out["pacing_quantile"].append(min(1.0, max(0.0, 1 - slots / max(1, config.expected - seen + 1))))
            out["decision"].append(reason == "selected")
            out["decision_reason"].append(reason)
        return out

    fields = [("slots_before", "integer"), ("slots_after", "integer"), ("cooldown_remaining", "integer"), ("threshold", "double"), ("pacing_quantile", "double"), ("decision", "boolean"), ("decision_reason", "string")]
    done = ordered_scan(with_thresholds(scores, config), fields, dict, step)
    return done.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold"))).drop("thresholds")


def selected_by(scores: DataFrame, policies: dict[str, PolicyConfig]) -> DataFrame:
    """policy, iso, quote_date of the days that each of a few policies selects, in one pass over the sorted rows.

    The state of a series is one budget per policy. Policies of one lookback share the window that gives their quantiles,
    those of one calendar window share its count. A column ``minimum_score`` takes the place of the policies' own.
    """
    configs = list(policies.values())
    own = "minimum_score" in scores.columns
    df = scores.filter("score is not null and not isnan(score)").withColumn("decision_date", F.coalesce("available_on", "quote_date"))
    kinds, lookbacks = sorted({c.window for c in configs}), sorted({c.threshold_lookback for c in configs})
    levels = {n: sorted({q for c in configs if c.threshold_lookback == n for q in c.levels()}) for n in lookbacks}
    df = df.withColumns({f"window_{k}": window_id("decision_date", k) for k in kinds}).withColumn("at", F.row_number().over(o()) - 1)
    df = df.withColumns({f"seen_{k}": F.row_number().over(Window.partitionBy("iso", f"window_{k}").orderBy("quote_date")) for k in kinds})
    for n in lookbacks:
        past = o().rowsBetween(-n, -1)
        asked = ", ".join(f"{q!r}D" for q in levels[n])
        df = df.withColumns({f"held_{n}": F.count("score").over(past), f"q_{n}": F.expr(f"percentile(score, array({asked}))").over(past)})

    def limits(c: PolicyConfig) -> Column:
        place = {q: i for i, q in enumerate(levels[c.threshold_lookback])}
        places = F.array(*[F.lit(place[q]) for q in c.levels()])
        left = F.greatest(F.lit(1), c.expected - F.col(f"seen_{c.window}") + 1)
        floor = F.col("minimum_score") if own else F.lit(c.minimum_score).cast("double")
        each = [F.get(f"q_{c.threshold_lookback}", F.get(places, s * c.expected + left - 1)) for s in range(c.max_signals_per_window + 1)]
        return F.array(*[F.greatest(q, F.when(q.isNotNull(), floor)) for q in each])

    df = df.select("iso", "quote_date", "at", "score", *[f"window_{k}" for k in kinds], *[f"held_{n}" for n in lookbacks], F.array(*[limits(c) for c in configs]).alias("limits"))

    def step(states: list[dict], part: pd.DataFrame) -> dict:
        sent = []
        columns = [part[c] for c in ("at", "score", "limits")]
        days = zip(*columns, *[part[f"window_{c.window}"] for c in configs], *[part[f"held_{c.threshold_lookback}"] for c in configs], strict=True)
        for at, score, bounds, *rest in days:
            sent.append([i for i, c in enumerate(configs) if decide(states[i], c, rest[i], at, score, bounds[i], rest[len(configs) + i])[0] == "selected"])
        return {"sent": sent}

    done = ordered_scan(df, [("sent", "array<int>")], lambda: [{} for _ in configs], step)
    name = F.get(F.array(*[F.lit(p) for p in policies]), F.col("i"))
    return done.select("iso", "quote_date", F.explode("sent").alias("i")).select(name.alias("policy"), "iso", "quote_date")


def cooldown_emission(predictions: DataFrame, slots_per_week: float = 2, lookback: int = 250) -> DataFrame:
    """Days whose prediction exceeds the trailing (1 - slots / 5) quantile, ``round(5 / slots)`` observations apart."""
    q, wait = 1 - slots_per_week / 5, round(5 / slots_per_week)
    history = o().rowsBetween(-lookback, -1)
    df = predictions.filter("prediction is not null").withColumn("_at", F.row_number().over(o()))
    df = df.withColumn("_high", (F.count("prediction").over(history) >= 20) & (F.col("prediction") > F.expr(f"percentile(prediction, {q!r}D)").over(history)))

    def step(state: dict, part: pd.DataFrame) -> dict:
        sent = []
        for at, high in zip(part["_at"], part["_high"], strict=True):
            ok = bool(high) and at - state.get("last", -(10**9)) >= wait
            if ok:
                state["last"] = at
            sent.append(ok)
        return {"sent": sent}

    return ordered_scan(df, [("sent", "boolean")], dict, step).filter("sent").drop("sent", "_at", "_high")


def best_per_window(scores: DataFrame, window: str = "week", k: int = 2) -> DataFrame:
    """With hindsight: the ``k`` best days of each calendar window by quote date, earlier days first on ties."""
    place = F.row_number().over(Window.partitionBy("iso", "window_id").orderBy(F.desc("score"), "quote_date"))
    return scores.filter("score is not null").withColumn("window_id", window_id("quote_date", window)).withColumn("place", place).filter(F.col("place") <= k)
