"""The send policy over a stream of scored days, and a watermarked rate panel from a stream of trades.

The state of a series is what the batch policy carries along: its window, slots used, last signal, position and the
trailing scores. Days of one series have to arrive in date order; late ones are refused, as they would change the past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.functions.windows import window_id
from tempo.operators.policy import PolicyConfig

DECISIONS = "iso string, quote_date date, window_id string, observation_position long, score double, slots_before int, decision boolean, decision_reason string"
STATE = "last_date date, window_id string, used int, seen int, position long, last_sent long, scores array<double>"


def stream_decisions(scores: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Decisions for a stream with iso, quote_date, available_on, score; append mode."""
    dated = scores.filter("score is not null").select("iso", "quote_date", window_id(F.coalesce("available_on", "quote_date"), config.window).alias("window_id"), "score")

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_date, window, used, seen, position, last_sent, history = state.get if state.exists else (None, "", 0, 0, 0, -1, [])
        history, rows = list(history), []
        for r in pd.concat(list(batches)).sort_values("quote_date").itertuples(index=False):
            if last_date is not None and r.quote_date <= last_date:
                continue
            if r.window_id != window:
                window, used, seen = r.window_id, 0, 0
            seen += 1
            slots = config.max_signals_per_window - used
            rest = max(0, config.cooldown_observations - (position - last_sent) + 1) if last_sent >= 0 else 0
            if len(history) < config.minimum_threshold_history:
                reason = "threshold_warmup"
            elif slots <= 0:
                reason = "window_budget_exhausted"
            elif rest:
                reason = "cooldown"
            else:
                limit = float(np.quantile(history, min(1.0, max(0.0, 1 - slots / max(1, config.expected - seen + 1)))))
                limit = limit if config.minimum_score is None else max(limit, config.minimum_score)
                reason = "below_threshold" if r.score < limit else "selected"
            if reason == "selected":
                used, last_sent = used + 1, position
            rows.append((key[0], r.quote_date, window, position, r.score, slots, reason == "selected", reason))
            history = [*history, float(r.score)][-config.threshold_lookback :]
            last_date, position = r.quote_date, position + 1
        state.update((last_date, window, used, seen, position, last_sent, history))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    return dated.groupBy("iso").applyInPandasWithState(decide, DECISIONS, STATE, "append", "NoTimeout")


def hourly_panel(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Mean value per event type and hour from a stream of events (ts, event_type, value); later rows than ``delay`` are dropped."""
    hours = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return hours.agg(F.avg("value").alias("rub_per_unit"), F.count(F.lit(1)).alias("nominal")).select(F.col("event_type").alias("iso"), F.col("w.start").alias("quote_hour"), "nominal", "rub_per_unit")
