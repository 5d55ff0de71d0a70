"""Hand-computed cases, invariants and truncation tests of the panel engine."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempo.functions import windows as W
from tempo.operators import backtest, benchmark, evaluation, features, indicators, labels, models, policy, signals, stats, tuning
from tempo.plans import service
from tempo.sources import panel as N
from tempo.sources import sinks

V = "rub_per_unit"


def quotes(spark, rates, iso="USD", start="2026-01-01", lag=1):
    days = pd.bdate_range(start, periods=len(rates))
    rows = [(d.date(), (d + pd.Timedelta(days=lag)).date(), iso, 1, float(r), float(r)) for d, r in zip(days, rates, strict=True)]
    return spark.createDataFrame(rows, "quote_date date, available_on date, iso string, nominal long, rate double, rub_per_unit double")


def walk(n, seed, scale=10.0, phi=0.97, sigma=0.01):
    rng, level, out = np.random.default_rng(seed), 0.0, []
    for _ in range(n):
        level = phi * level + rng.normal(0, sigma)
        out.append(scale * np.exp(level))
    return out


@pytest.fixture(scope="module")
def two_series(spark):
    return quotes(spark, walk(1400, 1), "TJS", "2015-01-01").unionByName(quotes(spark, walk(1400, 2, 85.0), "USD", "2015-01-01")).cache()


def test_normalise(spark):
    raw = spark.createDataFrame([("2026-09-02", " amd ", "100", "23.8162")], "date string, iso string, nominal string, rate string")
    row = N.normalize(raw).first()
    assert (row.iso, row.nominal, row.available_on) == ("AMD", 100, dt.date(2026, 9, 3)) and row[V] == pytest.approx(0.238162)


@pytest.mark.parametrize(("row", "said"), [(("x", "AMD", 1.0, 1.0, None), "bad_date"), (("2026-01-01", "AM", 1.0, 1.0, None), "bad_iso"), (("2026-01-01", "AMD", 0.0, 1.0, None), "bad_nominal"), (("2026-01-01", "AMD", 1.5, 1.0, None), "whole"), (("2026-01-01", "AMD", 1.0, -1.0, None), "bad_rate"), (("2026-01-01", "AMD", 1.0, 0.187651, 1.0), "does not match")])
def test_violations_raise(spark, row, said):
    with pytest.raises(N.RateDataError, match=said):
        N.normalize(spark.createDataFrame([row], "date string, iso string, nominal double, rate double, rate_per_unit double"))


def test_duplicates_raise(spark):
    raw = spark.createDataFrame([("2026-01-01", "AMD", 1.0, 1.0)] * 2, "date string, iso string, nominal double, rate double")
    with pytest.raises(N.RateDataError, match="Duplicate"):
        N.normalize(raw)


def test_directory_round_trip(spark, tmp_path):
    for iso in ("AMD", "TJS"):
        (tmp_path / f"rates_{iso}.csv").write_text(f"date,iso,nominal,rate\n2026-01-01,{iso},10,25.0\n2026-01-02,{iso},10,26.0\n")
    assert N.read_rate_directory(spark, str(tmp_path)).count() == 4
    assert {r.iso for r in N.read_rate_directory(spark, str(tmp_path), ["amd"]).collect()} == {"AMD"}
    (tmp_path / "rates_GEL.csv").write_text("date,iso,nominal,rate\n2026-01-01,USD,10,25.0\n")
    with pytest.raises(N.RateDataError):
        N.read_rate_directory(spark, str(tmp_path))


def test_xml(spark):
    xml = '<R><Record Date="02.09.2026"><Nominal>100</Nominal><Value>1 023,8162</Value></Record><Record Date="03.09.2026"><Nominal>1</Nominal><Value>2,5</Value></Record></R>'
    got = N.parse_rate_xml(spark.createDataFrame([("AMD", xml)], "iso string, xml string")).collect()
    assert [(r.date, r.nominal, r.rate) for r in got] == [(dt.date(2026, 9, 2), 100.0, 1023.8162), (dt.date(2026, 9, 3), 1.0, 2.5)]


def test_xml_keeps_records_apart(spark):
    """Blanks stay where they are, a unit rate of the record's own is used, numbers have decimal commas."""
    xml = (
        '<ValCurs><Record Date="01.01.2026"><Nominal>10</Nominal><Value>30,0</Value><VunitRate>3,01</VunitRate></Record>'
        '<Record Date="02.01.2026"><Nominal>10</Nominal><Value></Value></Record>'
        '<Record Date="03.01.2026"><Nominal></Nominal><Value>30,5</Value></Record></ValCurs>'
    )
    got = N.parse_rate_xml(spark.createDataFrame([("AMD", xml), ("KZT", "<ValCurs></ValCurs>")], "iso string, xml string")).orderBy("date").collect()
    assert [(r.iso, r.date.day, r.nominal, r.rate, r.rate_per_unit) for r in got] == [("AMD", 1, 10.0, 30.0, 3.01), ("AMD", 2, 10.0, None, None), ("AMD", 3, None, 30.5, 30.5)]


def test_directory_finds_columns_by_name(spark, tmp_path):
    (tmp_path / "rates_AMD.csv").write_text("date,iso,nominal,rate\n2026-01-01,AMD,10,25.5\n")
    (tmp_path / "rates_TJS.csv").write_text("rate,nominal,iso,date,rate_per_unit\n50.5,5,TJS,2026-01-01,10.1\n")
    (tmp_path / "notes.csv").write_text("anything\n1\n")
    got = {r.iso: (r.nominal, r.rate) for r in N.read_rate_directory(spark, str(tmp_path)).collect()}
    assert got == {"AMD": (10, 25.5), "TJS": (5, 50.5)}
    assert N.read_rate_csv(spark, f"{tmp_path}/rates_TJS.csv").first().rub_per_unit == pytest.approx(10.1)
    with pytest.raises(N.RateDataError):
        N.read_rate_directory(spark, str(tmp_path), ["GEL"])


def test_written_rates_are_read_back(spark, tmp_path):
    panel = quotes(spark, [10.0, 10.5, 9.75], "AMD").unionByName(quotes(spark, [3.0, 3.1], "TJS"))
    sinks.write_rates(panel, f"{tmp_path}/out")
    again = N.read_rate_directory(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, again.select(*panel.columns).collect())) == sorted(map(tuple, panel.collect()))
    assert {r.iso for r in N.read_rate_directory(spark, f"{tmp_path}/out", ["tjs"]).collect()} == {"TJS"}


def test_names_health_and_trim(spark):
    panel = quotes(spark, [10.0, 10.5, 9.75], "AMD").unionByName(quotes(spark, [3.0], "XXX"))
    named = {r.iso: (r.currency_name, r.country) for r in N.with_names(panel).collect()}
    assert named["AMD"][0] == "драм" and named["XXX"] == ("XXX", "")
    status = {r.iso: (r.status, r.n_quotes) for r in service.health(panel, ["amd", "KZT"]).collect()}
    assert status == {"AMD": ("ok", 3), "XXX": ("ok", 1), "KZT": ("degraded", 0)}
    assert N.between(panel, "2026-01-02", "2026-01-05").count() == 2 and N.between(panel).count() == 4


def test_policy_input_is_checked(spark):
    scores = quotes(spark, walk(60, 3)).withColumn("score", F.col(V))
    with pytest.raises(ValueError, match="score"):
        policy.check_scores(scores.drop("score"))
    with pytest.raises(ValueError, match="no scores"):
        policy.check_scores(scores.limit(0))
    log = backtest.decisions_with_outcomes(quotes(spark, walk(60, 3)), scores.unionByName(scores.limit(1)), backtest.BacktestConfig())
    with pytest.raises(Exception, match="scores has more than one row"):  # when it runs, not when it is planned
        log.collect()


def test_residual_is_a_difference(spark):
    rates = walk(320, 6)
    got = features.compute_features(quotes(spark, rates)).orderBy("quote_date").toPandas()["residual_pct"]
    x = pd.Series(rates)
    want = (x - x.ewm(span=60, adjust=False).mean()).rolling(250, min_periods=20).rank(pct=True)
    assert np.allclose(got.to_numpy(float), want.to_numpy(), equal_nan=True)


def test_tuner_tries_again_on_the_next_row(spark):
    """A choice that finds no correlation does not use up its turn."""
    n = 700
    panel = quotes(spark, walk(n, 9))
    days = [r.quote_date for r in panel.orderBy("quote_date").collect()]
    late = 540  # candidates are constant, and so without a correlation, before
    rows = panel.withColumn("c=1", F.when(F.col("quote_date") >= F.lit(days[late]), F.hash("quote_date") % 97).otherwise(1).cast("double")).withColumn("c=2", F.lit(1.0))
    got = tuning.calibrated(rows, ["c=1", "c=2"], tuning.TuningConfig(min_train=500)).orderBy("quote_date").toPandas()
    assert set(got["chosen"]) == {"c=1"}
    first = days.index(got["quote_date"].iloc[0])
    assert first < late + 21 + 11 and (first - 512) % 21 != 0 and len(got) == n - first


def test_calibration_is_a_plain_loop(spark):
    panel = quotes(spark, walk(900, 4), "AMD", "2020-01-01")
    got = {(r.indicator, r.params, r.fold): r.uplift for r in evaluation.fold_uplifts(panel, {"momentum": {"n": (3, 5, 40)}}).collect()}
    frame = panel.orderBy("quote_date").toPandas()
    x = frame[V].to_numpy()
    fall = np.zeros(len(x), dtype=int)
    for i in range(1, len(x)):
        fall[i] = fall[i - 1] + 1 if x[i] < x[i - 1] else 0
    dates = pd.to_datetime(frame["quote_date"])
    for fold in range(4):
        inside = (dates >= dates.max() - pd.DateOffset(months=6 * (fold + 1))).to_numpy()
        total = 50_000 * max(1.0, (dates[inside].max() - dates[inside].min()).days / 30.44)
        paced = x[inside][::5]
        dca = (total / len(paced) / paced).sum()
        for n in (3, 5, 40):
            buys = x[inside & (fall >= n)]
            bought = (total / len(buys) / buys).sum() if len(buys) else 0.0
            assert got["momentum", f"n={n}", fold] == pytest.approx((bought - dca) / dca * 100, abs=1e-6)


def test_null_orders_days_once_for_all_strategies(spark):
    """Every strategy's random days equal those that it would draw alone."""
    universe = quotes(spark, walk(40, 5), "AMD").withColumn("fold", F.lit("f")).withColumn("m", F.col(V))
    cells = spark.createDataFrame([("a", "AMD", "f", 7), ("b", "AMD", "f", 3), ("c", "AMD", "f", 90), ("d", "AMD", "f", 0)], "strategy string, iso string, fold string, n_signals long")
    both = {(r.strategy, r.trial): r.m for r in stats.fold_null(universe, cells, 6, 1, ["m"]).collect()}
    assert {k[0] for k in both} == {"a", "b", "c"} and len(both) == 18
    rows = universe.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("key", stats.draw_key(1, "trial", "iso", "quote_date")).toPandas()
    for (name, trial), mean in both.items():
        part = rows[rows["trial"] == trial].sort_values("key")
        assert mean == pytest.approx(part["m"].head({"a": 7, "b": 3, "c": 90}[name]).mean())


def test_request_chunks_cover_the_range(spark):
    got = N.request_chunks(spark, "2020-01-01", "2022-06-30").orderBy("chunk_start").collect()
    assert got[0].chunk_start == dt.date(2020, 1, 1) and got[-1].chunk_end == dt.date(2022, 6, 30)
    assert all((b.chunk_start - a.chunk_end).days == 1 and (a.chunk_end - a.chunk_start).days <= 365 for a, b in zip(got, got[1:], strict=False))


def test_series_break(spark):
    p = quotes(spark, [1.0, 1.1, 1000.0, 1001.0, 1002.0])
    assert N.series_breaks(p).count() == 1
    assert sorted(r[V] for r in N.after_last_break(p).collect()) == [1001.0, 1002.0]


def test_sinks(spark, tmp_path):
    p = quotes(spark, [1.0, 2.0])
    sinks.write_rates(p, str(tmp_path / "rates"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rates")).count() == 2
    assert sinks.write_artefacts({"a": p, "none": p.limit(0)}, str(tmp_path / "out")) == ["a"]
    sinks.write_log(p, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_outcomes(spark):
    got = labels.build_outcomes(quotes(spark, [100, 90, 110, 120]), 2, 30).orderBy("quote_date").collect()
    assert (got[0].future_median, got[0].advantage_bps, got[0].early_send, got[0].regret_bps) == (100.0, 0.0, True, pytest.approx(1000.0))
    assert [r.outcome_complete for r in got] == [True, True, False, False] and got[3].early_send is None


def test_label_offset(spark):
    got = labels.build_labels(quotes(spark, [10, 10, 10, 10, 10, 9, 11, 11, 11, 11]), horizon=2, execution_offset=1).orderBy("quote_date").collect()[4]
    assert (got.exec_rate, got.regret_bps, got.held_window_closing, got.held_favourable) == (9.0, 0.0, True, False)
    assert got.fwd_advantage_bps == pytest.approx(2 / 9 * 1e4)


def test_labels_tail_and_local_minimum(spark):
    tail = labels.build_labels(quotes(spark, range(1, 13)), horizon=4, execution_offset=1).filter("not outcome_complete")
    assert tail.count() == 5 and tail.filter("exec_rate is not null or bad_push or fwd_advantage_bps is not null").count() == 0
    low = labels.build_labels(quotes(spark, [10, 10, 10, 9, 10, 10, 10, 10]), horizon=2, execution_offset=0).orderBy("quote_date").collect()
    assert low[3].is_local_min and not low[1].is_local_min and not low[4].is_local_min


def test_training_prefix(spark):
    d = lambda x: dt.date(2026, 1, x)
    frame = spark.createDataFrame([("X", d(1 + i), d(a), d(m)) for i, (a, m) in enumerate([(2, 6), (3, 7), (6, 8), (7, 9)])], "iso string, quote_date date, available_on date, label_available_on date")
    got = [r.k for r in labels.matured_before(frame).orderBy("quote_date").collect()]
    assert got == [0, 0, 1, 2]


def test_policy_states(spark):
    scores = quotes(spark, [1.0] * 6, start="2026-01-05").withColumn("score", F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.9, 0.95, 0.96, 0.99)]), F.row_number().over(W.o())))
    config = policy.PolicyConfig("month", 2, 1, 250, 2, 0.8, 10)
    got = policy.apply_policy(scores, config).orderBy("quote_date").collect()
    assert [r.decision_reason for r in got] == ["threshold_warmup", "threshold_warmup", "selected", "cooldown", "selected", "window_budget_exhausted"]
    assert [r.slots_before for r in got] == [2, 2, 2, 1, 1, 0]


def plain_policy(frame, config):
    out, used, last = [], {}, None
    for i, (day, score) in enumerate(zip(frame["available_on"], frame["score"], strict=True)):
        day = pd.Timestamp(day)
        window = (day - pd.Timedelta(days=day.weekday())).date()
        seen = sum(1 for d in frame["available_on"][:i] if (pd.Timestamp(d) - pd.Timedelta(days=pd.Timestamp(d).weekday())).date() == window) + 1
        slots = config.max_signals_per_window - used.get(window, 0)
        q = min(1, max(0, 1 - slots / max(1, config.expected - seen + 1)))
        past = frame["score"][max(0, i - config.threshold_lookback) : i]
        rest = max(0, config.cooldown_observations - (i - last) + 1) if last is not None else 0
        if len(past) < config.minimum_threshold_history:
            reason = "threshold_warmup"
        elif slots <= 0:
            reason = "window_budget_exhausted"
        elif rest:
            reason = "cooldown"
        elif score < np.quantile(past, q):
            reason = "below_threshold"
        else:
            reason, last = "selected", i
            used[window] = used.get(window, 0) + 1
        out.append(reason)
    return out


def test_policy_equals_plain_loop_and_keeps_its_past(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=400)
    scores = quotes(spark, values + 10, start="2020-01-01").withColumn("score", F.col(V))
    config = policy.PolicyConfig(cooldown_observations=1)
    got = policy.apply_policy(scores, config).orderBy("quote_date").toPandas()
    assert got["decision_reason"].tolist() == plain_policy(scores.orderBy("quote_date").toPandas(), config)
    assert got[got["decision"]].groupby("window_id").size().max() <= 2
    cut = policy.apply_policy(scores.filter("quote_date <= '2021-01-31'"), config).orderBy("quote_date").toPandas()
    assert cut["decision_reason"].tolist() == got["decision_reason"].tolist()[: len(cut)]


def test_ewma_and_rank_equal_pandas(spark):
    rates = walk(300, 5)
    s = pd.Series(rates)
    df = W.with_ewma(quotes(spark, rates), V, (5, 60)).withColumn("r", W.rolling_rank(V, 90, 20)).orderBy("quote_date").toPandas()
    m = s.ewm(span=60, adjust=False).mean()
    assert np.allclose(df["mean_60"], m) and np.allclose(df["var_60"], ((s - m) ** 2).ewm(span=60, adjust=False).mean())
    assert np.allclose(df["r"], s.rolling(90, min_periods=20).rank(pct=True), equal_nan=True)


def test_scan_carries_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rates = walk(200, 6)
        got = W.with_ewma(quotes(spark, rates).unionByName(quotes(spark, rates[::-1], "TJS")), V, (20,)).filter("iso = 'TJS'").orderBy("quote_date").toPandas()
        assert np.allclose(got["mean_20"], pd.Series(rates[::-1]).ewm(span=20, adjust=False).mean())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_features_do_not_see_the_future(two_series):
    cut = "2018-06-29"
    full = features.compute_features(two_series).filter(F.col("quote_date") <= cut).orderBy("iso", "quote_date").toPandas()
    known = features.compute_features(two_series.filter(F.col("quote_date") <= cut)).orderBy("iso", "quote_date").toPandas()
    for c in features.FEATURES:
        assert np.allclose(full[c].astype(float), known[c].astype(float), rtol=1e-9, equal_nan=True), c


def plain_tuning(frame, names, config):
    out, current, last = [], None, -(10**9)
    rank = lambda x: pd.Series(x).rank().to_numpy()
    for i in range(len(frame)):
        k = frame["k"][i]
        if k < config.min_train:
            out.append(None)
            continue
        if current is None or i - last >= config.refit_every:
            part, best = frame.iloc[max(0, k - config.lookback) : k], (-np.inf, None)
            for n in names:
                ok = part[n].notna() & part["currency_gain_bps"].notna()
                if ok.sum() >= 30:
                    rho = np.corrcoef(rank(part.loc[ok, n]), rank(part.loc[ok, "currency_gain_bps"]))[0, 1]
                    if rho > best[0]:
                        best = (rho, n)
            current, last = best[1], i
        out.append(current)
    return out


def test_tuner_equals_plain_loop(two_series):
    config = tuning.TuningConfig(min_train=300, lookback=250)
    names = [f"span={s}" for s in (5, 20, 60)]
    scored = tuning.zscore_candidates(two_series.filter("iso = 'TJS'"), (5, 20, 60))
    got = tuning.calibrated(scored, names, config).orderBy("quote_date").toPandas()
    known = labels.matured_before(labels.build_labels(two_series.filter("iso = 'TJS'"))).select("iso", "quote_date", "k", "currency_gain_bps")
    frame = scored.join(known, ["iso", "quote_date"]).orderBy("quote_date").toPandas()
    frame["want"] = plain_tuning(frame, names, config)
    want = frame.dropna(subset=["want"])
    assert got["chosen"].tolist() == want["want"].tolist() and len(got) > 500


def test_signals_state_facts(two_series):
    table = signals.signal_table(two_series).toPandas()
    assert list(table.columns) == list(signals.COLUMNS) and len(table)
    assert (table["deviation_pct"] < 0).all() and (table["message"] != "").all()
    assert table["direction"].isin(["up", "down"]).all() and table["speed"].isin(["fast", "medium", "slow"]).all()
    known = signals.signals_asof(two_series, "2019-06-28").toPandas()
    past = table[table["signal_date"] < dt.date(2019, 6, 28)]
    assert set(zip(known["iso"], known["signal_date"], strict=True)) == set(zip(past["iso"], past["signal_date"], strict=True))


def test_statistics(spark):
    v = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([1.0, 2.0, 4.0, 3.0, 5.0])] + [("b", 0, 2.0)], "k string, at int, x double")
    got = {r.k: r for r in stats.newey_west(v, ["k"], "x", "at").collect()}
    assert got["a"].mean == 3.0 and got["a"].t_stat > 0 and got["b"].mean == 2.0 and got["b"].se is None
    null = spark.createDataFrame([("a", float(x)) for x in np.random.default_rng(0).normal(size=999)], "k string, v double")
    assert stats.permutation_pvalue(null, spark.createDataFrame([("a", 100.0)], "k string, v double"), ["k"], "v").first().p_value == 1 / 1000
    tests = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.001, 0.02, 0.03, 0.5, None])], "f string, i int, p_value double")
    q = stats.benjamini_hochberg(tests, ["f"]).orderBy("i").collect()
    assert [r.significant_fdr for r in q] == [True, True, True, False, False] and q[4].q_value is None
    ci = stats.block_bootstrap(v.filter("k = 'a'"), ["k"], "x", "at", 2, 200).first()
    assert ci.ci_low <= 3.0 <= ci.ci_high


def test_spearman(spark):
    rows = [("a", float(x), float(x**3)) for x in range(40)] + [("b", 1.0, float(x)) for x in range(40)] + [("c", 1.0, 2.0), ("c", 2.0, 1.0)]
    got = {r.g: r.rho for r in tuning.with_spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None and got["c"] is None


def test_gates_and_folds(spark):
    board = spark.createDataFrame([("s", 1.0, 2.5, None)], "strategy string, m double, n double, z double")
    got = benchmark.evaluate_gates(board, (("a", "m", ">=", 1.0, None), ("b", "m", ">", 1.0, None), ("c", "n", "between", 0.5, 2.0), ("d", "z", "<", 1.0, None)))
    assert [r.passed for r in got.collect()] == [True, False, False, None]
    folds = benchmark.folds(spark, "2021-01-01", "2022-12-31").orderBy("fold_start").collect()
    assert len(folds) == 4 and folds[0].fold == "2021-01..2021-06" and folds[-1].fold_end == dt.date(2022, 12, 31)


def test_cadence_is_judged_within_a_series(spark):
    rows = [(iso, dt.date(2026, 1, 1) + dt.timedelta(days=7 * i + o)) for iso, o in (("A", 0), ("B", 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "iso string, quote_date date")
    assert all(r.interval_cv == 0 for r in benchmark.cadence(df, ["iso"]).collect())


def test_matched_schedules_spend_the_same_budget(spark):
    rng = np.random.default_rng(0)
    rows = [("A", dt.date(2026, 1, 1) + dt.timedelta(days=i), f"w{i // 7}", bool(rng.random() < 0.3)) for i in range(70)]
    log = spark.createDataFrame(rows, "iso string, quote_date date, window_id string, decision boolean")
    want = {r.window_id: r.n for r in log.filter("decision").groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    got = stats.matched_random_schedules(log, 4, 1).groupBy("trial", "window_id").agg(F.count("*").alias("n"), F.countDistinct("quote_date").alias("d")).collect()
    assert all(r.n == want[r.window_id] == r.d for r in got) and len(got) == 4 * len(want)


def test_benchmark_runs_and_hindsight_dominates(two_series):
    spec = benchmark.BenchmarkSpec("2017-01-01", horizon=5, random_trials=20, bootstrap_trials=20)
    result = benchmark.run_benchmark(two_series, spec, ["zscore", "oracle_topk"])
    board = {r.strategy: r for r in result.leaderboard.collect()}
    assert board["oracle_topk"].currency_uplift_bps > board["zscore"].currency_uplift_bps
    assert board["oracle_topk"].p_value <= 1 / 10 and abs(board["zscore"].random_currency_uplift_bps) < 30
    assert result.gates.count() == 2 * len(benchmark.GATES)
    with pytest.raises(KeyError):
        benchmark.get_strategy("none")


def test_heads_equal_plain_fits_and_rescoring(two_series):
    tjs = two_series.filter("iso = 'TJS'")
    f = features.compute_features(two_series).filter("iso = 'TJS'")
    config = models.UtilityRiskConfig(min_train=600, refit_every=200)
    scores = models.walk_forward_heads(tjs, f, config)
    rows = scores.orderBy("quote_date").toPandas()
    assert rows[["p_min", "p_bad"]].stack().between(0, 1).all() and len(rows) > 200
    again = models.rescore(scores, 0.0).orderBy("quote_date").toPandas()
    assert np.allclose(again["score"], rows["u_bps"] - rows["base_u_bps"])
    data = models.heads_data(tjs, f, config).orderBy("pos").toPandas()
    first = models.walk_forward_coefficients(models.heads_data(tjs, f, config), config).orderBy("turn").first()
    part = data.iloc[: first.training_observations]
    x, y = part[list(config.columns)].to_numpy(float), part["fwd_advantage_bps"].to_numpy(float)
    scale = np.where(x.std(0) == 0, 1, x.std(0))
    z = (x - x.mean(0)) / scale
    w = np.linalg.solve(z.T @ z + config.ridge_alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    assert np.allclose(first.u[:-1], w, rtol=1e-5, atol=1e-8)


def test_ridge_prediction_equals_plain_fit(two_series):
    tjs = two_series.filter("iso = 'TJS'")
    f = features.compute_features(two_series).filter("iso = 'TJS'")
    got = models.walk_forward_ridge(f, tjs, min_train=400).orderBy("quote_date").toPandas()
    data = f.join(labels.make_target(tjs, 20), ["iso", "quote_date"], "left").dropna(subset=list(models.RAW)).orderBy("quote_date").toPandas()
    row = data[data["quote_date"] == got["quote_date"].iloc[100]].iloc[0]
    part = data[data["target_available_on"].notna() & (data["target_available_on"] <= row["available_on"])]
    x, y = part[list(models.RAW)].to_numpy(float), part["target"].to_numpy(float)
    scale = np.where(x.std(0) == 0, 1, x.std(0))
    z = (x - x.mean(0)) / scale
    w = np.linalg.solve(z.T @ z + 1.0 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    want = ((row[list(models.RAW)].to_numpy(float) - x.mean(0)) / scale) @ w + y.mean()
    assert got["prediction"].iloc[100] == pytest.approx(want, rel=1e-5)


def test_logistic_separates(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=500) > 0).astype(float)
    w, _ = models.logistic(x, y)
    assert w[0] > 1 and w[1] < -0.5 and abs(w[2]) < 0.4
    flat, c = models.logistic(x, np.ones(500))
    assert not flat.any() and c > 10


def test_backtest_report(two_series):
    f = features.compute_features(two_series)
    log, report = backtest.run_backtest(two_series, backtest.baseline_scores(f), backtest.BacktestConfig(random_trials=5, bootstrap_trials=10))
    got = {r.iso: r for r in report.collect()}
    assert set(got) == {"TJS", "USD", "ALL"} and got["ALL"].n_signals == got["TJS"].n_signals + got["USD"].n_signals
    assert log.filter("decision and decision_reason <> 'selected'").count() == 0


def test_forward_asof(spark):
    d = lambda x: dt.date(2026, 1, x)
    events = spark.createDataFrame([("A", d(1)), ("A", d(5)), ("A", d(9))], "iso string, signal_date date")
    marks = spark.createDataFrame([("A", d(5)), ("A", d(7))], "iso string, mark_date date")
    strict = {r.signal_date.day: r.mark_date and r.mark_date.day for r in indicators.next_on_or_after(events, marks, True).collect()}
    loose = {r.signal_date.day: r.mark_date and r.mark_date.day for r in indicators.next_on_or_after(events, marks, False).collect()}
    assert strict == {1: 5, 5: 7, 9: None} and loose == {1: 5, 5: 5, 9: None}


def test_verdicts(spark):
    rows = [("a", 1.4, 2.0, 1.5), ("b", 0.9, 2.0, 1.5), ("c", 1.4, -1.0, 1.5), ("d", 1.4, 2.0, 3.0), ("e", 1.1, 2.0, 1.5)]
    got = {r.k: r.verdict for r in indicators.verdicts(spark.createDataFrame(rows, "k string, lift_h5 double, uplift_vs_dca double, per_week double")).collect()}
    assert got == {"a": "keep", "b": "drop", "c": "drop", "d": "marginal", "e": "marginal"}


def test_parameter_grid(spark):
    assert indicators.parameter_grid(spark, {"a": [1, 2], "b": [0.1, 0.2, 0.3]}).count() == 6
    key = spark.range(1).select(indicators.params_key(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("k")).first().k
    assert key == "a=1,b=2"
