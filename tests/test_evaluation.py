"""Strategies by their own rule, sweeps, significance, audits, stored states, the stand and its exports against plain loops."""

import datetime as dt
import hashlib
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempo.functions import windows as W
from tempo.operators import benchmark, charts, features, indicators, labels, models, policy, signals, stand, stats
from tempo.plans import service
from tempo.sources import chunked, sinks
from tempo.sources import panel as N

from test_engine import V, quotes, walk


@pytest.fixture(scope="module")
def pair(spark):
    return quotes(spark, walk(1100, 1), "TJS", "2015-01-01").unionByName(quotes(spark, walk(1100, 2, 85.0), "USD", "2015-01-01")).cache()


@pytest.fixture(scope="module")
def built(pair):
    return features.compute_features(pair).cache()


@pytest.fixture(scope="module")
def run(pair):
    spec = benchmark.BenchmarkSpec("2016-01-01", horizon=5, random_trials=30, bootstrap_trials=40)
    return spec, benchmark.run_benchmark(pair, spec, ["percentile", "oracle", "reversal"])


def test_every_strategy_is_judged_by_its_own_rule(run, pair):
    spec, result = run
    sent = result.signals.toPandas()
    rule = {"percentile": "held_favourable", "oracle": "held_window_closing", "reversal": "held_window_closing"}
    for r in result.leaderboard.collect():
        own = sent[sent["strategy"] == r.strategy]
        assert r.hit_rate == pytest.approx(own[rule[r.strategy]].astype(float).mean())
        drawn = result.null.filter(F.col("strategy") == r.strategy).toPandas()
        other = {"held_favourable": "hit_favourable", "held_window_closing": "hit_closing"}[rule[r.strategy]]
        assert (drawn["hit_rate"] == drawn[other]).all()
    at = result.horizons.toPandas().set_index("strategy")
    outcomes = labels.build_labels(pair, 3, 1).filter("outcome_complete").toPandas()
    mine = sent[sent["strategy"] == "oracle"][["iso", "quote_date"]].merge(outcomes, on=["iso", "quote_date"])
    assert at.loc["oracle", "hit_h3"] == pytest.approx(mine["held_window_closing"].astype(float).mean())


def test_board_is_ordered_by_score_and_keeps_silent_cells(run, pair):
    spec, result = run
    board = result.leaderboard.toPandas()
    score = board["currency_uplift_bps"] / board["ceiling_bps"] * 100
    assert np.allclose(board["cbsb_score"], score) and (board["cbsb_score"].diff().dropna() <= 0).all()
    cells = result.cells.toPandas()
    folds = cells[["iso", "fold"]].drop_duplicates()
    assert len(cells) == 3 * len(folds) and cells["n_signals"].sum() == result.signals.count()
    assert np.allclose(cells["per_week"], cells["n_signals"] / (cells["trading_days"] / 5))


def plain_significance(keys, x, block, trials, seed):
    n = len(x)
    wide = min(block, n)
    means = []
    for trial in range(trials):
        picked = []
        for b in range(-(-n // wide)):
            number = int(hashlib.md5("|".join([str(seed), *keys, str(trial), str(b)]).encode()).hexdigest()[:12], 16)
            begin = number % (n - wide + 1)
            picked += x[begin : begin + min(wide, n - b * wide)]
        means.append(np.mean(picked))
    return np.quantile(means, [0.025, 0.975])


def test_significance_of_both_columns(run):
    spec, result = run
    sent = result.signals.toPandas()
    board = result.leaderboard.toPandas().set_index("strategy")
    series = result.corridors.toPandas().set_index(["strategy", "iso"])
    for name in ("percentile", "oracle"):
        own = sent[sent["strategy"] == name].sort_values(["iso", "quote_date"])
        for prefix, column in benchmark.SIGNIFICANT.items():
            x = own[column].dropna().tolist()
            low, high = plain_significance([name], x, spec.horizon, spec.bootstrap_trials, spec.seed)
            assert board.loc[name, f"{prefix}_ci_low"] == pytest.approx(low) and board.loc[name, f"{prefix}_ci_high"] == pytest.approx(high)
            one = own[own["iso"] == "TJS"][column].dropna().tolist()
            low, high = plain_significance([name, "TJS"], one, spec.horizon, spec.bootstrap_trials, spec.seed)
            assert series.loc[(name, "TJS"), f"{prefix}_ci_low"] == pytest.approx(low)
            d, lags = np.array(one) - np.mean(one), int(4 * (len(one) / 100) ** (2 / 9))
            var = d @ d / len(d) + sum(2 * (1 - k / (lags + 1)) * (d[k:] @ d[:-k]) / len(d) for k in range(1, lags + 1))
            assert series.loc[(name, "TJS"), f"{prefix}_hac_se"] == pytest.approx(np.sqrt(var / len(d))) and series.loc[(name, "TJS"), f"{prefix}_hac_t"] == pytest.approx(np.mean(one) / np.sqrt(var / len(d)))


def test_no_plan_of_the_leaderboard_is_large(pair, monkeypatch):
    """The driver plans anew after every stage, so its memory follows the largest plan."""
    sizes, asked = [], []

    def planned(df):
        sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return df.sparkSession.createDataFrame(df.sparkSession.sparkContext.emptyRDD(), df.schema)

    for module in (benchmark, models, stats):
        monkeypatch.setattr(module, "cut_lineage", planned, raising=False)
    monkeypatch.setattr(benchmark, "horizon_table", lambda *_, **__: asked.append("horizons"))
    benchmark.run_benchmark(pair, names=list(benchmark.STRATEGIES))
    assert max(sizes) <= 12 and not asked


def test_a_p_value_needs_a_trial(spark):
    null = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None), ("c", 3.0)], "k string, n double")
    seen = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", None)], "k string, o double")
    got = {r.k: r.p for r in null.join(seen, "k").groupBy("k").agg(stats.pvalue("n", "o").alias("p")).collect()}
    alone = {r.k: r.p_value for r in stats.permutation_pvalue(null, seen.withColumnRenamed("o", "n"), ["k"], "n").collect()}
    assert got == {"a": 2 / 3, "b": None, "c": 1 / 2} and alone == {"a": 2 / 3, "c": 1 / 2}


def test_budgets_in_one_pass_equal_single_policies(pair):
    rng = np.random.default_rng(3)
    scores = pair.withColumn("score", F.rand(5) + F.lit(float(rng.random()))).withColumn("minimum_score", F.when(F.col("iso") == "USD", 0.7).cast("double")).cache()
    policies = {"a": policy.PolicyConfig("week", 2, 3), "b": policy.PolicyConfig("month", 4, 3), "c": policy.PolicyConfig("week", 1, 1, 60), "d": policy.PolicyConfig("month", 1, 0)}
    got = {(r.policy, r.iso, r.quote_date) for r in policy.selected_by(scores, policies).collect()}
    want = {(name, r.iso, r.quote_date) for name, config in policies.items() for r in policy.apply_policy(scores, config).filter("decision").collect()}
    assert got == want and {g[0] for g in got} == set(policies)


def test_lambda_sweep_has_a_floor_and_a_row_each(pair, spark):
    heads = pair.select("quote_date", "available_on", "iso", V, F.randn(1).alias("u_bps"), F.abs(F.randn(2)).alias("risk_bps"), F.lit(0.1).alias("base_u_bps"), F.lit(0.5).alias("base_risk_bps")).cache()
    spec = benchmark.BenchmarkSpec("2016-01-01")
    days = benchmark.evaluated_days(pair, spec)
    got = {r.lam: r for r in benchmark.lambda_sweep(heads, days, spec.policy, (0.0, 3.0, 1000.0)).collect()}
    known = days.toPandas()
    for lam in got:
        scored = models.rescore(heads, lam)
        one = policy.apply_policy(scored, policy.PolicyConfig(cooldown_observations=1, minimum_score=0.0)).filter("decision").select("iso", "quote_date").toPandas().merge(known, on=["iso", "quote_date"])
        assert got[lam].n_signals == len(one) and got[lam].per_week == pytest.approx(len(one) / 2 / (len(known) / 2 / 5))
        if len(one):
            assert got[lam].hit_rate == pytest.approx(one["held_favourable"].astype(float).mean()) and got[lam].regret_bps == pytest.approx(one["regret_bps"].mean())
    with pytest.raises(ValueError, match="not a configuration"):
        models.UtilityRiskConfig(lam=-1.0)


def test_cadence_sweep_equals_a_plain_loop(pair, built):
    spec = benchmark.BenchmarkSpec("2016-01-01")
    strategies = benchmark.swept_strategies(["percentile", "oracle", "zscore"])
    scores = benchmark.build_scores(pair, strategies, built).cache()
    days = benchmark.evaluated_days(pair, spec)
    got = {(r.cadence, r.strategy): r for r in benchmark.cadence_sweep(scores, strategies, days).collect()}
    assert len(got) == 6 * 2
    label, window, most, wait = benchmark.CADENCES[3]
    known, row = days.toPandas(), got[label, "percentile"]
    sent = policy.apply_policy(scores.filter("strategy = 'percentile'"), policy.PolicyConfig(window, most, wait)).filter("decision").select("iso", "quote_date").toPandas().merge(known, on=["iso", "quote_date"])
    gaps = {iso: pd.to_datetime(g["quote_date"]).sort_values().diff().dt.days.dropna() for iso, g in sent.groupby("iso")}
    n = sent.groupby("iso").size()
    cv = sum(g.std() / g.mean() * n[iso] for iso, g in gaps.items()) / n.sum()
    assert (row.n_signals, row.max_gap_days, row.window, row.max_per_window, row.cooldown) == (len(sent), max(g.max() for g in gaps.values()), window, most, wait)
    assert row.interval_cv == pytest.approx(cv) and row.currency_uplift_bps == pytest.approx(sent["currency_gain_bps"].mean())


def test_audit_deletes_the_future(pair):
    """A score that reads one quote ahead is caught; one that does not is matched on every series and cut."""
    spec = benchmark.BenchmarkSpec("2016-01-01")
    builders = {
        "leaks": lambda p, u: p.withColumn("score", F.coalesce(F.lead(V).over(W.o()), F.lit(0.0))),
        "clean": lambda p, u: features.compute_features(p, u).withColumn("score", F.col("pct_rank_90") + F.col("rub_strength")),
        "tuned": benchmark.score_builders(spec)["tuned"],
    }
    got = benchmark.audit_no_lookahead(pair, None, builders, spec, 3).toPandas()
    assert got.groupby("score_name").size().to_dict() == {"leaks": 6, "clean": 6, "tuned": 6}
    assert got[got["score_name"] != "leaks"]["matched"].all()
    leaks = got[got["score_name"] == "leaks"].sort_values("cut")
    assert not leaks["matched"].head(4).any()


def test_scores_asof_repeat_the_full_run(pair, built):
    config = models.UtilityRiskConfig(min_train=750, refit_every=100)
    full = models.walk_forward_heads(pair, built, config).select("iso", "quote_date", "score").toPandas()
    day = sorted(full["quote_date"])[len(full) // 2]
    known = models.scores_asof(pair, str(day), features.compute_features, config).select("iso", "quote_date", F.col("score").alias("then")).toPandas()
    both = known.merge(full, on=["iso", "quote_date"])
    assert len(both) == len(known) > 50 and np.allclose(both["score"], both["then"])


def test_joins_fail_when_a_key_repeats(pair, built):
    twice = built.unionByName(built.filter("iso = 'TJS'").limit(1))
    with pytest.raises(Exception, match="features has more than one row"):
        models.heads_data(pair, twice, models.UtilityRiskConfig()).count()
    assert W.one_row_each(pair, ["iso", "quote_date"], "panel").count() == pair.count()


def test_ridge_at_a_date_reads_stored_sums(pair, built, spark, tmp_path):
    full = models.walk_forward_ridge(built, pair)
    answers = {(r.iso, r.quote_date): r.prediction for r in full.collect()}
    sinks.write_artefacts({"snapshots": models.ridge_snapshots(built, pair, every=40), "predictions": full, "features": built}, str(tmp_path), "parquet")
    held = {n: sinks.read_artefact(spark, str(tmp_path), n) for n in ("snapshots", "predictions", "features")}
    days = sorted({d for _, d in answers})
    for day in days[:: len(days) // 10][:10]:
        got = models.ridge_asof(held["snapshots"], held["features"], pair, str(day + dt.timedelta(days=1))).collect()
        assert {r.iso for r in got} == {"TJS", "USD"}
        assert all(r.prediction == pytest.approx(answers[r.iso, r.quote_date], rel=1e-9) and r.quote_date == day for r in got)
    sent = {(r.iso, r.signal_date) for r in indicators.model_ridge(full).collect()}
    day = max(d for i, d in sent if i == "TJS")
    row = service.ridge_on(held["predictions"], held["snapshots"], held["features"], pair, "tjs", str(day + dt.timedelta(days=1))).first()
    assert row.quote_date == day and row.sent


def test_chunked_source_retries_and_covers_the_range(spark, tmp_path):
    """Every range is asked for once more than it fails; a source that never answers is an error."""
    folder = str(tmp_path)

    def xml(start, end):
        days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
        return "<ValCurs>" + "".join(f'<Record Date="{d:%d.%m.%Y}"><Nominal>10</Nominal><Value>{20 + d.day},5</Value></Record>' for d in days) + "</ValCurs>"

    def flaky(iso, start, end):
        with open(os.path.join(folder, f"{iso}-{start}"), "a") as f:
            f.write("x")
        with open(os.path.join(folder, f"{iso}-{start}")) as f:
            if len(f.read()) < 3:
                raise OSError("no answer")
        return xml(start, end)

    panel, breaks = chunked.collect_quotes(spark, flaky, ["amd", "TJS"], "2020-01-01", "2021-03-01", backoff=0.0)
    assert {r.iso: r["count"] for r in panel.groupBy("iso").count().collect()} == {"AMD": 426, "TJS": 426}
    assert breaks.count() == 0
    frame = spark.read.format("rate_chunks").options(isos="AMD,TJS", start="2020-01-01", end="2021-03-01", days=100).load()
    assert frame.rdd.getNumPartitions() == 10
    with pytest.raises(Exception, match="not answered in 2 tries"):
        chunked.collect_quotes(spark, flaky, ["KZT"], "2020-01-01", "2020-01-05", backoff=0.0, retries=2)[0].count()


def test_days_do_not_depend_on_zones(spark):
    rows = [("2026-01-01T23:00:00+00:00", 1), ("2026-01-01 01:00:00-11:00", 1), ("2026-01-01T05:00:00Z", 1), ("01/01/2026", 1), ("01.01.2026", 1), ("2026-01-01", 1), ("2026-13-01", 0), ("x", 0), (None, 0)]
    for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = spark.createDataFrame(rows, "t string, ok int").select("ok", N.parsed_day(F.col("t")).alias("d")).collect()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert all((r.d == dt.date(2026, 1, 1)) if r.ok else r.d is None for r in got)


def test_params_are_typed(spark):
    got = spark.createDataFrame([("a=1,b=0.5,c=x",), ("",)], "k string").select(indicators.params_of(F.col("k")).alias("p")).collect()
    assert (got[0].p["a"].whole, got[0].p["b"].fraction, got[0].p["c"].text) == (1, 0.5, "x") and got[0].p["a"].fraction is None and got[1].p == {}


@pytest.fixture(scope="module")
def sent(pair):
    return signals.signal_table(pair).cache()


def test_the_stand_answers_every_day(spark, pair, sent, tmp_path):
    start = "2018-01-01"
    listed = {r.iso: r for r in stand.corridors(pair, sent, start, "2018-06-01").collect()}
    rates = pair.filter("iso = 'TJS'").orderBy("quote_date").toPandas().set_index("quote_date")[V]
    drawn = rates[[d >= dt.date(2018, 1, 1) for d in rates.index]]
    assert listed["TJS"].threshold_bps == pytest.approx(round(float((drawn.pct_change().abs() * 1e4).median()), 1))
    mine = sent.filter("iso = 'TJS' and signal_date >= '2018-01-01'").orderBy("signal_date").toPandas()
    counts = mine["window"].value_counts()
    assert f"span={listed['TJS'].trend_span}" in set(counts[counts == counts.max()].index)
    trend = stand.trend_series(pair, stand.corridors(pair, sent, start, start), start).filter("iso = 'TJS'").orderBy("quote_date").toPandas()
    assert np.allclose(trend["trend"], rates.ewm(span=listed["TJS"].trend_span, adjust=False).mean()[drawn.index], atol=1e-6)
    path = str(tmp_path / "days")
    stand.store_days(stand.day_log(pair, sent, start), path)
    first = mine["signal_date"].iloc[0]
    hit, weekend, outside = stand.look_up(spark, path, "tjs", str(first)).first(), stand.look_up(spark, path, "TJS", "2018-01-06").first(), stand.look_up(spark, path, "TJS", "1999-01-01").first()
    assert hit.decision == "candidate" and hit.has_quote and hit.signal.message == mine["message"].iloc[0] and "сомони" in hit.signal.client_message
    assert (weekend.has_quote, weekend.rate, weekend.decision, outside.has_quote, outside.decision) == (False, None, "hold", False, "hold")
    plan = stand.look_up(spark, path, "TJS", str(first))._jdf.queryExecution().toString()
    assert "EqualTo(iso,TJS)" in plan and "EqualTo(day" in plan


def test_export_reads_back(spark, pair, sent, tmp_path):
    start, path = "2018-01-01", str(tmp_path / "export")
    stand.write_export(stand.export_pieces(pair, sent, start, start, ["2018-06-01"]), path)
    series = stand.read_export(spark, path, "series").orderBy("iso", "d").collect()
    want = stand.trend_series(pair, stand.corridors(pair, sent, start, start), start).orderBy("iso", "quote_date").collect()
    assert [(r.iso, r.d, r.r, r.e) for r in series] == [(r.iso, r.quote_date, r.rate, r.trend) for r in want]
    told = stand.read_export(spark, path, "signals").orderBy("iso", "date").collect()
    rates = {(r.iso, r.quote_date): r[V] for r in pair.collect()}
    days = {iso: sorted(d for i, d in rates if i == iso) for iso in ("TJS", "USD")}
    assert [(r.iso, r.date) for r in told] == sorted((r.iso, r.signal_date) for r in sent.filter("signal_date >= '2018-01-01'").collect())
    for r in told[:: max(1, len(told) // 8)]:
        at = days[r.iso].index(r.date)
        ahead = days[r.iso][at + 1 : at + 6]
        assert [f.d for f in r.follow] == ahead
        assert [f.bps for f in r.follow] == pytest.approx([round((rates[r.iso, d] / rates[r.iso, r.date] - 1) * 1e4, 1) for d in ahead], abs=0.11)
    audit = stand.read_export(spark, path, "audit").collect()
    assert len(audit) == 2 and all(r.identical for r in audit)
    meta = stand.read_export(spark, path, "meta").first()
    assert (meta.observations, meta.window_from) == (pair.count(), dt.date(2018, 1, 1)) and stand.read_export(spark, path, "stats").count() == 2


def test_artefacts_keep_their_types_and_feed_the_charts(spark, run, pair, tmp_path):
    _, result = run
    names = sinks.write_artefacts({"leaderboard": result.leaderboard, "per_corridor": result.corridors, "signals": result.signals, "none": pair.limit(0)}, str(tmp_path))
    assert names == ["leaderboard", "per_corridor", "signals"]
    board = sinks.read_artefact(spark, str(tmp_path), "leaderboard")
    assert board.dtypes == result.leaderboard.dtypes and sorted(map(str, board.collect())) == sorted(map(str, result.leaderboard.collect()))
    points = charts.corridor_points(sinks.read_artefact(spark, str(tmp_path), "per_corridor"), ["oracle"]).collect()
    assert len(points) == 2 and all(p.n_positive == 2 for p in points)
    assert [r.strategy for r in charts.rules_comparison(board).orderBy("place").collect()] == [r.strategy for r in result.leaderboard.filter("strategy <> 'oracle'").orderBy(F.desc("currency_uplift_bps")).collect()]
    assert charts.ladder(board).count() == 0
    marks = charts.rate_points(pair, sinks.read_artefact(spark, str(tmp_path), "signals"), "TJS", "2017-01-02")
    assert marks.filter("marks is not null").count() == result.signals.filter("iso = 'TJS' and quote_date >= '2017-01-02'").select("quote_date").distinct().count()
    assert "| oracle |" in service.scorecard(result.leaderboard, result.gates)


def test_service_answers(spark, pair, sent):
    row = sent.filter("iso = 'TJS'").orderBy(F.desc("signal_date")).first()
    usable = row.signal_date + dt.timedelta(days=1)
    said = service.evaluate(pair, " tjs ", str(usable)).first()
    assert (said.status, said.message, said.window) == ("candidate", row.message, row.window) and "below its mean" in said.reason
    hold = service.evaluate(pair, "TJS", "2015-03-02").first()
    assert hold.status == "hold" and hold.message is None and hold.rate > 0
    for iso, day in (("XX", "2020-01-01"), ("TJS", "2001-01-01"), ("KZT", "2018-01-01")):
        with pytest.raises(service.RateNotFoundError):
            service.evaluate(pair, iso, day)
    assert {r.client_message for r in service.signal_payloads(pair).filter("iso = 'TJS'").collect()} == {r.message.replace("TJS", "сомони", 1) for r in sent.filter("iso = 'TJS'").collect()}
    assert service.latest_rate(pair, "tjs", "2016-01-01").first().quote_date < dt.date(2016, 1, 1)
    assert service.Settings.of(spark).rates_dir


@pytest.mark.parametrize("wrong", [{"horizon": 0}, {"horizon": 61}, {"random_trials": 9}, {"bootstrap_trials": 99}, {"window": "day"}, {"corridors": ()}, {"corridors": ("TJS", "tjs")}, {"corridors": ("TJS",) * 6}, {"corridors": ("TJ",)}, {"max_signals_per_window": 11}, {"min_train": 10}, {"source": "x"}])
def test_requests_are_bounded(wrong):
    with pytest.raises(ValueError):
        service.BacktestRequest(**{"corridors": ("TJS",), **wrong})


def test_requested_backtest(pair):
    log, report = service.run_backtest(pair, None, service.BacktestRequest(("tjs",), "baseline", random_trials=10, bootstrap_trials=100, window="month", max_signals_per_window=4))
    assert {r.iso for r in report.collect()} == {"TJS", "ALL"} and log.filter("decision").groupBy("window_id").count().agg(F.max("count")).first()[0] <= 4
    with pytest.raises(service.RateNotFoundError, match="KZT"):
        service.run_backtest(pair, None, service.BacktestRequest(("TJS", "KZT")))


def test_command_line_writes_what_it_reads(spark, pair, tmp_path):
    rates, out = str(tmp_path / "rates"), str(tmp_path / "out")
    sinks.write_rates(pair, rates)
    service.main(["rates", rates, str(tmp_path / "again")])
    assert N.read_rate_directory(spark, str(tmp_path / "again")).count() == pair.count()
    service.main(["signals", rates, out])
    assert sinks.read_artefact(spark, out, "signals").count() == signals.signal_table(pair).count()
    service.main(["backtest", rates, out, "--source", "baseline"])
    assert spark.read.json(f"{out}/decision_log").filter("decision").count() > 0
