import math
import warnings

import pytest
from pyspark.sql import functions as F

from tallymark.operators import binning, diagnosis, drift, metrics, monitoring, profile, rules, scorecard, screening, woe
from tallymark.operators.binning import Settings
from tallymark.operators.quality_report import estimator_name, quality
from tallymark.plans.chain import Chain, Spec
from tallymark.plans.loans import FEATURES, SPECIALS, loans, samples
from tallymark.sources import files
from tallymark.streaming import tracking


@pytest.fixture(scope="module")
def df(spark, sf):
    return loans(spark, sf).cache()


@pytest.fixture(scope="module")
def tables(df):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return binning.fit(df, "bad", FEATURES, Settings(n_bins=5, special_values=SPECIALS))


def test_tables_count_every_row(df, tables):
    n, bad = df.agg(F.count("*"), F.sum("bad")).first()
    for t in tables.values():
        assert sum(b.bad + b.good for b in t.bins) == n and sum(b.bad for b in t.bins) == bad
        assert t.cuts == sorted(t.cuts) and len(t.main) <= 12
    assert [b.kind for b in tables["qty"].bins][-2:] == ["special", "missing"]
    assert tables["qty"].bins[0].label.startswith("(-inf, ")


def test_narrowed_quantiles_equal_direct_ones(spark, df):
    import numpy as np

    tied = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 7).alias("x"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("y"))
    for frame, columns in ((df, ["qty", "price"]), (tied, ["x", "y"])):
        one = profile.quantile_edges(frame, columns, 10)
        two = profile.quantile_edges(frame, columns, 10, at_once=50)
        for c in columns:
            assert np.allclose(one[c], two[c]), c


def test_methods_and_bad_settings(df):
    for method in binning.METHODS:
        t = binning.fit(df, "bad", ["qty", "price"], Settings(method=method, n_bins=6, special_values=SPECIALS))["price"]
        assert 1 <= len(t.main) <= 6
    for bad in ({"method": "optimal"}, {"category_mode": "custom"}, {"missing_combine": "yes"}, {"min_nobs": -1}, {"monotonic": "zigzag"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(TypeError):
        Settings(bins=3)
    with pytest.raises(ValueError):
        binning.fit(df.where("bad = 1"), "bad", ["qty"])
    with pytest.raises(ValueError):
        binning.fit(df, "bad", ["qty", "qty"])


def test_missing_rows_join_a_bin(df):
    s = Settings(manual_cutoffs=(10.0, 20.0, 30.0, 40.0), special_values=SPECIALS, missing_combine="near")
    t = binning.fit(df, "bad", ["qty"], s)["qty"]
    assert t.missing_merged is not None and all(b.kind != "missing" for b in t.bins)
    assert woe.missing_woe(t) == 0.0 and woe.missing_woe(t, follow_merge=True) == t.bins[t.missing_merged].woe


def test_nan_is_missing(spark):
    own = spark.createDataFrame([(float(i % 7) if i % 5 else float("nan"), i % 2) for i in range(200)], "x double, y int")
    t = binning.fit(own, "y", ["x"], Settings(method="frequency", n_bins=3, max_categories=3))["x"]
    assert [b.kind for b in t.bins][-1] == "missing" and sum(b.bad + b.good for b in t.bins) == 200


def test_woe_of_unknown_and_missing_levels(spark, df, tables):
    own = spark.createDataFrame([("new",), (None,), ("1-URGENT",)], "prio string")
    got = [r[0] for r in own.select(woe.woe_column(tables["prio"], F.col("prio"))).collect()]
    assert got == [woe.fallback(tables["prio"]), 0.0, tables["prio"].main[0].woe]
    with pytest.raises(ValueError):
        woe.fallback(tables["prio"], "guess")


def test_screen_reports_each_reason(df):
    own = df.withColumns({"fixed": F.lit(1.0), "gone": F.lit(None).cast("double"), "copy": F.col("qty") * 2})
    found = screening.screen(own, "bad", ["qty", "copy", "price", "fixed", "gone"], iv_range=(None, None), max_corr=0.9)
    assert found.reasons["fixed"] == ["one_value"] and "missing" in found.reasons["gone"] and found.reasons["copy"] == ["corr"]
    assert found.support == ["qty", "price"]
    with pytest.warns(screening.FeatureScreenWarning):
        assert not screening.assess_screen([], stage="x").ok
    with pytest.warns(screening.FeatureScreenWarning):
        screening.screen(df, "bad", ["qty"], max_psi=0.1)


def test_scores_follow_the_formula(spark, df, tables):
    encoded = woe.woe_transform(df.select("qty", "disc", "tax", "bad"), tables)
    model = scorecard.fit_model(encoded, "bad", ["qty", "disc", "tax"])
    card = scorecard.ScoreCard(model, tables, odds=20, pdo=20)
    factor = 20 / math.log(2)
    row = df.select(card.score().alias("s"), card.probability().alias("p"), *(card.woe(c).alias(c) for c in model.names)).first()
    z = model.intercept + sum(model.coef[c] * row[c] for c in model.names)
    assert math.isclose(row.p, 1 / (1 + math.exp(-z)))
    assert math.isclose(row.s, 600 + factor * (math.log(20) + model.intercept) - factor * (z - model.intercept))
    assert card.points(spark).count() == sum(len(tables[c].bins) for c in model.names)
    with pytest.raises(ValueError):
        scorecard.fit_model(encoded, "bad", [])


def test_grouped_spark_fit_agrees(df, tables, monkeypatch):
    encoded = woe.woe_transform(df.select("qty", "disc", "tax", "bad"), tables)
    own = scorecard.fit_model(encoded, "bad", ["qty", "disc", "tax"])
    monkeypatch.setattr(scorecard, "COMBINATIONS", 3)
    other = scorecard.fit_model(encoded, "bad", ["qty", "disc", "tax"])
    assert all(math.isclose(a, b, rel_tol=1e-4) for a, b in zip(own.params, other.params))
    with pytest.raises(ValueError):
        scorecard.stepwise(encoded, "bad", ["qty", "disc", "tax"])


def test_stepwise(df, tables):
    train, test, _ = samples(df)
    encode = lambda d: woe.woe_transform(d.select(*tables, "bad"), tables)
    found = scorecard.stepwise(encode(train), "bad", list(tables), encode(test), scorecard.StepwiseSettings(n_min=2, n_max=3, random_state=1))
    assert 2 <= len(found.support) <= 3 and found.record and {"disc", "tax"} & set(found.support)
    forced = scorecard.stepwise(encode(train), "bad", list(tables), None, scorecard.StepwiseSettings(n_min=1, objective="ks", max_iter_round=3), ["status"])
    assert "status" in forced.support
    with pytest.raises(KeyError):
        scorecard.stepwise(encode(train), "bad", list(tables), None, scorecard.StepwiseSettings(feature_belong={"nobody": "x"}))


def test_stepwise_beyond_the_driver(df, tables, monkeypatch):
    train, test, _ = samples(df)
    encode = lambda d: woe.woe_transform(d.select("qty", "disc", "tax", "bad"), tables)
    found = []
    for most in (scorecard.COMBINATIONS, 8):  # 8: some trials fit the driver, others do not
        monkeypatch.setattr(scorecard, "COMBINATIONS", most)
        settings = scorecard.StepwiseSettings(n_min=2, n_max=3, max_iter_round=2, random_state=1, distributed=True)
        found.append(scorecard.stepwise(encode(train), "bad", ["qty", "disc", "tax"], encode(test), settings, ["disc", "tax"]))
    own, other = found
    assert own.support == other.support and [r[:3] for r in own.record] == [r[:3] for r in other.record]
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(own.model.params, other.model.params, strict=True))
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(own.model.errors, other.model.errors, strict=True))
    assert own.performance.keys() == other.performance.keys()
    assert all(math.isclose(own.performance[k], other.performance[k], abs_tol=1e-6) for k in own.performance)


def test_rules_hit_what_they_say(df):
    found = rules.mine(df, "bad", ["qty", "disc", "tax"], rules.RuleSettings(min_lift=1.3, max_hit_rate=0.5))
    assert found and [r.lift for r in found] == sorted((r.lift for r in found), reverse=True)
    again = rules.measured(df, "bad", [rules.Rule(r.parts, 0, 0) for r in found])
    assert [(r.hit, r.bad) for r in again] == [(r.hit, r.bad) for r in found]
    for method in ("tree", "apriori"):
        assert rules.mine(df, "bad", ["qty", "disc", "tax"], rules.RuleSettings(method=method, min_lift=1.1, max_hit_rate=0.6))
    with pytest.raises(ValueError):
        rules.RuleSettings(method="magic")
    with pytest.warns(UserWarning):
        rules.mine(df.withColumn("bad", F.lit(2)), "bad", ["qty"])


def test_monitor_round_trip(spark, df, tables, tmp_path):
    own = df.withColumn("score", 600 - F.col("disc") * 10 - F.coalesce("tax", F.lit(0.0)) * 500)
    train, _, oot = samples(own)
    m = monitoring.baseline(train, "score", "bad", {"qty": tables["qty"]}, rules=monitoring.thresholds(psi_warn=0.0))
    same = m.track(train, "base", "score", "bad")
    assert same.psi_score == 0.0 and same.psi_features == {"qty": 0.0} and same.ks_decay == 0.0 and same.status == "ok"
    shifted = m.track(oot.withColumn("score", F.col("score") - 40), "late", "score", "bad")
    assert shifted.psi_score > 0 and shifted.status != "ok" and shifted.psi_trend > 0
    path = str(tmp_path / "m.json")
    m.save(path)
    held = monitoring.Monitor.load(path)
    assert held.history(spark).collect() == m.history(spark).collect()
    assert held.track(train, "again", "score").psi_score == 0.0
    m.add_snapshot(monitoring.Snapshot("older", 5, None, None, None, None, timestamp="2020-01-01T00:00:00+00:00"))
    rows = m.history(spark).collect()
    assert len(rows[0]) == 10 and rows[-1].timestamp.startswith("2020") and rows[0].timestamp > rows[-1].timestamp and m.latest_alerts() == []
    assert not monitoring.compare(1, "~", 1) and monitoring.compare(1, "==", 1 + 1e-12)


def test_monitor_from_a_chain_and_any_model(spark, df):
    train, test, oot = (d.drop("apply_date", "yr") for d in samples(df))
    chain = Chain().read(train, target="bad", test=test, oot=oot)
    with pytest.raises(RuntimeError):
        monitoring.from_chain(chain)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        chain.bin(n_bins=4, special_values=SPECIALS).transform().fit().scorecard().evaluate()
    m = monitoring.from_chain(chain)
    assert m.auc == pytest.approx(chain.evaluation_["trn_auc"], abs=1e-4) and set(m.features) == set(chain.support)
    assert set(monitoring.from_chain(chain, ["qty"]).features) == {"qty"}
    raw = chain.card.probability()
    own = metrics.evaluate(raw, chain.train, "bad", chain.test, chain.oot, chain.support)
    for k, v in chain.evaluation_.items():
        if k != "score_table":
            assert own[k] == (pytest.approx(v, abs=1e-4) if isinstance(v, float) else v), k
    assert metrics.evaluate(lambda d: raw, chain.train, "bad")["trn_auc"] == own["trn_auc"]

    class Fitted:
        def transform(self, frame):
            return frame.withColumn("probability", F.array(1 - raw, raw))

    assert metrics.evaluate(Fitted(), chain.train, "bad")["trn_ks"] == own["trn_ks"]
    with pytest.raises(TypeError):
        metrics.evaluate(3, chain.train, "bad")


def test_stream_tracks_batches(spark, df, tmp_path):
    own = df.select((600 - F.col("disc") * 10).alias("score"), "bad", F.col("yr").cast("string").alias("period"))
    own.repartition(2).write.parquet(f"{tmp_path}/in")
    m = monitoring.baseline(own, "score", "bad")
    stream = spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in")
    q = tracking.track_stream(stream, m, "score", "bad", "period", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert {s.period for s in m.snapshots} == {str(r[0]) for r in df.select("yr").distinct().collect()}
    counts = tracking.windowed_counts(df.select(F.col("apply_date").alias("ts"), "bad"), "ts", "30 days", "bad")
    assert counts.agg(F.sum("n")).first()[0] == df.count()


def test_diagnosis():
    bad = {"trn_ks": 0.4, "test_ks": 0.1, "oot_ks": 0.05, "trn_auc": 0.8, "test_auc": 0.58, "psi": 0.3, "psi_oot": 0.12, "n_vars": 14}
    found = diagnosis.diagnose(bad, psi_by_variable={"a": 0.5, "b": 0.01}, coef={"a": -0.1}, bad_rate=0.01)
    assert {i.category for i in found.critical} == {"discrimination", "overfitting", "stability"} and found and "a" in str(found)
    assert any(i.culprits == ("a",) for i in found.critical)
    assert not diagnosis.diagnose({"trn_ks": 0.4, "trn_auc": 0.8})
    strict = {"discrimination": {"ks_info": 0.5}, "unknown": {}}
    assert diagnosis.diagnose({"trn_ks": 0.4, "trn_auc": 0.8}, own_limits=strict).infos


def test_quality_and_estimators(df):
    train, _, oot = samples(df)
    rows = {r.variable: r for r in quality(train, "bad", FEATURES, test=oot).collect()}
    assert rows["prio"].auc is None and rows["qty"].auc >= 0.5 and rows["qty"].psi is not None
    assert estimator_name("Decision-Tree") == "dt"
    with pytest.raises(ImportError):
        estimator_name("xgboost")
    with pytest.raises(ValueError):
        estimator_name("svm")


def test_chain(df):
    train, test, oot = samples(df)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        chain = Chain(Spec(model={"odds": 20})).read(train, target="bad", test=test, oot=oot).detect().quality().prefilter(iv_range=(None, None)).bin(n_bins=5, special_values=SPECIALS)
        chain.refine(iv_range=(None, None)).transform().select(n_min=2, n_max=3, random_state=1).fit(pdo=20).scorecard().evaluate().diagnose()
        assert chain.card.odds == 20 and chain.card.pdo == 20 and 0 < chain.evaluation_["trn_ks"] < 1
        halted = Chain().read(train, target="bad").prefilter(iv_range=(9, None)).bin().transform
        assert callable(halted)
    with pytest.raises(RuntimeError):
        Chain().bin()
    with pytest.raises(ValueError):
        Chain().read(train, target="bad", test=test.drop("qty"))
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        stopped = Chain().read(train.select("qty", "bad"), target="bad").prefilter(iv_range=(9, None)).bin()
    assert stopped.halted and stopped.tables is None


def test_files(spark, tmp_path):
    presets = tmp_path / "p.csv"
    presets.write_text("variable,monotonic,special_values,dimension\nqty,increasing,\"-999, -1\",size\n,x,,\ntax,sideways,,rate\n")
    with pytest.warns(UserWarning):
        found = files.load_presets(str(presets))
    assert found.feature_config == {"qty": {"monotonic": "increasing", "special_values": (-999.0, -1.0)}, "tax": {}} and found.feature_belong == {"qty": "size", "tax": "rate"}
    table = tmp_path / "t.csv"
    table.write_text("SeriousDlqin2yrs,age,debt\n1,30,0.5\n0,40,NaN\n")
    own = files.prepare(files.read_csv(spark, str(table)))
    assert own.columns == ["target", "apply_year", "age", "debt"] and own.where("debt IS NULL").count() == 1
    with pytest.raises(ValueError):
        files.source_of(["a"])
    with pytest.raises(ValueError):
        files.checked_columns(own, target="nothing")
    wide = spark.createDataFrame([("Fully Paid", "Dec-2015", "13.5%", 1.0, 2.0), ("Charged Off", "2016-01-01", "9%", 2.0, 3.0), ("Current", "Dec-2015", "1%", 1.0, 2.0)], "loan_status string, issue_d string, int_rate string, dti double, total_pymnt double")
    rows = files.prepare(wide).orderBy("target").collect()
    assert [(r.target, r.apply_year, r.int_rate) for r in rows] == [(0, 2015, 13.5), (1, 2016, 9.0)] and "total_pymnt" not in rows[0]


def test_empty_and_small_inputs(spark):
    none = spark.createDataFrame([], "x double, y int")
    assert profile.quick_iv(none, "y", ["x"]).collect() == []
    with pytest.raises(ValueError):
        binning.fit(none, "y", ["x"])
    one = spark.createDataFrame([(1.0, 1)], "x double, y int")
    assert metrics.ks_auc(one, F.col("x"), "y", []).first().auc == 0.5
    with pytest.raises(ValueError):
        drift.stability(one.withColumn("t", F.lit(1)), "y", F.col("t"), ["x"])


def test_trees_equal_the_plain_version(spark):
    from tallymark.functions.kernels import INF, tree_cuts
    from tallymark.operators import trees

    own = spark.range(3000).select(
        (F.pmod(F.xxhash64("id"), F.lit(701)) / 7).alias("a"), F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("double")).alias("b"),
        F.lit(3.0).alias("c"), F.lit(None).cast("double").alias("d"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)) < F.pmod(F.xxhash64("id"), F.lit(701)) / 100).cast("int").alias("y"),
    )
    for most in ({"max_leaves": 6}, {"max_depth": 3}):
        found = trees.grow(own, "y", {c: F.col(c) for c in "abcd"}, dict.fromkeys("abcd", 20), **most)
        assert found["d"] == []
        for c in "abc":
            rows = [[x, bad, n - bad] for x, bad, n in sorted(own.where(f"{c} IS NOT NULL").groupBy(c).agg(F.sum("y"), F.count("*")).collect())]
            cuts = tree_cuts(rows, least=20, **most)
            assert [leaf.hi for leaf in found[c]] == [*cuts, INF] and len(cuts) > 0 or c == "c"
            for leaf in found[c]:
                inside = [r for r in rows if leaf.lo < r[0] <= leaf.hi]
                assert (leaf.bad, leaf.good) == (sum(r[1] for r in inside), sum(r[2] for r in inside))
