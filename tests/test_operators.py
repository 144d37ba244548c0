import hashlib
import hmac
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from vigil import config
from vigil.config import Settings
from vigil.functions.scalars import hmac_sha256
from vigil.operators import evaluation, exchange, integrity, policy, reputation
from vigil.operators.model import train_calibrated
from vigil.sources import io
from vigil.streaming.live import velocity_features

from builders import NOW, event, events, normal_history


def test_hmac_equals_library(spark):
    token = spark.range(1).select(hmac_sha256(F.lit("e1|abc"), "secret")).first()[0]
    assert token == hmac.new(b"secret", b"e1|abc", hashlib.sha256).hexdigest()


def test_consortium_counts_institutions(spark):
    schema = "recipient_id string, institution_id string, confidence double, created_us long, report_seq long"
    twice = [("r", "bank-a", 0.9, 1, 1), ("r", "bank-a", 0.95, 2, 2)]
    score = lambda rows: exchange.consortium_scores(spark.createDataFrame(rows, schema)).first()
    assert score(twice)["independent_institutions"] == 1 and score(twice)["consortium_score"] == 0
    both = score([*twice, ("R ", "bank-b", 0.85, 3, 3)])
    assert both["independent_institutions"] == 2 and both["consortium_score"] >= 0.85


def test_three_victims_quarantine_a_terminal(spark):
    rows = [("t", "k", f"acct_{i}", 1000 + i) for i in range(3)]
    log = spark.createDataFrame(rows, "tenant_id string, terminal_key string, account_id string, confirmed_us long")
    assert reputation.reputation(log, reputation.TERMINAL).first()["status"] == "quarantined"


def test_tampered_chain_reports_first_bad_row(spark):
    rows = spark.range(40).select(F.lit("c").alias("key"), "id", F.concat(F.lit("p"), "id").alias("payload"))
    chain = integrity.chain_append(rows, F.col("key"), ["id"], F.col("payload"))
    assert integrity.verify_chain(chain).first()["valid"]
    broken = chain.withColumn("body", F.when(F.col("sequence") == 7, "x").otherwise(F.col("body")))
    row = integrity.verify_chain(broken).first()
    assert not row["valid"] and row["first_invalid_sequence"] == 7 and row["entries_checked"] == 6


def _policy_row(spark, score, used, **features):
    zero = {n: 0.0 for n in config.FEATURES + config.AGENT_FEATURES}
    extra = {"campaign_risk": 0.0, "consortium_recipient_risk": 0.0, "fraud_sketch_risk": 0.0,
             "fraud_sketch_local_corroboration": 0.0, "fraud_sketch_pre_exchange_score": score}
    base = {**zero, **extra, **features, "fused_score": score, "confidence_score": 1.0, "amount": 5000.0}
    df = spark.createDataFrame([base]).withColumn("regret_used", F.lit(used)).withColumn(
        "regret_limit_30d", F.lit(3))
    return policy.decide(df).first()


def test_regret_budget(spark):
    free = _policy_row(spark, 0.60, 0)
    assert free["action"] in config.INTRUSIVE_ACTIONS
    spent = _policy_row(spark, 0.60, 3)
    assert config.ACTIONS.index(spent["action"]) < config.ACTIONS.index(free["action"])
    forced = _policy_row(spark, 0.70, 3, recovery_signal_72h=1.0, new_recipient=1.0)
    assert forced["budget_override_reason"] == config.OVERRIDE_CRITICAL


def test_wilson_and_bootstrap_bracket_the_point(spark):
    df = spark.range(2000).select(
        (F.col("id") % 40 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 40 == 0, (F.col("id") % 10) / 10.0 + 0.05).otherwise((F.col("id") % 97) / 200.0).alias("score"))
    point = evaluation.with_wilson(evaluation.operating_points(df, {"p": 0.48})).first()
    assert point["recall_low"] <= point["recall"] <= point["recall_high"]
    ci = {r["metric"]: r for r in evaluation.bootstrap_ci(df, 0.48, resamples=100).collect()}
    assert ci["recall"]["ci_lower"] <= point["recall"] <= ci["recall"]["ci_upper"]
    assert ci["recall"]["resamples"] == 100


def test_bootstrap_shuffles_totals_and_no_drawn_weights(spark):
    """The same draws as Spark's hash names, whatever ranges the scores are dealt by, from a row for each replicate and range."""
    scores = [None, 0.0, 0.25, 0.48, 0.481, 0.9, float("nan")]
    rows = [(s, k % 2, k) for k in range(40) for s in scores[: 1 + k % 7]]
    df = spark.createDataFrame(rows, "score double, label int, k int")
    hashed = df.select("score", F.posexplode(F.array(*[F.xxhash64("score", F.lit(r), F.lit(5), F.lit("p")) for r in range(1, 9)]))).distinct()
    value = np.array([np.nan if s is None else s for s in scores])
    mine = evaluation.uniforms(value, np.array([s is not None for s in scores]), np.arange(1, 9), 5, "p")
    for score, r, h in hashed.collect():
        at = next(i for i, s in enumerate(scores) if s == score or (s is not None and score is not None and s != s and score != score))
        assert mine[at, r] == (h % (1 << 52) + 0.5) / (1 << 52)
    ci = evaluation.bootstrap_ci(df, 0.48, resamples=50)
    assert "Generate explode(sequence" not in ci._jdf.queryExecution().executedPlan().toString()
    whole = sorted(ci.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(evaluation.bootstrap_ci(df, 0.48, resamples=50).collect()) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_round_trip_json_csv_parquet(spark, tmp_path):
    df = events(spark, normal_history(5))
    for fmt in ("parquet", "json", "csv"):
        io.write_events(df, str(tmp_path / fmt), fmt)
        back = io.read_events(spark, str(tmp_path / fmt), fmt).select("event_id", "amount", "ts_us")
        assert sorted(back.collect()) == sorted(df.select("event_id", "amount", "ts_us").collect())
    assert io.snapshot_manifest(spark, str(tmp_path / "parquet")).count() > 0


def test_stream_velocity_equals_batch(spark, tmp_path):
    rows = []
    for i in range(40):
        kind = ["purchase", "failed_login", "transfer", "login"][i % 4]
        rows.append(event(f"s-{i:03d}", f"a{i % 3}", NOW + timedelta(minutes=7 * i), event_type=kind))
    df = events(spark, rows).select("tenant_id", "account_id", "event_id", "ts_us", "event_type")
    df.repartition(1).sortWithinPartitions("ts_us").write.parquet(str(tmp_path / "in"))
    stream = velocity_features(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("velocity").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["event_id"]: r for r in spark.table("velocity").collect()}
    txn = ("purchase", "transfer")
    for e in rows:
        past = [r for r in rows if r["account_id"] == e["account_id"] and r["occurred_at"] < e["occurred_at"]]
        age = lambda r: e["occurred_at"] - r["occurred_at"]  # noqa: E731, B023
        row = got[e["event_id"]]
        assert row["txn_1h"] == sum(r["event_type"] in txn and age(r) <= timedelta(hours=1) for r in past)
        assert row["failed_24h"] == sum(r["event_type"] == "failed_login" for r in past)


def test_calibrated_forest(spark):
    base = spark.range(600).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    df = base.select(
        F.col("id").cast("string").alias("event_id"), "label",
        *[(F.col("label") * 0.6 + F.rand(i) * 0.4).alias(n) if i < 3 else F.rand(i).alias(n)
          for i, n in enumerate(config.MODEL_FEATURES)])
    model = train_calibrated(df, trees=5, depth=4, folds=2)
    scored = model.transform(df)
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("model_score").alias("m")).collect()}
    assert means[1] > means[0]


def test_sketch_score_needs_independent_institutions(spark):
    settings = Settings()
    schema = ("report_id string, indicator_type string, indicator_value string, institution_id string,"
              " confidence double, evidence_class string, observed_us long, ttl_hours int, received_us long")
    rows = [(f"r{i}", "recipient", "ACCT_9 ", bank, 0.9, "verified_account_takeover", 10**15, 200, 10**15)
            for i, bank in enumerate(["bank-a", "bank-b"])]
    shared = exchange.tokenised(spark.createDataFrame(rows, schema), settings)
    none = spark.createDataFrame([], "report_id string, institution_id string, revoked_us long")
    gone = spark.createDataFrame([("r1", "bank-b", 1), ("r0", "bank-b", 1)], none.schema)
    score = lambda rev: exchange.sketch_score(exchange.sketch_latest(shared, rev), 10**15).first()
    assert score(none)["status"] == "shared_watch"
    assert score(gone)["independent_institutions"] == 1  # bank-b cannot revoke bank-a's report
