"""Wide event rows are dealt to their buckets once; later joins move narrow rows alone."""

from datetime import timedelta

from pyspark.sql import functions as F

from vigil import config
from vigil.functions.storage import cut_by
from vigil.functions.wide import packed
from vigil.operators.policy import decide, safety_envelope
from vigil.operators.scoring import customer_explanation, reason_assembly
from vigil.operators.sender import sender_features
from vigil.plans.scoring import EVENT_KEY, all_features, decide_events, feature_table, scored_events, with_contexts

from builders import AGENT, NOW, event, events


def _rows():
    rows = [event(f"e{i:02d}", f"a{i % 3}", NOW + timedelta(hours=7 * i), event_type="transfer" if i % 2 else "login", amount=100.0 * (i % 2 * i),
                  recipient_id="r" if i % 2 else None, channel="agent" if i % 5 == 0 else "app", agent_assurance=AGENT if i % 5 == 0 else None)
            for i in range(24)]
    # A row that comes twice, an event id on two accounts and rows without an account or a tenant.
    return rows + [rows[7], {**rows[9], "account_id": "a9"}, {**rows[11], "account_id": None}, {**rows[13], "tenant_id": None}]


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _joins(df):
    """(name, whether the left side moves) of the joins on the way down the left sides of a plan."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    plan = plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        left = plan.children().apply(0)
        if plan.nodeName().endswith("Join"):
            out.append((plan.nodeName(), any("Exchange" in n.nodeName() for n in _nodes(left))))
        plan = left
    return out


def test_features_are_those_of_whole_rows(spark):
    rows = events(spark, _rows())
    confirmed = rows.where("recipient_id is not null").limit(3).select(
        "event_id", "tenant_id", "account_id", "recipient_id", F.lit(None).cast("string").alias("terminal_token"), (F.col("ts_us") + 1).alias("confirmed_us"))
    made = feature_table(cut_by(rows, EVENT_KEY, spread=True), None, confirmed).drop("metadata")
    whole = all_features(sender_features(with_contexts(rows, confirmed))).drop("metadata")
    assert made.columns == whole.columns and made.count() > 24
    assert made.exceptAll(whole).count() == whole.exceptAll(made).count() == 0


def test_wide_rows_stay_in_their_buckets(spark):
    features = cut_by(feature_table(cut_by(events(spark, _rows()[:6]), EVENT_KEY, spread=True)), EVENT_KEY)
    score = scored_events(features)
    assert _joins(score) == [("ShuffledHashJoin", False)]
    scored = cut_by(score, EVENT_KEY)
    log = scored.select("tenant_id", "account_id", "ts_us", F.lit(config.HOLD).alias("action"))
    decided = decide_events(scored, log)
    assert _joins(decided) == [("ShuffledHashJoin", False)]
    assert sorted(r["regret_used"] for r in decided.select("regret_used").collect()) == [0, 0, 0, 1, 1, 1]


def _copies(df, column):
    """Projections of a plan that write the column on its own."""
    plans = _nodes(df._jdf.queryExecution().optimizedPlan())
    return sum(plan.nodeName() == "Project" and column in [plan.output().apply(i).name() for i in range(plan.output().size())] for plan in plans)


def test_columns_that_no_step_reads_are_not_copied_by_each(spark):
    features = cut_by(feature_table(cut_by(events(spark, _rows()), EVENT_KEY, spread=True)), EVENT_KEY)
    scored = cut_by(scored_events(features), EVENT_KEY)
    # Laid out anew at the end, and once where the rest is packed.
    assert _copies(scored_events(features), "session_id") <= 3
    assert _copies(decide_events(scored), "session_id") <= 2
    whole = customer_explanation(reason_assembly(safety_envelope(decide(scored.withColumn("regret_used", F.lit(0).cast("long"))))))
    made = decide_events(scored)
    assert made.columns == whole.columns and made.dtypes == whole.dtypes
    made, whole = (df.drop("metadata").withColumn("action_costs", F.to_json("action_costs")) for df in (made, whole))
    assert made.count() > 24 and made.exceptAll(whole).count() == whole.exceptAll(made).count() == 0


def test_packed_columns_come_back_in_their_places(spark):
    df = spark.createDataFrame([(1, None, "x", 2.0), (None, "b", None, 3.0), (1, None, "x", 2.0)], "a int, b string, c string, d double")
    narrow, whole = packed(df, {"c", "unknown"})
    assert narrow.columns == ["c", "_rest"]
    done = whole(narrow.withColumn("c", F.upper("c")).withColumn("e", F.lit(5)))
    assert done.columns == ["a", "b", "c", "d", "e"]
    assert sorted(map(tuple, done.collect()), key=str) == [(1, None, "X", 2.0, 5), (1, None, "X", 2.0, 5), (None, "b", None, 3.0, 5)]
    keys = df.select("c").distinct().withColumn("f", F.lit(1))
    assert whole(narrow.join(keys, "c"), ["c"]).columns == df.join(keys, "c").columns
    assert packed(df, {"a", "b", "c"})[0].columns == df.columns
