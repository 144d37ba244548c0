import pytest
from pyspark.sql import functions as F

from vigil.plans.fixtures import inputs, with_stand_in_model
from vigil.plans.rescore import as_known, rescore

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def i(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return inputs(spark, SF)


def test_scores_change_only_where_evidence_was_out_or_a_campaign_counted(i):
    rows = i.rescored.join(as_known(i.features, i.outage_context), ["tenant_id", "event_id"])
    whole = F.col("dep_recipient_graph") & F.col("dep_consortium") & F.col("dep_model_runtime")
    counts = rows.join(i.scored.select("event_id", "campaign_risk"), "event_id").agg(
        F.count_if(F.col("score_delta") > 0).alias("up"), F.count_if(F.col("score_delta") < 0).alias("down"),
        F.count_if(whole & (F.col("campaign_risk") == 0) & (F.col("score_delta") != 0)).alias("unfounded"),
        F.countDistinct("resilience_mode").alias("modes")).first()
    assert counts.up > 0 and counts.down > 0
    assert counts.unfounded == 0
    assert counts.modes >= 2


def test_without_the_graph_an_event_knows_its_own_transfer_alone(i):
    known = as_known(i.features, i.outage_context, with_stand_in_model).where("recipient_id is not null")
    alone = known.where("not dep_recipient_graph")
    assert alone.count() > 0
    assert alone.where("recipient_sender_diversity_24h <> 0.083333 or recipient_first_time_sender_ratio_24h <> 1"
                       " or recipient_rapid_cashout_ratio_1h <> 0").count() == 0
    assert known.where("not dep_model_runtime and model_score is not null").count() == 0
    both = known.where("dep_recipient_graph").select("event_id", "recipient_inflow_velocity_1h").exceptAll(
        i.features.select("event_id", "recipient_inflow_velocity_1h"))
    assert both.count() == 0


def test_repeated_unknown_and_no_entries(spark, i):
    entry = i.journal.where("status = 'pending'").select("tenant_id", "event_id").limit(1).collect()[0]
    journal = spark.createDataFrame([tuple(entry), tuple(entry), (entry.tenant_id, "no-such-event")], "tenant_id string, event_id string")
    got = rescore(i.features, journal, i.outage_context, i.consortium, i.sketches, with_stand_in_model, i.settings).collect()
    want = i.rescored.where(F.col("event_id") == entry.event_id).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
    assert rescore(i.features, journal.limit(0), i.outage_context, settings=i.settings).count() == 0
