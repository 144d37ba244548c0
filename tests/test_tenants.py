from pyspark.sql import functions as F

from vigil.operators import exchange


def test_events_of_two_tenants_with_one_id_keep_their_own_matches(spark):
    found = "tenant_id string, event_id string, kind string, score double, independent_institutions long, confidence double, active_reports long, status string"
    lookup = spark.createDataFrame(
        [("t", "e", "recipient", 0.7, 2, 0.9, 3, "shared_watch"), ("u", "e", "recipient", 0.3, 1, 0.5, 1, "observe_only"),
         ("u", "e", "campaign", 0.2, 1, 0.5, 1, "observe_only")], found)
    got = {r.tenant_id: (r.sketch_best, r.matches) for r in exchange.sketch_match(lookup).collect()}
    assert got == {"t": (0.7, 1), "u": (0.3, 2)}
    alone = exchange.sketch_match(lookup.drop("tenant_id")).collect()
    assert [(r.event_id, r.sketch_best, r.matches) for r in alone] == [("e", 0.7, 3)]


def test_indicators_carry_their_tenant(spark):
    staged = spark.createDataFrame([("t", "e", 5, "shop", 0.0), ("u", "e", 6, "mule", 0.7)],
                                   "tenant_id string, event_id string, ts_us long, recipient_id string, campaign_risk double").withColumns({
        "agent_assurance": F.lit(None).cast("struct<gateway_attested:boolean,terminal_token:string>"), "campaign_stages": F.array(F.lit("a"), F.lit("b"))})
    got = sorted((r.tenant_id, r.event_id, r.kind, r.value) for r in exchange.event_indicators(staged).collect())
    assert got == [("t", "e", "recipient", "shop"), ("u", "e", "campaign", "a|b"), ("u", "e", "recipient", "mule")]
