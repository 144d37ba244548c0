"""Stored intermediates shared by the registered queries of one session and data folder."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import Settings
from vigil.functions.scalars import HOUR_US, rnd
from vigil.operators import exchange, integrity, reputation, resilience
from vigil.functions.storage import cut, cut_by
from vigil.plans.replay import Replay, replay
from vigil.plans.rescore import rescore
from vigil.plans.scoring import EVENT_KEY, decide_events, feature_table, scored_events
from vigil.sources import adapter

SETTINGS = Settings(
    sketch_reports_per_hour=3,
    institution_keys={f"bank-{i}": f"fixture-signing-key-{i}" for i in range(1, 5)},
)


def with_stand_in_model(features: DataFrame) -> DataFrame:
    """A fixed linear score in place of a trained model, so that every fusion path is exercised."""
    return features.withColumn(
        "model_score",
        F.when(
            F.col("channel") != "ussd",
            rnd(0.5 * F.col("balance_drain_ratio") + 0.3 * F.col("new_device") + 0.2 * F.col("new_sim")),
        ),
    )


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    settings: Settings = SETTINGS

    @cached_property
    def events(self) -> DataFrame:
        """The typed event table, stored once, in buckets of the key that all wide rows are joined by."""
        return cut_by(adapter.read_events(self.spark, self.sf_dir), EVENT_KEY, "events", spread=True)

    @cached_property
    def flat(self) -> DataFrame:
        return adapter.flat_events(self.spark, self.sf_dir)

    @cached_property
    def accounts(self) -> DataFrame:
        return adapter.read_accounts(self.spark, self.sf_dir)

    @cached_property
    def tenant_accounts(self) -> DataFrame:
        return self.events.select("tenant_id", "account_id").distinct()

    @cached_property
    def feedback(self) -> DataFrame:
        return adapter.feedback(self.spark, self.sf_dir)

    @cached_property
    def confirmed(self) -> DataFrame:
        return reputation.confirmed_from_feedback(self.feedback, self.events)

    @cached_property
    def features(self) -> DataFrame:
        return cut_by(feature_table(self.events, self.accounts, self.confirmed, self.settings), EVENT_KEY, "features")

    @cached_property
    def labelled_features(self) -> DataFrame:
        labels = adapter.labelled(self.spark, self.sf_dir)
        return self.features.join(labels, "event_id").withColumn("label", F.col("is_takeover"))

    @cached_property
    def reports(self) -> DataFrame:
        """Signed reports, with the marked ones forged."""
        signed = exchange.sign_reports(adapter.sketch_reports(self.spark, self.sf_dir), self.settings)
        return signed.withColumn(
            "signature", F.when(F.col("forged"), F.reverse("signature")).otherwise(F.col("signature"))
        ).drop("forged")

    @cached_property
    def admission(self) -> DataFrame:
        return cut(exchange.sketch_admission(self.reports, self.settings))

    @cached_property
    def admitted(self) -> DataFrame:
        return self.admission.filter("rejection is null and not replay")

    @cached_property
    def sketches(self) -> DataFrame:
        revocations = self.admitted.filter("withdrawn").select(
            "report_id", "institution_id", F.col("received_us").alias("revoked_us"))
        shared = exchange.tokenised(self.admitted, self.settings)
        return cut(exchange.sketch_latest(shared, revocations, self.settings))

    @cached_property
    def consortium(self) -> DataFrame:
        reports = adapter.consortium_reports(self.spark, self.sf_dir)
        return cut(exchange.consortium_scores(reports, self.settings))

    @cached_property
    def scored(self) -> DataFrame:
        return cut_by(scored_events(with_stand_in_model(self.features), self.consortium, self.sketches,
                                    self.settings), EVENT_KEY, "scored")

    @cached_property
    def unbudgeted(self) -> DataFrame:
        """Decisions without the intervention budget: the recorded log the budget counts."""
        return cut(decide_events(self.scored, settings=self.settings).select(
            "tenant_id", "event_id", "account_id", "ts_us", "fused_score", "amount", "action"))

    @cached_property
    def decisions(self) -> DataFrame:
        log = self.unbudgeted.select("tenant_id", "account_id", "ts_us", "action")
        return cut(decide_events(self.scored, log, self.settings))

    @cached_property
    def labelled_decisions(self) -> DataFrame:
        labels = adapter.labelled(self.spark, self.sf_dir)
        joined = self.decisions.join(labels, "event_id")
        return joined.withColumn("label", F.col("is_takeover")).withColumn("score", F.col("fused_score"))

    @cached_property
    def generic(self) -> DataFrame:
        scored = adapter.generic_scores(self.spark, self.sf_dir)
        return scored.withColumn("score", rnd(F.col("raw")))

    @cached_property
    def beats(self) -> DataFrame:
        signed = resilience.sign_heartbeats(adapter.heartbeats(self.spark, self.sf_dir), self.settings)
        return signed.withColumn(
            "signature", F.when(F.col("forged"), F.reverse("signature")).otherwise(F.col("signature"))
        ).drop("forged")

    @cached_property
    def beat_admission(self) -> DataFrame:
        return resilience.heartbeat_admit(self.beats, self.settings)

    @cached_property
    def timeline(self) -> DataFrame:
        admitted = self.beat_admission.filter("rejection is null")
        done = adapter.completions(self.spark, self.sf_dir)
        return cut(resilience.mode_timeline(admitted, done, self.settings))

    @cached_property
    def outage_context(self) -> DataFrame:
        capsules = adapter.edge_capsules(self.spark, self.sf_dir)
        return cut(resilience.context_asof(self.events, self.timeline, capsules, self.settings))

    @cached_property
    def incoming(self) -> DataFrame:
        """Events as they arrive: some are sent again an hour later, and some sign-ins carry an amount."""
        k = F.col("metadata")["k"].cast("int")
        sent = self.events.withColumn("amount", F.when(k % 43 == 0, 1.0).otherwise(F.col("amount")))
        again = sent.where(k % 50 == 0).withColumns({
            "occurred_at": F.col("occurred_at") + F.expr("interval 1 hour"), "ts_us": F.col("ts_us") + HOUR_US})
        return sent.unionByName(again)

    @cached_property
    def replayed(self) -> Replay:
        """The whole engine over the incoming events, each scored in its turn."""
        return replay(self.incoming, self.accounts, self.confirmed, self.feedback, self.outage_context, self.consortium,
                      self.sketches, with_stand_in_model, self.settings)

    @cached_property
    def chained(self) -> DataFrame:
        """Event log linked into one hash chain per tenant and day."""
        chain = F.concat_ws("/", "tenant_id", F.date_format("occurred_at", "yyyy-MM-dd"))
        body = F.concat_ws("|", F.col("ts_us").cast("string"), "event_type", "account_id", "event_id")
        rows = self.events.select("tenant_id", "occurred_at", "ts_us", "event_type", "account_id", "event_id")
        return cut(integrity.chain_append(rows, chain, ["ts_us", "event_id"], body))

    @cached_property
    def journal(self) -> DataFrame:
        """Decisions made while the tenant was not online, as pending journal entries."""
        context = self.outage_context.filter("resilience_mode <> 'online'")
        rows = self.unbudgeted.select("tenant_id", "event_id", "account_id", "ts_us", "fused_score", "amount")
        return rows.join(context.select("tenant_id", "event_id"), ["tenant_id", "event_id"]).select(
            "tenant_id", "event_id", "ts_us", F.col("fused_score").alias("risk_score"),
            F.col("ts_us").alias("sequence"),
            F.when(F.col("ts_us") % 3 == 0, "reconciled").otherwise("pending").alias("status"),
            (F.col("ts_us") % 17 == 0).alias("failed"))

    @cached_property
    def rescored(self) -> DataFrame:
        """Pending journal entries scored with the evidence of their time and with all of it restored."""
        pending = self.journal.filter("status = 'pending'")
        return cut(rescore(self.features, pending, self.outage_context, self.consortium, self.sketches, with_stand_in_model, self.settings))


_CACHE: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Inputs(spark, sf_dir)
    return _CACHE[key]
