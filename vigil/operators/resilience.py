"""Outage resilience: heartbeats, mode timeline, context at event time, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import HOUR_US, from_micros, hmac_from_pads
from vigil.functions.storage import cut
from vigil.operators.asof import as_of
from vigil.operators.exchange import with_institution_key
from vigil.operators.topk import top_per_key

DEPS = [f"dep_{name}" for name in config.DEPENDENCIES]


def heartbeat_material() -> Column:
    return F.concat_ws("|", "institution_id", F.col("at_us").cast("string"), "nonce",
                       *[F.col(d).cast("string") for d in DEPS])


def sign_heartbeats(beats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    keyed = with_institution_key(beats, settings)
    return keyed.withColumn(
        "signature", hmac_from_pads(heartbeat_material(), F.col("inner_pad"), F.col("outer_pad"))
    ).drop("institution", "inner_pad", "outer_pad")


def heartbeat_admit(beats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each heartbeat with its rejection: stale, bad signature, or reused nonce (null = admitted).

    Needs at_us (observed), received_us, nonce, institution_id, the dep_ flags and signature.
    """
    keyed = with_institution_key(beats, settings)
    expected = hmac_from_pads(heartbeat_material(), F.col("inner_pad"), F.col("outer_pad"))
    stale = F.abs(F.col("received_us") - F.col("at_us")) > settings.heartbeat_max_age_seconds * 1_000_000
    basic = F.when(stale, "stale").when(
        ~F.coalesce(expected == F.col("signature"), F.lit(False)), "signature_invalid")
    checked = keyed.select(*beats.columns, basic.alias("rejection"))
    first = checked.filter("rejection is null").groupBy("nonce").agg(
        F.min(F.struct("received_us", "heartbeat_id")).alias("first_claim"))
    return checked.join(first, "nonce", "left").withColumn(
        "rejection",
        F.when(F.col("rejection").isNotNull(), F.col("rejection"))
        .when(F.struct("received_us", "heartbeat_id") > F.col("first_claim"), "nonce_reused"),
    ).drop("first_claim")


def _after(start: Column, ok: Column, early: Column, done: Column) -> Column:
    """The mode that a stretch without unhealthy heartbeats makes of ``start``.

    ``ok``: it has a healthy heartbeat; ``early``: a completion before any; ``done``: a completion after one.
    """
    return (
        F.when(done, "online")
        .when(start == "reconciling", F.when(early, "online").otherwise("reconciling"))
        .when(start.isin("degraded", "isolated") & ok, "reconciling")
        .otherwise(start)
    )


def _composed(steps: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Adds the composition of all steps of ``part`` up to each row: the mode last set (``start``, null: none) and the stretch since.

    A step sets a mode (``reset``), is a healthy heartbeat (``ok``) or a completion (``completion``).  All compositions of such
    steps are of this form, so the prefix is four running values; the second pair of windows keeps the first one's partitioning.
    """
    steps = steps.withColumn("_stretch", F.count("reset").over(Window.partitionBy(*part).orderBy(*order)))
    sofar = Window.partitionBy(*part, "_stretch").orderBy(*order)
    steps = steps.withColumns({"start": F.max("reset").over(sofar), "seen_ok": F.max("ok").over(sofar)})
    return steps.withColumns({
        "early": F.max(F.col("completion") & ~F.col("seen_ok")).over(sofar),
        "done": F.max(F.col("completion") & F.col("seen_ok")).over(sofar),
    }).drop("_stretch")


def mode_timeline(beats: DataFrame, completions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Admitted heartbeats with the tenant's mode after each.

    The state machine as composed transitions, in two levels: steps are composed inside (tenant, days), the compositions of a
    tenant's days are composed in turn, and a row's mode is its own composition applied to the mode its day began with.  A
    heartbeat comes before a completion of the same time, heartbeats of one time go by heartbeat_id.  Needs a tenant.
    """
    healthy = F.lit(True)
    for d in DEPS:
        healthy = healthy & F.col(d)
    down = F.when(~F.col("dep_core_banking"), "isolated").when(~healthy, "degraded")
    steps = beats.select(
        "tenant_id", F.col("at_us").alias("_at"), F.lit(0).alias("_kind"), F.col("heartbeat_id").alias("_id"), down.alias("reset"),
        healthy.alias("ok"), F.lit(False).alias("completion"), F.struct(*beats.columns).alias("beat"),
    ).unionByName(completions.select(
        "tenant_id", F.col("at_us").alias("_at"), F.lit(1).alias("_kind"), F.lit(False).alias("ok"), F.lit(True).alias("completion"),
    ), allowMissingColumns=True)
    days = F.floor(F.col("_at") / (24 * settings.bucket_hours * HOUR_US)).cast("long")
    within = cut(_composed(steps.withColumn("_b", days), ["tenant_id", "_b"], ["_at", "_kind", "_id"]), "steps")

    last = within.groupBy("tenant_id", "_b").agg(
        F.max_by(F.struct("start", "seen_ok", "early", "done"), F.struct("_at", "_kind", "_id")).alias("c"))
    # What a day does to a mode, as at most two steps again: a mode that it sets, or a completion and then a healthy heartbeat.
    mode = _after(F.col("c.start"), F.col("c.seen_ok"), F.col("c.early"), F.col("c.done"))
    days_steps = last.select("tenant_id", "_b", mode.alias("reset"), "c.early", "c.seen_ok").select(
        "tenant_id", "_b", "reset", F.explode(F.when(F.col("reset").isNotNull(), F.array(F.lit(0))).otherwise(
            F.array_compact(F.array(F.when(F.col("early"), 1), F.when(F.col("seen_ok"), 2))))).alias("_kind"),
    ).withColumns({"completion": F.col("_kind") == 1, "ok": F.col("_kind") == 2})
    ends = _composed(days_steps, ["tenant_id"], ["_b", "_kind"]).groupBy("tenant_id", "_b").agg(F.max_by(
        _after(F.coalesce("start", F.lit("online")), F.col("seen_ok"), F.col("early"), F.col("done")), "_kind").alias("end"))
    begins = ends.select("tenant_id", "_b", F.coalesce(
        F.lag("end").over(Window.partitionBy("tenant_id").orderBy("_b")), F.lit("online")).alias("begin"))

    known = within.filter("_kind = 0").join(begins, ["tenant_id", "_b"])
    at = _after(F.coalesce("start", "begin"), F.col("seen_ok"), F.col("early"), F.col("done"))
    return known.select("beat.*", at.alias("mode"))


def confidence_multiplier(mode: Column, model_available: Column, capsule_valid: Column) -> Column:
    base = (
        F.when(mode == "online", 1.0)
        .when(mode == "degraded", F.when(~model_available, 0.72).otherwise(0.82))
        .when(mode == "isolated", 0.35).otherwise(0.75)
    )
    return F.when((mode != "online") & ~capsule_valid, F.least(base, F.lit(0.25))).otherwise(base)


def context_asof(
    events: DataFrame, timeline: DataFrame, capsules: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Events (tenant_id, event_id, ts_us) with mode, missing sources and multiplier at their time.

    ``capsules`` (tenant_id, issued_us) are valid for ``edge_capsule_ttl_hours``.
    """
    # Heartbeats of one time are one change, as are repeated capsules.
    states = timeline.groupBy("tenant_id", F.col("at_us").alias("at")).agg(F.max(F.struct("mode", *DEPS)).alias("state"))
    issued = capsules.select("tenant_id", F.col("issued_us").alias("at"), "issued_us").distinct()
    asked = events.select("tenant_id", F.col("ts_us").alias("at"), "event_id")
    found = as_of(as_of(asked, states, ["tenant_id"], "at", ["state"]), issued, ["tenant_id"], "at", ["issued_us"])
    mode = F.coalesce(F.col("state.mode"), F.lit("online"))
    valid = F.coalesce(
        F.col("at") < F.col("issued_us") + settings.edge_capsule_ttl_hours * HOUR_US, F.lit(False))
    flags = {d: F.coalesce(F.col(f"state.{d}"), F.lit(True)) for d in DEPS}
    missing = F.sort_array(F.array_compact(F.array(
        *[F.when(~flags[f"dep_{n}"], F.lit(n)) for n in config.DEPENDENCIES])))
    return found.select(
        "tenant_id", "event_id", mode.alias("resilience_mode"), valid.alias("capsule_valid"),
        confidence_multiplier(mode, flags["dep_model_runtime"], valid).alias("confidence_multiplier"),
        F.array_join(missing, "|").alias("unavailable_sources"),
        *[flags[d].alias(d) for d in DEPS],
    )


def reconcile_plan(journal: DataFrame, batch: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Pending entries per tenant, highest risk first, at most one batch; stops at the failure budget.

    Needs tenant_id, sequence, risk_score, status and failed (whether the re-score cannot be done).
    """
    size = batch or settings.recovery_batch_size
    budget = max(1, min(5, size // 10))
    pending = journal.filter("status = 'pending'")
    chosen = top_per_key(pending, ["tenant_id"], [F.col("risk_score").desc(), F.col("sequence")], size,
                         "event_id")
    upto = Window.partitionBy("tenant_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    failures = F.coalesce(F.sum(F.col("failed").cast("int")).over(upto), F.lit(0))
    return chosen.withColumn("processed", failures < budget)


def resilience_status(journal: DataFrame) -> DataFrame:
    pending = F.col("status") == "pending"
    return journal.groupBy("tenant_id").agg(
        F.count_if(pending).alias("pending_events"),
        from_micros(F.min(F.when(pending, F.col("ts_us")))).alias("oldest_pending_at"),
    )


def reconcile_delta(original: DataFrame, restored: DataFrame) -> DataFrame:
    """Change of score after re-scoring journalled events with restored evidence; keeps further columns of ``restored``."""
    key = ["tenant_id", "event_id"]
    before = original.select(*key, F.col("fused_score").alias("original_score"))
    return before.join(restored.withColumnRenamed("fused_score", "restored_score"), key).withColumn(
        "score_delta",
        F.floor((F.col("restored_score") - F.col("original_score")) * 1_000_000.0 + 0.5) / 1_000_000.0,
    )
