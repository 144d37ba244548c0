"""Cross-account campaign memory: attack stages shared by several accounts within a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions import rules
from vigil.functions.scalars import HOUR_US, rnd
from vigil.operators.timeline import interval_deltas, neighbours, running_at


def campaign_stages(df: DataFrame) -> DataFrame:
    """Adds campaign_stages (sorted) and campaign_signature."""
    found = F.array_compact(F.array(*[F.expr(x) for x in rules.campaign_stage_items()]))
    df = df.withColumn(
        "campaign_stages", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ordinary")))
    )
    return df.withColumn(
        "campaign_signature",
        F.substring(F.sha2(F.array_join("campaign_stages", "|"), 256), 1, 20),
    )


def campaign_accounts(staged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, event_id, campaign_accounts): distinct accounts with the same signature in the last
    24 h, the event included.

    The commonest signature covers most rows, so the distinct count runs on merged per-account
    intervals and two-level running sums instead of a set per signature.
    """
    width = F.lit(settings.campaign_window_hours * HOUR_US)
    bucket = settings.bucket_hours * HOUR_US
    narrow = staged.select("tenant_id", "campaign_signature", "account_id", "event_id", "ts_us")
    near = neighbours(narrow, ["tenant_id", "campaign_signature", "account_id"], "ts_us", "event_id",
                      F.lit(True), bucket)
    t, prev, nxt = F.col("ts_us"), F.col("prev_at"), F.col("next_at")
    deltas = near.select(
        "tenant_id", "campaign_signature",
        F.inline(interval_deltas(
            [
                (F.when(prev.isNull() | (prev < t - width), t), {"campaign_accounts": F.lit(1)}),
                (F.when(nxt.isNull() | (nxt > t + width), t + width + 1),
                 {"campaign_accounts": F.lit(-1)}),
            ], ["campaign_accounts"], {"campaign_accounts": "bigint"},
        )),
    )
    queries = narrow.select("tenant_id", "campaign_signature", F.col("ts_us").alias("at"), "event_id")
    return running_at(deltas, queries, ["tenant_id", "campaign_signature"], "at",
                      sums=["campaign_accounts"], bucket_us=bucket).select(
        "tenant_id", "event_id", "campaign_accounts")


def campaign_eligible() -> Column:
    material = F.array(*[F.lit(s) for s in config.MATERIAL_STAGES])
    return (F.size("campaign_stages") >= 3) & F.arrays_overlap("campaign_stages", material)


def campaign_score() -> Column:
    return F.when(
        campaign_eligible(),
        rnd(F.least(F.lit(0.92), F.lit(0.28) + F.col("campaign_accounts") * 0.13
                    + F.size("campaign_stages") * 0.07)),
    ).otherwise(F.lit(0.0))


def without_campaign(df: DataFrame) -> DataFrame:
    """The columns of ``with_campaign`` where no campaign counts as evidence."""
    return campaign_stages(df).withColumns({
        "campaign_accounts": F.lit(0).cast("long"), "campaign_is_eligible": F.lit(False), "campaign_risk": F.lit(0.0)})


def with_campaign(
    df: DataFrame, settings: Settings = DEFAULTS, accounts: DataFrame | None = None
) -> DataFrame:
    """Adds stages, signature, accounts, eligibility and campaign_risk to a (stored) feature table.

    ``accounts`` is a stored result of ``campaign_accounts``, when one exists.
    """
    staged = campaign_stages(df)
    counts = campaign_accounts(staged, settings) if accounts is None else accounts
    counted = staged.join(counts.hint("shuffle_hash"), ["tenant_id", "event_id"])
    return counted.withColumn("campaign_is_eligible", campaign_eligible()).withColumn(
        "campaign_risk", campaign_score()
    )
