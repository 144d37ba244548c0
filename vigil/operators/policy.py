"""Reversible response selection with a soft intervention budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions import rules
from vigil.functions.scalars import DAY_US, HOUR_US
from vigil.operators.timeline import running_at


def regret_used(
    queries: DataFrame, decisions: DataFrame, days: int = 30, settings: Settings = DEFAULTS
) -> DataFrame:
    """Queries (tenant_id, account_id, ts_us, payload) with the count of intrusive decisions of the
    account in the ``days`` before them.

    ``decisions`` (tenant_id, account_id, ts_us, action) is the recorded log, so the result is a pure
    query and does not recurse into the decisions being made.
    """
    taken = decisions.filter(F.col("action").isin(config.INTRUSIVE_ACTIONS)).select(
        "tenant_id", "account_id",
        F.inline(F.array(
            F.struct((F.col("ts_us") + 1).alias("at"), F.lit(1).cast("long").alias("regret_used")),
            F.struct((F.col("ts_us") + days * DAY_US + 1).alias("at"),
                     F.lit(-1).cast("long").alias("regret_used")),
        )),
    )
    asked = queries.withColumnRenamed("ts_us", "at")
    found = running_at(taken, asked, ["tenant_id", "account_id"], "at", sums=["regret_used"],
                       bucket_us=24 * settings.bucket_hours * HOUR_US)
    return found.withColumnRenamed("at", "ts_us")


def action_costs(df: DataFrame) -> DataFrame:
    """Adds cost_0 .. cost_4, one per base action in ascending severity."""
    return df.select(
        "*",
        *[
            F.expr(rules.cost(config.RESIDUAL_LOSS[a], config.BASE_FRICTION[a])).alias(f"cost_{i}")
            for i, a in enumerate(config.RESIDUAL_LOSS)
        ],
    )


def critical_signal(df: DataFrame) -> DataFrame:
    return df.withColumn("critical_signal", F.expr(rules.CRITICAL))


def decide(df: DataFrame) -> DataFrame:
    """Adds the policy outcome.

    Needs fused_score, confidence_score, amount, regret_used, regret_limit_30d and the feature columns.
    """
    df = critical_signal(action_costs(df)).withColumn("action_0", F.expr(rules.banded_action()))
    df = df.withColumn("action_1", F.expr(rules.ceiling_action()))
    df = df.withColumn("action_2", F.expr(rules.confident_action()))
    df = df.withColumn("action", F.expr(rules.budget_action())).withColumn(
        "override_code", F.expr(rules.override_code())
    )
    pause = F.expr(rules.cost(config.SAFE_PAUSE_RESIDUAL, config.SAFE_PAUSE_FRICTION))
    costs = F.create_map(
        *[x for i, a in enumerate(config.RESIDUAL_LOSS) for x in (F.lit(a), F.col(f"cost_{i}"))],
        F.lit(config.SAFE_PAUSE), F.when(F.col("action_1") == config.SAFE_PAUSE, pause),
    )
    overrides = {
        "low_confidence": config.OVERRIDE_LOW_CONFIDENCE, "critical": config.OVERRIDE_CRITICAL,
        "delay": config.OVERRIDE_DELAY, "step_up": config.OVERRIDE_STEP_UP,
    }
    reason = F.lit(None).cast("string")
    for code, message in overrides.items():
        reason = F.when(F.col("override_code") == code, F.lit(message)).otherwise(reason)
    personal = F.array_compact(F.array(
        F.when(F.expr(f"{rules.REGRET_RATIO} >= 1.0"), F.lit(config.PERSONAL_BUDGET)),
        F.when(F.col("is_ussd") > 0, F.lit(config.PERSONAL_USSD)),
        F.when(F.col("recurring_payment_match") >= 0.80, F.lit(config.PERSONAL_RECURRING)),
        F.when(F.col("confidence_score") < 0.45, F.lit(config.PERSONAL_LOW_CONFIDENCE)),
        F.when(F.expr(rules.SINGLE_REPORT), F.lit(config.PERSONAL_SINGLE_REPORT)),
        F.when(F.expr(rules.SKETCH_ALONE), F.lit(config.PERSONAL_SKETCH_MONITOR)),
        F.when(F.expr(f"action_0 = '{config.HOLD}' and {rules.SKETCH_CEILING} and not"
                      f" ({rules.SINGLE_REPORT} or {rules.SKETCH_ALONE})"),
               F.lit(config.PERSONAL_SKETCH_DELAY)),
    ))
    intrusive = F.col("action").isin(config.INTRUSIVE_ACTIONS)
    out = df.select(
        "*",
        F.expr(rules.hold_seconds("action")).alias("hold_seconds"),
        intrusive.alias("requires_trusted_confirmation"),
        (F.col("action") == config.HOLD).alias("requires_analyst_review"),
        intrusive.alias("budget_consumed"),
        reason.alias("budget_override_reason"),
        costs.alias("action_costs"),
        F.coalesce(costs[F.col("action")], F.lit(0.0)).alias("selected_expected_cost"),
        F.when(F.size(personal) > 0, personal).otherwise(F.array(F.lit(config.PERSONAL_STANDARD)))
        .alias("personalization_reasons"),
    )
    return out.drop("action_0", "action_1", "action_2", *[f"cost_{i}" for i in range(5)])


def safety_envelope(df: DataFrame) -> DataFrame:
    """Escalates the action while trusted services are out; needs action and resilience_mode."""
    rank = F.expr(rules.envelope_rank("action", "resilience_mode"))
    moved = F.expr(rules.rank_action("_rank"))
    mode = F.col("resilience_mode")
    reason = (
        F.when(mode == "online", F.lit(None))
        .when((mode == "isolated") & (F.col("amount") > 0), F.lit(config.OUTAGE_ISOLATED))
        .when(F.expr(rules.RISKY_CHANGE) & (F.col("amount") > 0), F.lit(config.OUTAGE_RISKY))
        .when(F.col("action") == config.ALLOW, F.lit(config.OUTAGE_MONITOR))
    )
    df = df.withColumn("_rank", rank).withColumn("outage_reason", reason)
    df = df.withColumn("_moved", moved)
    changed = F.col("_moved") != F.col("action")
    return df.select(
        *[c for c in df.columns if c not in (
            "_rank", "_moved", "action", "hold_seconds", "requires_trusted_confirmation",
            "requires_analyst_review", "budget_consumed")],
        F.col("_moved").alias("action"),
        F.when(changed, F.greatest("hold_seconds", F.expr(rules.hold_seconds("_moved"))))
        .otherwise(F.col("hold_seconds")).alias("hold_seconds"),
        F.col("_moved").isin(config.INTRUSIVE_ACTIONS).alias("requires_trusted_confirmation"),
        (F.col("_moved") == config.HOLD).alias("requires_analyst_review"),
        F.col("_moved").isin(config.INTRUSIVE_ACTIONS).alias("budget_consumed"),
        F.col("outage_reason").isNotNull().alias("safety_envelope_applied"),
    )
