"""The engine replayed over recorded events: decisions feed the trust and the budget of later ones.

An event of an account is scored against what the account had learned by then.  It was learned from earlier events whose own
decisions were safe, once their quarantine had passed, and which no feedback had revoked; and the response to it depends on how
many interventions the account has had in the last 30 days.  So decisions depend on earlier decisions.

The replay is a fixpoint.  A first round takes every event as safe; each round computes decisions from the trust that the
round before left, and goes on with the accounts whose trust it changed.  Every dependency points to an earlier time, so a round
settles at least the next event of every chain and the rounds end at the one result of a walk in time order; only
accounts that still change are computed again.  What no decision touches (contexts of recipients, terminals and reputation, and
sliding counts) is computed and stored once.

Before that, events pass the checks of the service: validation, repeats, evidence that is stale or whose source is out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.storage import cut
from vigil.operators import learning, policy, validate
from vigil.operators.campaign import campaign_accounts, campaign_stages
from vigil.operators.resilience import DEPS
from vigil.operators.scoring import customer_explanation, reason_assembly
from vigil.operators.sender import window_history, with_learned
from vigil.plans.scoring import EVENT_KEY, features_from, scored_events, with_contexts

ACCOUNT = ["tenant_id", "account_id"]


def admit(events: DataFrame, outage: DataFrame | None = None, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) events; both carry ``rejections``, the accepted ones the outage context of their time.

    Of events that repeat a tenant's event id the earliest counts (then the smallest hash of its row).  Evidence of a gateway that
    is out, and evidence observed too long before or after, loses its attestation.  ``outage`` is a result of ``context_asof``.
    """
    checked = validate.validate_events(events)
    plain = [c for c in events.columns if events.schema[c].dataType.typeName() not in ("map", "variant")]
    order = F.struct("ts_us", F.xxhash64(*plain), F.monotonically_increasing_id())
    numbered = cut(checked.withColumn("_order", order), "checked")
    first = numbered.where(F.size("violations") == 0).groupBy(*EVENT_KEY).agg(F.min("_order").alias("_first"))
    marked = numbered.join(first, EVENT_KEY, "left").withColumn("rejections", F.when(
        F.col("_order") > F.col("_first"), F.array_append("violations", F.lit("duplicate_event"))).otherwise(F.col("violations"))).drop("_order", "_first", "violations")
    rejected = marked.where(F.size("rejections") > 0)
    accepted = marked.where(F.size("rejections") == 0)
    known = {"resilience_mode": F.lit("online"), "confidence_multiplier": F.lit(1.0), **{d: F.lit(True) for d in DEPS}}
    if outage is None:
        accepted = accepted.withColumns(known)
    else:
        context = outage.select(*EVENT_KEY, *known)
        accepted = accepted.join(context, EVENT_KEY, "left").withColumns({c: F.coalesce(c, v) for c, v in known.items()})
    return validate.enforce_freshness(validate.mask_unavailable(accepted), settings), rejected


def without_graph(df: DataFrame) -> DataFrame:
    """Where the recipient graph was out, an event knows of its own transfer alone."""
    alone = {"unique_senders_24h": 1.0, "first_time_sender_ratio_24h": 1.0, "inflow_amount_1h": 0.0, "outflow_amount_1h": 0.0, "rapid_cashout_ratio_1h": 0.0,
             "current_sender_first_time": 1.0}
    out = ~F.col("dep_recipient_graph") & F.col("recipient_id").isNotNull()
    return df.withColumns({c: F.when(out, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in alone.items()})


def trust_times(decisions: DataFrame, feedback: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, account_id, event_id, from_us, to_us): when a decided event counts as profile evidence.

    A safe decision made online is learned from once its quarantine has passed; an event's last feedback revokes it from then
    on, or makes it trusted from then on at the latest.  Events that are never learned from have no row.
    """
    decided = learning.trust_state(decisions.withColumn("created_us", F.col("ts_us")), settings).select(
        *ACCOUNT, "event_id", F.col("eligible_after_us").alias("from_us"))
    if feedback is None:
        return decided.where("from_us is not null").withColumn("to_us", F.lit(None).cast("long"))
    last = learning.feedback_trust(feedback).groupBy("event_id").agg(
        F.max(F.struct(F.col("confirmed_us"), F.col("trust_state"))).alias("last")).select("event_id", "last.*")
    both = decided.join(last, "event_id", "left")
    return both.select(
        *ACCOUNT, "event_id",
        F.when(F.col("trust_state") == "trusted", F.least("from_us", "confirmed_us")).otherwise(F.col("from_us")).alias("from_us"),
        F.when(F.col("trust_state") == "revoked", F.col("confirmed_us")).alias("to_us"),
    ).where("from_us is not null and (to_us is null or from_us < to_us)")


def with_budget(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Decisions of stored scores, each with the count of interventions that the account's own earlier decisions made.

    A fixpoint of its own: counts follow from actions and actions from counts; the rounds end when no count changes.
    """
    asked = cut(scored.select("tenant_id", "account_id", "ts_us", "event_id"), "asked")
    used = cut(asked.select(*EVENT_KEY, F.lit(0).cast("long").alias("regret_used")), "regret")
    while True:
        decided = policy.safety_envelope(policy.decide(scored.join(used, EVENT_KEY)))
        # Stored before it is filtered: a filter would repeat the whole nested rule for the action.
        taken = cut(decided.select("tenant_id", "account_id", "ts_us", "action"), "actions")
        fresh = cut(policy.regret_used(asked, taken, settings=settings).select(*EVENT_KEY, "regret_used"), "regret")
        changed = fresh.join(used.withColumnRenamed("regret_used", "before"), EVENT_KEY).where("regret_used <> before").limit(1).count()
        used = fresh
        if not changed:
            return policy.safety_envelope(policy.decide(scored.join(used, EVENT_KEY)))


@dataclass
class Replay:
    """Stored results of a replay: decisions of all accepted events, the rejected ones, and the times of trust."""

    decisions: DataFrame
    rejected: DataFrame
    trust: DataFrame
    #: Events whose trust each round changed; the last is 0.
    changes: list[int] = field(default_factory=list)


def _replaced(old: DataFrame, new: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """``old`` without the keys in ``rows``, and ``new``."""
    return old.join(rows, keys, "left_anti").select(*new.columns).unionByName(new)


def _differences(one: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys (and the account) of rows that are only in one table or differ in a value."""
    a = one.select(*keys, F.struct(*values).alias("_a"))
    b = other.select(*keys, F.struct(*values).alias("_b"))
    return a.join(b, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def replay(
    events: DataFrame,
    accounts: DataFrame | None = None,
    confirmed: DataFrame | None = None,
    feedback: DataFrame | None = None,
    outage: DataFrame | None = None,
    consortium: DataFrame | None = None,
    sketches: DataFrame | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None,
    settings: Settings = DEFAULTS,
) -> Replay:
    """Score recorded events as if each had been scored in its turn.

    ``feedback`` (event_id, label, confirmed_us) moves trust, ``confirmed`` the reputations, ``model`` adds model_score to features.
    """
    accepted, rejected = admit(events, outage, settings)
    accepted = cut(accepted.drop("rejections"), "accepted")
    contexts = cut(without_graph(with_contexts(accepted, confirmed, settings)), "contexts")
    until = contexts.agg(F.max("ts_us")).first()[0]
    steady = cut(window_history(contexts, settings, until), "steady")

    def features_with(trust: DataFrame, some: DataFrame | None) -> DataFrame:
        own, history = accepted, steady
        if some is not None:
            own, history, trust = own.join(some, ACCOUNT, "left_semi"), history.join(some, ACCOUNT, "left_semi"), trust.join(some, ACCOUNT, "left_semi")
        made = features_from(with_learned(history, own, settings, trust, until), contexts.columns, accounts)
        if model is not None:
            made = model(made)
            made = made.withColumn("model_score", F.when(F.col("dep_model_runtime"), F.col("model_score")))
        return made

    # The optimistic start: every event made online is safe.
    safe = accepted.select(*ACCOUNT, "event_id", "ts_us", F.lit(config.ALLOW).alias("action"), F.lit(0.0).alias("fused_score"), "resilience_mode")
    trust = cut(trust_times(safe, feedback, settings), "trust")
    features = cut(features_with(trust, None), "features")
    campaign = cut(campaign_accounts(campaign_stages(features), settings), "campaign")
    scored = cut(scored_events(features, consortium, sketches, settings, campaign), "scored")
    decided = cut(with_budget(scored, settings), "decided")
    changes: list[int] = []
    while True:
        after = cut(trust_times(decided, feedback, settings), "trust")
        moved = cut(_differences(after, trust, [*ACCOUNT, "event_id"], ["from_us", "to_us"]), "moved")
        changes.append(moved.count())
        trust = after
        if not changes[-1]:
            break
        stirred = cut(moved.select(*ACCOUNT).distinct(), "stirred")
        fresh = cut(features_with(trust, stirred), "features")
        features = cut(_replaced(features, fresh, ACCOUNT, stirred), "features")
        shared = cut(campaign_accounts(campaign_stages(features), settings), "campaign")
        # Scores of the accounts themselves, and of events that share a campaign with them.
        keys = features.select(*ACCOUNT, "event_id")
        joined = _differences(shared, campaign, EVENT_KEY, ["campaign_accounts"])
        again = cut(keys.join(stirred, ACCOUNT, "left_semi").select(*EVENT_KEY).union(joined).distinct(), "again")
        campaign = shared
        rescored = cut(scored_events(cut(features.join(again, EVENT_KEY, "left_semi"), "rescore"), consortium, sketches, settings, campaign), "rescored")
        scored = cut(_replaced(scored, rescored, EVENT_KEY, again), "scored")
        touched = cut(keys.join(again, EVENT_KEY, "left_semi").select(*ACCOUNT).distinct(), "touched")
        redone = cut(with_budget(cut(scored.join(touched, ACCOUNT, "left_semi"), "rebudget"), settings), "redone")
        decided = cut(_replaced(decided, redone, ACCOUNT, touched), "decided")
    return Replay(cut(customer_explanation(reason_assembly(decided)), "replayed"), cut(rejected, "rejected"), trust, changes)
