"""Journalled events scored again once the services that were out have returned.

Two versions of the evidence of one event stand side by side.  The first is what was known at its time: where the recipient graph
was out it knows of its own transfer alone, without the model runtime there is no model score, and without the exchange neither
consortium nor sketches; the campaign counts as it was seen.  The second has all of them back and leaves the campaign out, as
other accounts' later decisions must not reach into a settled event.  Attestations that a gateway outage cleared stay cleared:
they are stored with the event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import rnd
from vigil.functions.storage import cut
from vigil.operators.campaign import campaign_accounts, campaign_stages
from vigil.operators.network import recipient_features
from vigil.operators.resilience import DEPS, reconcile_delta
from vigil.plans.replay import without_graph
from vigil.plans.scoring import EVENT_KEY, scored_events

Model = Callable[[DataFrame], DataFrame]


def as_known(features: DataFrame, outage: DataFrame, model: Model | None = None) -> DataFrame:
    """A feature table as its events' outages left it; ``outage`` is a result of ``context_asof``.

    Events without a context were online.  Sender features do not change, so no history is read again.
    """
    online = {"resilience_mode": F.lit("online"), "confidence_multiplier": F.lit(1.0), **{d: F.lit(True) for d in DEPS}}
    joined = features.drop(*online).join(outage.select(*EVENT_KEY, *online), EVENT_KEY, "left")
    masked = without_graph(joined.withColumns({c: F.coalesce(c, v) for c, v in online.items()}))
    masked = masked.withColumns({name: rnd(expr) for name, expr in recipient_features(masked).items()})
    if model is not None:
        masked = model(masked).withColumn("model_score", F.when(F.col("dep_model_runtime"), F.col("model_score")))
    return masked


def rescore(
    features: DataFrame,
    journal: DataFrame,
    outage: DataFrame,
    consortium: DataFrame | None = None,
    sketches: DataFrame | None = None,
    model: Model | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Journalled events with their score at the time, the restored one and the change between them.

    ``features`` is the stored feature table of all events; ``journal`` (tenant_id, event_id) names those to score again, once
    each.  Entries whose event is unknown have no row.  Also returns restored_confidence and restored_risk_level.
    """
    wanted = cut(journal.select(*EVENT_KEY).distinct(), "journal")
    known = as_known(features, outage, model)
    campaign = cut(campaign_accounts(campaign_stages(known), settings), "campaign")
    before = cut(known.join(wanted, EVENT_KEY, "left_semi"), "known")
    after = features.join(wanted, EVENT_KEY, "left_semi")
    after = cut(after if model is None else model(after), "restored")
    original = scored_events(before, consortium, sketches, settings, campaign)
    restored = scored_events(after, consortium, sketches, settings, campaign_evidence=False)
    details = restored.select(
        *EVENT_KEY, "fused_score", F.col("confidence_score").alias("restored_confidence"), F.col("risk_level").alias("restored_risk_level"))
    return reconcile_delta(original, details)
