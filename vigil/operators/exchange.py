"""Consortium reports and the privacy-reduced sketch exchange between institutions.

Shared tables hold only keyed tokens: an indicator token is bound to a rotating epoch, an institution
token is stable.  Raw identifiers never leave the reporting side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import (
    DAY_US, HOUR_US, from_micros, hmac_from_pads, hmac_sha256, key_pads, rnd,
)
from vigil.operators.timeline import running_at


# ------------------------------------------------------------------------------- consortium
def keyed_token(identifier: Column, key: str) -> Column:
    return hmac_sha256(F.lower(F.trim(identifier)), key)


def consortium_scores(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per recipient token: institutions and score from the latest report of each institution."""
    latest = (
        reports.groupBy(
            keyed_token(F.col("recipient_id"), settings.recipient_key).alias("recipient_token"),
            keyed_token(F.col("institution_id"), settings.recipient_key).alias("institution_token"),
        )
        .agg(F.max_by("confidence", F.struct("created_us", "report_seq")).alias("confidence"))
    )
    mean = F.sum("confidence") / F.count(F.lit(1))
    return latest.groupBy("recipient_token").agg(
        F.count(F.lit(1)).alias("independent_institutions"),
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(rnd(F.least(F.lit(0.92), mean)))
        .alias("consortium_score"),
    )


def consortium_apply(score: Column, consortium: Column) -> Column:
    return F.when(
        consortium >= 0.70, F.greatest(score, F.least(F.lit(0.96), consortium + 0.04))
    ).otherwise(score)


# -------------------------------------------------------------------------------- indicators
def normalise_indicator(kind: Column, value: Column) -> Column:
    """Canonical indicator text; null when it is shorter than three characters."""
    clean = F.lower(F.trim(value))
    stages = F.array_join(
        F.sort_array(F.array_distinct(F.filter(
            F.transform(F.split(clean, r"\|"), lambda s: F.trim(s)), lambda s: s != ""))), "|"
    )
    text = F.when(F.lower(F.trim(kind)) == "campaign", stages).otherwise(clean)
    return F.when(F.length(text) >= 3, text)


def epoch_bucket(at_us: Column, epoch_days: int) -> Column:
    """Identifier of the rotating token epoch."""
    number = F.floor(at_us / F.lit(max(1, epoch_days) * DAY_US)).cast("long")
    return F.concat(F.lit("e"), F.lpad(F.lower(F.hex(number)), 8, "0"))


def candidate_epochs(at_us: Column, settings: Settings = DEFAULTS) -> Column:
    """Epochs in which a still-valid report may have been tokenised, newest first."""
    days = max(1, settings.sketch_epoch_days)
    periods = max(1, math.ceil(settings.sketch_retention_days / days))
    return F.array(*[
        epoch_bucket(at_us - F.lit(i * days * DAY_US), days) for i in range(periods + 1)
    ])


def indicator_token(kind: Column, clean: Column, epoch: Column, settings: Settings = DEFAULTS) -> Column:
    return hmac_sha256(
        F.concat_ws("|", F.lit(settings.token_namespace), epoch, F.lower(F.trim(kind)), clean),
        settings.token_key,
    )


def institution_token(institution: Column, settings: Settings = DEFAULTS) -> Column:
    return hmac_sha256(
        F.concat_ws("|", F.lit(settings.token_namespace + "-institution"), F.lower(F.trim(institution))),
        settings.token_key,
    )


# -------------------------------------------------------------------------------- signatures
def report_material() -> Column:
    """Canonical text that an institution signs (fixed field order)."""
    return F.concat_ws(
        "|", "report_id", F.lower(F.trim("institution_id")), F.lower(F.trim("indicator_type")),
        normalise_indicator(F.col("indicator_type"), F.col("indicator_value")),
        F.floor(F.col("confidence") * 1_000_000 + 0.5).cast("long").cast("string"),
        "evidence_class", F.col("observed_us").cast("string"), F.col("ttl_hours").cast("string"), "nonce",
    )


def institution_keys(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    """Enrolled institutions with their HMAC pads: a configured list, so its size is known."""
    rows = [(name.strip().lower(), *key_pads(key)) for name, key in settings.institution_keys.items()]
    return spark.createDataFrame(rows, "institution string, inner_pad binary, outer_pad binary")


def with_institution_key(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    keys = institution_keys(df.sparkSession, settings)
    named = df.withColumn("institution", F.lower(F.trim("institution_id")))
    return named.join(F.broadcast(keys), "institution", "left")


def sign_reports(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the institution's signature; null for institutions that are not enrolled."""
    keyed = with_institution_key(reports, settings)
    return keyed.withColumn(
        "signature", hmac_from_pads(report_material(), F.col("inner_pad"), F.col("outer_pad"))
    ).drop("institution", "inner_pad", "outer_pad")


def verify_report_signatures(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds enrolled (allow-list) and signature_valid."""
    keyed = with_institution_key(reports, settings)
    expected = hmac_from_pads(report_material(), F.col("inner_pad"), F.col("outer_pad"))
    return keyed.select(
        *reports.columns,
        F.col("inner_pad").isNotNull().alias("enrolled"),
        F.coalesce(expected == F.col("signature"), F.lit(False)).alias("signature_valid"),
    )


# --------------------------------------------------------------------------------- admission
def sketch_admission(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each received report with ``rejection`` (null = admitted) and ``replay``.

    Needs the signed report columns and ``received_us``.  The hourly rate counts the institution's
    otherwise valid reports, so the rule does not depend on its own outcome.
    """
    checked = verify_report_signatures(reports, settings)
    age = (F.col("received_us") - F.col("observed_us")) / 1_000_000.0
    basic = (
        F.when((age > settings.sketch_max_age_seconds) | (age < -60), "stale_or_future")
        .when(~F.col("enrolled"), "institution_not_enrolled")
        .when((F.col("confidence") < 0.6) | (F.col("confidence") > 1.0), "confidence_out_of_range")
        .when(~F.col("evidence_class").isin(list(config.EVIDENCE_WEIGHTS)), "evidence_class_not_allowed")
        .when(normalise_indicator(F.col("indicator_type"), F.col("indicator_value")).isNull(),
              "indicator_too_short")
        .when(~F.col("signature_valid"), "signature_invalid")
    )
    checked = checked.withColumn("basic", basic)
    valid = checked.filter("basic is null")
    order = F.struct("received_us", "signature")
    # First claim of each report id and of each nonce: aggregations, so a repeated id cannot pile up.
    first_report = valid.groupBy("report_id").agg(F.min(order).alias("first_claim"))
    first_nonce = valid.groupBy("nonce").agg(F.min(F.struct("received_us", "report_id"))["report_id"].alias("nonce_owner"))
    rate_data = valid.select(
        F.lower(F.trim("institution_id")).alias("institution"),
        F.inline(F.array(
            F.struct((F.col("received_us") + 1).alias("at"), F.lit(1).cast("long").alias("recent")),
            F.struct((F.col("received_us") + HOUR_US + 1).alias("at"),
                     F.lit(-1).cast("long").alias("recent")),
        )),
    )
    asked = checked.withColumn("institution", F.lower(F.trim("institution_id"))).withColumn(
        "at", F.col("received_us"))
    rated = running_at(rate_data, asked, ["institution"], "at", sums=["recent"])
    joined = rated.join(first_report.hint("shuffle_hash"), "report_id", "left").join(first_nonce.hint("shuffle_hash"), "nonce", "left")
    again = F.col("basic").isNull() & (order > F.col("first_claim"))
    rejection = (
        F.when(F.col("basic").isNotNull(), F.col("basic"))
        .when(again & (F.col("signature") != F.col("first_claim.signature")), "conflicting_content")
        .when(again, None)
        .when(F.col("recent") >= settings.sketch_reports_per_hour, "rate_limit_exceeded")
        .when(F.col("nonce_owner") != F.col("report_id"), "nonce_reused")
    )
    return joined.select(
        *reports.columns, rejection.alias("rejection"),
        (again & (F.col("signature") == F.col("first_claim.signature"))).alias("replay"),
    )


# ------------------------------------------------------------------------- tokens and scores
def tokenised(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Shared form of admitted reports: tokens, quality and validity only."""
    clean = normalise_indicator(F.col("indicator_type"), F.col("indicator_value"))
    epoch = epoch_bucket(F.col("observed_us"), settings.sketch_epoch_days)
    kind = F.lower(F.trim("indicator_type"))
    lifetime = F.least(
        F.col("observed_us") + F.col("ttl_hours").cast("long") * HOUR_US,
        F.col("received_us") + settings.sketch_retention_days * DAY_US,
    )
    return reports.select(
        "report_id", kind.alias("indicator_type"),
        indicator_token(kind, clean, epoch, settings).alias("indicator_token"),
        epoch.alias("epoch_id"), institution_token(F.col("institution_id"), settings)
        .alias("institution_token"),
        "confidence", "evidence_class", "observed_us", lifetime.alias("expires_us"),
        F.col("received_us").alias("created_us"),
    )


def sketch_latest(shared: DataFrame, revocations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Latest report per (type, token, institution); revoked only by the institution that owns it.

    ``revocations``: report_id, institution_id, revoked_us.
    """
    keys = ["indicator_type", "indicator_token", "institution_token"]
    rest = [c for c in shared.columns if c not in keys]
    latest = (
        shared.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("created_us", "report_id")).alias("r"))
        .select(*keys, "r.*")
    )
    revoked = revocations.select(
        "report_id", institution_token(F.col("institution_id"), settings).alias("institution_token"),
        F.lit(True).alias("is_revoked"),
    ).distinct()
    return latest.join(revoked, ["report_id", "institution_token"], "left").select(
        *shared.columns,
        F.when(F.col("is_revoked"), "revoked").otherwise("active").alias("status"),
    )


def _weighted(at_us: Column) -> Column:
    age = F.greatest(F.lit(0.0), (at_us - F.col("observed_us")) / float(HOUR_US))
    life = F.greatest(F.lit(1.0), (F.col("expires_us") - F.col("observed_us")) / float(HOUR_US))
    weight = F.lit(0.0)
    for name, value in config.EVIDENCE_WEIGHTS.items():
        weight = F.when(F.col("evidence_class") == name, F.lit(value)).otherwise(weight)
    return F.col("confidence") * weight * F.greatest(F.lit(0.25), 1.0 - age / life)


def _scored(df: DataFrame) -> DataFrame:
    """score and status from columns institutions and quality."""
    n, c = F.col("institutions"), F.col("quality")
    score = (
        F.when(n == 1, 0.30 + 0.08 * c).when(n == 2, 0.58 + 0.16 * c)
        .otherwise(0.72 + F.least(F.lit(0.10), 0.025 * (n - 3)) + 0.14 * c)
    )
    return (
        df.withColumn("score", rnd(F.least(F.lit(0.92), score)))
        .withColumn("status", F.when(n == 1, "observe_only").when(n == 2, "shared_watch")
                    .otherwise("high_confidence"))
        .withColumn("confidence", rnd(F.least(F.lit(1.0), c)))
    )


def sketch_score(latest: DataFrame, at_us: int) -> DataFrame:
    """Per token: score, confidence, institutions, active reports and status at one time."""
    now = F.lit(at_us)
    active = latest.filter((F.col("status") == "active") & (F.col("expires_us") > now))
    grouped = active.groupBy("indicator_type", "indicator_token", "epoch_id").agg(
        F.count_distinct("institution_token").alias("institutions"),
        F.count(F.lit(1)).alias("active_reports"),
        (F.sum(_weighted(now)) / F.count(F.lit(1))).alias("quality"),
        F.min("expires_us").alias("expires_us"),
    )
    return _scored(grouped).select(
        "indicator_type", "indicator_token", "epoch_id", "score", "confidence",
        F.col("institutions").alias("independent_institutions"), "active_reports", "status", "expires_us",
    )


def _event_key(df: DataFrame) -> list[str]:
    """Tenants number their events apart; rows without a tenant go by event alone."""
    return [c for c in ("tenant_id", "event_id") if c in df.columns]


def sketch_lookup(indicators: DataFrame, latest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Best summary per indicator row (columns: event_id, kind, value, at_us, and tenant_id where there is one).

    Each row is tokenised for its candidate epochs and equi-joined on the token.  A token has at most
    one current report per institution, so the join fans out by the number of enrolled institutions.
    A report counts only once it has been observed.
    """
    event = _event_key(indicators)
    clean = normalise_indicator(F.col("kind"), F.col("value"))
    asked = (
        indicators.withColumn("_clean", clean).filter("_clean is not null")
        .withColumn("_epoch", F.explode(candidate_epochs(F.col("at_us"), settings)))
        .select(*event, "kind", "at_us",
                indicator_token(F.col("kind"), F.col("_clean"), F.col("_epoch"), settings)
                .alias("indicator_token"))
    )
    reports = latest.filter("status = 'active'").withColumnRenamed("indicator_type", "kind")
    matched = asked.join(reports.drop("status"), ["kind", "indicator_token"]).filter(
        (F.col("observed_us") <= F.col("at_us")) & (F.col("expires_us") > F.col("at_us"))
    )
    per_token = matched.groupBy(*event, "kind", "indicator_token").agg(
        F.count_distinct("institution_token").alias("institutions"),
        F.count(F.lit(1)).alias("active_reports"),
        (F.sum(_weighted(F.col("at_us"))) / F.count(F.lit(1))).alias("quality"),
        F.min("expires_us").alias("expires_us"),
    )
    scored = _scored(per_token)
    best = scored.groupBy(*event, "kind").agg(
        F.max(F.struct("score", "institutions", "confidence", "active_reports", "status", "expires_us"))
        .alias("b")
    )
    return best.select(
        *event, "kind", "b.score", F.col("b.institutions").alias("independent_institutions"),
        "b.confidence", "b.active_reports", "b.status", "b.expires_us",
    )


def event_indicators(staged: DataFrame) -> DataFrame:
    """Up to three indicators per event: recipient, attested terminal, campaign (when scored)."""
    token = F.when(
        F.coalesce(F.col("agent_assurance")["gateway_attested"], F.lit(False)),
        F.col("agent_assurance")["terminal_token"],
    )
    items = F.array_compact(F.array(
        F.when(F.col("recipient_id").isNotNull(),
               F.struct(F.lit("recipient").alias("kind"), F.col("recipient_id").alias("value"))),
        F.when(token.isNotNull(), F.struct(F.lit("agent_terminal").alias("kind"), token.alias("value"))),
        F.when(F.col("campaign_risk") > 0,
               F.struct(F.lit("campaign").alias("kind"),
                        F.array_join("campaign_stages", "|").alias("value"))),
    ))
    return staged.select(*_event_key(staged), F.col("ts_us").alias("at_us"), F.inline(items))


def sketch_match(lookup: DataFrame) -> DataFrame:
    """Per event: the best of its matched indicators and how many matched."""
    place = F.when(F.col("kind") == "recipient", 0).when(F.col("kind") == "agent_terminal", -1).otherwise(-2)
    return lookup.groupBy(*_event_key(lookup)).agg(
        F.max(F.struct("score", "independent_institutions", place.alias("place"), "confidence",
                       "active_reports", "status", "kind")).alias("b"),
        F.count(F.lit(1)).alias("matches"),
        F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("matched_indicators"),
    ).select(
        *_event_key(lookup), F.col("b.score").alias("sketch_best"),
        F.col("b.independent_institutions").alias("sketch_institutions"),
        F.col("b.confidence").alias("sketch_confidence"),
        F.col("b.active_reports").alias("sketch_active_reports"),
        F.col("b.status").alias("sketch_status"), "matches", "matched_indicators",
    )


def sketch_apply(df: DataFrame) -> DataFrame:
    """Raises the score within the ceiling that the evidence allows.

    Needs pre_sketch_score, the columns of ``sketch_match`` (nullable), campaign_risk and features.
    """
    local = (
        (F.col("pre_sketch_score") >= 0.30)
        | (F.coalesce("recipient_rep_score", F.lit(0.0)) >= 0.35)
        | (F.coalesce("terminal_rep_score", F.lit(0.0)) >= 0.35)
        | (F.col("campaign_risk") >= 0.62)
        | ((F.col("new_recipient") > 0) & (F.col("balance_drain_ratio") >= 0.45))
    )
    matched = F.col("sketch_best").isNotNull()
    exchange = F.least(
        F.lit(0.92), F.col("sketch_best") + F.when(F.col("matches") >= 2, 0.04).otherwise(0.0)
    )
    delay = matched & (F.col("sketch_institutions") >= 2) & F.col("sketch_local")
    ceiling = F.when(delay, 0.82).otherwise(0.42)
    df = df.withColumn("sketch_local", local).withColumn(
        "fused_score",
        F.when(matched, rnd(F.greatest(F.col("pre_sketch_score"), F.least(ceiling, exchange))))
        .otherwise(F.col("pre_sketch_score")),
    )
    return df.select(
        "*",
        F.when(matched, rnd(exchange)).otherwise(F.lit(0.0)).alias("fraud_sketch_risk"),
        F.when(F.col("sketch_local"), 1.0).otherwise(0.0).alias("fraud_sketch_local_corroboration"),
        rnd(F.col("pre_sketch_score")).alias("fraud_sketch_pre_exchange_score"),
        F.when(delay, "delay").otherwise("monitor").alias("sketch_ceiling"),
    )


# ---------------------------------------------------------------------------------- capsules
def sketch_capsules(scores: DataFrame, issued_us: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Short-lived offline copies of token scores, valid at most ``sketch_capsule_ttl_hours``."""
    limit = F.lit(issued_us + settings.sketch_capsule_ttl_hours * HOUR_US)
    capsule = F.concat(F.lit("cap_"), F.substring(F.sha2(F.concat_ws(
        "|", "indicator_type", "indicator_token", F.lit(str(issued_us))), 256), 1, 24))
    return scores.select(
        capsule.alias("capsule_id"), "indicator_type", "indicator_token", "epoch_id", "score",
        "confidence", "independent_institutions", "active_reports", "status",
        F.lit(issued_us).alias("issued_us"), F.least("expires_us", limit).alias("capsule_expires_us"),
    )


def capsule_lookup(capsules: DataFrame, at_us: int) -> DataFrame:
    """Unexpired capsules with the discounts of cached evidence."""
    return capsules.filter(F.col("capsule_expires_us") > F.lit(at_us)).select(
        "indicator_type", "indicator_token", rnd(F.col("score") * 0.85).alias("score"),
        rnd(F.col("confidence") * 0.75).alias("confidence"), "independent_institutions",
        F.concat(F.lit("cached_"), F.col("status")).alias("status"),
    )


def privacy_violations(shared: DataFrame, raw_ids: DataFrame) -> DataFrame:
    """Shared rows in which a raw identifier (column raw_id) appears in any text column."""
    texts = [n for n, t in shared.dtypes if t == "string" and n != "report_id"]
    cells = shared.select("report_id", F.explode(F.array(*[F.col(n) for n in texts])).alias("raw_id"))
    return cells.join(raw_ids.select("raw_id").distinct(), "raw_id", "left_semi")


def sketch_status(indicators: DataFrame, latest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Public view of asked indicators: no tokens, no institutions, no source values."""
    found = sketch_lookup(indicators, latest, settings)
    asked = [*_event_key(indicators), "kind"]
    return indicators.select(*asked).join(found, asked, "left").select(
        *asked, F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("independent_institutions", F.lit(0)).alias("independent_institutions"),
        F.coalesce("active_reports", F.lit(0)).alias("active_reports"),
        F.coalesce("status", F.lit("clear")).alias("status"),
        from_micros(F.col("expires_us")).alias("expires_at"),
    )


