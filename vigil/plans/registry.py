"""Named queries over the test tables, each with brute-force SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import config
from vigil.functions import rules as R
from vigil.functions.scalars import DAY_US, HOUR_US, hmac_sha256, micros, rnd
from vigil.operators import (
    campaign, evaluation, exchange, governance, integrity, learning, model, network, policy, profile,
    reputation, resilience, scoring, sender, terminal, validate, whatif,
)
from vigil.functions.storage import cut
from vigil.plans import oracle as O
from vigil.plans import replay
from vigil.plans.fixtures import Inputs, inputs
from vigil.plans.oracle import with_cte
from vigil.sources import adapter, io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
START = 1_704_067_200_000_000  # first instant of the event calendar
MID = START + 20 * DAY_US
END = START + 31 * DAY_US


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(inputs(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def ev(select: str, ctes: str = "") -> str:
    return with_cte(O.EV + (",\n" + ctes if ctes else ""), select)


def cols(text: str) -> list[str]:
    return text.split()


def text_list(name: str):
    return F.array_join(name, "|").alias(name)


# ------------------------------------------------------------------------- sources and scans
_FLAT = cols(
    "event_id account_id tenant_id event_type channel amount available_balance_before recipient_id"
    " device_id sim_id ip_prefix latitude longitude interaction_ms menu_depth input_method"
    " navigation_signature success profile_eligible ts_us"
)


@query("read_events", ev(
    f"select {', '.join(_FLAT)}, case when has_telco then telco_age end as sim_age,"
    " case when has_terminal then terminal_token end as terminal, case when has_session then pause_ms end as pause from ev"))
def _(i):
    return i.events.select(
        *_FLAT, F.col("telco_assurance.sim_activation_age_hours").alias("sim_age"),
        F.col("agent_assurance.terminal_token").alias("terminal"),
        F.col("coercion_signals.pause_before_confirmation_ms").alias("pause"))


@query("read_accounts", with_cte(O.ACCT, "select * from acct"))
def _(i):
    return i.accounts


@query("history_scan", ev(
    f"select event_id, ts_us, event_type from ev where tenant_id = 'tenant_1' and account_id = 'acct_7'"
    f" and ts_us < {MID} and ts_us >= {MID - 180 * DAY_US} order by ts_us desc, event_id limit 25"))
def _(i):
    return io.history_scan(i.events, "tenant_1", "acct_7", MID, MID - 180 * DAY_US, 25).select(
        "event_id", "ts_us", "event_type")


@query("network_scan", ev(
    f"select account_id, recipient_id, count(*) as n from ev where tenant_id = 'tenant_1' and ts_us < {MID}"
    f" and ts_us >= {MID - 7 * DAY_US} group by account_id, recipient_id"))
def _(i):
    return io.network_scan(i.events, "tenant_1", MID, MID - 7 * DAY_US).groupBy(
        "account_id", "recipient_id").agg(F.count(F.lit(1)).alias("n"))


_TRUST = (
    O.FEEDBACK + ",\ntl as (select event_id, case when label in ('account_takeover','other_fraud') then 'revoked'"
    " when label = 'legitimate' then 'trusted' end as trust_state from fb)"
)


def _trust_log(i: Inputs) -> DataFrame:
    changes = learning.feedback_trust(i.feedback).select(
        "event_id", "trust_state", F.col("confirmed_us").alias("updated_us"), F.lit(1).alias("seq"))
    start = i.events.filter("profile_eligible").select(
        "event_id", F.lit("trusted").alias("trust_state"), F.col("ts_us").alias("updated_us"),
        F.lit(0).alias("seq"))
    return start.unionByName(changes)


_TRUST_LATEST = _TRUST + (
    ",\ntlog as (select event_id, trust_state, 1 as seq from tl where trust_state is not null union all"
    " select event_id, 'trusted', 0 from ev where profile_eligible),\n"
    "tlatest as (select event_id, arg_max(trust_state, seq) as trust_state, count(*) as changes from tlog group by event_id)"
)


@query("trust_latest", ev("select * from tlatest", _TRUST_LATEST))
def _(i):
    return learning.trust_latest(_trust_log(i))


@query("trusted_scan", ev(
    "select e.account_id, count(*) as n, max(e.ts_us) as newest from ev e join tlatest t on t.event_id = e.event_id"
    " and t.trust_state = 'trusted' group by e.account_id", _TRUST_LATEST))
def _(i):
    return learning.trusted_scan(i.events, learning.trust_latest(_trust_log(i))).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("newest"))


@query("apply_trust", ev(
    "select e.event_id, case when t.trust_state is null then e.profile_eligible else t.trust_state = 'trusted' end"
    " as profile_eligible from ev e left join tlatest t on t.event_id = e.event_id", _TRUST_LATEST))
def _(i):
    return learning.apply_trust(i.events, learning.trust_latest(_trust_log(i))).select(
        "event_id", "profile_eligible")


@query("event_sink", ev(f"select event_id, tenant_id, ts_us from ev where ts_us >= {MID}"))
def _(i):
    incoming = i.events.unionByName(i.events)
    return io.new_events(incoming, i.events.filter(F.col("ts_us") < MID)).select(
        "event_id", "tenant_id", "ts_us")


_PIECES = ", ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), 'null')" for c in cols("doc_id text lang source n_chars"))


@query("snapshot_manifest", (
    f"with numbered as (select *, row_number() over () - 1 as place from documents),\n"
    f"hashed as (select cast('0x' || substr(sha256(concat_ws('|', cast(place as varchar), {_PIECES})), 1, 15) as bigint) as h from numbered)\n"
    "select 'documents.parquet' as file, count(*) as rows, cast(sum(h) as varchar) as digest from hashed"))
def _(i):
    return io.snapshot_manifest(i.spark, f"{i.sf_dir}/documents.parquet").select("file", "rows", "digest")


@query("outbox_emit", with_cte(
    O.DECIDED + ",\nlc as (select 'order_' || cast(l_orderkey as varchar) as event_id, "
    + adapter.LIFECYCLE_STATE + " as to_state from lineitem)",
    "select 'decision.created' as topic, '{\"decision_id\":\"' || event_id || '\",\"action\":\"' || action || '\"}' as payload_json,"
    " 'pending' as status from dec union all select 'transaction.lifecycle', '{\"event_id\":\"' || event_id || '\",\"state\":\"'"
    " || to_state || '\"}', 'pending' from lc"))
def _(i):
    return learning.outbox(i.decisions, adapter.lifecycle_requests(i.spark, i.sf_dir))


# -------------------------------------------------------------------------------- validation
_RAW_SQL = (
    "bad as (select *, amount * 100000000.0 as amount2, latitude * 9 as latitude2,"
    " case when k % 13 = 0 then null else longitude end as longitude2,"
    " case when k % 17 = 0 then null else interaction_ms end as interaction2,"
    " case when k % 19 = 0 then 'fax' else channel end as channel2,"
    " case when k % 31 = 0 then substr(event_id, 1, 3) when k % 37 = 0 then event_id || '#' else event_id end as event2,"
    " case when k % 41 = 0 then 10 else keystroke_interval_ms end as keystroke2,"
    " case when k % 43 = 0 then 1 else amount * 100000000.0 end as amount3 from ev)"
)


def _corrupted(i: Inputs) -> DataFrame:
    """The event table with deterministic defects, so that every rule family rejects something."""
    k = F.col("metadata")["k"].cast("int")
    null = F.lit(None)
    return i.events.withColumn("original_id", F.col("event_id")).withColumns({
        "amount": F.when(k % 43 == 0, 1.0).otherwise(F.col("amount") * 100_000_000.0),
        "latitude": F.col("latitude") * 9,
        "longitude": F.when(k % 13 == 0, null).otherwise(F.col("longitude")),
        "interaction_ms": F.when(k % 17 == 0, null).otherwise(F.col("interaction_ms")),
        "channel": F.when(k % 19 == 0, "fax").otherwise(F.col("channel")),
        "event_id": F.when(k % 31 == 0, F.substring("event_id", 1, 3))
        .when(k % 37 == 0, F.concat("event_id", F.lit("#"))).otherwise(F.col("event_id")),
        "keystroke_interval_ms": F.when(k % 41 == 0, 10.0).otherwise(F.col("keystroke_interval_ms")),
    })


_VIOLATION_SQL = [
    ("event_id", "not (length(event2) between 6 and 100 and regexp_matches(event2, '^[A-Za-z0-9_.:-]+$'))"),
    ("channel", "channel2 not in ('app','ussd','web','agent')"),
    ("amount", "not (amount3 between 0 and 1e9)"),
    ("latitude", "latitude2 is not null and not (latitude2 between -90 and 90)"),
    ("keystroke_interval_ms", "keystroke2 is not null and not (keystroke2 between 20 and 5000)"),
    ("coordinates_together", "(latitude2 is null) <> (longitude2 is null)"),
    ("non_transaction_amount", f"event_type not in {O.TXN} and amount3 <> 0"),
    ("menu_depth_needs_interaction", "menu_depth is not null and interaction2 is null"),
    ("agent_envelope_channel", "has_terminal and channel2 <> 'agent'"),
]


@query("validate_events", ev(
    "select event_id as original_id, concat_ws('|', " + ", ".join(
        f"case when {cond} then '{name}' end" for name, cond in _VIOLATION_SQL) + ") as violations from bad",
    _RAW_SQL))
def _(i):
    return validate.validate_events(_corrupted(i)).select("original_id", text_list("violations"))


@query("validate_pairs", ev(
    "select concat_ws('|', " + ", ".join(
        f"case when {cond} then '{name}' end" for name, cond in _VIOLATION_SQL[5:])
    + ") as violations, count(*) as n from bad group by 1", _RAW_SQL))
def _(i):
    bad = _corrupted(i).withColumn("violations", validate.violations(validate.pair_rules()))
    return bad.groupBy(text_list("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("normalise_time", ev(
    "select event_id, user3 <> 2 as has_zone, case user3 when 0 then epoch_us(date_trunc('second', occurred_at))"
    f" when 1 then epoch_us(date_trunc('second', occurred_at)) - {HOUR_US} end as at_us"
    " from (select *, k % 3 as user3 from ev)"))
def _(i):
    k = F.col("metadata")["k"].cast("int") % 3
    stamp = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")
    df = i.events.withColumn("occurred_text", F.concat(
        stamp, F.when(k == 0, "Z").when(k == 1, "+01:00").otherwise("")))
    return validate.normalise_time(df).select("event_id", "has_zone", micros("occurred_at").alias("at_us"))


_FRESH = "(k % 10 <> 0 and (k % 10 = 1 or abs((k - 50) * 20) > 300))"


@query("enforce_freshness", ev(
    f"select event_id, coalesce(has_telco and telco_attested and not {_FRESH}, false) as telco,"
    f" coalesce(has_terminal and terminal_attested and not {_FRESH}, false) as terminal,"
    f" coalesce(has_session and session_attested and not {_FRESH}, false) as session,"
    f" case when {_FRESH} then 'stale_ignored' end as status from ev"))
def _(i):
    k = F.col("metadata")["k"].cast("int")
    observed = F.timestamp_micros(F.col("ts_us") + (k - 50) * 20_000_000)
    text = F.when(k % 10 == 1, "not a time").when(
        k % 10 != 0, F.date_format(observed, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    df = i.events.withColumn(
        "metadata", F.map_concat("metadata", F.create_map(F.lit("gateway_observed_at"), text)))
    out = validate.enforce_freshness(df, i.settings)
    no = F.lit(False)
    return out.select(
        "event_id", F.coalesce("telco_assurance.gateway_attested", no).alias("telco"),
        F.coalesce("agent_assurance.gateway_attested", no).alias("terminal"),
        F.coalesce("coercion_signals.consented_device_attested", no).alias("session"),
        F.col("metadata")["evidence_freshness_status"].alias("status"))


@query("trusted_filter", ev(
    "select event_type, count(*) as n from ev h where " + O.TRUSTED + " group by event_type"))
def _(i):
    return validate.trusted_filter(i.events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("transaction_filter", ev(
    f"select event_type, sum(amount) as total from ev where event_type in {O.TXN} group by event_type"))
def _(i):
    return validate.transaction_filter(i.events).groupBy("event_type").agg(F.sum("amount").alias("total"))


@query("tenant_filter", ev("select count(*) as n, min(ts_us) as first_us from ev where tenant_id = 'tenant_2'"))
def _(i):
    return validate.tenant_filter(i.events, "tenant_2").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"))


# ----------------------------------------------------------------------------------- profile
_PROF = (
    "tr as (select * from ev h where " + O.TRUSTED + "),\n"
    f"tx as (select * from tr where event_type in {O.TXN}),\n"
    "am as (select tenant_id, account_id, quantile_cont(amount, 0.5) as med from tx where amount > 0 group by all),\n"
    "mad as (select t.tenant_id, t.account_id, quantile_cont(abs(t.amount - am.med), 0.5) as mad from tx t join am"
    " on am.account_id = t.account_id and am.tenant_id = t.tenant_id where t.amount > 0 group by all),\n"
    "base as (select tenant_id, account_id, count(*) as history_events, max(ts_us) as newest from ev group by all),\n"
    f"txn as (select tenant_id, account_id, count(*) as n from tx group by all),\n"
    "lastev as (select tenant_id, account_id, max(ts_us) as last_us, arg_max(channel, ts_us) as ch, arg_max(device_id, ts_us) as dev,"
    " arg_max(sim_id, ts_us) as sim, arg_max(latitude, ts_us) filter (where latitude is not null) as lat,"
    " arg_max(longitude, ts_us) filter (where latitude is not null) as lon from tr group by all),\n"
    f"fails as (select e.tenant_id, e.account_id, count(*) as n from ev e join base b on b.account_id = e.account_id and b.tenant_id = e.tenant_id"
    f" where e.event_type = 'failed_login' and e.ts_us >= b.newest - {DAY_US} group by all),\n"
    "prof as (select b.tenant_id, b.account_id, b.history_events, coalesce(t.n, 0) as transaction_events, "
    + "case when t.n > 0 then " + O.r("least(1, ln(1 + t.n) / ln(cast(51 as double)))") + " else 0 end as profile_confidence, "
    + O.r("coalesce(med, 0)", 2) + " as amount_median, " + O.r("coalesce(mad, 0)", 2) + " as amount_mad,"
    " coalesce(f.n, 0) as recent_failed_auth_24h, l.last_us, l.ch as last_event_channel, l.dev as last_event_device,"
    " l.sim as last_event_sim, l.lat as last_latitude, l.lon as last_longitude"
    " from base b left join txn t using (tenant_id, account_id) left join am using (tenant_id, account_id)"
    " left join mad using (tenant_id, account_id) left join fails f using (tenant_id, account_id)"
    " left join lastev l using (tenant_id, account_id))"
)
_COUNTERS = (
    "cn as (select tenant_id, account_id, kind, key, count(*) as n, min(ts_us) as first_us from ("
    "select tenant_id, account_id, 'device' as kind, device_id as key, ts_us from tr"
    " union all select tenant_id, account_id, 'sim', sim_id, ts_us from tr"
    " union all select tenant_id, account_id, 'recipient', recipient_id, ts_us from tx where recipient_id is not null"
    " union all select tenant_id, account_id, 'channel', channel, ts_us from tr"
    " union all select tenant_id, account_id, 'ip_prefix', ip_prefix, ts_us from tr"
    " union all select tenant_id, account_id, 'event_type', event_type, ts_us from ev"
    " union all select tenant_id, account_id, 'hour', cast(hour(occurred_at) as varchar), ts_us from tx"
    " union all select tenant_id, account_id, 'navigation', channel || '|' || navigation_signature, ts_us from tr"
    " union all select tenant_id, account_id, 'input_method', channel || '|' || input_method, ts_us from tr where input_method <> 'unknown'"
    ") group by tenant_id, account_id, kind, key),\n"
    "ch as (select tenant_id, account_id, string_agg(cast(hr as varchar), '|' order by rn) as common_hours from (select tenant_id,"
    " account_id, key as hr, row_number() over (partition by tenant_id, account_id order by n desc, first_us) as rn from cn where kind = 'hour')"
    " where rn <= 5 group by tenant_id, account_id),\n"
    "card as (select tenant_id, account_id, count(*) filter (where kind = 'device') as known_devices, count(*) filter (where kind = 'sim') as known_sims,"
    " count(*) filter (where kind = 'recipient') as known_recipients, string_agg(key, '|' order by key) filter (where kind = 'channel') as known_channels"
    " from cn group by tenant_id, account_id)"
)


@query("profile_stats", ev("select * from prof", _PROF))
def _(i):
    return profile.profile_stats(profile.newest(i.events, i.settings)).withColumn(
        "last_us", micros("last_event_at")).drop("last_event_at")


@query("profile_counters", ev("select * from cn", _PROF + ",\n" + _COUNTERS))
def _(i):
    return profile.profile_counters(profile.newest(i.events, i.settings))


@query("profile_hour_hist", ev("select * from ch", _PROF + ",\n" + _COUNTERS))
def _(i):
    counters = profile.profile_counters(profile.newest(i.events, i.settings))
    return profile.profile_common_hours(counters).withColumn(
        "common_hours", F.array_join("common_hours", "|"))


_SIG = (
    "sg as (select tenant_id, account_id, channel, 'interaction' as signal, interaction_ms / cast(menu_depth as double) as v from tr"
    " where interaction_ms > 0 and menu_depth > 0"
    " union all select tenant_id, account_id, channel, 'typing', keystroke_interval_ms from tr where keystroke_interval_ms is not null"
    " union all select tenant_id, account_id, channel, 'tilt', device_tilt_variance from tr where device_tilt_variance is not null),\n"
    "sm as (select tenant_id, account_id, channel, signal, quantile_cont(v, 0.5) as median, count(*) as samples from sg group by all),\n"
    "ss as (select sm.tenant_id, sm.account_id, sm.channel, sm.signal, sm.median, quantile_cont(abs(sg.v - sm.median), 0.5) as mad, sm.samples"
    " from sm join sg using (tenant_id, account_id, channel, signal) group by all)"
)


@query("profile_channel_stats", ev(
    f"select tenant_id, account_id, channel, signal, {O.r('median')} as median, {O.r('mad')} as mad, samples from ss",
    _PROF + ",\n" + _SIG))
def _(i):
    return profile.profile_channel_stats(profile.newest(i.events, i.settings)).withColumns(
        {"median": rnd(F.col("median")), "mad": rnd(F.col("mad"))})


_VIEW_SELECT = (
    "select p.tenant_id, p.account_id, history_events, transaction_events, profile_confidence, amount_median, amount_mad,"
    " known_devices, known_sims, known_recipients, known_channels, common_hours, recent_failed_auth_24h"
    " from prof p left join card using (tenant_id, account_id) left join ch using (tenant_id, account_id)"
)


@query("profile_view", ev(_VIEW_SELECT, _PROF + ",\n" + _COUNTERS))
def _(i):
    return profile.profile_view(profile.behaviour_profile(i.events, i.settings))


@query("profile_rebuild", ev(
    _VIEW_SELECT + " where (p.tenant_id, p.account_id) in (select (tenant_id, account_id) from fb)",
    O.FEEDBACK + ",\n" + _PROF + ",\n" + _COUNTERS))
def _(i):
    changed = i.feedback.join(i.events.select("event_id", "tenant_id", "account_id"), "event_id")
    return profile.profile_view(profile.profile_rebuild(i.events, changed, i.settings))


# ---------------------------------------------------------------------- point-in-time features
FEATURE_GROUPS = {
    "amount_features": "amount_deviation amount_to_median balance_drain_ratio",
    "unusual_hour": "unusual_hour",
    "recipient_novelty": "new_recipient recipient_rarity",
    "device_novelty": "new_device device_rarity",
    "identity_novelty": "new_sim new_ip_prefix new_channel verified_sim_change",
    "channel_transition_novelty": "channel_transition_novelty",
    "cross_channel_features":
        "cross_channel_events_15m new_channel_enrollment_24h app_to_ussd_handoff cross_channel_device_mismatch",
    "velocity_features": "velocity_5m velocity_1h",
    "auth_signals": "failed_auth_24h recovery_signal_72h",
    "impossible_travel": "impossible_travel",
    "rhythm_features":
        "interaction_speed_deviation typing_cadence_deviation device_handling_deviation paste_anomaly navigation_novelty",
    "calendar_features": "calendar_confidence day_of_month_deviation recurring_payment_match",
    "coercion_features":
        "call_transfer_overlap screen_sharing_signal recipient_edit_anomaly confirmation_friction"
        " coercion_on_device_score coercion_evidence_coverage",
    "telco_features":
        "recent_sim_activation repeat_sim_change imsi_change iccid_change sim_type_change otp_sim_change_proximity"
        " otp_sim_geo_mismatch short_previous_sim_tenure telco_assurance_coverage",
    "evidence_coverage": "evidence_coverage",
    "pass_through_flags": "history_confidence shared_device_allowed is_ussd is_transfer is_withdrawal is_agent",
    "recipient_features":
        "recipient_sender_diversity_24h recipient_first_time_sender_ratio_24h recipient_inflow_velocity_1h"
        " recipient_rapid_cashout_ratio_1h recipient_network_coverage",
    "reputation_features":
        "recipient_confirmed_fraud_score recipient_confirmed_accounts recipient_watchlist_coverage"
        " agent_confirmed_fraud_score agent_confirmed_accounts",
    "terminal_features":
        "agent_customer_diversity_1h agent_recipient_concentration_24h agent_first_time_recipient_ratio_24h"
        " agent_failed_auth_ratio_1h agent_value_velocity_1h agent_location_mismatch agent_after_hours"
        " agent_terminal_novelty agent_evidence_coverage",
}


def _register_group(name: str, wanted: list[str]) -> None:
    @query(name, with_cte(O.FEATURES, f"select event_id, {', '.join(wanted)} from feat"))
    def _(i):
        return i.features.select("event_id", *wanted)


for _name, _wanted in FEATURE_GROUPS.items():
    _register_group(_name, cols(_wanted))
_register_group("feature_table", config.FEATURES + config.AGENT_FEATURES)


@query("account_hazard", with_cte(
    O.FEATURES,
    "select event_id, account_hazard_score, risk_window_hours_remaining, precursors, case when account_hazard_score >= 0.60 then 'high'"
    " when account_hazard_score >= 0.30 then 'elevated' when account_hazard_score > 0 then 'watch' else 'clear' end as state from feat"))
def _(i):
    return i.features.select(
        "event_id", "account_hazard_score", "risk_window_hours_remaining",
        F.array_join("active_precursors", "|").alias("precursors"), F.col("risk_window_state").alias("state"))


@query("sender_features", ev(
    "select event_id, " + ", ".join(O.SENDER_FEATURES) + " from sf", O.SENDER))
def _(i):
    return sender.sender_features(i.events, settings=i.settings).select("event_id", *O.SENDER_FEATURES)


def _rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[rnd(F.col(c)).alias(c) for c in df.columns if c not in keep])


_NET = cols("unique_senders_24h first_time_sender_ratio_24h inflow_amount_1h outflow_amount_1h"
            " rapid_cashout_ratio_1h current_sender_first_time")
_TERM = cols("customer_diversity_1h recipient_concentration_24h first_time_recipient_ratio_24h"
             " failed_auth_ratio_1h value_velocity_1h")


@query("recipient_network", ev(
    "select tenant_id, event_id, " + ", ".join(f"{O.r(c)} as {c}" for c in _NET) + " from net", O.NETWORK))
def _(i):
    return _rounded(network.recipient_context(i.events, i.settings), ["tenant_id", "event_id"])


@query("agent_terminal", ev(
    "select tenant_id, event_id, " + ", ".join(f"{O.r(c)} as {c}" for c in _TERM) + " from term", O.TERMINAL))
def _(i):
    return _rounded(terminal.terminal_context(i.events, i.settings), ["tenant_id", "event_id"])


# -------------------------------------------------------------------------------- reputation
def _rep_sql(key: str, scope: str, days: int, top: str) -> str:
    return (
        f"select {scope}sha256({key}) as {'recipient_key' if top == 'high' else 'terminal_key'}, count(*) as confirmed_reports,"
        " count(distinct acc) as distinct_accounts, min(epoch_us(l_shipdate)) as first_us, max(epoch_us(l_shipdate)) as last_us,"
        f" max(epoch_us(l_shipdate)) + {days * DAY_US} as expires_us, case when count(distinct acc) >= 3 then '{top}'"
        " when count(distinct acc) = 2 then 'elevated' else 'monitor' end as status from (select *, 'supp_' || cast(l_suppkey as varchar) as rid,"
        " 'acct_' || cast(l_orderkey % 200 as varchar) as acc, 'tenant_' || cast(l_suppkey % 3 as varchar) as tenant_id from lineitem"
        f" where l_returnflag = 'R') group by all"
    )


def _rep_out(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if not c.endswith("_at")], micros("first_confirmed_at").alias("first_us"),
        micros("last_confirmed_at").alias("last_us"), micros("expires_at").alias("expires_us"))


@query("recipient_reputation", _rep_sql("rid", "", 90, "high"))
def _(i):
    log = adapter.lineitem_feedback(i.spark, i.sf_dir).withColumn(
        "recipient_key", reputation.shared_key(F.col("recipient_id")))
    return _rep_out(reputation.reputation(log, reputation.RECIPIENT))


@query("terminal_reputation", _rep_sql("rid", "tenant_id, ", 60, "quarantined"))
def _(i):
    log = adapter.lineitem_feedback(i.spark, i.sf_dir).withColumn(
        "terminal_key", reputation.shared_key(F.col("recipient_id")))
    return _rep_out(reputation.reputation(log, reputation.TERMINAL))


_REP_COLS = ["tenant_id", "event_id", "status", "score", "confirmed_reports", "distinct_accounts"]


@query("recipient_reputation_asof", ev(f"select {', '.join(_REP_COLS)} from rrep", O.REPUTATION))
def _(i):
    return reputation.event_reputation(i.events, i.confirmed, i.settings)[0].toDF(*_REP_COLS)


@query("terminal_reputation_asof", ev(f"select {', '.join(_REP_COLS)} from trep", O.REPUTATION))
def _(i):
    return reputation.event_reputation(i.events, i.confirmed, i.settings)[1].toDF(*_REP_COLS)


@query("terminal_status", ev(
    "select tenant_id, substr(sha256(tenant_id || '|' || terminal_token), 1, 16) as terminal_reference,"
    " count(*) as confirmed_reports, count(distinct account_id) as distinct_accounts,"
    " case when count(distinct account_id) >= 3 then 'quarantined' when count(distinct account_id) = 2 then 'elevated' else 'monitor' end as status"
    " from confirmed where terminal_token is not null group by all", O.FEEDBACK))
def _(i):
    known = i.confirmed.filter("terminal_token is not null")
    refs = known.select(
        "tenant_id", reputation.shared_key(F.col("terminal_token")).alias("terminal_key"),
        integrity.terminal_reference(F.col("tenant_id"), F.col("terminal_token")).alias("terminal_reference"),
    ).distinct()
    rep = reputation.reputation(reputation.terminal_confirmations(i.confirmed), reputation.TERMINAL)
    return rep.join(refs, ["tenant_id", "terminal_key"]).select(
        "tenant_id", "terminal_reference", "confirmed_reports", "distinct_accounts", "status")


@query("feedback_propagate", ev(
    "select f.event_id, f.trust_state, e.recipient_id, e.account_id from tl f join ev e on e.event_id = f.event_id"
    " where f.trust_state is not null", _TRUST))
def _(i):
    return learning.feedback_trust(i.feedback).join(
        i.events.select("event_id", "recipient_id", "account_id"), "event_id").select(
        "event_id", "trust_state", "recipient_id", "account_id")


@query("dual_control_check", ev(
    "select event_id as decision_id, event_id, label, case when second_approver_id is null and (rec or ter) then 'second_approver_required'"
    " else 'approver_not_independent' end as violation from (select c.*, exists (select 1 from confirmed p where p.recipient_id = c.recipient_id"
    " and p.confirmed_us < c.confirmed_us) as rec, exists (select 1 from confirmed p where p.tenant_id = c.tenant_id and"
    " p.terminal_token = c.terminal_token and p.confirmed_us < c.confirmed_us) as ter from confirmed c) x"
    " where (second_approver_id is null and (rec or ter)) or second_approver_id = analyst_id", O.FEEDBACK))
def _(i):
    return reputation.dual_control_violations(i.feedback, i.events, i.settings)


# --------------------------------------------------------------------- consortium and sketches
@query("consortium_score", with_cte(
    O.CONSORTIUM, "select independent_institutions, consortium_score, count(*) as recipients from cons group by all"))
def _(i):
    return i.consortium.groupBy("independent_institutions", "consortium_score").agg(
        F.count(F.lit(1)).alias("recipients"))


@query("consortium_apply", with_cte(
    O.SKETCHED, "select event_id, consortium_score, pre_sketch_score from sk"))
def _(i):
    return i.decisions.select("event_id", "consortium_score", "pre_sketch_score")


def _hmac_sql(message: str, key: str) -> str:
    from vigil.functions.scalars import key_pads

    inner, outer = (bytes(p).hex() for p in key_pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query("keyed_token", ev(
    "select distinct recipient_id, " + _hmac_sql("lower(trim(recipient_id))", "fixture-recipient-key")
    + " as token from ev where recipient_id is not null"))
def _(i):
    ids = i.events.filter("recipient_id is not null").select("recipient_id").distinct()
    return ids.withColumn(
        "token", exchange.keyed_token(F.col("recipient_id"), i.settings.recipient_key))


@query("indicator_normalise", with_cte(
    O.REPORTS, "select kind, clean, count(*) as n from rep group by kind, clean"))
def _(i):
    clean = exchange.normalise_indicator(F.col("indicator_type"), F.col("indicator_value"))
    return i.reports.groupBy(F.col("indicator_type").alias("kind"), clean.alias("clean")).agg(
        F.count(F.lit(1)).alias("n"))


@query("indicator_token", with_cte(
    O.REPORTS, "select distinct kind, clean, epoch, " + _hmac_sql(
        "'sketch-v1|' || epoch || '|' || kind || '|' || clean", "fixture-token-key") + " as token, inst, "
    + _hmac_sql("'sketch-v1-institution|' || inst", "fixture-token-key") + " as inst_token from rep"))
def _(i):
    clean = exchange.normalise_indicator(F.col("indicator_type"), F.col("indicator_value"))
    epoch = exchange.epoch_bucket(F.col("observed_us"), i.settings.sketch_epoch_days)
    keyed = i.reports.select(
        F.col("indicator_type").alias("kind"), clean.alias("clean"), epoch.alias("epoch"),
        F.lower(F.trim("institution_id")).alias("inst")).distinct()
    return keyed.select(
        "*", exchange.indicator_token(F.col("kind"), F.col("clean"), F.col("epoch"), i.settings).alias("token"),
        exchange.institution_token(F.col("inst"), i.settings).alias("inst_token"))


@query("candidate_epochs", ev(
    "select epoch, count(*) as n from (select 'e' || lpad(lower(printf('%x', cast(floor((ts_us - j * "
    f"{7 * DAY_US}) / {7 * DAY_US}) as bigint))), 8, '0') as epoch from ev, range(0, 6) t(j)) group by epoch"))
def _(i):
    return i.events.select(
        F.explode(exchange.candidate_epochs(F.col("ts_us"), i.settings)).alias("epoch")
    ).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


@query("verify_report_signatures", with_cte(
    O.REPORTS, "select report_id, inst in ('bank-1','bank-2','bank-3','bank-4') as enrolled,"
    " inst in ('bank-1','bank-2','bank-3','bank-4') and not forged as signature_valid, received_us from rep"))
def _(i):
    return exchange.verify_report_signatures(i.reports, i.settings).select(
        "report_id", "enrolled", "signature_valid", "received_us")


@query("issuer_allowlist", with_cte(
    O.REPORTS, "select institution_id, count(*) as rejected from rep where inst not in"
    " ('bank-1','bank-2','bank-3','bank-4') group by institution_id"))
def _(i):
    checked = exchange.verify_report_signatures(i.reports, i.settings)
    return checked.filter("not enrolled").groupBy("institution_id").agg(F.count(F.lit(1)).alias("rejected"))


@query("sketch_admission", with_cte(
    O.ADMISSION, "select report_id, received_us, inst, rejection, replay from admitted"))
def _(i):
    return i.admission.select(
        "report_id", "received_us", F.lower("institution_id").alias("inst"), "rejection", "replay")


@query("sketch_latest", with_cte(
    O.LATEST, "select report_id, kind, epoch, status, confidence, evidence_class, observed_us, expires_us, created_us from latest"))
def _(i):
    return i.sketches.select(
        "report_id", F.col("indicator_type").alias("kind"), F.col("epoch_id").alias("epoch"), "status",
        "confidence", "evidence_class", "observed_us", "expires_us", "created_us")


_TOKEN_SQL = _hmac_sql("'sketch-v1|' || epoch || '|' || kind || '|' || clean", "fixture-token-key")
_SCORES = O.LATEST + (
    f",\nsc0 as (select kind, clean, epoch, count(distinct inst) as n, count(*) as active_reports, sum({O.weighted(str(MID))}) / count(*) as q,"
    f" min(expires_us) as expires_us from latest where status = 'active' and expires_us > {MID} group by all),\n"
    f"sc as (select kind, epoch, {_TOKEN_SQL} as token, n, active_reports, expires_us, {O.SCORED} from sc0)"
)


@query("sketch_score", with_cte(
    _SCORES, "select token, kind, epoch, n as independent_institutions, active_reports, score, confidence, status, expires_us from sc"))
def _(i):
    return exchange.sketch_score(i.sketches, MID).withColumnsRenamed(
        {"indicator_token": "token", "indicator_type": "kind", "epoch_id": "epoch"})


@query("sketch_capsules", with_cte(
    _SCORES, f"select 'cap_' || substr(sha256(kind || '|' || token || '|{MID}'), 1, 24) as capsule_id, kind, epoch, score, confidence,"
    f" n as independent_institutions, status, least(expires_us, {MID + DAY_US}) as capsule_expires_us from sc"))
def _(i):
    capsules = exchange.sketch_capsules(exchange.sketch_score(i.sketches, MID), MID, i.settings)
    return capsules.select(
        "capsule_id", F.col("indicator_type").alias("kind"), F.col("epoch_id").alias("epoch"), "score",
        "confidence", "independent_institutions", "status", "capsule_expires_us")


@query("capsule_lookup", with_cte(
    _SCORES, f"select token, {O.r('score * 0.85')} as score, {O.r('confidence * 0.75')} as confidence, n as independent_institutions,"
    f" 'cached_' || status as status from sc where least(expires_us, {MID + DAY_US}) > {MID + 12 * HOUR_US}"))
def _(i):
    capsules = exchange.sketch_capsules(exchange.sketch_score(i.sketches, MID), MID, i.settings)
    return exchange.capsule_lookup(capsules, MID + 12 * HOUR_US).select(
        F.col("indicator_token").alias("token"), "score", "confidence", "independent_institutions", "status")


_LOOK = (
    "score independent_institutions confidence active_reports status expires_us"
)


@query("sketch_lookup", with_cte(
    O.SKETCHED, "select event_id, kind, score, n as independent_institutions, confidence, active_reports, status, expires_us from best"))
def _(i):
    indicators = exchange.event_indicators(campaign.with_campaign(i.features, i.settings))
    return exchange.sketch_lookup(indicators, i.sketches, i.settings).select(
        "event_id", "kind", *cols(_LOOK))


@query("sketch_apply", with_cte(
    O.SKETCHED, "select event_id, fused_score, fraud_sketch_risk, fraud_sketch_local_corroboration, sketch_ceiling, sketch_status, matches from sk"))
def _(i):
    return i.decisions.select(
        "event_id", "fused_score", "fraud_sketch_risk", "fraud_sketch_local_corroboration", "sketch_ceiling",
        "sketch_status", "matches")


@query("sketch_status", with_cte(
    O.SKETCHED, "select i.event_id, i.kind, coalesce(b.score, 0) as score, coalesce(b.n, 0) as independent_institutions,"
    " coalesce(b.active_reports, 0) as active_reports, coalesce(b.status, 'clear') as status"
    " from ind i left join best b on b.event_id = i.event_id and b.kind = i.kind where i.kind = 'agent_terminal'"))
def _(i):
    token = F.col("agent_assurance")["terminal_token"]
    asked = terminal.attested(i.events).select(
        "event_id", F.lit("agent_terminal").alias("kind"), token.alias("value"), F.col("ts_us").alias("at_us"))
    return exchange.sketch_status(asked, i.sketches, i.settings).select(
        "event_id", "kind", "score", "independent_institutions", "active_reports", "status")


@query("privacy_storage_check", ev(
    "select cast(0 as bigint) as leaked_cells, (select count(distinct x) from (select account_id as x from ev union select recipient_id from ev"
    " where recipient_id is not null union select terminal_token from ev where terminal_token is not null)) as identifiers_checked"))
def _(i):
    raw = i.events.select(F.explode(F.array_compact(F.array(
        "account_id", "recipient_id", F.col("agent_assurance")["terminal_token"]))).alias("raw_id"))
    flat = i.flat.select(F.col("terminal_token").alias("raw_id")).filter("raw_id is not null")
    ids = raw.unionByName(flat).distinct()
    leaks = exchange.privacy_violations(i.sketches, ids)
    return leaks.select(F.lit(1).alias("leak"), F.lit(0).alias("known")).unionByName(
        ids.select(F.lit(0).alias("leak"), F.lit(1).alias("known"))).agg(
        F.sum("leak").alias("leaked_cells"), F.sum("known").alias("identifiers_checked"))


# ------------------------------------------------------------------------------------ scoring
_CONTRIB_SQL = (
    "cb as (select event_id, unnest([" + ", ".join(
        f"{{'code': '{f.upper()}', 'v': {O.r(R.contribution(f))}}}" for f in config.WEIGHTS)
    + ", " + ", ".join(
        f"{{'code': '{code}', 'v': {O.r(R.compound(cond, value))}}}" for code, cond, value, _ in config.COMPOUNDS)
    + "]) as c from feat)"
)


@query("anomaly_contributions", with_cte(
    O.FEATURES + ",\n" + _CONTRIB_SQL,
    f"select c.code as code, count(*) as events, {O.r('max(c.v)')} as largest from cb where c.v > 0 group by c.code"))
def _(i):
    return scoring.contributions(i.features).groupBy("code").agg(
        F.count(F.lit(1)).alias("events"), rnd(F.max("contribution")).alias("largest"))


@query("compound_signatures", with_cte(
    O.FEATURES, "select event_id, concat_ws('|', " + ", ".join(
        f"case when {cond} then '{code}' end" for code, cond, _, _ in config.COMPOUNDS) + ") as codes from feat"))
def _(i):
    return i.features.select("event_id", F.array_join(scoring.compound_codes(i.features), "|").alias("codes"))


@query("anomaly_score", with_cte(O.FEATURES, f"select event_id, {R.anomaly_score()} as anomaly_score from feat"))
def _(i):
    return scoring.anomaly(i.features).select("event_id", "anomaly_score")


def _reason_items() -> str:
    items = []
    for place, f in enumerate(config.WEIGHTS):
        c = R.contribution(f)
        items.append(
            f"case when {c} >= {config.REASON_MINIMUM} and {f} > 0 then {{'v': -{O.r(c)}, 'p': {place}, 'code': '{f.upper()}'}} end")
    for place, (code, cond, value, _) in enumerate(config.COMPOUNDS, start=len(config.WEIGHTS)):
        items.append(
            f"case when {cond} then {{'v': -{O.r(f'cast({value} as double)')}, 'p': {place}, 'code': '{code}'}} end")
    return ", ".join(items)


_REASONS = (
    f"rs0 as (select *, list_slice(list_sort(list_filter([{_reason_items()}], lambda x: x is not null)), 1, 8) as rl from feat),\n"
    "rs as (select event_id, array_to_string(list_transform(rl, lambda x: x.code), '|') as codes from rs0)"
)


@query("reason_codes", with_cte(O.FEATURES + ",\n" + _REASONS, "select * from rs"))
def _(i):
    return scoring.anomaly(i.features).select(
        "event_id", F.array_join(F.transform("anomaly_reasons", lambda x: x["code"]), "|").alias("codes"))


@query("security_floors", with_cte(
    O.FEATURES, f"select event_id, {R.security_floor()} as security_floor, concat_ws('|', " + ", ".join(
        f"case when {R.floor_value(cond, value)} > 0 then '{code}' end" for code, cond, value in config.FLOORS)
    + ") as codes from feat"))
def _(i):
    return i.features.select(
        "event_id", F.expr(R.security_floor()).alias("security_floor"),
        F.array_join(scoring.floor_codes(), "|").alias("codes"))


@query("fuse_scores", with_cte(
    O.FUSED, "select event_id, model_score, anomaly_score, model_weight, blended_score, security_floor, fused_0 as fused_score, driver,"
    " nullif(concat_ws(' ', case when model_score is null then " + R.text(config.NOTE_NO_MODEL)
    + f" end, case when history_confidence < {config.COLD_START_CONFIDENCE} then " + R.text(config.NOTE_COLD_START)
    + f" end, case when evidence_coverage < {config.SPARSE_COVERAGE} then " + R.text(config.NOTE_SPARSE)
    + " end), '') as uncertainty_note from fz"))
def _(i):
    from vigil.plans.fixtures import with_stand_in_model

    return scoring.fuse(scoring.anomaly(with_stand_in_model(i.features))).select(
        "event_id", "model_score", "anomaly_score", "model_weight", "blended_score", "security_floor",
        "fused_score", "driver", "uncertainty_note")


_CONF_TEXTS = config.CONFIDENCE_REASONS


@query("decision_confidence", with_cte(
    O.CONFIDENT, "select event_id, data_coverage, scorer_agreement, confidence_score, confidence_level,"
    " coalesce(nullif(concat_ws('|', case when history_confidence < 0.35 then " + R.text(_CONF_TEXTS["profile"])
    + " end, case when data_coverage < 0.50 then " + R.text(_CONF_TEXTS["coverage"])
    + f" end, case when {R.RECIPIENT_PRESENT} and {R.RECIPIENT_COVERAGE} = 0 then " + R.text(_CONF_TEXTS["recipient"])
    + " end, case when is_agent > 0 and agent_evidence_coverage = 0 then " + R.text(_CONF_TEXTS["agent"])
    + " end, case when model_score is null then " + R.text(_CONF_TEXTS["no_model"])
    + " when scorer_agreement < 0.65 then " + R.text(_CONF_TEXTS["disagree"])
    + " end), ''), " + R.text(_CONF_TEXTS["consistent"]) + ") as reasons from dc"))
def _(i):
    return i.decisions.select(
        "event_id", "data_coverage", "scorer_agreement", "confidence_score", "confidence_level",
        F.array_join("confidence_reasons", "|").alias("reasons"))


_SIGNAL_SQL = dict(zip(config.SUMMARY_SIGNALS, [
    "available_balance_before is not null", "recipient_id is not null", "device_id is not null", "sim_id is not null",
    "ip_prefix is not null", "latitude is not null", "interaction_ms is not null and menu_depth is not null",
    "keystroke_interval_ms is not null", "input_method <> 'unknown'", "device_tilt_variance is not null",
    "navigation_signature is not null", "telco_attested", "recipient_network_coverage > 0",
    "coercion_evidence_coverage > 0", "agent_evidence_coverage > 0",
]))


def _signals(wanted: bool) -> str:
    arms = " ".join(
        f"when '{channel}' then concat_ws('|', " + ", ".join(
            f"case when {'' if wanted else 'not '}({_SIGNAL_SQL[s]}) then '{s}' end" for s in names) + ")"
        for channel, names in config.SUMMARY_EXPECTED.items())
    return f"case channel {arms} end"


@query("evidence_summary", with_cte(
    O.FEATURES, f"select event_id, {_signals(True)} as available, {_signals(False)} as missing, case channel"
    " when 'app' then (case when evidence_coverage >= 0.60 then 'app_rich_behaviour' else 'core_banking_fallback' end)"
    " when 'ussd' then (case when telco_attested then 'ussd_telco_assured' else 'ussd_gateway_behaviour' end)"
    " when 'agent' then (case when agent_evidence_coverage > 0 then 'agent_terminal_integrity' else 'agent_network_behaviour' end)"
    " else 'web_session_behaviour' end as mode from feat"))
def _(i):
    return scoring.evidence_summary(i.features).select(
        "event_id", F.array_join("available_signals", "|").alias("available"),
        F.array_join("missing_signals", "|").alias("missing"), F.col("evidence_mode").alias("mode"))


_SKETCH_CODE = (
    "case when sketch_ceiling = 'delay' then 'PRIVATE_SKETCH_CORROBORATED' when sketch_institutions >= 2 then"
    " 'PRIVATE_SKETCH_UNCORROBORATED' else 'PRIVATE_SKETCH_OBSERVE_ONLY' end"
)
_ASSEMBLED = O.DECIDED + ",\n" + _REASONS + (
    ",\nra0 as (select dec.*, list_concat(list_filter([case when driver = 'security_floor' then 'SECURITY_FLOOR_APPLIED' end,"
    " case when model_score >= 0.65 then 'POPULATION_MODEL_MATCH' end,"
    f" case when fraud_sketch_risk > 0 then {_SKETCH_CODE} end,"
    " case when consortium_score >= 0.70 then 'INDEPENDENT_CONSORTIUM_REPORTS' end,"
    " case when campaign_risk >= 0.62 then 'CROSS_ACCOUNT_CAMPAIGN_DNA' end], lambda x: x is not null),"
    " list_filter(string_split(rs.codes, '|'), lambda x: x <> '')) as rc from dec join rs on rs.event_id = dec.event_id),\n"
    "ra as (select *, case when len(rc) = 0 then ['NO_MATERIAL_ANOMALY'] else list_slice(rc, 1, 8) end as rc8 from ra0)"
)


def _case(column: str, table: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {R.text(v)}" for k, v in table.items()) + " end"


_MESSAGES = ({f.upper(): m for f, m in config.REASON_MESSAGES.items()} | {c: m for c, _, _, m in config.COMPOUNDS}
             | config.EXTRA_REASONS | config.SKETCH_REASONS)


@query("reason_assembly", with_cte(
    _ASSEMBLED, "select event_id, array_to_string(rc8, '|') as codes,"
    " array_to_string(list_transform(rc8, lambda x: coalesce(" + _case("x", _MESSAGES) + ", '?')), '|') as messages from ra"))
def _(i):
    return i.decisions.select(
        "event_id", F.array_join(F.transform("reasons", lambda x: x["code"]), "|").alias("codes"),
        F.array_join(F.transform("reasons", lambda x: F.coalesce(x["message"], F.lit("?"))), "|").alias("messages"))


@query("customer_explanation", with_cte(
    _ASSEMBLED + ",\nphr as (select *, list_slice(list_filter(list_transform(rc8, lambda x: " + _case("x", config.CUSTOMER_PHRASES)
    + "), lambda y: y is not null), 1, 3) as ph from ra)",
    "select event_id, case when action = 'allow' and verified_sim_change > 0 then " + R.text(config.EXPLAIN_VERIFIED)
    + " when action = 'allow' then " + R.text(config.EXPLAIN_ALLOW) + " else " + _case("action", config.EXPLAIN_PREFIX)
    + " || ' ' || case len(ph) when 0 then " + R.text(config.PHRASE_DEFAULT) + " when 1 then ph[1]"
    " else array_to_string(list_slice(ph, 1, len(ph) - 1), ', ') || ' and ' || ph[len(ph)] end || '; ' || "
    + _case("action", config.EXPLAIN_RECOURSE) + " || '.' end as customer_explanation from phr"))
def _(i):
    return i.decisions.select("event_id", "customer_explanation")


@query("recourse_options", with_cte(
    O.DECIDED, "select event_id, concat_ws('|', case when action <> 'allow' then 'review_activity:No interruption' end,"
    " case when intrusive then 'trusted_device_confirmation:Immediate after successful confirmation' end,"
    " case when intrusive then 'official_bank_callback:After identity verification' end,"
    " case when action <> 'allow' and hold_seconds > 0 then 'automatic_review_or_expiry:Within ' ||"
    " cast(greatest(1, hold_seconds // 60) as varchar) || ' minutes' end) as options from dec"))
def _(i):
    options = scoring.recourse_options(F.col("action"), F.col("hold_seconds"))
    return i.decisions.select("event_id", F.array_join(F.transform(
        options, lambda o: F.concat_ws(":", o["action"], o["estimated_clearance"])), "|").alias("options"))


# ------------------------------------------------------------------------------------- policy
@query("risk_level", with_cte(O.DECIDED, "select risk_level, count(*) as n from dec group by risk_level"))
def _(i):
    return i.decisions.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("action_costs", with_cte(
    O.DECIDED, "select event_id, " + ", ".join(f"cost_{n}" for n in range(5)) + " from dec"))
def _(i):
    costs = F.col("action_costs")
    return i.decisions.select(
        "event_id", *[costs[a].alias(f"cost_{n}") for n, a in enumerate(config.RESIDUAL_LOSS)])


@query("choose_action", with_cte(
    O.DECIDED, "select event_id, action, case action " + " ".join(
        f"when '{a}' then cost_{n}" for n, a in enumerate(config.RESIDUAL_LOSS))
    + " else cost_pause end as selected_expected_cost from dec"))
def _(i):
    return i.decisions.select("event_id", "action", "selected_expected_cost")


@query("critical_signal", with_cte(O.DECIDED, "select event_id, critical_signal from dec"))
def _(i):
    return i.decisions.select("event_id", "critical_signal")


@query("regret_budget", with_cte(O.DECIDED, "select event_id, regret_used from used"))
def _(i):
    asked = i.events.select("tenant_id", "account_id", "ts_us", "event_id")
    return policy.regret_used(asked, i.unbudgeted, settings=i.settings).select("event_id", "regret_used")


_OVERRIDE = {"low_confidence": config.OVERRIDE_LOW_CONFIDENCE, "critical": config.OVERRIDE_CRITICAL,
             "delay": config.OVERRIDE_DELAY, "step_up": config.OVERRIDE_STEP_UP}


@query("policy_outcome", with_cte(
    O.DECIDED, "select event_id, action, hold_seconds, intrusive as requires_trusted_confirmation,"
    f" action = '{config.HOLD}' as requires_analyst_review, regret_used, regret_limit_30d, "
    + _case("override_code", _OVERRIDE) + " as budget_override_reason, coalesce(nullif(concat_ws('|',"
    f" case when {R.REGRET_RATIO} >= 1.0 then " + R.text(config.PERSONAL_BUDGET)
    + " end, case when is_ussd > 0 then " + R.text(config.PERSONAL_USSD)
    + " end, case when recurring_payment_match >= 0.80 then " + R.text(config.PERSONAL_RECURRING)
    + " end, case when confidence_score < 0.45 then " + R.text(config.PERSONAL_LOW_CONFIDENCE)
    + f" end, case when {R.SINGLE_REPORT} then " + R.text(config.PERSONAL_SINGLE_REPORT)
    + f" end, case when {R.SKETCH_ALONE} then " + R.text(config.PERSONAL_SKETCH_MONITOR)
    + f" end, case when action_0 = '{config.HOLD}' and {R.SKETCH_CEILING} and not ({R.SINGLE_REPORT} or {R.SKETCH_ALONE}) then "
    + R.text(config.PERSONAL_SKETCH_DELAY) + " end), ''), " + R.text(config.PERSONAL_STANDARD) + ") as reasons from dec"))
def _(i):
    return i.decisions.select(
        "event_id", "action", "hold_seconds", "requires_trusted_confirmation", "requires_analyst_review",
        "regret_used", "regret_limit_30d", "budget_override_reason",
        F.array_join("personalization_reasons", "|").alias("reasons"))


# ----------------------------------------------------------------------------------- campaign
@query("campaign_stages", with_cte(
    O.STAGED, "select campaign_signature, stages_text as stages, count(*) as n from st group by all"))
def _(i):
    return campaign.campaign_stages(i.features).groupBy(
        "campaign_signature", F.array_join("campaign_stages", "|").alias("stages")).agg(
        F.count(F.lit(1)).alias("n"))


@query("campaign_memory", with_cte(O.STAGED, "select event_id, campaign_accounts from camp"))
def _(i):
    return campaign.campaign_accounts(campaign.campaign_stages(i.features), i.settings).select(
        "event_id", "campaign_accounts")


@query("campaign_score", with_cte(
    O.STAGED, "select event_id, campaign_accounts, campaign_is_eligible, campaign_risk from cs"))
def _(i):
    return campaign.with_campaign(i.features, i.settings).select(
        "event_id", "campaign_accounts", "campaign_is_eligible", "campaign_risk")


@query("campaign_apply", with_cte(
    O.SKETCHED, "select event_id, fused_0 as before, fused_1 as after from sk where campaign_risk >= 0.62"))
def _(i):
    d = i.decisions.filter("campaign_risk >= 0.62")
    before = F.greatest("blended_score", "security_floor")
    return d.select("event_id", before.alias("before"), F.greatest(before, "campaign_risk").alias("after"))


# -------------------------------------------------------------------- learning, lifecycle, cases
_TRUST_STATE = O.DECIDED + (
    f",\nts0 as (select event_id, tenant_id, account_id, ts_us, action, {END} - ({END} - ts_us) % {2 * DAY_US} as created_us,"
    " fused_score from dec),\n"
    "tst as (select *, case when action in ('allow','allow_with_monitoring') and fused_score < 0.48 then"
    f" (case when ts_us <= created_us - {DAY_US} then 'trusted' else 'pending' end) else 'excluded' end as trust_state from ts0)"
)


def _trust_rows(i: Inputs) -> DataFrame:
    created = F.lit(END) - (F.lit(END) - F.col("ts_us")) % (2 * DAY_US)
    return learning.trust_state(i.decisions.withColumn("created_us", created), i.settings)


@query("trust_state", with_cte(
    _TRUST_STATE, f"select event_id, trust_state, case when trust_state = 'pending' then created_us + {DAY_US} end as eligible_after_us,"
    " case when trust_state = 'pending' then 'safe_learning_quarantine' else action end as trust_reason from tst"))
def _(i):
    return _trust_rows(i).select("event_id", "trust_state", "eligible_after_us", "trust_reason")


@query("mature_learning", with_cte(
    _TRUST_STATE, f"select tenant_id, account_id, count(*) as matured from tst where trust_state = 'pending' and created_us + {DAY_US} <= {END}"
    " group by tenant_id, account_id"))
def _(i):
    matured = learning.mature_learning(_trust_rows(i), END)
    return matured.groupBy("tenant_id", "account_id").agg(F.count(F.lit(1)).alias("matured"))


_LC = (
    "lc0 as (select 'order_' || cast(l_orderkey as varchar) as event_id, " + adapter.LIFECYCLE_STATE + " as to_state,"
    " epoch_us(l_shipdate) as at_us, cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey as seq,"
    " cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as idem from lineitem),\n"
    "lc1 as (select *, row_number() over (partition by idem order by at_us, seq) as rn from lc0),\n"
    "lc as (select * from lc1 where rn = 1),\n"
    "lv as (select event_id, seq, coalesce(lag(to_state) over (partition by event_id order by at_us, seq), 'created') as from_state, to_state from lc)"
)
_EDGE_SQL = " or ".join(
    f"(from_state = '{s}' and to_state in ({', '.join(repr(t) for t in ts)}))"
    for s, ts in config.LIFECYCLE_EDGES.items() if ts)


@query("lifecycle_validate", with_cte(
    _LC, f"select from_state, to_state, ({_EDGE_SQL}) as allowed, count(*) as n from lv group by all"))
def _(i):
    log = learning.lifecycle_log(adapter.lifecycle_requests(i.spark, i.sf_dir))
    return learning.lifecycle_validate(log).groupBy("from_state", "to_state", "allowed").agg(
        F.count(F.lit(1)).alias("n"))


@query("lifecycle_current", with_cte(
    _LC, "select event_id, arg_max(to_state, (at_us, seq)) as state, count(*) as version from lc group by event_id"))
def _(i):
    return learning.lifecycle_current(learning.lifecycle_log(adapter.lifecycle_requests(i.spark, i.sf_dir)))


@query("initial_state", with_cte(
    O.DECIDED, f"select action, case when action in ('{config.HOLD}','{config.SAFE_PAUSE}','{config.DELAY}') then 'held'"
    " else 'authorized' end as state, count(*) as n from dec group by all"))
def _(i):
    return i.decisions.groupBy("action", learning.initial_state(F.col("action")).alias("state")).agg(
        F.count(F.lit(1)).alias("n"))


_CASES = O.DECIDED + (
    ",\nca0 as (select d.*, coalesce(rrep.confirmed_reports, 0) + coalesce(trep.confirmed_reports, 0) + coalesce(sketch_active_reports, 0) as reports,"
    f" (d.action = '{config.HOLD}' or fused_score >= 0.84) as due, cast('0x' || substr(sha256(d.event_id), 1, 6) as bigint) % 100 = 0 as lucky"
    " from dec d left join rrep on rrep.event_id = d.event_id left join trep on trep.event_id = d.event_id),\n"
    "ca as (select tenant_id, event_id, ts_us, not due and lucky as random_audit, case when due then "
    + R.review_priority("reports") + " else 0.1 end as priority from ca0 where due or lucky)"
)


@query("review_priority", with_cte(_CASES, "select tenant_id, event_id, random_audit, priority from ca"))
def _(i):
    return learning.review_cases(i.decisions).select("tenant_id", "event_id", "random_audit", "priority")


@query("case_queue", with_cte(
    _CASES, "select tenant_id, event_id, priority, rank from (select *, row_number() over (partition by tenant_id order by priority desc,"
    " ts_us, event_id) as rank from ca) where rank <= 100"))
def _(i):
    return learning.case_queue(learning.review_cases(i.decisions)).select(
        "tenant_id", "event_id", "priority", "rank")


@query("account_decisions", with_cte(
    O.DECIDED, "select account_id, event_id, action, rank from (select *, row_number() over (partition by tenant_id, account_id order by"
    " ts_us desc, event_id) as rank from dec) where rank <= 5"))
def _(i):
    return learning.account_decisions(i.decisions, 5).select("account_id", "event_id", "action", "rank")


@query("appeals_join", with_cte(
    O.DECIDED, "select tenant_id, event_id as decision_id, action, 'open' as status from dec"
    f" where action in ({O._INTRUSIVE}) and success and ts_us % 2 = 0"))
def _(i):
    held = i.events.filter(F.col("ts_us") % 2 == 0).filter("success").select(
        "tenant_id", F.col("event_id").alias("decision_id"))
    decided = i.decisions.filter(F.col("action").isin(config.INTRUSIVE_ACTIONS))
    return learning.appeals_join(held, decided).select("tenant_id", "decision_id", "action", "status")


def _privacy(i: Inputs) -> DataFrame:
    kind = F.when(F.col("event_type") == "account_recovery", "delete").otherwise("export")
    return i.events.filter(F.col("event_type").isin("account_recovery", "pin_reset")).select(
        "tenant_id", "account_id", kind.alias("request_type"))


@query("privacy_queue", ev(
    "select 'export' as outcome, count(*) as events from ev where (tenant_id, account_id) in (select (tenant_id, account_id) from ev"
    " where event_type = 'pin_reset') union all select 'kept', count(*) from ev where (tenant_id, account_id) not in"
    " (select (tenant_id, account_id) from ev where event_type = 'account_recovery')"))
def _(i):
    requests = learning.privacy_queue(_privacy(i), i.tenant_accounts)
    exported = learning.privacy_export(i.events, requests).agg(F.count(F.lit(1)).alias("events"))
    kept = learning.privacy_delete(i.events, requests).agg(F.count(F.lit(1)).alias("events"))
    return exported.select(F.lit("export").alias("outcome"), "events").unionByName(
        kept.select(F.lit("kept").alias("outcome"), "events"))


@query("profile_succession", ev(
    "select event_id, account_id, (sim_change_verified and success) as approved, case when sim_change_verified and success then"
    " 'conservative_reseed' else 'verification_required' end as mode from ev where event_type in ('account_recovery','pin_reset')"))
def _(i):
    asked = i.events.filter(F.col("event_type").isin("account_recovery", "pin_reset")).select(
        "event_id", "account_id", F.col("sim_change_verified").alias("trusted_device_confirmed"),
        F.col("success").alias("official_callback_confirmed"))
    return learning.profile_succession(asked, i.settings).select("event_id", "account_id", "approved", "mode")


# ---------------------------------------------------------------------------------- integrity
_CHAIN = (
    "rows0 as (select tenant_id || '/' || strftime(occurred_at, '%Y-%m-%d') as chain, ts_us, event_id,"
    " cast(ts_us as varchar) || '|' || event_type || '|' || account_id || '|' || event_id as body from ev),\n"
    "rows1 as (select *, row_number() over (partition by chain order by ts_us, event_id) as seq from rows0),\n"
    "linked(chain, seq, body, entry_hash) as (select chain, seq, body, sha256('1|' || body || '|" + "0" * 64 + "') from rows1 where seq = 1"
    " union all select r.chain, r.seq, r.body, sha256(cast(r.seq as varchar) || '|' || r.body || '|' || l.entry_hash)"
    " from linked l join rows1 r on r.chain = l.chain and r.seq = l.seq + 1)"
)


@query("chain_append", ev("select chain, seq as sequence, entry_hash from linked", _CHAIN))
def _(i):
    return i.chained.select("chain", "sequence", "entry_hash")


@query("audit_verify", ev(
    "select chain, true as valid, max(seq) as entries_checked, cast(null as bigint) as first_invalid_sequence,"
    " arg_max(entry_hash, seq) as head_hash from linked group by chain", _CHAIN))
def _(i):
    return integrity.verify_chain(i.chained)


@query("journal_verify", ev(
    "select l.chain, coalesce(t.seq, 0) = 0 as valid, coalesce(t.seq - 1, m.n) as entries_checked, t.seq as first_invalid_sequence,"
    " case when coalesce(t.seq - 1, m.n) > 0 then l.entry_hash end as head_hash from (select chain, max(seq) as n from linked group by chain) m"
    " left join (select chain, min(seq) as seq from rows1 where event_id like '%77' group by chain) t on t.chain = m.chain"
    " left join linked l on l.chain = m.chain and l.seq = greatest(1, coalesce(t.seq - 1, m.n))", _CHAIN))
def _(i):
    altered = i.chained.withColumn(
        "body", F.when(F.col("event_id").endswith("77"), F.concat("body", F.lit("#"))).otherwise(F.col("body")))
    return integrity.verify_chain(altered)


_DIGEST = O.FEATURES + (
    ",\ndg as (select event_id, ts_us, sha256(concat_ws('|', event_id, account_id, tenant_id, cast(ts_us as varchar), event_type, channel,"
    " cast(cast(floor(amount * 1000000 + 0.5) as bigint) as varchar), coalesce(recipient_id, ''), device_id, sim_id)) as event_digest, sha256(concat_ws('|', "
    + ", ".join(f"cast(cast(floor({n} * 1000000 + 0.5) as bigint) as varchar)"
                for n in config.FEATURES + config.AGENT_FEATURES)
    + ")) as feature_digest from feat),\n"
    "rd as (select *, sha256(event_digest || '|' || feature_digest || '|rules-only|policy-1.4.0|' || cast(ts_us as varchar)) as replay_digest from dg)"
)


@query("provenance_digest", with_cte(
    _DIGEST, "select event_id, event_digest, feature_digest, replay_digest, sha256('"
    + "|".join(config.MODEL_FEATURES) + "') as feature_schema from rd"))
def _(i):
    return integrity.provenance(i.features, i.settings).select(
        "event_id", "event_digest", "feature_digest", "replay_digest",
        validate.schema_hash(config.MODEL_FEATURES).alias("feature_schema"))


@query("replay_verify", with_cte(
    _DIGEST, "select event_id, replay_digest as computed_digest, not (event_id like '%99') as exact_match from rd"))
def _(i):
    stored = integrity.provenance(i.features, i.settings).withColumn(
        "replay_digest", F.when(F.col("event_id").endswith("99"), F.reverse("replay_digest"))
        .otherwise(F.col("replay_digest")))
    return integrity.replay_verify(stored).select("event_id", "computed_digest", "exact_match")


@query("offline_reference", ev(
    "select event_id, 'OFF-' || upper(substr(sha256(tenant_id || '|' || event_id), 1, 12)) as reference from ev"))
def _(i):
    return i.events.select(
        "event_id", integrity.offline_reference(F.col("tenant_id"), F.col("event_id")).alias("reference"))


@query("audit_anchor", ev(
    "select chain, arg_max(entry_hash, seq) as head_hash, " + _hmac_sql(
        "arg_max(entry_hash, seq) || '|2024-02-01T00:00:00+00:00'", "fixture-anchor-key")
    + " as signature from linked group by chain", _CHAIN))
def _(i):
    return integrity.audit_anchor(
        integrity.verify_chain(i.chained), "2024-02-01T00:00:00+00:00", i.settings
    ).select("chain", "head_hash", "signature")


# --------------------------------------------------------------------------------- resilience
_HB = (
    "hb0 as (select tenant_id, ts_us as at_us, " + ", ".join(f"{v} as {n}" for n, v in adapter.HEARTBEAT.items())
    + " from ev where event_type = 'deposit'),\n"
    "hb1 as (select *, case when abs(received_us - at_us) > 300000000 then 'stale' when forged then 'signature_invalid' end as basic from hb0),\n"
    "hbn as (select nonce, min((received_us, heartbeat_id)) as first_claim from hb1 where basic is null group by nonce),\n"
    "hb as (select h.*, case when basic is not null then basic when (received_us, heartbeat_id) > first_claim then 'nonce_reused' end as rejection"
    " from hb1 h left join hbn on hbn.nonce = h.nonce)"
)
_ALL_UP = " and ".join(f"dep_{d}" for d in config.DEPENDENCIES)
# The mode as a literal state machine over heartbeats and completions of each tenant, in time order.
_MODES = _HB + (
    f",\nsteps0 as (select tenant_id, at_us, 0 as kind, heartbeat_id, {_ALL_UP} as up, dep_core_banking as core from hb where rejection is null"
    " union all select distinct tenant_id, ts_us, 1, null, null, null from ev where event_type = 'withdrawal'),\n"
    "steps as (select *, row_number() over (partition by tenant_id order by at_us, kind) as rn from steps0),\n"
    "walk(tenant_id, rn, at_us, kind, heartbeat_id, mode) as (select tenant_id, cast(0 as bigint), cast(0 as bigint), 0, cast(null as varchar), 'online'"
    " from (select distinct tenant_id from steps) union all select s.tenant_id, s.rn, s.at_us, s.kind, s.heartbeat_id,"
    " case when s.kind = 1 then (case when w.mode = 'reconciling' then 'online' else w.mode end)"
    " when not s.core then 'isolated' when not s.up then 'degraded' when w.mode <> 'online' then 'reconciling' else 'online' end"
    " from walk w join steps s on s.tenant_id = w.tenant_id and s.rn = w.rn + 1)"
)
_CONTEXT = _MODES + (
    ",\ntl as (select w.tenant_id, w.at_us, w.mode, hb.* exclude (tenant_id, at_us) from walk w join hb on hb.heartbeat_id = w.heartbeat_id where w.kind = 0),\n"
    "cp as (select tenant_id, ts_us as issued_us from ev where event_type = 'failed_login'),\n"
    "cx0 as (select e.event_id, e.tenant_id, e.ts_us, t.mode, " + ", ".join(f"t.dep_{d}" for d in config.DEPENDENCIES)
    + " from ev e asof left join tl t on t.tenant_id = e.tenant_id and t.at_us <= e.ts_us),\n"
    "cx1 as (select c.*, cp.issued_us from cx0 c asof left join cp on cp.tenant_id = c.tenant_id and cp.issued_us <= c.ts_us),\n"
    "cx2 as (select event_id, tenant_id, coalesce(mode, 'online') as resilience_mode, coalesce(ts_us < issued_us + "
    f"{8 * HOUR_US}, false) as capsule_valid, " + ", ".join(
        f"coalesce(dep_{d}, true) as dep_{d}" for d in config.DEPENDENCIES) + " from cx1),\n"
    "cx3 as (select *, case resilience_mode when 'online' then 1.0 when 'degraded' then (case when not dep_model_runtime then 0.72 else 0.82 end)"
    " when 'isolated' then 0.35 else 0.75 end as m from cx2),\n"
    "cx as (select *, case when resilience_mode <> 'online' and not capsule_valid then least(m, 0.25) else m end as confidence_multiplier,"
    " concat_ws('|', " + ", ".join(f"case when not dep_{d} then '{d}' end" for d in sorted(config.DEPENDENCIES))
    + ") as unavailable_sources from cx3)"
)


@query("heartbeat_admit", ev("select heartbeat_id, rejection from hb", _HB))
def _(i):
    return i.beat_admission.select("heartbeat_id", "rejection")


@query("mode_timeline", ev(
    "select tenant_id, heartbeat_id, at_us, mode from walk where kind = 0 and heartbeat_id is not null", _MODES))
def _(i):
    return i.timeline.select("tenant_id", "heartbeat_id", "at_us", "mode")


@query("resilience_context_asof", ev(
    "select event_id, resilience_mode, capsule_valid, confidence_multiplier, unavailable_sources from cx", _CONTEXT))
def _(i):
    return i.outage_context.select(
        "event_id", "resilience_mode", "capsule_valid", "confidence_multiplier", "unavailable_sources")


@query("mask_unavailable", ev(
    "select e.event_id, coalesce(has_telco and telco_attested and dep_telco_gateway, false) as telco,"
    " coalesce(has_terminal and terminal_attested and dep_agent_integrity, false) as terminal from ev e join cx on cx.event_id = e.event_id", _CONTEXT))
def _(i):
    joined = i.events.join(i.outage_context, ["tenant_id", "event_id"])
    no = F.lit(False)
    return validate.mask_unavailable(joined).select(
        "event_id", F.coalesce("telco_assurance.gateway_attested", no).alias("telco"),
        F.coalesce("agent_assurance.gateway_attested", no).alias("terminal"))


_INCOMING = _CONTEXT + (
    f",\ninc as (select *, event_type not in {O.TXN} and amount2 <> 0 as bad from (select *, case when k % 43 = 0 then 1 else amount end as amount2, ts_us as at_us, false as again from ev"
    f" union all select *, case when k % 43 = 0 then 1 else amount end as amount2, ts_us + {HOUR_US} as at_us, true as again from ev where k % 50 = 0))"
)


@query("admitted_events", ev(
    "select i.event_id, at_us, case when bad then 'non_transaction_amount' when again then 'duplicate_event' else '' end as rejections,"
    " case when not bad and not again then resilience_mode end as resilience_mode,"
    " case when not bad and not again then coalesce(has_telco and telco_attested and dep_telco_gateway, false) end as telco"
    " from inc i join cx on cx.event_id = i.event_id", _INCOMING))
def _(i):
    accepted, rejected = replay.admit(i.incoming, i.outage_context, i.settings)
    telco = F.coalesce("telco_assurance.gateway_attested", F.lit(False))
    kept = accepted.select("event_id", F.col("ts_us").alias("at_us"), text_list("rejections"), "resilience_mode", telco.alias("telco"))
    return kept.unionByName(rejected.select("event_id", F.col("ts_us").alias("at_us"), text_list("rejections")), allowMissingColumns=True)


@query("replayed_decisions")
def _(i):
    return i.replayed.decisions.select(
        "event_id", "fused_score", "risk_level", "confidence_level", "action", "regret_used", "resilience_mode", "history_confidence")


@query("replayed_trust")
def _(i):
    return i.replayed.trust.select("event_id", "account_id", "from_us", "to_us")


_ENVELOPE = O.DECIDED + ",\n" + _CONTEXT + (
    ",\nen0 as (select d.*, cx.resilience_mode from dec d join cx on cx.event_id = d.event_id),\n"
    f"en as (select *, {R.envelope_rank('action', 'resilience_mode')} as rank_2 from en0)"
)


@query("safety_envelope", with_cte(
    _ENVELOPE, f"select event_id, resilience_mode, {R.rank_action('rank_2')} as action, case when {R.rank_action('rank_2')} <> action"
    f" then greatest(hold_seconds, {R.hold_seconds('(' + R.rank_action('rank_2') + ')')}) else hold_seconds end as hold_seconds from en"))
def _(i):
    context = i.outage_context.select("tenant_id", "event_id", "resilience_mode")
    decided = i.decisions.drop("resilience_mode", "outage_reason", "safety_envelope_applied")
    return policy.safety_envelope(decided.join(context, ["tenant_id", "event_id"])).select(
        "event_id", "resilience_mode", "action", "hold_seconds")


_JOURNAL = O.DECIDED + ",\n" + _CONTEXT + (
    ",\njn as (select p.tenant_id, p.event_id, p.ts_us, p.fused_score as risk_score, p.ts_us as sequence,"
    " case when p.ts_us % 3 = 0 then 'reconciled' else 'pending' end as status, p.ts_us % 17 = 0 as failed"
    " from p join cx on cx.event_id = p.event_id where cx.resilience_mode <> 'online'),\n"
    "rp0 as (select *, row_number() over (partition by tenant_id order by risk_score desc, sequence) as rank from jn where status = 'pending')"
)


@query("reconcile_plan", with_cte(
    _JOURNAL, "select tenant_id, event_id, risk_score, rank, coalesce(sum(cast(failed as integer)) over (partition by tenant_id order by rank"
    " rows between unbounded preceding and 1 preceding), 0) < 5 as processed from rp0 where rank <= 100"))
def _(i):
    return resilience.reconcile_plan(i.journal, settings=i.settings).select(
        "tenant_id", "event_id", "risk_score", "rank", "processed")


@query("resilience_status", with_cte(
    _JOURNAL, "select tenant_id, count(*) filter (where status = 'pending') as pending_events, min(ts_us) filter (where status = 'pending')"
    " as oldest_us from jn group by tenant_id"))
def _(i):
    return resilience.resilience_status(i.journal).select(
        "tenant_id", "pending_events", micros("oldest_pending_at").alias("oldest_us"))


def _variant(text: str, *changes: tuple[str, str]) -> str:
    """The same chain of SQL with some of its parts exchanged; each must be there."""
    for old, new in changes:
        assert old in text, old
        text = text.replace(old, new)
    return text


# Evidence as the outage left it: own transfer alone without the graph, no model score, no exchange.
_ALONE = {"unique_senders_24h": 1, "first_time_sender_ratio_24h": 1, "inflow_amount_1h": 0, "outflow_amount_1h": 0,
          "rapid_cashout_ratio_1h": 0, "current_sender_first_time": 1}
_MASKED_NET = _CONTEXT + ",\n" + _variant(O.NETWORK, ("\nnet as (", "\nnet_all as (")) + (
    ",\nnet as (select n.event_id, n.tenant_id, "
    + ", ".join(f"case when cx.dep_recipient_graph then n.{c} else cast({v} as double) end as {c}" for c, v in _ALONE.items())
    + " from net_all n join cx on cx.event_id = n.event_id)"
)
_AS_KNOWN = _variant(
    O.SKETCHED, (O.NETWORK, _MASKED_NET),
    ("feat as materialized (select e.*,", "feat as materialized (select e.*, cx.resilience_mode, cx.dep_model_runtime, cx.dep_consortium,"),
    (" from ev e join sf on", " from ev e join cx on cx.event_id = e.event_id join sf on"),
    (O.MODEL_STAND_IN, f"case when dep_model_runtime then ({O.MODEL_STAND_IN}) end"),
    ("coalesce(cons.consortium_score, 0) as", "case when dep_consortium then coalesce(cons.consortium_score, 0) else 0 end as"),
    (O.LOOKUP, _variant(O.LOOKUP, (" from fz where ", " from fz where dep_consortium and "))),
)
# All evidence back, and no campaign.
_RESTORED = _variant(O.CONFIDENT, (" else 0 end as campaign_risk from st", " else 0 end * 0 as campaign_risk from st"))


@query("reconcile_rescore", (
    f"with known as materialized ({with_cte(_AS_KNOWN, 'select event_id, ts_us, resilience_mode, fused_score from sk')}),\n"
    f"restored as materialized ({with_cte(_RESTORED, 'select event_id, fused_score, confidence_score, risk_level from dc')})\n"
    f"select k.event_id, k.fused_score as original_score, r.fused_score as restored_score, {O.r('r.fused_score - k.fused_score')} as score_delta,"
    " r.confidence_score as restored_confidence, r.risk_level as restored_risk_level"
    " from known k join restored r on r.event_id = k.event_id where k.resilience_mode <> 'online' and k.ts_us % 3 <> 0"))
def _(i):
    return i.rescored.drop("tenant_id")


# --------------------------------------------------------------------------------- governance
POLICIES = [("live", 0.30, 0.48, 0.66, 0.84), ("strict", 0.20, 0.40, 0.55, 0.75),
            ("lenient", 0.40, 0.60, 0.75, 0.92)]


@query("policy_simulation", with_cte(
    O.DECIDED, "select tenant_id, policy, case when fused_score >= h then 'hold' when fused_score >= d then 'delay' when fused_score >= c then"
    " 'confirm' when fused_score >= m then 'monitor' else 'allow' end as bucket, count(*) as events from dec, (values "
    + ", ".join(f"('{n}', {m}, {c}, {d}, {h})" for n, m, c, d, h in POLICIES)
    + ") t(policy, m, c, d, h) group by tenant_id, policy, bucket"))
def _(i):
    return governance.policy_simulation(i.decisions, POLICIES)


def _psi_sql(source: str, keys: str) -> str:
    bins = " + ".join(f"(case when value >= lo + {float(b)} * ((hi - lo) / 10.0) then 1 else 0 end)" for b in range(1, 10))
    return (
        f"lim as (select {keys}, min(value) as lo, max(value) as hi, count(*) filter (where not is_current) as ne,"
        f" count(*) filter (where is_current) as na from {source} group by {keys}),\n"
        f"bn as (select {keys}, lo, hi, ne, na, {bins} as bin, count(*) filter (where not is_current) as e,"
        f" count(*) filter (where is_current) as a from {source} join lim using ({keys}) group by all),\n"
        "pt as (select *, greatest(e / cast(ne as double), 1e-6) as ep, greatest(a / cast(na as double), 1e-6) as ap from bn),\n"
        f"psi as (select {keys}, {O.r('sum(case when hi - lo <= 1e-9 * greatest(abs(hi), abs(lo)) then 0 else (ap - ep) * ln(ap / ep) end)')}"
        f" as psi from pt group by {keys})"
    )


@query("psi", with_cte(
    f"ps as (select event_type, value, epoch_us(ts) >= {START + 15 * DAY_US} as is_current from events),\n" + _psi_sql("ps", "event_type"),
    "select event_type, psi from psi"))
def _(i):
    raw = adapter.table(i.spark, i.sf_dir, "events").select(
        "event_type", "value", (micros("ts") >= START + 15 * DAY_US).alias("is_current"))
    return governance.psi(raw, ["event_type"])


_WINDOWS = O.DECIDED + (
    ",\nnum as (select *, row_number() over (partition by tenant_id order by ts_us, event_id) as pos, count(*) over (partition by tenant_id) as total from dec),\n"
    "win as (select *, (total // 2) as w, pos > total - (total // 2) as is_current from num"
    " where pos <= (total // 2) or pos > total - (total // 2)),\n"
    "dl as (" + " union all ".join(
        f"select tenant_id, '{n}' as feature, is_current, {n} as value from win" for n in ["fused_score", *config.DRIFT_FEATURES])
    + "),\n" + _psi_sql("dl", "tenant_id, feature") + ",\n"
    "dr as (select *, case when psi >= 0.25 then 'alert' when psi >= 0.10 then 'watch' else 'stable' end as status from psi),\n"
    "ac as (select tenant_id, action, count(*) filter (where not is_current) as rr, count(*) filter (where is_current) as cc from win group by all),\n"
    "at2 as (select tenant_id, sum(rr) as nr, sum(cc) as nc from ac group by tenant_id),\n"
    f"ad0 as (select ac.tenant_id, action, {O.r('rr / cast(nr as double)')} as reference_share, {O.r('cc / cast(nc as double)')} as current_share"
    " from ac join at2 on at2.tenant_id = ac.tenant_id),\n"
    f"ad as (select *, {O.r('abs(current_share - reference_share)')} as share_change from ad0)"
)


def _windows(i: Inputs) -> DataFrame:
    return governance.drift_windows(i.decisions.withColumn("model_version", F.lit("rules-only")))


@query("drift_report", with_cte(_WINDOWS, "select tenant_id, feature, psi, status from dr"))
def _(i):
    return governance.drift_report(_windows(i))


@query("action_drift", with_cte(_WINDOWS, "select * from ad"))
def _(i):
    return governance.action_drift(_windows(i))


@query("drift_summary", with_cte(
    _WINDOWS, "select d.tenant_id, (select max(w) from win where win.tenant_id = d.tenant_id) as window_size,"
    " max(psi) filter (where feature = 'fused_score') as score_psi, count(*) filter (where feature <> 'fused_score' and status = 'alert') as alerting_features,"
    " (select max(share_change) from ad where ad.tenant_id = d.tenant_id) as max_share_change, 1 as model_versions,"
    " case when bool_or(status = 'alert') then 'alert' when bool_or(status = 'watch') then 'watch' else 'stable' end as status,"
    " (select max(share_change) from ad where ad.tenant_id = d.tenant_id) >= 0.15 as action_mix_moved,"
    " max(psi) filter (where feature = 'fused_score') >= 0.25 or count(*) filter (where feature <> 'fused_score' and status = 'alert') >= 2"
    " as retraining_recommended from dr d group by d.tenant_id"))
def _(i):
    windows = _windows(i)
    return governance.drift_summary(governance.drift_report(windows), governance.action_drift(windows), windows)


@query("equity_report", with_cte(O.DECIDED, "select tenant_id, action, count(*) as events from dec group by all"))
def _(i):
    return governance.equity_report(i.decisions)


@query("ops_metrics", with_cte(
    _CASES + ",\n" + _TRUST_STATE[len(O.DECIDED) + 2:],
    "select tenant_id, 'decisions_by_level' as metric, risk_level as key, count(*) as n from dec group by all union all"
    " select tenant_id, 'decisions_by_action', action, count(*) from dec group by all union all"
    " select tenant_id, 'feedback_by_label', label, count(*) from fb group by all union all"
    " select tenant_id, 'pending_learning', '', count(*) from tst where trust_state = 'pending' group by all union all"
    " select tenant_id, 'open_cases', '', count(*) from ca group by all union all"
    f" select 'shared', 'active_sketches', kind, count(*) from latest where status = 'active' and expires_us > {MID} group by all"))
def _(i):
    named = i.feedback.join(i.events.select("event_id", "tenant_id"), "event_id")
    return governance.ops_metrics(
        i.decisions, named, _trust_rows(i), learning.review_cases(i.decisions), i.sketches, MID)


@query("latency_quantiles",
       "select event_type, arr[least(n, cast(floor(n * 0.50) as bigint) + 1)] as p50, arr[least(n, cast(floor(n * 0.95) as bigint) + 1)] as p95,"
       " arr[least(n, cast(floor(n * 0.99) as bigint) + 1)] as p99, n as samples from (select event_type, list(value order by value) as arr,"
       " count(*) as n from events group by event_type)")
def _(i):
    return governance.latency_quantiles(adapter.table(i.spark, i.sf_dir, "events"), "value", ["event_type"])


# --------------------------------------------------------------------------------- evaluation
_LAB = O.DECIDED + (
    ",\nlab as materialized (select d.*, " + adapter.EVENT["is_takeover"] + " as label, " + adapter.EVENT["scenario"]
    .replace("raw_type", "event_type") + " as scenario2, fused_score as score from dec d)"
)
_GEN = (
    "gen as (select d.doc_id, l.toxic as label, d.lang as channel, d.source as scenario, "
    + O.r("least(1.0, n_chars / cast(20000 as double))") + " as score from documents d join labels l on l.doc_id = d.doc_id)"
)
_T = config.THRESHOLDS
_POINTS = "(values " + ", ".join(f"('{n}', {t})" for n, t in _T.items()) + ") t(point, threshold)"


def _points_sql(source: str, keys: str = "") -> str:
    return (
        f"pc as (select {keys} point, cast(threshold as double) as threshold, count(*) filter (where score >= threshold and label = 1) as true_positives,"
        " count(*) filter (where score >= threshold and label = 0) as false_positives, count(*) filter (where score < threshold and label = 1)"
        f" as false_negatives, count(*) filter (where label = 0) as normal_events, count(*) filter (where label = 1) as takeover_events from {source}, {_POINTS}"
        f" group by {keys} point, threshold),\n"
        f"pts as (select *, {O.r('true_positives / cast(greatest(1, takeover_events) as double)')} as recall,"
        f" {O.r('true_positives / cast(greatest(1, true_positives + false_positives) as double)')} as precision,"
        f" {O.r('false_positives / cast(greatest(1, normal_events) as double)')} as false_positive_rate,"
        f" {O.r('2.0 * true_positives / cast(greatest(1, 2 * true_positives + false_positives + false_negatives) as double)')} as f1 from pc)"
    )


def _rank_sql(source: str, keys: str, group: str) -> str:
    on = " and ".join(f"b.{k} = a.{k}" for k in keys.split(", ")) if keys else "true"
    k = keys + ", " if keys else ""
    part = f"partition by {keys} " if keys else ""
    return (
        f"rk as (select {k} label, score, rank() over ({part} order by score) + (count(*) over ({part + ',' if part else 'partition by '} score) - 1) / 2.0 as rnk"
        f" from {source}),\n".replace(" ,", ",").replace("partition by " + keys + ",", "partition by " + keys + ",")
        + f"au as (select {k} " + O.r(
            "(sum(rnk) filter (where label = 1) - (count(*) filter (where label = 1)) * ((count(*) filter (where label = 1)) + 1) / 2.0)"
            " / cast(nullif((count(*) filter (where label = 1)) * (count(*) filter (where label = 0)), 0) as double)")
        + f" as roc_auc, count(*) filter (where label = 1) as positives, count(*) as samples from rk {group}),\n"
        f"ap0 as (select {k} score, count(*) filter (where label = 1) as p, count(*) as c from {source} group by {k} score),\n"
        f"ap1 as (select {k} p, sum(p) over ({part} order by score desc) as tp, sum(c) over ({part} order by score desc) as fl from ap0),\n"
        f"apx as (select {k} " + O.r("sum(p * (tp / cast(fl as double))) / nullif(sum(p), 0)") + f" as pr_auc from ap1 {group})"
    )


_ROC = _rank_sql("lab", "", "")
_ROC_GEN = _rank_sql("gen", "channel", "group by channel")


@query("chrono_split", ev(
    "select split, count(*) as events, min(ts_us) as first_us, max(ts_us) as last_us from (select *, case when pos <= floor(n * 0.65) then 'train'"
    " when pos <= floor(n * 0.82) then 'validation' else 'test' end as split from (select *, row_number() over (order by ts_us, event_id) as pos,"
    " count(*) over () as n from ev)) group by split"))
def _(i):
    return evaluation.chrono_split(i.events, "ts_us", "event_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


_SPLIT = (
    "sp as (select *, case when cast(split_part(account_id, '_', 2) as integer) % 10 < 6 then 'train' when"
    " cast(split_part(account_id, '_', 2) as integer) % 10 >= 8 then 'test' else 'unused' end as split from ev)"
)


@query("account_disjoint_split", ev(
    "select split, count(*) as events, count(distinct account_id) as accounts, cast(0 as bigint) as overlapping_accounts from sp group by split", _SPLIT))
def _(i):
    return evaluation.split_overlap(evaluation.account_disjoint_split(i.events))


@query("split_overlap", ev(
    "select split, count(*) as events, count(distinct account_id) as accounts, count(distinct case when both_splits then account_id end) as overlapping_accounts"
    " from (select *, count(distinct split) over (partition by account_id) > 1 as both_splits from (select *, case when pos <= floor(n * 0.65) then 'train'"
    " when pos <= floor(n * 0.82) then 'validation' else 'test' end as split from (select *, row_number() over (order by ts_us, event_id) as pos,"
    " count(*) over () as n from ev))) group by split"))
def _(i):
    return evaluation.split_overlap(evaluation.chrono_split(i.events, "ts_us", "event_id"))


@query("operating_point", with_cte(_LAB + ",\n" + _points_sql("lab"), "select * from pts"))
def _(i):
    return evaluation.operating_points(i.labelled_decisions, _T)


@query("transfer_only_metrics", with_cte(
    _LAB + ",\ntro as (select * from lab where is_transfer >= 0.5),\n" + _points_sql("tro"), "select * from pts"))
def _(i):
    return evaluation.operating_points(i.labelled_decisions.filter("is_transfer >= 0.5"), _T)


@query("choose_threshold", with_cte(
    _LAB + ",\ncu as (select score, sum(sum(label)) over (order by score desc) as tp, sum(sum(1 - label)) over (order by score desc) as fp from lab group by score),\n"
    "al as (select sum(label) as p, sum(1 - label) as n from lab)",
    "select coalesce(max((tp, score)) filter (where fp / cast(n as double) <= 0.01)[2], 0.70) as threshold, "
    + O.r("coalesce(max(tp) filter (where fp / cast(n as double) <= 0.01), 0) / cast(max(p) as double)") + " as recall from cu, al"))
def _(i):
    return evaluation.choose_threshold(i.labelled_decisions)


@query("roc_auc", with_cte(_LAB + ",\n" + _ROC, "select roc_auc, positives, samples from au"))
def _(i):
    return evaluation.rank_metrics(i.labelled_decisions).select("roc_auc", "positives", "samples")


@query("pr_auc", with_cte(_LAB + ",\n" + _ROC, "select pr_auc from apx"))
def _(i):
    return evaluation.rank_metrics(i.labelled_decisions).select("pr_auc")


@query("rank_metrics_by_language", with_cte(
    _GEN + ",\n" + _ROC_GEN, "select au.channel, roc_auc, pr_auc, positives, samples from au join apx on apx.channel = au.channel"))
def _(i):
    return evaluation.rank_metrics(i.generic, ["channel"])


def _calibration_sql(source: str, keys: str, group: str) -> str:
    k = keys + ", " if keys else ""
    return (
        f"cb0 as (select {k} least(cast(floor(score * 10) as integer), 9) as bin, count(*) as n, avg(score) as s, avg(label) as y,"
        f" sum((score - label) * (score - label)) as sq from {source} group by {k} bin),\n"
        f"cal as (select {k} {O.r('sum(sq) / sum(n)')} as brier_score, {O.r('sum(n * abs(s - y)) / sum(n)')} as expected_calibration_error from cb0 {group})"
    )


@query("brier_ece", with_cte(_LAB + ",\n" + _calibration_sql("lab", "", ""), "select * from cal"))
def _(i):
    return evaluation.calibration(i.labelled_decisions)


@query("brier_ece_by_language", with_cte(
    _GEN + ",\n" + _calibration_sql("gen", "channel", "group by channel"), "select * from cal"))
def _(i):
    return evaluation.calibration(i.generic, ["channel"])


@query("separation_summary", with_cte(
    _GEN, "select channel, max(score) filter (where label = 0) as normal_max, min(score) filter (where label = 1) as takeover_min,"
    " min(score) filter (where label = 1) > max(score) filter (where label = 0) as perfect_ranking_gap from gen group by channel"))
def _(i):
    return evaluation.separation_summary(i.generic, ["channel"])


def _wilson_sql(s: str, n: str, side: int) -> str:
    p, n = f"({s} / cast({n} as double))", f"cast({n} as double)"
    z = "1.96"
    den = f"(1.0 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / (2.0 * {n})) / {den})"
    half = f"({z} * sqrt({p} * (1.0 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / {den})"
    return O.r(O.clamp(f"({centre} {'+' if side > 0 else '-'} {half})"))


@query("wilson_interval", with_cte(
    _LAB + ",\n" + _points_sql("lab"), "select point, " + ", ".join([
        _wilson_sql("true_positives", "takeover_events", -1) + " as recall_low",
        _wilson_sql("true_positives", "takeover_events", 1) + " as recall_high",
        _wilson_sql("false_positives", "normal_events", -1) + " as fpr_low",
        _wilson_sql("false_positives", "normal_events", 1) + " as fpr_high"]) + " from pts"))
def _(i):
    return evaluation.with_wilson(evaluation.operating_points(i.labelled_decisions, _T)).select(
        "point", "recall_low", "recall_high", "fpr_low", "fpr_high")


@query("bootstrap_ci")
def _(i):
    return evaluation.bootstrap_ci(i.labelled_decisions, _T["confirm"])


_VARIANT_SQL = "vr as (" + " union all ".join(
    f"select label, '{n}' as variant, cast({e} as double) as score from lab" for n, e in evaluation.VARIANTS.items()) + ")"


@query("ablation_table", with_cte(
    _LAB + ",\n" + _VARIANT_SQL + ",\n" + _points_sql("vr", "variant,") + ",\n" + _rank_sql("vr", "variant", "group by variant"),
    "select p.variant, recall, precision, false_positive_rate, true_positives, false_positives, roc_auc from pts p join au on au.variant = p.variant"
    " where point = 'confirm'"))
def _(i):
    return evaluation.ablation_table(i.labelled_decisions, _T["confirm"])


@query("detection_attribution", with_cte(
    _LAB, "select case when label = 1 then 'true_positives' else 'false_positives' end as outcome, case when blended_score >= 0.48 and"
    " security_floor >= 0.48 then 'both' when blended_score >= 0.48 then 'blend_alone' else 'floor_required' end as category, count(*) as alerts"
    " from lab where fused_score >= 0.48 group by all"))
def _(i):
    return evaluation.detection_attribution(i.labelled_decisions, _T["confirm"])


@query("floor_attribution", with_cte(
    _LAB, "select case when label = 1 then 'true_positives' else 'false_positives' end as outcome, code, count(*) as alerts from (select label,"
    " unnest([" + ", ".join(f"case when {R.floor_value(cond, value)} > 0 then '{code}' end" for code, cond, value in config.FLOORS)
    + "]) as code from lab where fused_score >= 0.48 and security_floor >= 0.48) where code is not null group by all"))
def _(i):
    return evaluation.floor_attribution(i.labelled_decisions, _T["confirm"])


def _cohort_sql(source: str) -> str:
    arm = (
        "select '{c}' as cohort, {c} as value, count(*) as samples, count(*) filter (where label = 1) as takeovers, "
        + O.r("avg(cast(score >= 0.48 as integer)) filter (where label = 1)") + " as recall, "
        + O.r("avg(cast(score >= 0.48 as integer)) filter (where label = 0)") + " as false_positive_rate from {s} group by {c}"
    )
    return " union all ".join(arm.format(c=c, s=source) for c in ("channel", "scenario"))


_LAB2 = _LAB + ",\nlab2 as (select channel, scenario2 as scenario, label, score from lab)"


@query("cohort_rates", with_cte(_LAB2, _cohort_sql("lab2")))
def _(i):
    return evaluation.cohort_rates(i.labelled_decisions, _T["confirm"])


@query("cohort_rates_documents", with_cte(_GEN, _cohort_sql("gen")))
def _(i):
    return evaluation.cohort_rates(i.generic, _T["confirm"])


@query("hard_negative_rate", with_cte(
    _LAB2, "select scenario, count(*) as events, " + O.r("avg(cast(score >= 0.48 as integer))")
    + " as intervention_rate from lab2 where label = 0 and scenario <> 'legitimate' group by scenario"))
def _(i):
    return evaluation.hard_negative_rate(i.labelled_decisions, _T["confirm"])


@query("scenario_recall", with_cte(
    _LAB2, "select scenario, " + O.r("avg(cast(score >= 0.48 as integer))") + " as recall from lab2 where label = 1 group by scenario"))
def _(i):
    return evaluation.scenario_recall(i.labelled_decisions, _T["confirm"])


@query("prevalence_stress", with_cte(
    _LAB + ",\n" + _points_sql("lab"), "select point, cast(prevalence as double) as prevalence, "
    + O.r("recall * prevalence / greatest(recall * prevalence + false_positive_rate * (1.0 - prevalence), 1e-12)") + " as projected_precision, "
    + O.r("10000.0 * (recall * prevalence + false_positive_rate * (1.0 - prevalence))", 2) + " as projected_alerts_per_10000, "
    + O.r("10000.0 * (false_positive_rate * (1.0 - prevalence))", 2) + " as projected_false_alerts_per_10000"
    " from pts, (values (cast(0.001 as double)), (cast(0.005 as double)), (cast(0.01 as double))) v(prevalence)"))
def _(i):
    return evaluation.prevalence_stress(evaluation.operating_points(i.labelled_decisions, _T))


_COVERAGE = [n for n in config.FEATURES if n.endswith(("_coverage", "_confidence"))] + [
    "shared_device_allowed", "is_ussd"]


def _audit_sql(names: list[str]) -> str:
    return (
        O.FEATURES + ",\nfl as (" + " union all ".join(
            f"select {adapter.EVENT['is_takeover']} as label, '{n}' as feature, cast({n} as double) as score from feat" for n in names)
        + "),\n" + _rank_sql("fl", "feature", "group by feature") + ",\n"
        "fs as (select feature, " + O.r("avg(score) filter (where label = 0)") + " as mean_normal, " + O.r("avg(score) filter (where label = 1)")
        + " as mean_takeover, " + O.r("avg(cast(score > 0 as integer)) filter (where label = 0)") + " as present_rate_normal, "
        + O.r("avg(cast(score > 0 as integer)) filter (where label = 1)") + " as present_rate_takeover from fl group by feature),\n"
        "fr2 as (select feature, " + O.r(
            "greatest((sum(rnk) filter (where label = 1) - (count(*) filter (where label = 1)) * ((count(*) filter (where label = 1)) + 1) / 2.0)"
            " / cast((count(*) filter (where label = 1)) * (count(*) filter (where label = 0)) as double), 1 -"
            " (sum(rnk) filter (where label = 1) - (count(*) filter (where label = 1)) * ((count(*) filter (where label = 1)) + 1) / 2.0)"
            " / cast((count(*) filter (where label = 1)) * (count(*) filter (where label = 0)) as double))")
        + " as separation_auc from rk group by feature)"
    )


@query("leakage_audit", with_cte(
    _audit_sql(_COVERAGE), "select fs.*, separation_auc, separation_auc < 0.75 as passed from fs join fr2 on fr2.feature = fs.feature"))
def _(i):
    return evaluation.leakage_audit(i.labelled_features, _COVERAGE)


@query("univariate_separation", with_cte(
    _audit_sql(config.MODEL_FEATURES), "select feature, separation_auc, separation_auc < 0.98 as below_limit from fr2"
    " order by separation_auc desc, feature limit 10"))
def _(i):
    return evaluation.univariate_separation(i.labelled_features, config.MODEL_FEATURES)


# ---------------------------------------------------------------------------- what-if and model
def _override_sql(source: str, overrides: dict[str, str]) -> str:
    return "select * replace (" + ", ".join(
        f"cast({text} as double) as {n}" for n, text in overrides.items()) + f") from {source}"


def _score_sql(source: str, name: str, keep: str = "*") -> str:
    return f"select {keep}, greatest({R.anomaly_score()}, {R.security_floor()}) as {name} from {source}"


_WHAT_IF = O.FEATURES + ",\n" + (
    f"w0 as ({_score_sql('(select * from feat where recipient_id is not null)', 'base_score')}),\n"
    f"w1 as ({_override_sql('w0', whatif.MULE_CONTEXT)}),\nw2 as ({_score_sql('w1', 'mule_score')}),\n"
    f"w3 as ({_override_sql('w2', whatif.RECOVERY_PRECURSOR)}),\n"
    f"w4 as ({_score_sql('w3', 'mule_and_recovery_score')})"
)


@query("what_if_mitigation", with_cte(
    _WHAT_IF, "select event_id, base_score, mule_score, mule_and_recovery_score from w4"))
def _(i):
    return whatif.what_if_mitigation(i.features)


def _values(values: list, name: str) -> str:
    return "(values " + ", ".join(f"({v})" for v in values) + f") v_{name}({name})"


_GRID = O.FEATURES + ",\n" + _PROF.replace("base as (", "pbase as (").replace("from base b", "from pbase b").replace(
    "join base b", "join pbase b").replace("tx as (", "ptx as (").replace("from tx ", "from ptx ").replace(
    "from tr ", "from ptr ").replace("from tr)", "from ptr)").replace("tr as (", "ptr as (", 1) + (
    ",\ng0 as (select f.*, p.amount_median, p.amount_mad from feat f join prof p on p.account_id = f.account_id and p.tenant_id = f.tenant_id"
    " qualify row_number() over (partition by f.tenant_id, f.account_id order by f.ts_us desc, f.event_id desc) = 1),\n"
    "g1 as (select * from g0, " + ", ".join([_values(whatif.AMOUNTS, "c_amount")] + [
        _values([0, 1], f) for f in whatif.FLAGS] + [
        _values([f"cast({s} as double)" for s in whatif.SPEEDS], "c_speed"), _values(whatif.HOURS, "c_hour")]) + "),\n"
    f"g2 as ({_override_sql('g1', whatif.CELL_FEATURES)}),\n"
    + "g3 as (" + _score_sql("g2", "score", f"account_id, c_amount, {whatif.CHANGED} as changed") + ")"
)


@query("scenario_grid_search", with_cte(
    _GRID, "select account_id, count(*) as cells, count(*) filter (where score < 0.48) as evasions,"
    " -(min((-c_amount, changed, score)) filter (where score < 0.48))[1] as best_amount,"
    " (min((-c_amount, changed, score)) filter (where score < 0.48))[2] as best_changed,"
    " (min((-c_amount, changed, score)) filter (where score < 0.48))[3] as best_score from g3 group by account_id"))
def _(i):
    stats = profile.profile_stats(profile.newest(i.events, i.settings)).select(
        "tenant_id", "account_id", "amount_median", "amount_mad")
    rest = [c for c in i.features.columns if c not in ("tenant_id", "account_id")]
    latest = i.features.groupBy("tenant_id", "account_id").agg(
        F.max_by(F.struct(*rest), F.struct("ts_us", "event_id")).alias("r")
    ).select("tenant_id", "account_id", "r.*")
    return whatif.scenario_grid_search(latest.join(stats, ["tenant_id", "account_id"]))


@query("train_forest")
def _(i):
    """Train on the first 65 % of events, report the last 18 %."""
    split = evaluation.chrono_split(i.labelled_features, "ts_us", "event_id")
    data = cut(split.select("event_id", "label", "split", "scenario", *config.MODEL_FEATURES))
    forest = model.train_calibrated(data.filter("split = 'train'"))
    scored = forest.transform(data.filter("split = 'test'")).withColumn("score", F.col("model_score"))
    return evaluation.with_wilson(evaluation.operating_points(scored, {"half": 0.5, **_T}))
