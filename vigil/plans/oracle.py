"""Brute-force SQL for the same results: self-joins over the whole history, no windows tricks."""

from __future__ import annotations

from vigil import config
from vigil.sources import adapter as A


def r(expr: str, digits: int = 6) -> str:
    scale = float(10**digits)
    return f"(floor(({expr}) * cast({scale} as double) + cast(0.5 as double)) / cast({scale} as double))"


def clamp(expr: str) -> str:
    return f"greatest(cast(0 as double), least(cast(1 as double), cast({expr} as double)))"


def flag(cond: str) -> str:
    return f"(case when {cond} then cast(1 as double) else cast(0 as double) end)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(cast(12742 as double) * atan2(sqrt({a}), sqrt(greatest(cast(0 as double), 1 - {a}))))"


H = 3_600_000_000
DAY = 24 * H
LOOKBACK = 180 * DAY


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


TXN = f"({_list(config.TRANSACTION_TYPES)})"
TRUSTED = f"(h.profile_eligible and h.success and h.event_type not in ({_list(config.UNTRUSTED_TYPES)}))"

EV = (
    "raw as (select event_id, ts, user_id, event_type as raw_type, value,"
    " cast(json_extract_string(props, '$.k') as integer) as k from events),\n"
    "kinds as (select *, " + ", ".join(f"{v} as {n}" for n, v in A.KIND.items()) + " from raw),\n"
    "ev as materialized (select " + ", ".join(f"{v} as {n}" for n, v in A.EVENT.items())
    + ", ts as occurred_at, epoch_us(ts) as ts_us, k from kinds)"
)
ACCT = (
    "acct as (select 'acct_' || cast(c_custkey as varchar) as account_id, c_custkey % 6 = 0 as"
    " shared_device_allowed, cast(2 + c_custkey % 3 as integer) as regret_limit_30d from customer)"
)
FEEDBACK = (
    f"fb0 as (select event_id, k, ts_us + {12 * H} as confirmed_us, tenant_id, account_id, recipient_id,"
    " case when terminal_attested then terminal_token end as terminal_token,"
    f" {A.FEEDBACK_LABEL} as label, 'analyst_' || cast(k % 3 as varchar) as analyst_id,"
    " case when k = 57 then 'analyst_0' when k = 7 then null else 'analyst_9' end as second_approver_id"
    " from ev),\nfb as (select * from fb0 where label is not null),\n"
    "confirmed as (select * from fb where label in ('account_takeover','other_fraud'))"
)


def _stat(name: str, cond: str, value: str) -> str:
    return f"quantile_cont({value}, 0.5) filter (where {cond}) as {name}_med, count(*) filter (where {cond}) as {name}_n"


_SPEED = "h.interaction_ms / cast(h.menu_depth as double)"
_STATS = {
    "amt": (f"{TRUSTED} and h.event_type in {TXN} and h.amount > 0", "h.amount"),
    "spd": (f"{TRUSTED} and h.channel = e.channel and h.interaction_ms > 0 and h.menu_depth > 0", _SPEED),
    "typ": (f"{TRUSTED} and h.channel = e.channel and h.keystroke_interval_ms is not null",
            "h.keystroke_interval_ms"),
    "tlt": (f"{TRUSTED} and h.channel = e.channel and h.device_tilt_variance is not null",
            "h.device_tilt_variance"),
}


def _cnt(name: str, cond: str) -> str:
    return f"count(*) filter (where {cond}) as {name}"


def _age() -> str:
    return f"((e.ts_us - h.ts_us) / cast({H} as double))"


_SWAP = "(h.telco_attested and not h.sim_change_verified and (h.telco_imsi or h.telco_iccid))"
_PREC = [
    "h.event_type = 'failed_login'", "h.event_type = 'account_recovery'", "h.event_type = 'pin_reset'",
    _SWAP,
]


def _hazard() -> str:
    parts = []
    left = []
    names = []
    for (name, weight, decay, limit), cond in zip(config.PRECURSORS, _PREC):
        inside = f"{cond} and {_age()} <= {limit}"
        parts.append(
            f"coalesce(sum({weight} * exp(-{_age()} / cast({decay} as double))) filter (where {inside}), 0)"
        )
        left.append(f"coalesce(max({limit} - {_age()}) filter (where {inside}), 0)")
        names.append(f"case when count(*) filter (where {inside}) > 0 then '{name}' end")
    order = sorted(range(len(names)), key=lambda i: config.PRECURSORS[i][0])
    return (
        f"{clamp(' + '.join(parts))} as hazard, {r('greatest(' + ', '.join(left) + ')', 2)} as hours_left,"
        f" concat_ws('|', {', '.join(names[i] for i in order)}) as precursors"
    )


_JOIN = (
    "ev e left join ev h on h.account_id = e.account_id and h.tenant_id = e.tenant_id"
    f" and h.ts_us < e.ts_us and h.ts_us >= e.ts_us - {LOOKBACK}"
)

SENDER_CTES = f"""
hist as (select e.event_id,
 count(h.event_id) as n_all,
 {_cnt('n_txn', f"{TRUSTED} and h.event_type in {TXN}")},
 {_cnt('n_rec_total', f"{TRUSTED} and h.event_type in {TXN} and h.recipient_id is not null")},
 {_cnt('n_rec', f"{TRUSTED} and h.event_type in {TXN} and h.recipient_id = e.recipient_id")},
 {_cnt('n_dev_total', f"{TRUSTED} and h.device_id is not null")},
 {_cnt('n_dev', f"{TRUSTED} and h.device_id = e.device_id")},
 {_cnt('n_sim', f"{TRUSTED} and h.sim_id = e.sim_id")},
 {_cnt('n_ip', f"{TRUSTED} and h.ip_prefix = e.ip_prefix")},
 {_cnt('n_chan', f"{TRUSTED} and h.channel = e.channel")},
 {_cnt('n_nav', f"{TRUSTED} and h.channel = e.channel and h.navigation_signature = e.navigation_signature")},
 {_cnt('n_input', f"{TRUSTED} and h.channel = e.channel and h.input_method <> 'unknown'")},
 {_cnt('n_paste', f"{TRUSTED} and h.channel = e.channel and h.input_method in ('pasted','mixed')")},
 {_cnt('n_5m', f"h.event_type in {TXN} and h.ts_us >= e.ts_us - {H // 12}")},
 {_cnt('n_1h', f"h.event_type in {TXN} and h.ts_us >= e.ts_us - {H}")},
 {_cnt('n_fail', f"h.event_type = 'failed_login' and h.ts_us >= e.ts_us - {24 * H}")},
 {_cnt('n_recov', f"h.event_type in ('pin_reset','account_recovery') and h.ts_us >= e.ts_us - {72 * H}")},
 {_cnt('n_cross', f"h.channel <> e.channel and h.ts_us >= e.ts_us - {H // 4}")},
 {_cnt('n_cross_dev', f"h.channel <> e.channel and h.device_id is not null and h.ts_us >= e.ts_us - {H // 4}")},
 {_cnt('n_cross_same', f"h.channel <> e.channel and h.device_id = e.device_id and h.ts_us >= e.ts_us - {H // 4}")},
 {_cnt('n_app30', f"h.channel = 'app' and h.ts_us >= e.ts_us - {H // 2}")},
 {', '.join(_stat(n, c, v) for n, (c, v) in _STATS.items())},
 arg_max(h.channel, h.ts_us) as prev_channel,
 arg_max(struct_pack(at := h.ts_us, lat := h.latitude, lon := h.longitude), h.ts_us)
   filter (where {TRUSTED} and h.latitude is not null and h.longitude is not null) as loc,
 count(distinct year(h.occurred_at) * 12 + month(h.occurred_at)) filter (where h.event_type in {TXN}) as n_months,
 min(abs(day(h.occurred_at) - day(e.occurred_at))) filter (where h.event_type in {TXN}) as near_day,
 count(distinct year(h.occurred_at) * 12 + month(h.occurred_at)) filter (where h.event_type in {TXN}
   and h.recipient_id = e.recipient_id and h.amount > 0 and abs(day(h.occurred_at) - day(e.occurred_at)) <= 3
   and abs(h.amount - e.amount) / greatest(e.amount, 1) <= 0.20) as n_similar,
 {_hazard()}
 from {_JOIN} group by e.event_id),
mads as (select e.event_id, {', '.join(
    f"quantile_cont(abs({v} - s.{n}_med), 0.5) filter (where {c}) as {n}_mad" for n, (c, v) in _STATS.items())}
 from {_JOIN} join hist s on s.event_id = e.event_id group by e.event_id),
hour_counts as (select e.event_id, hour(h.occurred_at) as hr, count(*) as c, min(h.ts_us) as first_at
 from {_JOIN} where {TRUSTED} and h.event_type in {TXN} group by e.event_id, hour(h.occurred_at)),
hour_top as (select *, row_number() over (partition by event_id order by c desc, first_at) as rn from hour_counts),
hours as (select t.event_id, min(least(abs(t.hr - hour(e.occurred_at)), 24 - abs(t.hr - hour(e.occurred_at)))) as gap
 from hour_top t join ev e on e.event_id = t.event_id where t.rn <= 5 group by t.event_id),
seq as (select *, lag(channel) over (partition by tenant_id, account_id order by ts_us) as left_channel,
 lag(ts_us) over (partition by tenant_id, account_id order by ts_us) as left_us from ev),
pairs as (select e.event_id, count(*) as n_pairs,
 count(*) filter (where h.left_channel = s.prev_channel and h.channel = e.channel) as n_same
 from ev e join hist s on s.event_id = e.event_id join seq h on h.account_id = e.account_id
 and h.tenant_id = e.tenant_id and h.ts_us < e.ts_us and h.left_us >= e.ts_us - {LOOKBACK} group by e.event_id),
chan_counts as (select e.event_id, h.channel, count(*) as c from {_JOIN} where {TRUSTED}
 group by e.event_id, h.channel),
dev_counts as (select e.event_id, h.device_id, count(*) as c from {_JOIN} where {TRUSTED}
 group by e.event_id, h.device_id),
enrol as (select distinct e.event_id from {_JOIN}
 left join chan_counts cc on cc.event_id = e.event_id and cc.channel = h.channel
 left join dev_counts dc on dc.event_id = e.event_id and dc.device_id = h.device_id
 where h.ts_us >= e.ts_us - {24 * H} and h.channel <> e.channel and h.event_type in ({_list(config.AUTH_TYPES)})
 and (coalesce(cc.c, 0) <= 1 or (h.device_id is not null and coalesce(dc.c, 0) <= 1)))"""


def _dev(value: str, stat: str, share: str, floor: str) -> str:
    return (
        f"case when {value} is not null and s.{stat}_n >= 3 then "
        + clamp(
            f"abs({value} - s.{stat}_med) / greatest(1.4826 * m.{stat}_mad, s.{stat}_med * {share},"
            f" cast({floor} as double)) / 6"
        )
        + " else 0 end"
    )


_PRESENT = {
    "balance": "e.available_balance_before is not null", "recipient": "e.recipient_id is not null",
    "device": "e.device_id is not null", "sim": "e.sim_id is not null", "ip": "e.ip_prefix is not null",
    "location": "e.latitude is not null", "interaction": "e.interaction_ms is not null",
    "typing": "e.keystroke_interval_ms is not null", "tilt": "e.device_tilt_variance is not null",
    "navigation": "e.navigation_signature is not null", "telco": "e.telco_attested",
    "coercion": "e.session_attested", "terminal": "e.terminal_attested",
}


def _coverage() -> str:
    arms = " ".join(
        f"when '{channel}' then (" + " + ".join(
            f"case when {_PRESENT[i]} then 1 else 0 end" for i in items
        ) + f") / cast({len(items)} as double)"
        for channel, items in config.COVERAGE_ITEMS.items()
    )
    return f"case e.channel {arms} end"


def _tel(expr: str, need: str | None = None) -> str:
    cond = "e.telco_attested" + (f" and {need} is not null" if need else "")
    return f"case when {cond} then {expr} else 0 end"


def _ses(expr: str, need: str | None = None) -> str:
    cond = "e.session_attested" + (f" and {need} is not null" if need else "")
    return f"case when {cond} then {expr} else 0 end"


def _n(exprs: list[str]) -> str:
    return " + ".join(f"case when {x} is not null then 1 else 0 end" for x in exprs)


_CONF = r("case when s.n_txn > 0 then least(1, ln(1 + s.n_txn) / ln(cast(51 as double))) else 0 end")
_MED = r("coalesce(s.amt_med, 0)", 2)
_MAD = r("coalesce(m.amt_mad, 0)", 2)
_PRICED = f"e.amount > 0 and {_MED} > 0"
_TRAVEL_KMH = (
    hav("s.loc.lat", "s.loc.lon", "e.latitude", "e.longitude")
    + f" / greatest((e.ts_us - s.loc.at) / cast({H} as double), 1 / cast(60 as double))"
)
SENDER_FEATURES = {
    "history_confidence": _CONF,
    "balance_drain_ratio": "case when e.available_balance_before > 0 then "
    + clamp("e.amount / e.available_balance_before") + " else 0 end",
    "call_transfer_overlap": flag("e.session_attested and e.active_call"),
    "screen_sharing_signal": flag("e.session_attested and e.screen_sharing"),
    "recipient_edit_anomaly": _ses(clamp("e.replacements / cast(3 as double)")),
    "confirmation_friction": _ses(
        "greatest(" + clamp("e.backtracks / cast(4 as double)") + ", "
        + clamp("e.amount_edits / cast(5 as double)") + ", "
        + clamp("(coalesce(e.pause_ms, 0) - 30000) / cast(120000 as double)") + ", "
        + flag("e.pasted_in_call") + ")"
    ),
    "coercion_on_device_score": _ses("e.session_score", "e.session_score"),
    "coercion_evidence_coverage": _ses(
        f"(6 + {_n(['e.pause_ms', 'e.session_score'])}) / cast(8 as double)"),
    "recent_sim_activation": _tel(clamp("1 - e.telco_age / 168"), "e.telco_age"),
    "repeat_sim_change": _tel(clamp("e.telco_changes / cast(3 as double)"), "e.telco_changes"),
    "imsi_change": flag("e.telco_attested and e.telco_imsi"),
    "iccid_change": flag("e.telco_attested and e.telco_iccid"),
    "sim_type_change": flag("e.telco_attested and e.telco_type"),
    "otp_sim_change_proximity": _tel("exp(-e.telco_otp / 360)", "e.telco_otp"),
    "otp_sim_geo_mismatch": _tel(clamp("e.telco_geo / 250"), "e.telco_geo"),
    "short_previous_sim_tenure": _tel(clamp("1 - e.telco_tenure / 365"), "e.telco_tenure"),
    "telco_assurance_coverage": _tel(
        "(3 + " + _n(["e.telco_age", "e.telco_changes", "e.telco_tenure", "e.telco_otp", "e.telco_geo"])
        + ") / cast(8 as double)"
    ),
    "evidence_coverage": _coverage(),
    "is_ussd": flag("e.channel = 'ussd'"),
    "is_transfer": flag("e.event_type = 'transfer'"),
    "is_withdrawal": flag("e.event_type = 'withdrawal'"),
    "is_agent": flag("e.channel = 'agent'"),
    "amount_deviation": f"case when {_PRICED} then " + clamp(
        f"abs(e.amount - {_MED}) / greatest(1.4826 * {_MAD}, {_MED} * 0.08, 50) / 6") + " else 0 end",
    "amount_to_median": f"case when {_PRICED} then "
    + clamp(f"e.amount / greatest({_MED}, 1) / 8") + " else 0 end",
    "unusual_hour": f"case when hh.gap is not null and {_CONF} > 0 then "
    + clamp("hh.gap / cast(8 as double)") + " else 0.25 end",
    "new_recipient": flag("e.recipient_id is not null and s.n_rec = 0"),
    "recipient_rarity": "case when e.recipient_id is not null then "
    + clamp("1 - s.n_rec / cast(greatest(1, s.n_rec_total) as double)") + " else 0 end",
    "new_device": flag("e.device_id is not null and s.n_dev = 0"),
    "device_rarity": "case when e.device_id is not null then "
    + clamp("1 - s.n_dev / cast(greatest(1, s.n_dev_total) as double)") + " else 0 end",
    "new_sim": flag("e.sim_id is not null and s.n_sim = 0"),
    "new_ip_prefix": flag("e.ip_prefix is not null and s.n_ip = 0"),
    "new_channel": flag("s.n_all > 0 and s.n_chan = 0"),
    "channel_transition_novelty": "case when p.n_pairs > 0 then "
    + clamp("1 - p.n_same / cast(p.n_pairs as double)")
    + " when s.n_all = 1 and s.prev_channel <> e.channel then 0.75 else 0 end",
    "cross_channel_events_15m": clamp("s.n_cross / cast(3 as double)"),
    "new_channel_enrollment_24h": flag(f"e.event_type in {TXN} and n.event_id is not null"),
    "app_to_ussd_handoff": flag("e.channel = 'ussd' and s.n_app30 > 0"),
    "cross_channel_device_mismatch": flag(
        "e.device_id is not null and s.n_cross_dev > 0 and s.n_cross_same = 0"),
    "velocity_5m": clamp("s.n_5m / cast(5 as double)"),
    "velocity_1h": clamp("s.n_1h / cast(15 as double)"),
    "failed_auth_24h": clamp("s.n_fail / cast(5 as double)"),
    "recovery_signal_72h": flag("s.n_recov > 0"),
    "account_hazard_score": "s.hazard",
    "risk_window_hours_remaining": clamp("s.hours_left / 72"),
    "impossible_travel": f"case when s.loc is not null and e.latitude is not null and e.longitude is not null and {_TRAVEL_KMH} > 250"
    " then " + clamp(f"({_TRAVEL_KMH} - 250) / 750") + " else 0 end",
    "interaction_speed_deviation": _dev(
        "(e.interaction_ms / cast(e.menu_depth as double))", "spd", "0.1", "50"),
    "typing_cadence_deviation": _dev("e.keystroke_interval_ms", "typ", "0.1", "15"),
    "device_handling_deviation": _dev("e.device_tilt_variance", "tlt", "0.12", "0.05"),
    "paste_anomaly": "case when e.input_method in ('pasted','mixed') then " + clamp(
        "(1 - case when s.n_input > 0 then s.n_paste / cast(s.n_input as double) else 0 end)"
        f" * greatest(0.25, {_CONF})") + " else 0 end",
    "navigation_novelty": f"case when s.n_all > 0 and s.n_nav = 0 then greatest(0.10, {_CONF}) else 0 end",
    "calendar_confidence": clamp("s.n_months / cast(4 as double)"),
    "day_of_month_deviation": "case when s.n_months >= 3 then "
    + clamp("s.near_day / cast(12 as double)") + " else 0 end",
    "recurring_payment_match": "case when s.n_months >= 3 and e.recipient_id is not null and e.amount > 0 then "
    + clamp("s.n_similar / cast(3 as double)") + " else 0 end",
    "verified_sim_change": flag("e.sim_change_verified and s.n_sim = 0"),
}
SENDER = (
    SENDER_CTES + ",\nsf as (select e.event_id, s.n_all as history_events, s.hours_left, s.precursors, "
    + ", ".join(f"{r(v)} as {n}" for n, v in SENDER_FEATURES.items())
    + " from ev e join hist s on s.event_id = e.event_id join mads m on m.event_id = e.event_id"
    " left join hours hh on hh.event_id = e.event_id left join pairs p on p.event_id = e.event_id"
    " left join enrol n on n.event_id = e.event_id)"
)

# ------------------------------------------------------------------ recipient network and terminals
WEEK = 7 * DAY
NETWORK = f"""
edges as (select * from ev where event_type in {TXN} and success and recipient_id is not null),
inc as (select e.event_id, h.account_id, count(*) as n_week,
 count(*) filter (where h.ts_us >= e.ts_us - {DAY}) as n_day,
 sum(h.amount) filter (where h.ts_us >= e.ts_us - {H}) as in_1h
 from ev e join edges h on h.tenant_id = e.tenant_id and h.recipient_id = e.recipient_id
 and h.ts_us < e.ts_us and h.ts_us >= e.ts_us - {WEEK} group by e.event_id, h.account_id),
outg as (select e.event_id, sum(h.amount) as out_1h from ev e join ev h on h.tenant_id = e.tenant_id
 and h.account_id = e.recipient_id and h.event_type in {TXN} and h.success
 and h.ts_us < e.ts_us and h.ts_us >= e.ts_us - {H} group by e.event_id),
net0 as (select e.event_id,
 count(i.account_id) filter (where i.n_day > 0) + max(case when i.account_id = e.account_id and i.n_day > 0 then 0 else 1 end
   ) * 0 as base_senders,
 count(i.account_id) filter (where i.n_day > 0 and i.n_week <= 1) as base_firsts,
 coalesce(bool_or(i.account_id = e.account_id and i.n_day > 0), false) as active_before,
 coalesce(bool_or(i.account_id = e.account_id), false) as known_before,
 coalesce(sum(i.in_1h), 0) as inflow
 from ev e left join inc i on i.event_id = e.event_id where e.recipient_id is not null group by e.event_id),
net as (select n.event_id, e.tenant_id,
 cast(coalesce(base_senders, 0) + (case when active_before then 0 else 1 end) as double) as unique_senders_24h,
 (base_firsts + (case when known_before then 0 else 1 end)) /
   cast(coalesce(base_senders, 0) + (case when active_before then 0 else 1 end) as double) as first_time_sender_ratio_24h,
 cast(inflow as double) as inflow_amount_1h, cast(coalesce(out_1h, 0) as double) as outflow_amount_1h,
 least(1, coalesce(out_1h, 0) / greatest(1, inflow)) as rapid_cashout_ratio_1h,
 case when known_before then cast(0 as double) else cast(1 as double) end as current_sender_first_time
 from net0 n join ev e on e.event_id = n.event_id left join outg o on o.event_id = n.event_id)"""
NETWORK = NETWORK.replace(
    """ + max(case when i.account_id = e.account_id and i.n_day > 0 then 0 else 1 end
   ) * 0 as base_senders""", " as base_senders")

TERMINAL = f"""
ag as (select * from ev where terminal_attested),
t1 as (select e.event_id, e.tenant_id, e.account_id, e.recipient_id, e.event_type, e.amount, e.ts_us,
 count(distinct h.account_id) filter (where h.ts_us >= e.ts_us - {H} and h.account_id <> e.account_id) + 1 as customers,
 count(h.event_id) filter (where h.ts_us >= e.ts_us - {H}) + 1 as events_1h,
 count(h.event_id) filter (where h.ts_us >= e.ts_us - {H} and h.event_type = 'failed_login')
   + (case when e.event_type = 'failed_login' then 1 else 0 end) as failed_1h,
 coalesce(sum(h.amount) filter (where h.ts_us >= e.ts_us - {H} and h.event_type in {TXN}), 0)
   + (case when e.event_type in {TXN} then e.amount else 0 end) as value_1h,
 count(h.event_id) filter (where h.event_type in {TXN} and h.recipient_id is not null)
   + (case when e.event_type in {TXN} and e.recipient_id is not null then 1 else 0 end) as txns
 from ag e left join ag h on h.tenant_id = e.tenant_id and h.terminal_token = e.terminal_token
 and h.ts_us < e.ts_us and h.ts_us >= e.ts_us - {DAY}
 group by e.event_id, e.tenant_id, e.account_id, e.recipient_id, e.event_type, e.amount, e.ts_us),
t2 as (select e.event_id, h.recipient_id, count(*) as c from ag e join ag h on h.tenant_id = e.tenant_id
 and h.terminal_token = e.terminal_token and h.ts_us >= e.ts_us - {DAY}
 and (h.ts_us < e.ts_us or h.event_id = e.event_id) and h.event_type in {TXN} and h.recipient_id is not null
 group by e.event_id, h.recipient_id),
t3 as (select event_id, max(c) as top from t2 group by event_id),
t4 as (select e.event_id, count(h.event_id) as seen from ag e left join ev h on h.tenant_id = e.tenant_id
 and h.account_id = e.account_id and h.recipient_id = e.recipient_id and h.event_type in {TXN}
 and h.ts_us < e.ts_us and h.ts_us >= e.ts_us - {WEEK} group by e.event_id),
term as (select t1.tenant_id, t1.event_id, cast(customers as double) as customer_diversity_1h,
 coalesce(top, 0) / cast(greatest(1, txns) as double) as recipient_concentration_24h,
 (case when event_type in {TXN} and recipient_id is not null and seen = 0 then 1 else 0 end)
   / cast(greatest(1, txns) as double) as first_time_recipient_ratio_24h,
 failed_1h / cast(events_1h as double) as failed_auth_ratio_1h, cast(value_1h as double) as value_velocity_1h
 from t1 left join t3 on t3.event_id = t1.event_id left join t4 on t4.event_id = t1.event_id)"""

# ------------------------------------------------------------------------------- reputation as of
REC_KEY = "sha256(lower(trim(recipient_id)))"


def rep_score(days: int) -> str:
    return (
        f"case when n_rep = 0 or t_at >= last_us + {days * DAY} then 0 else "
        + r(
            "greatest(0, (case n_acc when 1 then 0.35 when 2 then 0.75 else 1.0 end)"
            f" * (1 - greatest(0, (t_at - last_us) / cast({DAY} as double)) / {days}))"
        )
        + " end"
    )


def rep_status(days: int, top: str) -> str:
    return (
        f"case when n_rep = 0 then 'clear' when t_at >= last_us + {days * DAY} then 'expired'"
        f" when n_acc >= 3 then '{top}' when n_acc = 2 then 'elevated' else 'monitor' end"
    )


REPUTATION = f"""{FEEDBACK},
rr0 as (select e.event_id, e.tenant_id, e.ts_us as t_at, count(f.event_id) as n_rep,
 count(distinct f.account_id) as n_acc, max(f.confirmed_us) as last_us
 from ev e left join confirmed f on f.recipient_id = e.recipient_id and f.confirmed_us <= e.ts_us
 where e.recipient_id is not null group by e.event_id, e.tenant_id, e.ts_us),
rrep as (select event_id, tenant_id, {rep_score(90)} as score, {rep_status(90, 'high')} as status,
 n_rep as confirmed_reports, n_acc as distinct_accounts from rr0),
tr0 as (select e.event_id, e.tenant_id, e.ts_us as t_at, count(f.event_id) as n_rep,
 count(distinct f.account_id) as n_acc, max(f.confirmed_us) as last_us
 from ev e left join confirmed f on f.tenant_id = e.tenant_id and f.terminal_token = e.terminal_token
 and f.confirmed_us <= e.ts_us
 where e.terminal_attested group by e.event_id, e.tenant_id, e.ts_us),
trep as (select event_id, tenant_id, {rep_score(60)} as score, {rep_status(60, 'quarantined')} as status,
 n_rep as confirmed_reports, n_acc as distinct_accounts from tr0)"""

_GIVEN = _n(["e.terminal_lat", "e.terminal_lon", "e.shift_start", "e.shift_end", "e.terminal_age"])
_TDIST = hav("e.terminal_lat", "e.terminal_lon", "e.latitude", "e.longitude")
_INSIDE = (
    "case when e.shift_start < e.shift_end then e.shift_start <= hour(e.occurred_at) and"
    " hour(e.occurred_at) < e.shift_end else hour(e.occurred_at) >= e.shift_start or"
    " hour(e.occurred_at) < e.shift_end end"
)
CONTEXT_FEATURES = {
    "recipient_sender_diversity_24h": clamp("coalesce(net.unique_senders_24h, 0) / 12"),
    "recipient_first_time_sender_ratio_24h": clamp("coalesce(net.first_time_sender_ratio_24h, 0)"),
    "recipient_inflow_velocity_1h": clamp("(coalesce(net.inflow_amount_1h, 0) + e.amount) / 500000"),
    "recipient_rapid_cashout_ratio_1h": clamp("coalesce(net.rapid_cashout_ratio_1h, 0)"),
    "recipient_network_coverage": flag("e.recipient_id is not null"),
    "recipient_confirmed_fraud_score": clamp("coalesce(rrep.score, 0)"),
    "recipient_confirmed_accounts": clamp("coalesce(rrep.distinct_accounts, 0) / cast(3 as double)"),
    "recipient_watchlist_coverage": flag("e.recipient_id is not null"),
    "agent_customer_diversity_1h": clamp("coalesce(term.customer_diversity_1h, 0) / 12"),
    "agent_recipient_concentration_24h": clamp("coalesce(term.recipient_concentration_24h, 0)"),
    "agent_first_time_recipient_ratio_24h": clamp("coalesce(term.first_time_recipient_ratio_24h, 0)"),
    "agent_failed_auth_ratio_1h": clamp("coalesce(term.failed_auth_ratio_1h, 0)"),
    "agent_value_velocity_1h": clamp("coalesce(term.value_velocity_1h, 0) / 1000000"),
    "agent_location_mismatch": "case when e.terminal_attested and e.terminal_lat is not null and e.latitude"
    f" is not null then {clamp(f'({_TDIST} - 10) / 90')} else 0 end",
    "agent_after_hours": flag(f"e.terminal_attested and e.shift_start is not null and not ({_INSIDE})"),
    "agent_terminal_novelty": "case when e.terminal_attested and e.terminal_age is not null then "
    + clamp("1 - e.terminal_age / 30") + " else 0 end",
    "agent_confirmed_fraud_score": clamp("coalesce(trep.score, 0)"),
    "agent_confirmed_accounts": clamp("coalesce(trep.distinct_accounts, 0) / cast(3 as double)"),
    "agent_evidence_coverage": f"case when e.terminal_attested then (3 + {_GIVEN}) / cast(8 as double) else 0 end",
}
FEATURES = (
    f"{EV},\n{ACCT},\n{SENDER},\n{NETWORK},\n{TERMINAL},\n{REPUTATION},\n"
    "feat as materialized (select e.*, sf.* exclude (event_id), "
    + flag("coalesce(a.shared_device_allowed, false)") + " as shared_device_allowed,"
    " coalesce(a.regret_limit_30d, 3) as regret_limit_30d,"
    " coalesce(rrep.confirmed_reports, 0) as rec_reports, coalesce(trep.confirmed_reports, 0) as term_reports, "
    + ", ".join(f"{r(v)} as {n}" for n, v in CONTEXT_FEATURES.items())
    + " from ev e join sf on sf.event_id = e.event_id left join acct a on a.account_id = e.account_id"
    " left join net on net.event_id = e.event_id left join term on term.event_id = e.event_id"
    " left join rrep on rrep.event_id = e.event_id left join trep on trep.event_id = e.event_id)"
)

# --------------------------------------------------------------------------- shared exchange
REPORTS = (
    "rep0 as (select *, 0 as copy from orders union all select *, 1 as copy from orders where "
    + A.REPORT["resent"] + "),\n"
    "rep1 as (select " + ", ".join(f"{v} as {n}" for n, v in A.REPORT.items())
    + ", copy, o_orderkey from rep0),\n"
    "rep as (select * exclude (delay_us), observed_us + delay_us + copy * 5000000 as received_us,"
    " lower(trim(institution_id)) as inst, lower(trim(indicator_type)) as kind,"
    " case when indicator_type = 'campaign' then array_to_string(list_sort(list_distinct(list_filter("
    "list_transform(string_split(lower(trim(indicator_value)), '|'), lambda x: trim(x)), lambda x: x <> ''))), '|')"
    " else lower(trim(indicator_value)) end as clean,"
    f" 'e' || lpad(lower(printf('%x', cast(floor(observed_us / {7 * DAY}) as bigint))), 8, '0') as epoch from rep1)"
)
# Signatures are forged on marked rows only, so validity needs no HMAC here.  A resend has the same
# content and signature as its first copy.
ADMISSION = (
    REPORTS + ",\nadm0 as (select *, (received_us - observed_us) / cast(1000000 as double) as age from rep),\n"
    "adm1 as (select *, case when age > 900 or age < -60 then 'stale_or_future'"
    " when inst not in ('bank-1','bank-2','bank-3','bank-4') then 'institution_not_enrolled'"
    " when confidence < 0.6 or confidence > 1.0 then 'confidence_out_of_range'"
    f" when evidence_class not in ({_list(config.EVIDENCE_WEIGHTS)}) then 'evidence_class_not_allowed'"
    " when length(clean) < 3 then 'indicator_too_short' when forged then 'signature_invalid' end as basic from adm0),\n"
    "adm2 as (select a.*, (select count(*) from adm1 b where b.basic is null and b.inst = a.inst"
    f" and b.received_us < a.received_us and b.received_us >= a.received_us - {H}) as recent from adm1 a),\n"
    "fr as (select report_id, min(received_us) as t, arg_min(o_orderkey, (received_us, o_orderkey)) as owner from adm1"
    " where basic is null group by report_id),\n"
    "fn as (select nonce, arg_min(report_id, (received_us, report_id)) as owner from adm1 where basic is null group by nonce),\n"
    "adm as (select a.*, (basic is null and (a.received_us > fr.t or a.o_orderkey <> fr.owner)) as again,"
    " fr.owner as first_key, fn.owner as nonce_owner from adm2 a left join fr on fr.report_id = a.report_id"
    " left join fn on fn.nonce = a.nonce),\n"
    "admitted as (select *, case when basic is not null then basic when again and o_orderkey <> first_key then"
    " 'conflicting_content' when again then null when recent >= 3 then 'rate_limit_exceeded'"
    " when nonce_owner <> report_id then 'nonce_reused' end as rejection,"
    " coalesce(again and o_orderkey = first_key, false) as replay from adm)"
)
_WEIGHT = "case evidence_class " + " ".join(
    f"when '{n}' then {v}" for n, v in config.EVIDENCE_WEIGHTS.items()) + " else 0 end"
LATEST = (
    ADMISSION + ",\nlatest0 as (select *, row_number() over (partition by kind, clean, epoch, inst order by"
    " received_us desc, report_id desc) as rn from admitted where rejection is null and not replay),\n"
    "latest as materialized (select kind, clean, epoch, inst, report_id, confidence, evidence_class, observed_us,"
    f" least(observed_us + cast(ttl_hours as bigint) * {H}, received_us + {30 * DAY}) as expires_us, received_us as created_us,"
    " case when withdrawn then 'revoked' else 'active' end as status from latest0 where rn = 1)"
)


def weighted(at: str) -> str:
    return (
        f"(confidence * {_WEIGHT} * greatest(0.25, 1.0 - greatest(0, ({at} - observed_us) / cast({H} as double))"
        f" / greatest(1.0, (expires_us - observed_us) / cast({H} as double))))"
    )


SCORED = (
    r("least(0.92, case when n = 1 then 0.30 + 0.08 * q when n = 2 then 0.58 + 0.16 * q"
      " else 0.72 + least(0.10, 0.025 * (n - 3)) + 0.14 * q end)") + " as score, "
    + r("least(1.0, q)") + " as confidence, case when n = 1 then 'observe_only' when n = 2 then 'shared_watch'"
    " else 'high_confidence' end as status"
)
CONSORTIUM = (
    "cr as (select lower(trim('acct_' || cast(o_custkey % 50 as varchar))) as rid, lower('Bank-' || substr(o_orderpriority, 1, 1)) as iid,"
    f" arg_max({A.REPORT['confidence']}, (o_orderdate, o_orderkey)) as confidence from orders group by 1, 2),\n"
    "cons as (select rid, count(*) as independent_institutions, case when count(*) < 2 then 0 else "
    + r("least(0.92, sum(confidence) / count(*))") + " end as consortium_score from cr group by rid)"
)

# ------------------------------------------------------------------------------ decisions
from vigil.functions import rules as R  # noqa: E402

STAGED = (
    f"{FEATURES},\nst0 as (select *, concat_ws('|', {', '.join(R.campaign_stage_items())}) as stages_text,"
    + " + ".join(f"(case when {c} then 1 else 0 end)" for _, c in config.CAMPAIGN_STAGES) + " as stage_n,"
    + " + ".join(f"(case when {c} then 1 else 0 end)" for n, c in config.CAMPAIGN_STAGES
                 if n in config.MATERIAL_STAGES) + " as material_n from feat),\n"
    "st as (select * exclude (stages_text, stage_n), case when stages_text = '' then 'ordinary' else stages_text end as stages_text,"
    " greatest(stage_n, 1) as stage_n, substr(sha256(case when stages_text = '' then 'ordinary' else stages_text end), 1, 20)"
    " as campaign_signature from st0),\n"
    "camp as (select e.event_id, count(distinct h.account_id) as campaign_accounts from st e join st h on"
    " h.tenant_id = e.tenant_id and h.campaign_signature = e.campaign_signature and h.ts_us <= e.ts_us"
    f" and h.ts_us >= e.ts_us - {DAY} group by e.event_id),\n"
    "cs as materialized (select st.*, campaign_accounts, (stage_n >= 3 and material_n > 0) as campaign_is_eligible,"
    " case when stage_n >= 3 and material_n > 0 then "
    + r("least(0.92, 0.28 + campaign_accounts * 0.13 + stage_n * 0.07)")
    + " else 0 end as campaign_risk from st join camp on camp.event_id = st.event_id)"
)
MODEL_STAND_IN = (
    "case when channel <> 'ussd' then "
    + r("0.5 * balance_drain_ratio + 0.3 * new_device + 0.2 * new_sim") + " end"
)
FUSED = (
    f"{STAGED},\nsc as (select *, {R.anomaly_score()} as anomaly_score, {MODEL_STAND_IN} as model_score from cs),\n"
    f"fz0 as (select *, cast({R.model_weight()} as double) as model_weight, cast({R.blended()} as double) as blend,"
    f" {R.security_floor()} as security_floor from sc),\n"
    f"fz as materialized (select *, {r(clamp('blend'))} as blended_score, {r(clamp('greatest(blend, security_floor)'))} as fused_0,"
    " case when security_floor > blend then 'security_floor' else 'blend' end as driver from fz0)"
)
_LOCAL = (
    "(pre_sketch_score >= 0.30 or coalesce(rr_score, 0) >= 0.35 or coalesce(tr_score, 0) >= 0.35 or campaign_risk >= 0.62"
    " or (new_recipient > 0 and balance_drain_ratio >= 0.45))"
)
_EXCHANGE = "least(0.92, sketch_best + (case when matches >= 2 then 0.04 else 0 end))"
LOOKUP = (
    "ind as (select event_id, ts_us as at_us, 'recipient' as kind, lower(trim(recipient_id)) as clean from fz where recipient_id is not null"
    " union all select event_id, ts_us, 'agent_terminal', lower(trim(terminal_token)) from fz where terminal_attested"
    " union all select event_id, ts_us, 'campaign', stages_text from fz where campaign_risk > 0),\n"
    "lk0 as (select i.event_id, i.kind, l.epoch, count(distinct l.inst) as n, count(*) as active_reports,"
    f" sum({weighted('i.at_us')}) / count(*) as q, min(expires_us) as expires_us from ind i join latest l on l.kind = i.kind"
    " and l.clean = i.clean and l.status = 'active' and l.observed_us <= i.at_us and l.expires_us > i.at_us"
    f" and floor(l.observed_us / {7 * DAY}) >= floor((i.at_us - {35 * DAY}) / {7 * DAY})"
    " group by i.event_id, i.kind, l.epoch),\n"
    f"lk1 as (select event_id, kind, n, active_reports, expires_us, {SCORED} from lk0),\n"
    "lk as (select *, row_number() over (partition by event_id, kind order by score desc, n desc, confidence desc,"
    " active_reports desc, status desc, expires_us desc) as rn from lk1),\n"
    "best as (select * from lk where rn = 1),\n"
    "mt0 as (select *, row_number() over (partition by event_id order by score desc, n desc, case kind when 'recipient' then 0"
    " when 'agent_terminal' then 1 else 2 end) as r2, count(*) over (partition by event_id) as matches from best),\n"
    "mt as (select event_id, score as sketch_best, n as sketch_institutions, confidence as sketch_confidence,"
    " active_reports as sketch_active_reports, status as sketch_status, matches from mt0 where r2 = 1)"
)
SKETCHED = (
    f"{FUSED},\n{CONSORTIUM},\n{LATEST},\n{LOOKUP},\n"
    "pre0 as (select fz.*, coalesce(cons.consortium_score, 0) as consortium_score,"
    " case when campaign_risk >= 0.62 then greatest(fused_0, campaign_risk) else fused_0 end as fused_1,"
    " rrep.score as rr_score, trep.score as tr_score from fz"
    " left join cons on cons.rid = lower(trim(fz.recipient_id)) left join rrep on rrep.event_id = fz.event_id"
    " left join trep on trep.event_id = fz.event_id),\n"
    "pre as (select *, case when consortium_score >= 0.70 then consortium_score else 0 end as consortium_recipient_risk,"
    " case when consortium_score >= 0.70 then greatest(fused_1, least(0.96, consortium_score + 0.04)) else fused_1 end"
    " as pre_sketch_score from pre0),\n"
    f"sk0 as (select pre.*, mt.* exclude (event_id), {_LOCAL} as sketch_local from pre left join mt on mt.event_id = pre.event_id),\n"
    "sk as materialized (select *, case when sketch_best is null then pre_sketch_score else "
    + r(f"greatest(pre_sketch_score, least(case when sketch_institutions >= 2 and sketch_local then 0.82 else 0.42 end, {_EXCHANGE}))")
    + " end as fused_score, case when sketch_best is null then 0 else " + r(_EXCHANGE) + " end as fraud_sketch_risk,"
    " case when sketch_local then cast(1 as double) else cast(0 as double) end as fraud_sketch_local_corroboration,"
    f" {r('pre_sketch_score')} as fraud_sketch_pre_exchange_score,"
    " case when sketch_best is not null and sketch_institutions >= 2 and sketch_local then 'delay' else 'monitor' end as sketch_ceiling from sk0)"
)
CONFIDENT = (
    f"{SKETCHED},\ndc0 as (select *, {R.data_coverage()} as data_coverage, cast({R.scorer_agreement()} as double) as scorer_agreement from sk),\n"
    f"dc1 as (select *, {R.confidence_score()} as confidence_score from dc0),\n"
    f"dc as materialized (select *, {R.confidence_level('confidence_score')} as confidence_level, {R.risk_level('fused_score')} as risk_level from dc1)"
)


def _policy(source: str, prefix: str) -> str:
    costs = ", ".join(
        f"{R.cost(config.RESIDUAL_LOSS[a], config.BASE_FRICTION[a])} as cost_{i}"
        for i, a in enumerate(config.RESIDUAL_LOSS))
    pause = R.cost(config.SAFE_PAUSE_RESIDUAL, config.SAFE_PAUSE_FRICTION)
    return (
        f"{prefix}0 as (select *, {costs}, {R.CRITICAL} as critical_signal, {pause} as cost_pause from {source}),\n"
        f"{prefix}1 as (select *, {R.banded_action()} as action_0 from {prefix}0),\n"
        f"{prefix}2 as (select *, {R.ceiling_action()} as action_1 from {prefix}1),\n"
        f"{prefix}3 as (select *, {R.confident_action()} as action_2 from {prefix}2),\n"
        f"{prefix} as (select *, {R.budget_action()} as action, {R.override_code()} as override_code from {prefix}3)"
    )


_INTRUSIVE = _list(config.INTRUSIVE_ACTIONS)
DECIDED = (
    f"{CONFIDENT},\nfree as (select *, 0 as regret_used from dc),\n{_policy('free', 'p')},\n"
    f"taken as (select tenant_id, account_id, ts_us from p where action in ({_INTRUSIVE})),\n"
    "used as (select e.event_id, count(t.ts_us) as regret_used from dc e left join taken t on t.tenant_id = e.tenant_id"
    f" and t.account_id = e.account_id and t.ts_us < e.ts_us and t.ts_us >= e.ts_us - {30 * DAY} group by e.event_id),\n"
    "budget as (select dc.*, used.regret_used from dc join used on used.event_id = dc.event_id),\n"
    f"{_policy('budget', 'd')},\n"
    f"dec as materialized (select *, {R.hold_seconds('action')} as hold_seconds, action in ({_INTRUSIVE}) as intrusive from d)"
)


def with_cte(ctes: str, select: str) -> str:
    return f"with recursive {ctes}\n{select}"
