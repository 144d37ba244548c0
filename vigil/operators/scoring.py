"""Anomaly score, reasons, security floors, fusion, confidence, evidence and texts.

Everything is a column expression over the feature row: no shuffle, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.functions import rules
from vigil.functions.scalars import clamp, lit_map, rnd


def contributions(df: DataFrame) -> DataFrame:
    """Long form: one row per event, reason code and positive contribution."""
    items = [
        F.struct(F.lit(f.upper()).alias("code"), rnd(F.expr(rules.contribution(f))).alias("contribution"))
        for f in config.WEIGHTS
    ] + [
        F.struct(F.lit(code).alias("code"), rnd(F.expr(rules.compound(cond, value))).alias("contribution"))
        for code, cond, value, _ in config.COMPOUNDS
    ]
    return df.select("event_id", F.inline(F.array(*items))).filter("contribution > 0")


def compound_codes(df: DataFrame) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.expr(cond), F.lit(code)) for code, cond, _, _ in config.COMPOUNDS])
    )


def reason_list() -> Column:
    """Up to eight (code, contribution), largest first, ties in rule order."""
    items = []
    for place, feature in enumerate(config.WEIGHTS):
        value = F.expr(rules.contribution(feature))
        keep = (value >= config.REASON_MINIMUM) & (F.col(feature) > 0)
        items.append((place, feature.upper(), value, keep))
    for place, (code, cond, value, _) in enumerate(config.COMPOUNDS, start=len(config.WEIGHTS)):
        items.append((place, code, F.expr(f"cast({value} as double)"), F.expr(cond)))
    structs = [
        F.when(keep, F.struct((-rnd(value)).alias("rank"), F.lit(place).alias("place"),
                              F.lit(code).alias("code")))
        for place, code, value, keep in items
    ]
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*structs))), 1, config.MAX_REASONS)
    return F.transform(
        ranked, lambda x: F.struct(x["code"].alias("code"), (-x["rank"]).alias("contribution"))
    )


def anomaly(df: DataFrame) -> DataFrame:
    return df.withColumn("anomaly_score", F.expr(rules.anomaly_score())).withColumn(
        "anomaly_reasons", reason_list()
    )


def floor_codes() -> Column:
    return F.array_compact(
        F.array(*[
            F.when(F.expr(f"{rules.floor_value(cond, value)} > 0"), F.lit(code))
            for code, cond, value in config.FLOORS
        ])
    )


def fuse(df: DataFrame) -> DataFrame:
    """Blend with the model, apply the floors; needs anomaly_score and model_score (nullable)."""
    df = df.select(
        "*",
        F.expr(rules.model_weight()).cast("double").alias("model_weight"),
        F.expr(rules.blended()).cast("double").alias("_blend"),
        F.expr(rules.security_floor()).alias("security_floor"),
        floor_codes().alias("security_floor_codes"),
    )
    notes = F.array_compact(F.array(
        F.when(F.col("model_score").isNull(), F.lit(config.NOTE_NO_MODEL)),
        F.when(F.col("history_confidence") < config.COLD_START_CONFIDENCE, F.lit(config.NOTE_COLD_START)),
        F.when(F.col("evidence_coverage") < config.SPARSE_COVERAGE, F.lit(config.NOTE_SPARSE)),
    ))
    return df.select(
        *[c for c in df.columns if c != "_blend"],
        rnd(clamp(F.col("_blend"))).alias("blended_score"),
        rnd(clamp(F.greatest("_blend", "security_floor"))).alias("fused_score"),
        F.when(F.col("security_floor") > F.col("_blend"), "security_floor").otherwise("blend")
        .alias("driver"),
        F.when(F.size(notes) > 0, F.array_join(notes, " ")).alias("uncertainty_note"),
    )


def decision_confidence(df: DataFrame) -> DataFrame:
    """Adds data_coverage, scorer_agreement, confidence_score, confidence_level and reasons."""
    df = df.withColumn("data_coverage", F.expr(rules.data_coverage())).withColumn(
        "scorer_agreement", F.expr(rules.scorer_agreement()).cast("double")
    )
    coverage = F.expr(rules.RECIPIENT_COVERAGE)
    texts = config.CONFIDENCE_REASONS
    found = F.array_compact(F.array(
        F.when(F.col("history_confidence") < 0.35, F.lit(texts["profile"])),
        F.when(F.col("data_coverage") < 0.50, F.lit(texts["coverage"])),
        F.when(F.expr(rules.RECIPIENT_PRESENT) & (coverage == 0), F.lit(texts["recipient"])),
        F.when((F.col("is_agent") > 0) & (F.col("agent_evidence_coverage") == 0), F.lit(texts["agent"])),
        F.when(F.col("model_score").isNull(), F.lit(texts["no_model"]))
        .when(F.col("scorer_agreement") < 0.65, F.lit(texts["disagree"])),
    ))
    df = df.withColumn("confidence_score", F.expr(rules.confidence_score()))
    return df.withColumn(
        "confidence_level", F.expr(rules.confidence_level("confidence_score"))
    ).withColumn(
        "confidence_reasons",
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(texts["consistent"]))),
    )


def evidence_summary(df: DataFrame) -> DataFrame:
    """Adds evidence_mode, available_signals and missing_signals per channel."""
    present = {
        "balance context": F.col("available_balance_before").isNotNull(),
        "recipient history": F.col("recipient_id").isNotNull(),
        "device identity": F.col("device_id").isNotNull(),
        "SIM identity": F.col("sim_id").isNotNull(),
        "network prefix": F.col("ip_prefix").isNotNull(),
        "coarse location": F.col("latitude").isNotNull(),
        "interaction rhythm": F.col("interaction_ms").isNotNull() & F.col("menu_depth").isNotNull(),
        "typing cadence": F.col("keystroke_interval_ms").isNotNull(),
        "typed-or-pasted signal": F.col("input_method") != "unknown",
        "device handling": F.col("device_tilt_variance").isNotNull(),
        "navigation path": F.col("navigation_signature").isNotNull(),
        "attested telco SIM lifecycle": F.coalesce(
            F.col("telco_assurance")["gateway_attested"], F.lit(False)),
        "recipient network history": F.col("recipient_network_coverage") > 0,
        "consented coercion-safety telemetry": F.col("coercion_evidence_coverage") > 0,
        "attested agent-terminal integrity": F.col("agent_evidence_coverage") > 0,
    }

    def listed(channel: str, wanted: bool) -> Column:
        return F.array_compact(F.array(*[
            F.when(present[s] if wanted else ~present[s], F.lit(s))
            for s in config.SUMMARY_EXPECTED[channel]
        ]))

    def by_channel(wanted: bool) -> Column:
        out = listed("web", wanted)
        for channel in ("app", "ussd", "agent"):
            out = F.when(F.col("channel") == channel, listed(channel, wanted)).otherwise(out)
        return out

    mode = (
        F.when(F.col("channel") == "app",
               F.when(F.col("evidence_coverage") >= 0.60, "app_rich_behaviour")
               .otherwise("core_banking_fallback"))
        .when(F.col("channel") == "ussd",
              F.when(present["attested telco SIM lifecycle"], "ussd_telco_assured")
              .when(present["interaction rhythm"] | present["navigation path"], "ussd_gateway_behaviour")
              .otherwise("core_banking_fallback"))
        .when(F.col("channel") == "agent",
              F.when(present["attested agent-terminal integrity"], "agent_terminal_integrity")
              .otherwise("agent_network_behaviour"))
        .otherwise("web_session_behaviour")
    )
    return df.select(
        "*", mode.alias("evidence_mode"), by_channel(True).alias("available_signals"),
        by_channel(False).alias("missing_signals"),
    )


def reason_assembly(df: DataFrame) -> DataFrame:
    """Prepend shared-intelligence, model, floor and outage reasons; keep the first eight, each with its message."""

    def one(code: Column | str, contribution: Column) -> Column:
        return F.struct(
            (F.lit(code) if isinstance(code, str) else code).alias("code"),
            rnd(contribution).alias("contribution"),
        )

    zero = F.lit(0.0)
    sketch_code = (
        F.when(F.col("sketch_ceiling") == "delay", "PRIVATE_SKETCH_CORROBORATED")
        .when(F.col("sketch_institutions") >= 2, "PRIVATE_SKETCH_UNCORROBORATED")
        .otherwise("PRIVATE_SKETCH_OBSERVE_ONLY")
    )
    lead = F.array_compact(F.array(
        F.when(F.col("driver") == "security_floor",
               one("SECURITY_FLOOR_APPLIED",
                   F.greatest(zero, F.col("security_floor") - F.col("blended_score")))),
        F.when(F.col("model_score") >= 0.65,
               one("POPULATION_MODEL_MATCH", F.least(F.lit(1.0), F.col("model_score") * 0.30))),
        F.when(F.col("fraud_sketch_risk") > 0,
               one(sketch_code, F.least(F.lit(1.0), F.greatest(
                   zero, F.col("fused_score") - F.col("fraud_sketch_pre_exchange_score"))))),
        F.when(F.col("consortium_score") >= 0.70,
               one("INDEPENDENT_CONSORTIUM_REPORTS",
                   F.least(F.lit(1.0), F.col("consortium_score") * 0.35))),
        F.when(F.col("campaign_risk") >= 0.62,
               one("CROSS_ACCOUNT_CAMPAIGN_DNA", F.least(F.lit(1.0), F.col("campaign_risk") * 0.35))),
    ))
    found = F.concat(lead, F.col("anomaly_reasons"))
    found = F.when(F.size(found) > 0, found).otherwise(
        F.array(one("NO_MATERIAL_ANOMALY", zero))
    )
    outage = F.when(
        F.col("resilience_mode") != "online",
        F.concat(F.array(one("OUTAGE_EVIDENCE_DEGRADED", zero)), found),
    ).otherwise(found)
    top = F.slice(outage, 1, config.MAX_REASONS)
    return df.withColumn("reasons", F.transform(top, lambda r: F.struct(
        r["code"].alias("code"), reason_message(r["code"]).alias("message"), r["contribution"].alias("contribution"))))


def reason_message(code: Column) -> Column:
    table = {f.upper(): m for f, m in config.REASON_MESSAGES.items()}
    table |= {code_: message for code_, _, _, message in config.COMPOUNDS}
    table |= config.EXTRA_REASONS | config.SKETCH_REASONS
    return lit_map(table)[code]


def customer_explanation(df: DataFrame) -> DataFrame:
    """One plain sentence from the action and up to three reason phrases."""
    phrases = F.slice(
        F.array_distinct(F.array_compact(
            F.transform("reasons", lambda x: lit_map(config.CUSTOMER_PHRASES)[x["code"]])
        )), 1, 3,
    )
    n = F.size("_phrases")
    detail = (
        F.when(n == 0, F.lit(config.PHRASE_DEFAULT))
        .when(n == 1, F.get("_phrases", F.lit(0)))
        .otherwise(F.concat(
            F.array_join(F.slice("_phrases", F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
            F.lit(" and "), F.get("_phrases", n - 1),
        ))
    )
    sentence = F.concat(
        lit_map(config.EXPLAIN_PREFIX)[F.col("action")], F.lit(" "), detail, F.lit("; "),
        lit_map(config.EXPLAIN_RECOURSE)[F.col("action")], F.lit("."),
    )
    return df.withColumn("_phrases", phrases).withColumn(
        "customer_explanation",
        F.when((F.col("action") == config.ALLOW) & (F.col("verified_sim_change") > 0),
               F.lit(config.EXPLAIN_VERIFIED))
        .when(F.col("action") == config.ALLOW, F.lit(config.EXPLAIN_ALLOW))
        .otherwise(sentence),
    ).drop("_phrases")


def recourse_options(action: Column, hold_seconds: Column) -> Column:
    """Safe clearance routes for an action."""

    def route(name: str) -> Column:
        code, description, clearance, channel = config.RECOURSE[name]
        wait = (
            F.lit(clearance) if clearance else F.concat(
                F.lit("Within "),
                F.greatest(F.lit(1), F.floor(hold_seconds / 60)).cast("string"), F.lit(" minutes"))
        )
        return F.struct(
            F.lit(code).alias("action"), F.lit(description).alias("description"),
            wait.alias("estimated_clearance"), F.lit(channel).alias("safe_channel"),
        )

    asked = action != config.ALLOW
    strong = action.isin(config.INTRUSIVE_ACTIONS)
    return F.array_compact(F.array(
        F.when(asked, route("review")), F.when(strong, route("device")),
        F.when(strong, route("callback")), F.when(asked & (hold_seconds > 0), route("expiry")),
    ))
