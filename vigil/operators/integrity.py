"""Hash-linked logs, provenance digests and anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import hmac_sha256
from vigil.operators.timeline import positions

GENESIS = "0" * 64


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chain, sequence, previous = None, 0, GENESIS
    for batch in batches:
        numbers, before, hashes = [], [], []
        for key, body in zip(batch["chain"], batch["body"]):
            if key != chain:
                chain, sequence, previous = key, 0, GENESIS
            sequence += 1
            digest = hashlib.sha256(f"{sequence}|{body}|{previous}".encode()).hexdigest()
            numbers.append(sequence)
            before.append(previous)
            hashes.append(digest)
            previous = digest
        yield batch.assign(sequence=numbers, previous_hash=before, entry_hash=hashes)


def chain_append(entries: DataFrame, chain: Column, order: list[str], body: Column) -> DataFrame:
    """Link entries into one hash chain per ``chain`` value (use tenant and day, not one chain).

    Linking is sequential by definition, so chains are spread over tasks and each is streamed in order
    with constant memory.
    """
    rows = entries.select("*", chain.alias("chain"), body.alias("body"))
    schema = rows.schema.add("sequence", "long").add("previous_hash", "string").add("entry_hash", "string")
    return rows.repartition("chain").sortWithinPartitions("chain", *order).mapInPandas(_link, schema)


def verify_chain(log: DataFrame) -> DataFrame:
    """Per chain: valid, entries_checked, first_invalid_sequence and head_hash, in parallel.

    A row is bad when its sequence is not its position, its previous hash is not the hash of the row
    before it, or its own hash does not match its content.  The rows before the first bad one all
    satisfy prev = hash of predecessor, so this equals the sequential walk.
    """
    placed = positions(log.withColumn("_s", F.col("sequence")), ["chain"], "_s", ["entry_hash"],
                       bucket_us=100_000)
    before = placed.select("chain", (F.col("position") + 1).alias("position"),
                           F.col("entry_hash").alias("linked_hash"))
    joined = placed.join(before, ["chain", "position"], "left").withColumn(
        "linked_hash", F.coalesce("linked_hash", F.lit(GENESIS)))
    expected = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "body", "linked_hash"), 256)
    bad = (
        (F.col("sequence") != F.col("position")) | (F.col("previous_hash") != F.col("linked_hash"))
        | (F.col("entry_hash") != expected)
    )
    checked = joined.select("chain", "position", "sequence", "entry_hash", bad.alias("bad"))
    first = checked.groupBy("chain").agg(
        F.min(F.when(F.col("bad"), F.struct("position", "sequence"))).alias("bad"),
        F.count(F.lit(1)).alias("entries"),
    ).withColumn("entries_checked", F.coalesce(F.col("bad.position") - 1, F.col("entries")))
    head = checked.select("chain", F.col("position").alias("entries_checked"),
                          F.col("entry_hash").alias("head_hash"))
    return first.join(head, ["chain", "entries_checked"], "left").select(
        "chain", F.col("bad").isNull().alias("valid"), "entries_checked",
        F.col("bad.sequence").alias("first_invalid_sequence"), "head_hash",
    )


def _canonical(values: list[Column]) -> Column:
    return F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def micro_units(name: str) -> Column:
    """A 6-decimal number as an integer, so that its text form is the same everywhere."""
    return F.floor(F.col(name) * 1_000_000 + 0.5).cast("long")


def provenance(decisions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds event_digest, feature_digest and replay_digest over fixed-order canonical text."""
    event = _canonical([
        F.col("event_id"), F.col("account_id"), F.col("tenant_id"), F.col("ts_us"), F.col("event_type"),
        F.col("channel"), micro_units("amount"), F.col("recipient_id"), F.col("device_id"), F.col("sim_id"),
    ])
    features = _canonical([micro_units(n) for n in config.FEATURES + config.AGENT_FEATURES])
    df = decisions.withColumns({
        "event_digest": F.sha2(event, 256), "feature_digest": F.sha2(features, 256),
        "model_version": F.lit(settings.model_version), "policy_version": F.lit(settings.policy_version),
    })
    return df.withColumn("replay_digest", replay_digest())


def replay_digest() -> Column:
    return F.sha2(_canonical([
        F.col("event_digest"), F.col("feature_digest"), F.col("model_version"), F.col("policy_version"),
        F.col("ts_us"),
    ]), 256)


def replay_verify(stored: DataFrame) -> DataFrame:
    """Recomputes the replay digest of every stored decision."""
    return stored.select(
        "event_id", F.col("replay_digest").alias("stored_digest"), replay_digest().alias("computed_digest"),
    ).withColumn("exact_match", F.col("stored_digest") == F.col("computed_digest"))


def offline_reference(tenant: Column, event: Column) -> Column:
    return F.concat(
        F.lit("OFF-"), F.upper(F.substring(F.sha2(F.concat_ws("|", tenant, event), 256), 1, 12)))


def audit_anchor(verified: DataFrame, at_text: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Signed anchor over the head of each chain."""
    head = F.coalesce("head_hash", F.lit("genesis"))
    return verified.select(
        "chain", head.alias("head_hash"), F.lit(at_text).alias("created_at"),
        hmac_sha256(F.concat_ws("|", head, F.lit(at_text)), settings.anchor_key).alias("signature"),
    )


def terminal_reference(tenant: Column, terminal: Column) -> Column:
    """Pseudonymous public reference of a terminal."""
    return F.substring(F.sha2(F.concat_ws("|", tenant, terminal), 256), 1, 16)
