"""The request path on JSON bodies: walk, gate, find, decide, mint and rewrite, and the evaluation of responses.

A body stays one row with its leaves as an array, so nothing is shuffled but the distinct
secrets that a vault is made of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from ..functions.text import free_name, sanitized_kind
from ..sources import bodies as b
from . import policy
from .detectors import BUILTIN, Rule, excused, found, needs_places, with_places
from .tokens import TOKEN, digest, own_secrets, spelled

def _gated(leaf: Column, keys: Sequence[str], case_sensitive: bool) -> Column:
    name = leaf["key"] if case_sensitive else F.lower(leaf["key"])
    return leaf["member"] & name.isin(*[k if case_sensitive else k.lower() for k in keys])


def evaluated(walked: DataFrame, rules: Sequence[Rule] = BUILTIN, sensitive: Sequence[str] = (), case_sensitive: bool = False, allowlist: Sequence[str] = (), phase: str = "request", budget: int | None = None) -> DataFrame:
    """Walked bodies with action, refusal, n_findings, rule_ids and backing, an array of (leaf_index, start, end, ...).

    In requests the value of a member with a sensitive name is one finding, unless a literal
    of ``allowlist`` covers all of it, and rules that redact are skipped there. A body that
    cannot be walked is refused in requests; in responses it is let through, and counted by
    ``walk_skip`` if it is JSON.
    """
    places = free_name("_places", walked.columns) if needs_places(rules, allowlist, phase) else None

    def one(leaf: Column, at: Column) -> Column:
        text, gate = leaf["value"], None
        allow = F.lit(False)
        if sensitive and phase == "request":
            gate = F.coalesce(_gated(leaf, sensitive, case_sensitive), F.lit(False))
            span = F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("end"))
            allow = let(text.cast("binary"), lambda raw: excused(span, raw, allowlist)) if allowlist else allow
        made = found(text, rules, allowlist, phase, budget, gate, allow, None if places is None else F.get(places, at))
        return F.transform(made, lambda f: F.struct(leaf["leaf_index"].alias("leaf_index"), *[f[n].alias(n) for n in ("start", "end", "rule_rank", "rule_id", "value", "category", "action", "confidence", "origin")]))

    rows = walked if places is None else with_places(walked, rules, places, "leaves", allowlist, phase, leaves=True)
    made = policy.decided(rows.withColumn("findings", F.flatten(F.transform("leaves", one))).select(*[F.col(f"`{c}`") for c in walked.columns if c != "findings"], "findings"))
    failed = F.col("walk_error").isNotNull()
    if phase != "request":
        return made.withColumn("walk_skip", (failed & F.col("is_json")).cast("int"))
    return made.withColumn("refusal", F.coalesce("refusal", "walk_error")).withColumn("action", F.when(failed, "block").otherwise(F.col("action")))


def redacted(decided: DataFrame, salt: bytes, key: str, body: str = "body") -> DataFrame:
    """key, redacted and applied of evaluated bodies; only those whose action is to redact change."""
    def edit(f: Column) -> Column:
        kind = sanitized_kind(f["category"])
        return F.struct(f["leaf_index"].alias("leaf_index"), f["start"].alias("start"), f["end"].alias("end"), spelled(kind, digest(salt, kind, f["value"])).alias("replacement"))

    edits = F.when(F.col("action") == "redact", F.transform("backing", edit))
    return b.rewritten(decided.select(key, F.col(body).alias("body"), edits.alias("edits")), key)


def restored(bodies: DataFrame, minted: DataFrame, key: str, body: str = "body", exclusions: DataFrame | None = None) -> DataFrame:
    """key, restored and n_restored of every body, placeholders of the vault spelled at the depth where they stand.

    Secrets in ``exclusions`` (secret) stay placeholders. Only bodies with placeholders are
    shuffled, to meet their own secrets; rows may share a key, or have none.
    """
    plain = bodies.select(F.col(key).alias("_key"), F.col(f"`{body}`").cast("binary").alias("body"))
    has = F.coalesce(F.contains(F.col("body").cast("string"), F.lit("__PII_")), F.lit(False))
    rows, secrets = own_secrets(plain.where(has), minted, "body", exclusions)
    done = b.restored_with(rows, secrets, "_key", TOKEN).union(plain.where(~has).select("_key", "body", F.lit(0)))
    return done.select(F.col("_key").alias(key), "restored", "n_restored")


def secrets_of(decided: DataFrame) -> DataFrame:
    """category and value of everything that a redaction of evaluated bodies replaces: what a vault is minted from."""
    return decided.where("action = 'redact'").select(F.explode("backing").alias("f")).select("f.category", "f.value")


def response_streams(events: DataFrame, rules: Sequence[Rule], stream: str = "stream_id", data: str = "data", allowlist: Sequence[str] = ()) -> DataFrame:
    """stream, action, rule_ids (distinct, sorted) and walk_skips of whole event streams.

    Events whose data is JSON are evaluated: any block wins, else any warning; an event
    that is JSON but cannot be walked counts one skip; other data is let through.
    """
    rows = b.walked(events.select(F.col(stream).alias("stream"), F.col(data).cast("binary").alias("body")))
    made = evaluated(rows, rules, allowlist=allowlist, phase="response")
    weigh = F.when(F.col("action") == "block", 2).when(F.col("action") == "warn", 1).otherwise(0)
    summed = made.groupBy("stream").agg(F.max(weigh).alias("top"), F.sum("walk_skip").alias("walk_skips"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(weigh == n, F.col("rule_ids")))))).alias(f"ids{n}") for n in (1, 2)])
    none = F.array().cast("array<string>")
    return summed.select(F.col("stream").alias(stream), F.element_at(F.array(F.lit("allow"), F.lit("warn"), F.lit("block")), F.col("top") + 1).alias("action"),
                         F.when(F.col("top") == 2, F.col("ids2")).when(F.col("top") == 1, F.col("ids1")).otherwise(none).alias("rule_ids"), "walk_skips")
