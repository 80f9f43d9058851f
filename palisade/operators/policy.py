"""Findings to decisions: the strongest action wins and only its findings stand behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import held, let
from ..functions.text import free_name, mask_secret
from .detectors import FAILED, SENSITIVE_ID

# Actions from weak to strong, and the findings that one body may have.
ACTIONS = ("allow", "warn", "redact", "block")
MOST_FINDINGS = 4096
WALK_ERRORS = ("malformed_json", "trailing_data", "invalid_utf8", "max_depth")


def action_rank(action: Column) -> Column:
    """0 to 3; an unknown action is -1."""
    return F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action).cast("int") - 1


def decision(findings: Column) -> Column:
    """(action, refusal, backing) of a body's findings in their order, without a shuffle.

    A rule that failed refuses the body with its reason, and so do more than
    ``MOST_FINDINGS`` findings, both without partial results; a body without findings is
    allowed. Only the findings of the strongest action stand behind it.
    """
    failed = F.get(F.filter(findings, lambda f: F.startswith(f["action"], F.lit(FAILED))), 0)["action"]
    reason = F.when(failed.isNotNull(), F.replace(failed, F.lit(FAILED), F.lit(""))).when(F.size(findings) > MOST_FINDINGS, "budget")
    over = reason.isNotNull()
    top = F.greatest(F.coalesce(F.array_max(F.transform(findings, lambda f: action_rank(f["action"]))), F.lit(0)), F.lit(0))
    none = F.filter(findings, lambda f: F.lit(False))

    def made(t: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), t + 1)
        return F.struct(F.when(over, "block").otherwise(name).alias("action"), reason.alias("refusal"), F.when(over, none).otherwise(F.filter(findings, lambda f: action_rank(f["action"]) == t)).alias("backing"))

    return let(top, made)


def decided(bodies: DataFrame, findings: str = "findings") -> DataFrame:
    """``bodies`` with action, refusal, n_findings and rule_ids (in order; the first is the primary one) and backing instead of their findings."""
    kept = [F.col(f"`{c}`") for c in bodies.columns if c not in (findings, "action", "refusal", "backing", "n_findings", "rule_ids")]
    name = free_name("_d", bodies.columns)
    made = held(bodies, name, decision(F.col(f"`{findings}`")))
    return made.select(*kept, f"{name}.action", f"{name}.refusal", F.size(f"{name}.backing").alias("n_findings"), F.transform(f"{name}.backing", lambda f: f["rule_id"]).alias("rule_ids"), f"{name}.backing")


def counters(decided: DataFrame, applied: str = "applied", walk_skips: str | None = None) -> DataFrame:
    """One row of totals over decided bodies.

    Redactions are the substitutions applied, in bodies whose action is to redact; walk
    skips are response events that are JSON but could not be walked.
    """
    block = F.col("action") == "block"
    skips = F.sum(F.col(walk_skips)) if walk_skips else F.lit(0)
    return decided.agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.when(F.col("action") == "redact", F.col(applied))), F.lit(0)).cast("long").alias("redactions"),
        F.count_if(block).alias("content_policy_blocks"), F.count_if(block & F.col("refusal").isNull()).alias("rule_blocks"), F.coalesce(skips, F.lit(0)).cast("long").alias("walk_skips"))


def refusals(decided: DataFrame, key: str) -> DataFrame:
    """key, status and body: the refusal document of every body that is not let through; it names codes and the first rule, never content.

    A body that cannot be walked is refused by what is wrong with it, one that cannot be
    evaluated with the reason, one that a rule blocks with the rule.
    """
    walked = F.col("refusal").isin(*WALK_ERRORS)
    error = F.when(F.col("refusal").isNull(), "rule_blocked").when(walked, F.col("refusal")).otherwise("plugin_failure")
    rule = F.when(F.col("refusal").isNull(), F.try_element_at("rule_ids", F.lit(1)))
    document = F.to_json(F.struct(error.alias("error"), F.when(~walked, F.col("refusal")).alias("reason"), rule.alias("rule_id")))
    return decided.where("action = 'block'").select(key, F.when(walked, 400).otherwise(403).alias("status"), document.alias("body"))


def status(totals: DataFrame) -> DataFrame:
    """One row, status: the counters as a document."""
    return totals.select(F.to_json(F.struct("requests", "redactions", "content_policy_blocks", "rule_blocks", "walk_skips")).alias("status"))


def restore_log(restored: DataFrame, key: str) -> DataFrame:
    """key and placeholders of every body in which something was restored."""
    return restored.where("n_restored > 0").select(key, F.col("n_restored").alias("placeholders"))


def redaction_log(decided: DataFrame, key: str) -> DataFrame:
    """key, nth, category, n_bytes and masked of every finding behind a redaction: what a log may show."""
    rows = decided.where("action = 'redact'").select(key, F.posexplode("backing").alias("nth", "f"))
    return rows.select(key, "nth", "f.category", (F.col("f.end") - F.col("f.start")).alias("n_bytes"), mask_secret(F.col("f.value"), F.col("f.category")).alias("masked"))


def audit(decided: DataFrame, key: str, phase: str = "request") -> DataFrame:
    """key, phase, action, refusal and the distinct rule ids and categories of every body: no content, no offsets."""
    return decided.select(key, F.lit(phase).alias("phase"), "action", "refusal", F.array_sort(F.array_distinct("rule_ids")).alias("rules"), F.array_sort(F.array_distinct(F.transform("backing", lambda f: f["category"]))).alias("categories"))


def budget_report(bodies: DataFrame, key: str, budget: int, text: str = "text") -> DataFrame:
    """key, longest and budget of the bodies with a text that is longer than the detectors scan."""
    return bodies.groupBy(key).agg(F.max(F.octet_length(text)).alias("longest")).where(F.col("longest") > budget).withColumn("budget", F.lit(budget))


def sensitive_keys(leaves: DataFrame, keys: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """Leaves under a sensitive member name; the whole value is one finding."""
    name = F.col("key") if case_sensitive else F.lower("key")
    wanted = list(keys) if case_sensitive else [k.lower() for k in keys]
    hit = F.col("member") & name.isin(wanted) & (F.octet_length("value") > 0)
    return leaves.where(hit).withColumns({"start": F.lit(0), "end": F.octet_length("value"), "rule_id": F.lit(SENSITIVE_ID), "category": F.lit("custom"), "action": F.lit("redact"), "confidence": F.lit(1.0), "origin": F.lit("remote_pack")})


def routes(requests: DataFrame, table: Sequence[tuple[str, str]], path: str = "path") -> DataFrame:
    """``requests`` with ``target``, that of the longest route that is the path or a prefix of it at a slash."""
    column = F.col(path)
    hits = [F.when((column == k) | F.lit(k == "/") | F.startswith(column, F.lit(k.rstrip("/") + "/")), F.struct(F.lit(len(k)).alias("n"), F.lit(t).alias("target"))) for k, t in sorted(table)]
    best = F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return requests.withColumn("target", best["target"])
