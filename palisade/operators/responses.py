"""A whole response: buffered up to a cap, decoded, evaluated, refused or restored, in this order.

Each row ends in one way. A body beyond the cap is refused unread; one with an unknown or
broken content coding cannot be decoded; one that a rule blocks is refused with that rule.
All these are 502 documents that name codes and rules, never content. Everything else goes
on with its own status, decoded, its placeholders restored last: warnings are kept as rule
ids, and a body that cannot be walked is let through, and counted if it is JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bodies as b
from ..staging import stage
from .detectors import BUILTIN, Rule
from .requests import evaluated, restored

# Refusal codes of responses, and the bytes that a response may have.
TOO_LARGE, UNDECODABLE, BLOCKED = "bad_gateway", "undecodable_content_encoding", "rule_blocked"
CAP = 32 << 20
CODINGS = ("gzip", "x-gzip", "deflate", "identity")


def buffered(responses: DataFrame, minted: DataFrame, key: str, rules: Sequence[Rule] = BUILTIN, status: str = "status", body: str = "body", encoding: str = "content_encoding", cap: int = CAP, exclusions: DataFrame | None = None) -> DataFrame:
    """key, status, body, error, rule_id, warnings, walk_skip and n_restored of every response.

    ``minted`` has placeholder and secret; ``encoding`` is the header, null where there is
    none. A null body is empty; keys may be shared or null.
    """
    raw = F.coalesce(F.col(f"`{body}`").cast("binary"), F.lit(b""))
    header = F.col(f"`{encoding}`")
    told = F.coalesce(F.forall(F.split(header, ","), lambda x: F.lower(F.trim(x)).isin(*CODINGS)), F.lit(True))
    first = F.when(F.octet_length(raw) > cap, TOO_LARGE).when(~told, UNDECODABLE)
    plain = responses.select(F.col(f"`{key}`").alias("k"), F.col(f"`{status}`").cast("int").alias("status"), F.when(first.isNull(), raw).alias("body"), header.alias("coding"), first.alias("error"))
    decoded = b.inflated(plain, "body", "coding", cap).withColumn("error", F.coalesce("error", F.when(F.col("refused"), UNDECODABLE))).drop("refused", "coding")
    # a refused body is not looked into
    made = evaluated(b.walked(decoded.withColumn("body", F.when(F.col("error").isNull(), F.col("body")))), rules, phase="response")
    # an action that is not known blocks
    blocked = F.col("error").isNull() & ~F.coalesce(F.col("action").isin("allow", "warn"), F.lit(False))
    judged = stage(made.select(
        "k", "status", "body", F.when(blocked, BLOCKED).otherwise(F.col("error")).alias("error"), F.when(blocked, F.try_element_at("rule_ids", F.lit(1))).alias("rule_id"),
        F.when(F.col("error").isNull() & (F.col("action") == "warn"), F.array_distinct("rule_ids")).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when(F.col("error").isNull(), F.col("walk_skip")).otherwise(0).alias("walk_skip")), "responses")
    document = F.to_json(F.struct("error", "rule_id")).cast("binary")
    refused = judged.where("error IS NOT NULL").select("k", F.lit(502).alias("status"), document.alias("body"), "error", "rule_id", "warnings", "walk_skip", F.lit(0).alias("n_restored"))
    passed = judged.where("error IS NULL").select(F.struct("k", "status", "error", "rule_id", "warnings", "walk_skip").alias("facts"), "body")
    back = restored(passed, minted, "facts", exclusions=exclusions).select("facts.k", "facts.status", F.col("restored").alias("body"), "facts.error", "facts.rule_id", "facts.warnings", "facts.walk_skip", "n_restored")
    return refused.unionByName(back).withColumnRenamed("k", key)
