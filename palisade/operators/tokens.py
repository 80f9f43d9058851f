"""Reversible tokens: mint placeholders into a vault, splice them in, restore them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import held, let, matches
from ..functions.text import free_name, hmac_sha256, sanitized_kind

# The placeholder grammar and the digest lengths tried in turn.
LADDER = (12, 16, 24, 32, 48, 64)
TOKEN = r"__PII_[a-z0-9_]{1,16}?_[0-9a-f]{12,64}__"


def digest(salt: bytes, kind: Column, secret: Column) -> Column:
    """HMAC-SHA256 of kind and secret under the session's salt; ``kind`` is sanitized."""
    return hmac_sha256(salt, F.concat(kind.cast("binary"), F.lit(b"\0"), secret.cast("binary")))


def spelled(kind: Column, digest: Column, width: Column | None = None) -> Column:
    """The placeholder with the first ``width`` characters of the digest, the least length where not told."""
    return F.concat(F.lit("__PII_"), kind, F.lit("_"), F.left(digest, F.lit(LADDER[0]) if width is None else width), F.lit("__"))


def vault(findings: DataFrame, salt: bytes, kind: str = "category", secret: str = "value", session: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """(session,) kind, secret, placeholder: one row for each distinct secret.

    The digest is HMAC-SHA256 under the session's salt, so one secret has one placeholder
    in a session. Where shortened digests of two secrets meet, the later one (by digest)
    takes the next length; only such rows are looked at again. Secrets of ``known``, an
    earlier vault of the same salt, keep their placeholders and come first; the result
    holds the new ones as well, so it replaces the earlier vault.
    """
    own = [session] if session else []
    names = [*own, "kind", "secret"]
    distinct = findings.select(*own, sanitized_kind(F.col(kind)).alias("kind"), F.col(secret).alias("secret")).distinct()
    if known is not None:
        distinct = distinct.join(known.select(*names), names, "left_anti")
    hashed = distinct.withColumn("digest", digest(salt, F.col("kind"), F.col("secret")))
    placed = hashed.select(*names, "digest", F.lit(None).cast("string").alias("placeholder"))
    if known is not None:
        placed = placed.union(known.select(*names, digest(salt, F.col("kind"), F.col("secret")), "placeholder"))
    short = F.left("digest", F.lit(LADDER[0]))
    group = Window.partitionBy(*own, "kind", short)
    # where short digests meet: who holds a place keeps it, then in the order of digests
    meeting = F.sort_array(F.collect_list(F.struct(F.col("placeholder").isNull().alias("new"), "digest", "secret", "placeholder")).over(group))
    text = F.when(F.size("_met") == 1, spelled(F.col("kind"), F.col("digest"))).otherwise(_laddered(F.col("_met"), F.col("digest"), F.col("secret"), F.col("kind")))
    return placed.withColumn("_met", meeting).select(*names, F.coalesce("placeholder", text).alias("placeholder"))


def _laddered(met: Column, own: Column, secret: Column, kind: Column) -> Column:
    """The placeholder of a secret among those whose short digests meet: each in turn takes the least length that is free; without one the plan fails."""

    def step(taken: Column, x: Column) -> Column:
        free = F.filter(F.array(*[F.lit(n) for n in LADDER]), lambda n: ~F.exists(taken, lambda t: t["placeholder"] == spelled(kind, x["digest"], n)))
        made = F.coalesce(x["placeholder"], spelled(kind, x["digest"], F.try_element_at(free, F.lit(1))), F.raise_error(F.lit("no placeholder is free")).cast("string"))
        return F.concat(taken, F.array(F.struct(x["digest"].alias("digest"), x["secret"].alias("secret"), made.alias("placeholder"))))

    every = F.aggregate(met, F.array().cast("array<struct<digest:string,secret:string,placeholder:string>>"), step)
    return F.get(F.filter(every, lambda t: (t["digest"] == own) & (t["secret"] == secret)), 0)["placeholder"]


def disjoint(edits: Column) -> Column:
    """(start, end, ...) edits in order, of overlapping ones the first; touching ones all stand. Nulls have none."""
    step = lambda acc, e: F.when(e["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(e))).otherwise(acc)
    return F.aggregate(F.array_sort(edits), F.filter(edits, lambda e: F.lit(False)), step)


def splice(text: Column, edits: Column) -> Column:
    """``text`` with disjoint (start, end, replacement) edits, byte offsets, in order."""

    def pieces(both: Column) -> Column:
        raw, own = both["raw"], both["edits"]
        before = lambda e, i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        parts = F.transform(own, lambda e, i: F.concat(F.substring(raw, before(e, i) + 1, e["start"] - before(e, i)).cast("string"), e["replacement"]))
        last = F.element_at(own, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

    return F.when(F.coalesce(F.size(edits), F.lit(0)) > 0, let(F.struct(text.cast("binary").alias("raw"), edits.alias("edits")), pieces)).otherwise(text)


def longer(minted: DataFrame) -> DataFrame:
    """The rows of a vault whose placeholder is longer than the shortest: those whose short digests met."""
    return minted.where(~F.col("placeholder").rlike(r"_[0-9a-f]{%d}__$" % LADDER[0]))


def redact(df: DataFrame, salt: bytes, minted: DataFrame | None = None, text: str = "text", findings: str = "findings") -> DataFrame:
    """``df`` (with its findings as an array) with ``redacted`` and ``applied``, the number of edits that changed it.

    Placeholders are an expression of kind and secret, so nothing is shuffled, and the plan
    never reads the vault's secrets. Only where the vault ``minted`` has longer
    placeholders are the rows that hold such secrets joined with them.
    """
    def edits(spell: Callable[[Column, Column], Column]) -> Column:
        def one(f: Column) -> Column:
            kind = sanitized_kind(f["category"])
            return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule_rank"].alias("rank"), spell(kind, f["value"]).alias("replacement"))

        return disjoint(F.transform(F.col(findings), one))

    def done(rows: DataFrame, spell: Callable[[Column, Column], Column], columns: list[str]) -> DataFrame:
        name = free_name("_edits", rows.columns)
        made = rows.withColumn(name, edits(spell))
        return made.select(*[F.col(f"`{c}`") for c in columns], splice(F.col(f"`{text}`"), F.col(name)).alias("redacted"), F.size(name).alias("applied"))

    plain = lambda kind, secret: spelled(kind, digest(salt, kind, secret))
    columns = [c for c in df.columns if c not in ("redacted", "applied")]
    more = None if minted is None else longer(minted).select("kind", "secret", "placeholder")
    if more is None or more.isEmpty():
        return done(df, plain, columns)
    # rows with the same secrets need the same placeholders
    by, name = free_name("_by", df.columns), free_name("_longer", df.columns)
    held = F.transform(findings, lambda f: F.struct(sanitized_kind(f["category"]).alias("kind"), f["value"].alias("secret")))
    row = df.withColumn(by, F.sha2(F.to_json(F.array_sort(F.array_distinct(held))).cast("binary"), 256))
    secrets = row.select(by, F.explode(held).alias("f")).select(by, "f.kind", "f.secret").distinct()
    told = secrets.join(more, ["kind", "secret"]).groupBy(by).agg(F.collect_set(F.struct("kind", "secret", "placeholder")).alias(name))
    longest = lambda kind, secret: F.coalesce(F.get(F.filter(name, lambda x: (x["kind"] == kind) & (x["secret"] == secret)), 0)["placeholder"], plain(kind, secret))
    return done(row.join(told, by, "left"), longest, columns)


def own_secrets(rows: DataFrame, minted: DataFrame, text: str, exclusions: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``rows`` with a map of the secrets behind the placeholders in a text column, and the map's name; null where there are none.

    What a text needs depends on the text alone, so rows meet their secrets by its digest:
    rows may share a key, or have none. Secrets in ``exclusions`` (secret) are left out.
    """
    known = minted if exclusions is None else minted.join(exclusions.select("secret").distinct(), "secret", "left_anti")
    by, name = free_name("_text", rows.columns), free_name("_secrets", rows.columns)
    marked = rows.withColumn(by, F.sha2(F.col(f"`{text}`").cast("binary"), 256))
    found = F.array_distinct(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"({TOKEN})"), F.lit(0)))
    asked = marked.select(by, F.explode(found).alias("placeholder")).distinct()
    own = asked.join(known.select("placeholder", "secret"), "placeholder").groupBy(by).agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "secret"))).alias(name))
    return marked.join(own, by, "left").drop(by), name


def restore(df: DataFrame, minted: DataFrame, key: str, text: str = "redacted", exclusions: DataFrame | None = None) -> DataFrame:
    """key, restored and n_restored: placeholders of the vault replaced by their secrets, row by row.

    Unknown placeholders stay, as do those whose secret is in ``exclusions`` (secret). Texts
    without a placeholder are not shuffled.
    """
    has = F.coalesce(F.contains(text, F.lit("__PII_")), F.lit(False))
    rows, secrets = own_secrets(df.where(has).select(key, text) if key != text else df.where(has).select(key), minted, text, exclusions)
    placed = F.transform(matches(F.col(f"`{text}`"), TOKEN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_element_at(secrets, m["value"]).alias("replacement")))
    edits = let(F.when(F.col(secrets).isNotNull(), F.filter(placed, lambda e: e["replacement"].isNotNull())), lambda e: F.struct(splice(F.col(f"`{text}`"), e).alias("restored"), F.coalesce(F.size(e), F.lit(0)).alias("n_restored")))
    name = free_name("_done", rows.columns)
    joined = held(rows, name, edits).select(key, f"{name}.restored", f"{name}.n_restored")
    return joined.union(df.where(~has).select(key, F.col(text), F.lit(0)))
