"""How far the sources of a language are from each other and from the language, by their terms.

Terms are counted by language and source with map-side sums. Each kept term of a language
is then one row whose counts stand in an array with a place for every source of the
language (a wide vector); from there on everything is arithmetic on arrays by higher-order
functions: each row emits the contribution of every pair of its sources, and the map-side
aggregation sums them, so that a task sends on a row for each pair at most. A row holds an
array of the language's sources and its pairs are emitted a source at a time. All numbers
are exact; counts are decimals where they are scaled.

Defined cases: null text, lang and source count as ''; a text without terms still makes its
group occur; a language without kept terms has pairs of value 0 and no terms; ties go by
the UTF-8 order of the items; repeated rows count each; an empty table gives no rows; long
texts are counted whole; only text, lang and source are read, so other columns may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

LEAST_DOCUMENTS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The terms of a text in sorted order, as often as they occur: runs of letters and of characters beyond ASCII; '' may come first."""
    return F.sort_array(F.split(F.translate(text, UPPER, LOWER), NO_TERM))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of every term."""
    # equal terms stand together, so the first of each marks the document
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("t", i - 1) == x), 0).otherwise(1).alias("first")))
    each = docs.select("lang", "source", terms(F.col("text")).alias("t")).select("lang", "source", F.explode(marked).alias("m")).where("m.term <> ''")
    return each.groupBy("lang", "source", F.col("m.term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.sum("m.first").alias("docs"))


def scaled(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * size)), exactly."""
    up = (count.cast("decimal(18,0)") + F.lit(PRIOR).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    down = total.cast("decimal(19,0)") + size.cast("decimal(18,0)") * F.lit(PRIOR).cast("decimal(1,0)")
    return F.call_function("div", up, down) + 1


def vectors(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(languages, kept): lang, sources, totals, total and size of every language; lang, term and counts (a place a source) of every kept term."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = own.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    by_term = counted(own).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    kept = stage(by_term.where(F.col("docs") >= least_documents).select("lang", "term", "by_source"), "terms")
    sums = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    per_source = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0)))
    languages = groups.join(totals, "lang", "left").join(sizes, "lang", "left").select("lang", "sources", per_source.alias("totals"), F.coalesce("size", F.lit(0)).alias("size"))
    languages = stage(languages.withColumn("total", F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x)), "languages")
    # few rows, so they are sent to all tasks if small; a large language is else split by the adaptive join
    wide = kept.join(languages.select("lang", "sources"), "lang").select("lang", "term", per_source.alias("counts"))
    return languages, wide


def profiles(languages: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, sources, term, counts, p (a place a source) and q (of the language)."""
    both = kept.join(languages, "lang")
    count = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    p = F.zip_with("counts", "totals", lambda n, total: scaled(n, total, F.col("size")))
    return both.select("lang", "sources", "term", "counts", p.alias("p"), scaled(count, F.col("total"), F.col("size")).alias("q"))


def pairs(languages: DataFrame, found: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of sources of a language."""
    one = found.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    rest = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x, k: F.struct((F.col("i") + 1 + k).alias("j"), F.abs(x - F.get("p", F.col("i"))).alias("f")))
    sums = one.select("lang", "i", F.inline(rest)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    alone = languages.where("size = 0").select("lang", "sources", F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("i"))
    zero = alone.where(F.col("i") + 1 < F.size("sources")).select("lang", "i", F.explode(F.sequence(F.col("i") + 1, F.size("sources") - 1)).alias("j"), F.lit(0).cast("long").alias("value"))
    named = stage(sums.unionByName(zero), "pairs").join(languages.select("lang", "sources"), "lang").select("lang", F.get("sources", F.col("i")).alias("a"), F.get("sources", F.col("j")).alias("b"), "value")
    return named.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")


def outstanding(found: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value and rank of the terms that a source uses more than its language, the ``top`` first."""
    above = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    each = found.select("lang", F.col("term").alias("item"), "q", F.explode(above).alias("x")).select("lang", F.col("x.sources").alias("source"), "item", (F.col("x.p") - F.col("q")).alias("value"))
    # the limit on ranks is taken before the shuffle too, so that a large group sends on ``top`` rows a task
    return each.withColumn("rank", F.row_number().over(_ranking())).where(F.col("rank") <= top)


def _ranking() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    languages, kept = vectors(docs)
    found = stage(profiles(languages, kept), "profiles")
    pair = pairs(languages, found).withColumn("rank", F.row_number().over(_ranking()))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*columns).unionByName(outstanding(found).withColumn("part", F.lit("term")).select(*columns))
