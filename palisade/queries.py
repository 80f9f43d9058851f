"""Registered queries over the synthetic tables, each with DuckDB SQL where SQL can express it.

The tables hold few secrets, so some queries plant them in every document by an expression
that both engines evaluate alike, with near misses beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import mask_secret, route
from .operators import detectors as d
from .operators import policy, requests, responses, tokens
from .sources import bodies, sse
from .staging import stage
from .streaming import events

SALT = bytes(range(32))
KEYWORDS, BLOCKED, ALLOWED = ("idiot", "clown"), ("worthless",), ("contact@", "example.com")
BUDGET = 2000
RUDE_TURNS, STOP_TURNS = ("the",), ("assistant", "zz")
SYLLABLES = ("an", "ar", "as", "at", "ci", "co", "de", "di", "el", "en", "er", "es", "ie", "in", "is", "it", "la", "le", "li", "me", "nd", "ne", "on", "or", "ou", "ra", "re", "se", "st", "te", "th", "ti")
REGEXES = (("head", r"^\S+\s\S+"), ("tail", r"\w+\W*$"), ("line", r"(?m)^.{3,40}$"), ("cased", r"(?i)\bthe\b|\bles?\b|ÉT"), ("posix", r"[[:upper:]][[:lower:]]+ [[:digit:]]+"), ("letters", r"[^\W\d_]{12,}"),
           ("named", r"(?P<user>[\w.]+)@(?P<host>[\w-]+)"), ("lazy", r"(?s)[(].*?[)]"), ("quoted", r"\Q.\E\s+\p{Lu}"), ("ungreedy", r"(?U)q.+[aeiou]{2,}\s"), ("boundary", r"\B[a-z]{1,3}\b\pP"), ("any", r"\x{E9}|[\x{C0}-\x{D6}\p{Nd}]{4}"))
ROUTES = (("/", "root"), ("/en", "english"), ("/fr", "french"), ("/fr/8", "eight"), ("/en/1", "one"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _md5(column: str) -> Column:
    return F.md5(F.col(column).cast("string").cast("binary"))


def _spans(df: DataFrame, build: Callable[[Column], Column]) -> DataFrame:
    return df.select("doc_id", F.explode(build(F.col("text"))).alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.value").alias("value"))


# the same plantings in both engines: Spark expression, DuckDB expression
PLANTED_KEY = (
    lambda: F.concat("text", F.lit(" AKIA"), F.upper(F.substring(_md5("doc_id"), 1, F.when(F.col("doc_id") % 3 == 2, 15).otherwise(16))), F.when(F.col("doc_id") % 3 == 1, "x").otherwise(" ")),
    "concat(text, ' AKIA', upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, CASE WHEN doc_id % 3 = 2 THEN 15 ELSE 16 END)), CASE WHEN doc_id % 3 = 1 THEN 'x' ELSE ' ' END)")
PLANTED_JWT = (
    lambda: F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 2 == 0, "eyJhbGciOiJIUzI1NiJ9").otherwise("eyJ0eXAiOiJKV1QifQ"), F.lit("."), _md5("doc_id"), F.lit("."), F.substring(_md5("doc_id"), 1, 10), F.lit(" ")),
    "concat(text, ' ', CASE WHEN doc_id % 2 = 0 THEN 'eyJhbGciOiJIUzI1NiJ9' ELSE 'eyJ0eXAiOiJKV1QifQ' END, '.', md5(CAST(doc_id AS VARCHAR)), '.', substr(md5(CAST(doc_id AS VARCHAR)), 1, 10), ' ')")
PLANTED_PEM = (
    lambda: F.concat("text", F.lit("\n-----BEGIN RSA PRIVATE KEY-----\n"), _md5("doc_id"), F.when(F.col("doc_id") % 2 == 0, "\n-----END RSA PRIVATE KEY-----\n").otherwise("\n-----END EC PRIVATE KEY-----\n")),
    "concat(text, chr(10), '-----BEGIN RSA PRIVATE KEY-----', chr(10), md5(CAST(doc_id AS VARCHAR)), chr(10), CASE WHEN doc_id % 2 = 0 THEN '-----END RSA PRIVATE KEY-----' ELSE '-----END EC PRIVATE KEY-----' END, chr(10))")
PLANTED_RANDOM = (
    lambda: F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 2 == 0, "ZqXkLmNpQrStUvWy").otherwise(""), _md5("doc_id"), F.lit(" ")),
    "concat(text, ' ', CASE WHEN doc_id % 2 = 0 THEN 'ZqXkLmNpQrStUvWy' ELSE '' END, md5(CAST(doc_id AS VARCHAR)), ' ')")


def planted(spark: SparkSession, sf_dir: str, what: tuple) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", what[0]().alias("text"))


def findings_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_docs(spark, sf_dir), d.email_spans)


def findings_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_docs(spark, sf_dir), d.luhn_spans)


def findings_prefix_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(planted(spark, sf_dir, PLANTED_KEY), d.prefix_spans)


def findings_jwt_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(planted(spark, sf_dir, PLANTED_JWT), d.jwt_spans)


def findings_pem_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(planted(spark, sf_dir, PLANTED_PEM), d.pem_spans)


def findings_entropy_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(planted(spark, sf_dir, PLANTED_RANDOM), d.entropy_spans)


def regex_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_docs(spark, sf_dir), d.regex_rule("phone", "[0-9]{3}[- ][0-9]{4}").spans)


def keyword_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_docs(spark, sf_dir), d.keyword_rule("rude", KEYWORDS).spans)


def _pack() -> list[d.Rule]:
    """Sixteen rules of 64 literals; those of even rules are compared without case."""
    words = [[SYLLABLES[2 * i + k // 32] + SYLLABLES[k % 32] for k in range(64)] for i in range(16)]
    return [d.keyword_rule(f"r{i:02d}", w, case_sensitive=i % 2 == 1, action="warn") for i, w in enumerate(words)]


def keyword_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of 1,024 literals."""
    found = d.findings(_docs(spark, sf_dir), _pack())
    return found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.max("end").alias("last_end"), F.count_distinct("value").alias("n_values"))


def regex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with anchors, classes, flags and names, as RE2 means them."""
    rows = d.with_findings(_docs(spark, sf_dir), [d.regex_rule(k, p) for k, p in REGEXES])

    def of(rule: str) -> Column:
        own = F.filter("findings", lambda f: f["rule_id"] == rule)
        return F.transform(own, lambda f, i: F.struct(f["rule_id"].alias("rule_id"), i.cast("long").alias("nth"), f["value"].alias("value")))

    own = F.concat(*[of(k) for k, _ in REGEXES])
    return rows.select("doc_id", F.inline(own))


def _guarded(text: bytes) -> list[tuple[int, int]] | None:
    """A rule of another origin that fails in every way: its spans are the places of ``que``."""
    if text.startswith(b"A"):
        raise RuntimeError("not my kind of text")
    if text.startswith(b"L"):
        return None
    if text.startswith(b"E"):
        return [(0, len(text) + 1)]
    if text.count(b"e") > 1000:
        return [(i, i + 1) for i in range(len(text)) if text[i] == 101] * 5
    out, at = [], text.find(b"que")
    while at >= 0:
        out.append((at, at + 3))
        at = text.find(b"que", at + 3)
    return out


def guarded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python rule beside built-in ones: what it finds, and how texts are refused where it fails."""
    rules = [d.BUILTIN[1], d.python_rule("que", _guarded, action="warn", confidence=0.5), d.keyword_rule("rude", KEYWORDS, action="warn")]
    made = policy.decided(d.with_findings(_docs(spark, sf_dir), rules)).withColumn("own", F.size(F.filter("backing", lambda f: f["origin"] == "plugin")))
    documents = policy.refusals(made, "doc_id").select(F.col("doc_id").alias("id"), "body")
    return made.join(documents, F.col("doc_id") == F.col("id"), "left").select("doc_id", "action", "refusal", F.col("own").cast("long").alias("own"), "body")


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_docs(spark, sf_dir), d.blocklist_rule(BLOCKED).spans)


def allowlist_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.findings(_docs(spark, sf_dir), [d.BUILTIN[1]], allowlist=KEYWORDS + ALLOWED)
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "value")


def _rules() -> list[d.Rule]:
    return [*d.BUILTIN, d.keyword_rule("rude", KEYWORDS, action="warn", scope="both"), d.blocklist_rule(BLOCKED)]


def findings_all_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.with_findings(planted(spark, sf_dir, PLANTED_KEY), _rules())
    rows = found.select("doc_id", F.posexplode("findings").alias("at", "f"))
    return rows.select("doc_id", (F.col("at") + 1).alias("nth"), F.col("f.start").alias("span_start"), F.col("f.end").alias("span_end"), "f.value", "f.rule_id", "f.category", "f.action")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decided(d.with_findings(planted(spark, sf_dir, PLANTED_KEY), _rules()))


def decision_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("doc_id", "action", F.col("n_findings").cast("long").alias("n_findings"), F.array_join("rule_ids", ",").alias("rule_ids"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.counters(tokens.redact(_decided(spark, sf_dir), SALT, findings="backing"))


def refusal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.refusals(_decided(spark, sf_dir), "doc_id")


def status_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.status(counters(spark, sf_dir))


def restore_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    minted, done = _redacted(spark, sf_dir)
    return policy.restore_log(tokens.restore(done, minted, "doc_id"), "doc_id").select("doc_id", F.col("placeholders").cast("long").alias("placeholders"))


def redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.redaction_log(_decided(spark, sf_dir), "doc_id").select("doc_id", F.col("nth").cast("long").alias("nth"), "category", F.col("n_bytes").cast("long").alias("n_bytes"), "masked")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.audit(_decided(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "phase", "action", F.array_join("rules", ",").alias("rules"), F.array_join("categories", ",").alias("categories"))


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in algorithms scan the first bytes only, keyword rules the whole text."""
    found = d.findings(_docs(spark, sf_dir), [d.BUILTIN[1], d.keyword_rule("rude", KEYWORDS)], budget=BUDGET)
    return found.select("doc_id", F.col("start").alias("span_start"), "value", "rule_id")


def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.budget_report(_docs(spark, sf_dir), "doc_id", BUDGET).select("doc_id", F.col("longest").cast("long").alias("longest"))


def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = d.findings(docs.withColumn("text", PLANTED_KEY[0]()), _rules())
    return found.cube("lang", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def mask_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.findings(planted(spark, sf_dir, PLANTED_KEY), d.BUILTIN)
    return found.select("doc_id", F.col("start").alias("span_start"), "rule_id", mask_secret(F.col("value"), F.col("category")).alias("masked"))


def vault_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vault(d.findings(planted(spark, sf_dir, PLANTED_KEY), d.BUILTIN), SALT)


def _redacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = d.with_findings(planted(spark, sf_dir, PLANTED_KEY), d.BUILTIN)
    minted = stage(tokens.vault(docs.select(F.explode("findings").alias("f")).select("f.*"), SALT), "vault")
    return minted, stage(tokens.redact(docs, SALT, minted).select("doc_id", "redacted", "applied"), "redacted")


def redaction_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir)[1].select("doc_id", F.octet_length("redacted").cast("long").alias("n_bytes"), F.col("applied").cast("long").alias("applied"))


def redact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    minted, done = _redacted(spark, sf_dir)
    back = tokens.restore(done.select("doc_id", "redacted"), minted, "doc_id")
    return back.select("doc_id", F.sha2(F.col("restored").cast("binary"), 256).alias("text_sha256"), F.col("n_restored").cast("long").alias("n_restored"))


def vault_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault of two runs: the second one's known secrets keep their placeholders."""
    found = d.findings(planted(spark, sf_dir, PLANTED_KEY), d.BUILTIN)
    earlier = tokens.vault(found.where("doc_id % 2 = 0"), SALT)
    # what was minted before need not be what would be minted now
    longer = earlier.withColumn("placeholder", tokens.spelled(F.col("kind"), tokens.digest(SALT, F.col("kind"), F.col("secret")), F.lit(16)))
    return tokens.vault(found, SALT, known=longer)


def restore_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a key or have none are restored each by its own text."""
    minted, done = _redacted(spark, sf_dir)
    shared = done.select(F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 7).alias("shared"), "redacted")
    back = tokens.restore(shared, minted, "shared")
    return back.select("shared", F.sha2(F.col("restored").cast("binary"), 256).alias("text_sha256"), F.col("n_restored").cast("long").alias("n_restored"))


def restore_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded secrets stay placeholders."""
    minted, done = _redacted(spark, sf_dir)
    kept = minted.where("kind = 'email'").select("secret")
    return tokens.restore(done, minted, "doc_id", exclusions=kept).select("doc_id", F.col("n_restored").cast("long").alias("n_restored"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("conv_turn", F.concat_ws("-", "conv_id", "turn"))
    inner = F.to_json(F.struct(F.col("text").alias("note")))
    message = F.struct(F.col("role"), F.col("text").alias("content"), inner.alias("Secret"))
    return rows.select("conv_turn", F.to_json(F.struct(F.lit("m1").alias("model"), F.array(message).alias("messages"))).alias("body"))


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.leaves(_conversations(spark, sf_dir), "conv_turn").select("conv_turn", "leaf_index", "path", "value", "encoded")


def _gate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as JSON, with an address in a member, in JSON within it and below a sensitive name."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("conv_turn", F.concat_ws("-", "conv_id", "turn"))
    mail = F.concat(F.lit("ann"), F.col("turn").cast("string"), F.lit("@corp.com"))
    inner = F.to_json(F.struct(F.concat(F.lit('say "hi" to '), mail).alias("note")))
    return rows.select("conv_turn", F.to_json(F.struct(F.concat("text", F.lit(" "), mail).alias("content"), inner.alias("inner"), F.concat(F.lit("pw "), mail).alias("Password"), F.array(mail, F.col("role")).alias("list"))).alias("body"))


def _request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [d.BUILTIN[1], d.keyword_rule("rude", KEYWORDS, action="warn", scope="both"), d.blocklist_rule(BLOCKED)]
    return requests.evaluated(bodies.walked(_gate_bodies(spark, sf_dir)), rules, sensitive=("password",))


def json_request_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _request(spark, sf_dir)
    return made.select("conv_turn", "action", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join(F.transform("backing", lambda f: F.concat_ws(":", f["leaf_index"], f["start"], f["end"])), ",").alias("spans"))


def json_request_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = requests.redacted(_request(spark, sf_dir), SALT, "conv_turn")
    return done.select("conv_turn", F.sha2("redacted", 256).alias("body_sha256"), F.col("applied").cast("long").alias("applied"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # walked and evaluated once, in tasks of their own: rewriting in the same task would take a second worker beside each
    made = stage(_request(spark, sf_dir).select("conv_turn", "body", "action", "backing"), "decided")
    minted = stage(tokens.vault(requests.secrets_of(made), SALT), "vault")
    done = stage(requests.redacted(made, SALT, "conv_turn"), "redacted")
    back = requests.restored(done.select("conv_turn", F.col("redacted").alias("body")), minted, "conv_turn")
    return back.select("conv_turn", F.sha2("restored", 256).alias("body_sha256"), F.col("n_restored").cast("long").alias("n_restored"))


def response_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event streams, evaluated as responses."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # JSON, JSON with a broken character, and no JSON
    data = F.when(F.col("turn") % 5 == 4, F.unhex(F.lit("7B2261223A22FF227D"))).when(F.col("turn") % 3 == 0, F.to_json(F.struct("role", "text")).cast("binary")).otherwise(F.col("text").cast("binary"))
    rules = [d.keyword_rule("rude", RUDE_TURNS, action="warn", scope="both"), d.keyword_rule("stop", STOP_TURNS, action="block", scope="response"), d.BUILTIN[1]]
    made = requests.response_streams(rows.select(F.col("conv_id").alias("stream_id"), data.alias("data")), rules)
    return made.select("stream_id", "action", F.array_join("rule_ids", ",").alias("rule_ids"), F.col("walk_skips").cast("long").alias("walk_skips"))


def _little(n: Column, size: int) -> Column:
    """Hex of a number, its lowest byte first."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _deflated(raw: Column) -> Column:
    """A body as one stored block of raw deflate, in hex."""
    return F.concat(F.lit("01"), _little(F.octet_length(raw), 2), _little(F.lit(65535) - F.octet_length(raw), 2), F.hex(raw))


def buffered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as responses of every kind: coded, broken, blocked, too long, torn, plain."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("conv_turn", F.concat_ws("-", "conv_id", "turn"))
    mail = F.concat(F.lit('an"n'), F.col("turn").cast("string"), F.lit("@corp.com"))
    name = tokens.spelled(F.lit("email"), tokens.digest(SALT, F.lit("email"), mail))
    minted = rows.select(mail.alias("secret"), name.alias("placeholder")).distinct()
    kind = F.conv(F.substring(_md5("conv_turn"), 1, 2), 16, 10).cast("int") % 9
    text = F.concat("text", F.lit(" "), name)
    document = F.to_json(F.struct("role", text.alias("t"))).cast("binary")
    gzip = F.concat(F.lit("1F8B0800000000000003"), _deflated(document), _little(F.crc32(document), 4), _little(F.octet_length(document), 4))
    coded = F.when(kind == 1, gzip).when(kind == 2, _deflated(document)).when(kind == 3, F.concat(F.lit("1F8B08"), F.hex(document)))
    body = (F.when(kind.between(1, 3), F.unhex(coded)).when(kind == 5, F.encode(text, "UTF-8")).when(kind == 6, F.concat(F.lit(b'{"a":"\xff'), name.cast("binary"), F.lit(b'"}')))
            .when(kind == 7, F.to_json(F.struct(F.lit("zz stop").alias("t"))).cast("binary")).otherwise(document))
    header = F.when(kind == 1, " X-GZIP ").when(kind == 2, "identity, deflate").when(kind == 3, "gzip").when(kind == 4, "br")
    rules = [d.keyword_rule("rude", RUDE_TURNS, action="warn", scope="both"), d.keyword_rule("stop", ("ZZ",), action="block", scope="response"), d.BUILTIN[1]]
    made = responses.buffered(rows.select("conv_turn", F.lit(200).alias("status"), body.alias("body"), header.alias("content_encoding")), minted, "conv_turn", rules, cap=600)
    return made.select("conv_turn", "status", F.sha2("body", 256).alias("body_sha256"), "error", "rule_id", F.array_join("warnings", ",").alias("warnings"), F.col("walk_skip").cast("long").alias("walk_skip"), F.col("n_restored").cast("long").alias("n_restored"))


def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = bodies.leaves(_conversations(spark, sf_dir), "conv_turn")
    return policy.sensitive_keys(leaves, ["NOTE", "role"]).select("conv_turn", "path", F.col("end").cast("int").alias("n_bytes"), "rule_id")


def route_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return policy.routes(pages.select("page_id", route(path).alias("path")), ROUTES)


def body_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.when(F.col("page_id") % 3 == 0, "Application/JSON; charset=utf-8").when(F.col("page_id") % 3 == 1, "text/html")
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" {"), "html")).otherwise(F.col("html"))
    rows = pages.select("page_id", kind.alias("kind"), body.alias("body"))
    return rows.select("page_id", bodies.declares_json(F.col("kind"), F.col("body")).alias("is_json"), bodies.within_cap(F.col("body").cast("binary"), 1500).alias("within_cap"))


def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.regexp_replace("text", "[\r\n]+", " ")
    record = F.concat(F.lit(": note\r\nevent: turn\r\ndata: "), text, F.lit("\ndata:"), F.col("turn").cast("string"), F.lit("\r\n\r\n"))
    half = (F.octet_length(record) / 2).cast("int")
    raw = record.cast("binary")
    parts = F.array(F.substring(raw, F.lit(1), half), F.substring(raw, half + 1, F.octet_length(raw)))
    chunks = rows.select(F.col("conv_id").alias("stream_id"), "turn", F.posexplode(parts).alias("part", "chunk"))
    return sse.events(chunks.withColumn("seq", F.col("turn") * 2 + F.col("part"))).select("stream_id", "nth", "event", "data")


def sse_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event streams in which a placeholder is split over two events, a foreign one stays."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mail = F.concat(F.lit("ann"), F.col("turn").cast("string"), F.lit("@corp.com"))
    name = tokens.spelled(F.lit("email"), tokens.digest(SALT, F.lit("email"), mail))
    cut = F.col("turn") % 20 + 3
    data = lambda text: F.concat(F.lit("data: "), F.to_json(F.struct(F.col("turn").alias("n"), text.alias("t"))), F.lit("\n\n"))
    text = F.concat(data(F.concat("text", F.lit(" "), F.left(name, cut))), F.lit(": ping\n\n"), data(F.concat(F.substring(name, cut + 1, F.lit(100)), F.lit(" __PII_email_ffffffffffff__"))))
    streams = rows.groupBy(F.col("conv_id").alias("stream_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda r: r["x"]), "").alias("body"))
    minted = rows.select(mail.alias("secret"), name.alias("placeholder")).distinct()
    done = events.restored_streams(streams, minted)
    return done.select("stream_id", F.sha2("restored", 256).alias("body_sha256"), F.col("n_restored").cast("long").alias("n_restored"))


def restored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored occurrences: how often each planted key's placeholder stands in the redacted texts."""
    minted, done = _redacted(spark, sf_dir)
    hits = done.select(F.explode(F.regexp_extract_all("redacted", F.lit(f"({tokens.TOKEN})"), F.lit(0))).alias("placeholder"))
    return hits.join(minted, "placeholder").groupBy("kind", "secret").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    findings_email, findings_luhn, findings_prefix_planted, findings_jwt_planted, findings_pem_planted, findings_entropy_planted, regex_rule, regex_rules, keyword_rule, keyword_pack, guarded_rules, blocklist, allowlist_suppression,
    findings_all_ordered, decision_by_doc, counters, status_document, refusal_documents, restore_log, redaction_log, audit_log, budget_cut, budget_report, findings_cube, mask_findings, vault_distinct, vault_second_run, redaction_lengths,
    redact_roundtrip, restore_shared_keys, restore_exclusions, restored_counts, json_leaves, sensitive_keys, json_request_decisions, json_request_redacted, json_roundtrip, response_streams, buffered_responses, sse_restored, route_longest_prefix, body_gate, sse_decode)}


def _matches(name: str, source: str, pattern: str) -> str:
    """CTEs that give ``name`` (id, x, s, e, v): the matches of a pattern in source (id, x), in bytes."""
    return f"""{name}_m AS (SELECT id, x, regexp_extract_all(x, '({pattern})', 0) AS v, regexp_split_to_array(x, '{pattern}') AS g FROM {source}),
        {name}_u AS (SELECT id, x, unnest(v) AS v, unnest(g[1:len(v)]) AS g, generate_subscripts(v, 1) AS i FROM {name}_m WHERE len(v) > 0),
        {name} AS (SELECT id, x, CAST(e - strlen(v) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, v FROM (SELECT id, x, v, sum(strlen(g) + strlen(v)) OVER (PARTITION BY id ORDER BY i) AS e FROM {name}_u))"""


def _luhn(digits: str) -> str:
    each = f"list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INTEGER) ELSE (2 * CAST(substr(reverse({digits}), i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse({digits}), i, 1) AS INTEGER)) % 10 END)"
    return f"len({digits}) BETWEEN 13 AND 19 AND replace({digits}, substr({digits}, 1, 1), '') <> '' AND list_sum({each}) % 10 = 0"


_SUFFIX_LIST = "[" + ", ".join(f"'{s}'" for s in d.EMAIL_SUFFIXES) + "]"
_SOURCE = "src AS (SELECT doc_id AS id, text AS x FROM documents)"
_KEYED = f"src AS (SELECT doc_id AS id, {PLANTED_KEY[1]} AS x FROM documents)"
_OUT = "SELECT id AS doc_id, s AS span_start, e AS span_end, v AS value FROM"


def _email(source: str = "src") -> str:
    return _matches("em", source, d.EMAIL) + f""",
        email AS (SELECT id, x, s, e, v FROM em WHERE NOT contains(v, '..') AND len(list_filter({_SUFFIX_LIST}, lambda t: ends_with('.' || lower(split_part(v, '@', 2)), t))) > 0)"""


def _cards(source: str = "src") -> str:
    return _matches("cr", source, d.CARD_RUN) + f""",
        card AS (SELECT id, x, s, s + CAST(strlen(v) AS INTEGER) AS e, v FROM (SELECT id, x, s, rtrim(v, ' -') AS v, replace(replace(v, ' ', ''), '-', '') AS n FROM cr) WHERE {_luhn('n')})"""


def _keys(source: str = "src") -> str:
    return _matches("kr", source, d.KEY_RUN) + f", pk AS (SELECT id, x, s, e, v FROM kr WHERE regexp_full_match(v, '{d.KEY_SHAPES}'))"


def _jwts(source: str = "src") -> str:
    header = "TRY(decode(from_base64(rpad(h, CAST(ceil(len(h) / 4.0) * 4 AS INTEGER), '='))))"
    return _matches("jr", source, d.JWT_RUN) + f""",
        jw AS (SELECT id, x, s, e, v FROM (SELECT *, {header} AS j FROM (SELECT *, rtrim(translate(split_part(v, '.', 1), '-_', '+/'), '=') AS h FROM jr WHERE regexp_full_match(v, '{d.JWT}')))
               WHERE json_valid(j) AND json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'alg'))"""


def _pems(source: str = "src") -> str:
    return _matches("ph", source, d.PEM_HEAD) + """,
        pe AS (SELECT id, x, s, e, f, instr(t, f) AS p, t FROM (SELECT *, replace(v, 'BEGIN', 'END') AS f, substr(x, len(decode(encode(x)[1:e])) + 1) AS t FROM ph))"""


def _words(name: str, source: str, words: tuple[str, ...], fold: bool) -> str:
    made = []
    for i, w in enumerate(words):
        pattern = "".join(f"[{c}{c.upper()}]" for c in w) if fold else w
        made.append(_matches(f"{name}{i}", source, pattern))
    return ", ".join(made) + f", {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(len(words))) + ")"


def _every() -> str:
    """all findings of the rules of _rules() in planted texts: id, s, e, v, rule_id, category, action, rank."""
    rules = sorted(_rules(), key=lambda r: (r.priority, r.id))
    rank = {r.id: i for i, r in enumerate(rules)}
    rows = [("pk", "prefix", "api_key", "redact"), ("email", "email", "email", "redact"), ("card", "luhn", "credit_card", "redact"), ("rude", "rude", "custom", "warn"), ("bl", "blocklist", "custom", "block")]
    union = " UNION ALL ".join(f"SELECT id, s, e, v, '{r}' AS rule_id, '{c}' AS category, '{a}' AS action, {rank[r]} AS rk FROM {t}" for t, r, c, a in rows)
    return f"{_KEYED}, {_keys()}, {_email()}, {_cards()}, {_words('rude', 'src', KEYWORDS, True)}, {_words('bl', 'src', BLOCKED, False)}, f AS ({union})"


def _builtin() -> str:
    union = " UNION ALL ".join(f"SELECT id, s, e, v, '{r}' AS rule_id, '{c}' AS category FROM {t}" for t, r, c in (("pk", "prefix", "api_key"), ("email", "email", "email"), ("card", "luhn", "credit_card")))
    return f"{_KEYED}, {_keys()}, {_email()}, {_cards()}, f AS ({union})"


def _hmac(message: str) -> str:
    pads = ["".join(f"{b ^ x:02x}" for b in SALT.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || {message})))"


_VAULT = f"""vault AS (SELECT kind, secret, '__PII_' || kind || '_' || left({_hmac("encode(kind) || unhex('00') || encode(secret)")}, 12) || '__' AS placeholder
    FROM (SELECT DISTINCT category AS kind, v AS secret FROM f))"""
_DECIDED = f"""WITH {_every()}, top AS (SELECT id, max(CASE action WHEN 'warn' THEN 1 WHEN 'redact' THEN 2 WHEN 'block' THEN 3 ELSE 0 END) AS t FROM f GROUP BY id),
    lst AS (SELECT f.id, count(*) AS n, string_agg(rule_id, ',' ORDER BY s, e, rk) AS ids FROM f JOIN top USING (id) WHERE CASE action WHEN 'warn' THEN 1 WHEN 'redact' THEN 2 WHEN 'block' THEN 3 ELSE 0 END = t GROUP BY f.id),
    dec AS (SELECT src.id AS doc_id, ['allow', 'warn', 'redact', 'block'][coalesce(t, 0) + 1] AS action, coalesce(n, 0) AS n_findings, coalesce(ids, '') AS rule_ids FROM src LEFT JOIN top USING (id) LEFT JOIN lst USING (id))"""
_LEAVES = """conv AS (SELECT conv_id || '-' || turn AS conv_turn, role, text FROM conversations),
    lv AS (SELECT conv_turn, 0 AS leaf_index, '/model' AS path, 'm1' AS value, false AS encoded FROM conv
        UNION ALL SELECT conv_turn, 1, '/messages/0/role', role, false FROM conv
        UNION ALL SELECT conv_turn, 2, '/messages/0/content', text, false FROM conv
        UNION ALL SELECT conv_turn, 3, '/messages/0/Secret/note', text, true FROM conv)"""

def _placeholder(kind: str, secret: str) -> str:
    message = f"encode('{kind}') || unhex('00') || encode({secret})"
    return f"'__PII_{kind}_' || left({_hmac(message)}, 12) || '__'"


_GATE = f"""src AS (SELECT conv_id || '-' || turn AS id, text || ' ann' || turn || '@corp.com' AS x, text AS t, 'ann' || turn || '@corp.com' AS mail, role FROM conversations),
    {_words('bl', 'src', BLOCKED, False)}, blk AS (SELECT id, string_agg('blocklist', ',') AS ids, string_agg('0:' || s || ':' || e, ',' ORDER BY s, e) AS spans FROM bl GROUP BY id),
    g AS (SELECT src.*, {_placeholder('email', 'mail')} AS ph, {_placeholder('custom', "'pw ' || mail")} AS pw, blk.ids, blk.spans FROM src LEFT JOIN blk USING (id))"""


def _gate_body(mail: str, password: str) -> str:
    inner = f"""'{{"note":' || to_json('say "hi" to ' || {mail}) || '}}'"""
    return f"""'{{"content":' || to_json(t || ' ' || {mail}) || ',"inner":' || to_json({inner}) || ',"Password":' || to_json({password}) || ',"list":[' || to_json({mail}) || ',' || to_json(role) || ']}}'"""


_COUNTERS = f"""{_DECIDED}, kept AS (SELECT id, list_reduce(list({{'s': s, 'e': e, 'n': 0}} ORDER BY s, e, rk), lambda acc, x: CASE WHEN x.s >= acc.e THEN {{'s': x.s, 'e': x.e, 'n': acc.n + 1}} ELSE acc END, {{'s': 0, 'e': 0, 'n': 0}}).n AS n
            FROM f JOIN top USING (id) WHERE t = 2 AND action = 'redact' GROUP BY id)
        SELECT (SELECT count(*) FROM dec) AS requests, CAST((SELECT coalesce(sum(n), 0) FROM kept) AS BIGINT) AS redactions, (SELECT count(*) FROM dec WHERE action = 'block') AS content_policy_blocks,
               (SELECT count(*) FROM dec WHERE action = 'block') AS rule_blocks, CAST(0 AS BIGINT) AS walk_skips"""

def _responses() -> str:
    coded, plain = (f"""'{{"role":' || to_json(role) || ',"t":' || to_json(text || ' ' || {x}) || '}}'""" for x in ("ph", "mail"))
    gzip, deflate = 10 + 5 + 8, 5
    return f"""WITH r AS (SELECT conv_id || '-' || turn AS conv_turn, role, text, 'an"n' || turn || '@corp.com' AS mail, {_placeholder('email', "('an' || chr(34) || 'n' || turn || '@corp.com')")} AS ph FROM conversations),
        q AS (SELECT *, CAST('0x' || substr(md5(conv_turn), 1, 2) AS INTEGER) % 9 AS kind, {coded} AS coded, {plain} AS plain FROM r),
        s AS (SELECT *, CASE kind WHEN 1 THEN strlen(coded) + {gzip} WHEN 2 THEN strlen(coded) + {deflate} WHEN 3 THEN strlen(coded) + 3 WHEN 5 THEN strlen(text || ' ' || ph) WHEN 6 THEN strlen(ph) + 9 WHEN 7 THEN 15 ELSE strlen(coded) END AS size FROM q),
        e AS (SELECT *, CASE WHEN size > 600 THEN 'bad_gateway' WHEN kind IN (3, 4) THEN 'undecodable_content_encoding' WHEN kind = 7 OR kind NOT IN (5, 6) AND (contains(lower(coded), 'zz')) THEN 'rule_blocked' END AS error FROM s)
        SELECT conv_turn, CASE WHEN error IS NULL THEN 200 ELSE 502 END AS status,
               CASE WHEN error = 'rule_blocked' THEN sha256('{{"error":"rule_blocked","rule_id":"stop"}}') WHEN error IS NOT NULL THEN sha256('{{"error":"' || error || '"}}')
                    WHEN kind = 5 THEN sha256(text || ' ' || mail) WHEN kind = 6 THEN sha256(unhex('7B2261223A22FF') || encode(mail) || unhex('227D')) ELSE sha256(plain) END AS body_sha256,
               error, CASE WHEN error = 'rule_blocked' THEN 'stop' END AS rule_id, CASE WHEN error IS NULL AND kind NOT IN (5, 6) AND (contains(lower(role), 'the') OR contains(lower(text), 'the')) THEN 'rude' ELSE '' END AS warnings,
               CAST(CASE WHEN error IS NULL AND kind = 6 THEN 1 ELSE 0 END AS BIGINT) AS walk_skip, CAST(CASE WHEN error IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_restored FROM e"""


def _regexes() -> str:
    each = " UNION ALL ".join(f"SELECT id, '{k}' AS rule_id, regexp_extract_all(x, '(?-s){p}') AS v FROM src" for k, p in REGEXES)
    return f"WITH {_SOURCE}, m AS ({each}) SELECT id AS doc_id, rule_id, generate_subscripts(v, 1) - 1 AS nth, unnest(v) AS value FROM m"


def _literals() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH {_SOURCE}, s AS (SELECT {list(SYLLABLES)} AS l), w AS (SELECT i // 64 AS rule, l[2 * (i // 64) + (i % 64) // 32 + 1] || l[i % 32 + 1] AS w FROM s, (SELECT unnest(range(1024)) AS i)),
        y AS (SELECT id, x, translate(x, '{upper}', '{lower}') AS y FROM src),
        h AS (SELECT id, x, rule, w, string_split(CASE WHEN rule % 2 = 0 THEN y ELSE x END, w) AS g FROM y JOIN w ON contains(CASE WHEN rule % 2 = 0 THEN y ELSE x END, w)),
        u AS (SELECT id, x, rule, w, unnest(g[1:len(g) - 1]) AS g, generate_subscripts(g[1:len(g) - 1], 1) AS i FROM h),
        e AS (SELECT id, rule, w, i, CAST(sum(strlen(g) + 4) OVER (PARTITION BY id, rule, w ORDER BY i) AS BIGINT) AS e, sum(len(g) + 4) OVER (PARTITION BY id, rule, w ORDER BY i) AS c, x FROM u)
        SELECT id AS doc_id, 'r' || lpad(CAST(rule AS VARCHAR), 2, '0') AS rule_id, count(*) AS n, CAST(sum(e - 4) AS BIGINT) AS sum_start, CAST(max(e) AS INTEGER) AS last_end, count(DISTINCT substr(x, CAST(c - 3 AS BIGINT), 4)) AS n_values FROM e GROUP BY id, rule"""


ORACLE_SQL: dict[str, str] = {
    "regex_rules": _regexes(),
    "guarded_rules": f"""WITH {_SOURCE}, {_email()}, {_words('rude', 'src', KEYWORDS, True)}, m AS (SELECT DISTINCT id FROM email), u AS (SELECT DISTINCT id FROM rude),
        g AS (SELECT src.id, CASE WHEN starts_with(x, 'A') THEN 'panic' WHEN starts_with(x, 'L') THEN 'error' WHEN starts_with(x, 'E') THEN 'malformed' WHEN len(x) - len(replace(x, 'e', '')) > 1000 THEN 'budget' END AS refusal,
            (len(x) - len(replace(x, 'que', ''))) // 3 AS n, m.id IS NOT NULL AS mail, u.id IS NOT NULL AS rude FROM src LEFT JOIN m USING (id) LEFT JOIN u USING (id))
        SELECT id AS doc_id, CASE WHEN refusal IS NOT NULL THEN 'block' WHEN mail THEN 'redact' WHEN n > 0 OR rude THEN 'warn' ELSE 'allow' END AS action, refusal,
               CASE WHEN refusal IS NOT NULL OR mail THEN 0 ELSE n END AS own, CASE WHEN refusal IS NOT NULL THEN '{{"error":"plugin_failure","reason":"' || refusal || '"}}' END AS body FROM g""",
    "keyword_pack": _literals(),
    "restore_shared_keys": f"WITH {_builtin()}, ed AS (SELECT id, count(*) AS n FROM f GROUP BY id) SELECT nullif(src.id % 7, 0) AS shared, sha256(x) AS text_sha256, coalesce(n, 0) AS n_restored FROM src LEFT JOIN ed USING (id)",
    "findings_email": f"WITH {_SOURCE}, {_email()} {_OUT} email",
    "findings_luhn": f"WITH {_SOURCE}, {_cards()} {_OUT} card",
    "findings_prefix_planted": f"WITH {_KEYED}, {_keys()} {_OUT} pk",
    "findings_jwt_planted": f"WITH src AS (SELECT doc_id AS id, {PLANTED_JWT[1]} AS x FROM documents), {_jwts()} {_OUT} jw",
    "findings_pem_planted": f"""WITH src AS (SELECT doc_id AS id, {PLANTED_PEM[1]} AS x FROM documents), {_pems()}
        SELECT id AS doc_id, s AS span_start, CAST(CASE WHEN p > 0 THEN e + strlen(substr(t, 1, p - 1)) + strlen(f) ELSE strlen(x) END AS INTEGER) AS span_end,
               CASE WHEN p > 0 THEN replace(f, 'END', 'BEGIN') || substr(t, 1, p - 1 + len(f)) ELSE replace(f, 'END', 'BEGIN') || t END AS value FROM pe""",
    "findings_entropy_planted": f"""WITH src AS (SELECT doc_id AS id, {PLANTED_RANDOM[1]} AS x FROM documents), {_matches("er", "src", d.ENTROPY_RUN)}
        {_OUT} er WHERE len(v) >= {d.ENTROPY_LENGTH} AND NOT regexp_full_match(v, '[0-9a-fA-F-]+')
          AND log2(len(v)) - list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (len(v) - len(replace(v, c, ''))) * log2(len(v) - len(replace(v, c, ''))))) / len(v) >= {d.ENTROPY_BITS}""",
    "regex_rule": f"WITH {_SOURCE}, {_matches('r', 'src', '[0-9]{3}[- ][0-9]{4}')} {_OUT} r",
    "keyword_rule": f"WITH {_SOURCE}, {_words('rude', 'src', KEYWORDS, True)} {_OUT} rude",
    "blocklist": f"WITH {_SOURCE}, {_words('bl', 'src', BLOCKED, False)} {_OUT} bl",
    "allowlist_suppression": f"WITH {_SOURCE}, {_email()} {_OUT} email WHERE NOT ({' OR '.join(f'contains({chr(39)}{w}{chr(39)}, v)' for w in KEYWORDS + ALLOWED)})",
    "findings_all_ordered": f"""WITH {_every()} SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY s, e, rk, rule_id) AS INTEGER) AS nth,
        s AS span_start, e AS span_end, v AS value, rule_id, category, action FROM f""",
    "decision_by_doc": f"{_DECIDED} SELECT * FROM dec",
    "counters": _COUNTERS,
    "status_document": f"""SELECT '{{"requests":' || requests || ',"redactions":' || redactions || ',"content_policy_blocks":' || content_policy_blocks || ',"rule_blocks":' || rule_blocks || ',"walk_skips":' || walk_skips || '}}' AS status FROM ({_COUNTERS})""",
    "restore_log": f"WITH {_builtin()} SELECT id AS doc_id, count(*) AS placeholders FROM f GROUP BY id",
    "refusal_documents": f"""{_DECIDED} SELECT doc_id, 403 AS status, '{{"error":"rule_blocked","rule_id":"' || split_part(rule_ids, ',', 1) || '"}}' AS body FROM dec WHERE action = 'block'""",
    "redaction_log": f"""{_DECIDED} SELECT f.id AS doc_id, row_number() OVER (PARTITION BY f.id ORDER BY s, e, rk) - 1 AS nth, category, CAST(e - s AS BIGINT) AS n_bytes,
        CASE category WHEN 'api_key' THEN left(v, 4) || '…' || right(v, 2) WHEN 'email' THEN '****@' || split_part(v, '@', 2) ELSE '****' END AS masked FROM f JOIN top USING (id) WHERE t = 2 AND action = 'redact'""",
    "audit_log": f"""{_DECIDED}, al AS (SELECT f.id, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
            FROM f JOIN top USING (id) WHERE CASE action WHEN 'warn' THEN 1 WHEN 'redact' THEN 2 WHEN 'block' THEN 3 ELSE 0 END = t GROUP BY f.id)
        SELECT doc_id, 'request' AS phase, action, coalesce(rules, '') AS rules, coalesce(categories, '') AS categories FROM dec LEFT JOIN al ON id = doc_id""",
    "budget_cut": f"""WITH whole AS (SELECT doc_id AS id, text AS x FROM documents),
        src AS (SELECT id, coalesce(TRY(decode(encode(x)[1:{BUDGET}])), TRY(decode(encode(x)[1:{BUDGET - 1}])), TRY(decode(encode(x)[1:{BUDGET - 2}])), TRY(decode(encode(x)[1:{BUDGET - 3}]))) AS x FROM whole),
        {_email()}, {_words('rude', 'whole', KEYWORDS, True)}
        SELECT id AS doc_id, s AS span_start, v AS value, 'email' AS rule_id FROM email UNION ALL SELECT id, s, v, 'rude' FROM rude""",
    "budget_report": f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS longest FROM documents WHERE strlen(text) > {BUDGET}",
    "findings_cube": f"WITH {_every()} SELECT lang, category, count(*) AS n, count(DISTINCT v) AS n_values FROM f JOIN documents ON id = doc_id GROUP BY CUBE (lang, category)",
    "mask_findings": f"""WITH {_builtin()} SELECT id AS doc_id, s AS span_start, rule_id,
        CASE category WHEN 'api_key' THEN left(v, 4) || '…' || right(v, 2) WHEN 'email' THEN '****@' || split_part(v, '@', 2) ELSE '****' END AS masked FROM f""",
    "vault_distinct": f"WITH {_builtin()}, {_VAULT} SELECT * FROM vault",
    "vault_second_run": f"""WITH {_builtin()}, {_VAULT}, early AS (SELECT DISTINCT category AS kind, v AS secret FROM f WHERE id % 2 = 0)
        SELECT kind, secret, CASE WHEN early.secret IS NULL THEN placeholder ELSE '__PII_' || kind || '_' || left({_hmac("encode(kind) || unhex('00') || encode(secret)")}, 16) || '__' END AS placeholder FROM vault LEFT JOIN early USING (kind, secret)""",
    "restore_exclusions": f"WITH {_builtin()}, ed AS (SELECT id, count(*) AS n FROM f WHERE category <> 'email' GROUP BY id) SELECT src.id AS doc_id, coalesce(n, 0) AS n_restored FROM src LEFT JOIN ed USING (id)",
    "redaction_lengths": f"""WITH {_builtin()}, {_VAULT}, ed AS (SELECT id, sum(strlen(placeholder) - strlen(v)) AS more, count(*) AS n FROM f JOIN vault ON kind = category AND secret = v GROUP BY id)
        SELECT src.id AS doc_id, CAST(strlen(x) + coalesce(more, 0) AS BIGINT) AS n_bytes, coalesce(n, 0) AS applied FROM src LEFT JOIN ed USING (id)""",
    "redact_roundtrip": f"WITH {_builtin()}, ed AS (SELECT id, count(*) AS n FROM f GROUP BY id) SELECT src.id AS doc_id, sha256(x) AS text_sha256, coalesce(n, 0) AS n_restored FROM src LEFT JOIN ed USING (id)",
    "restored_counts": f"WITH {_builtin()} SELECT category AS kind, v AS secret, count(*) AS n FROM f GROUP BY category, v",
    "json_leaves": f"WITH {_LEAVES} SELECT * FROM lv",
    "sensitive_keys": f"WITH {_LEAVES} SELECT conv_turn, path, CAST(strlen(value) AS INTEGER) AS n_bytes, 'sensitive_key' AS rule_id FROM lv WHERE (path LIKE '%/note' OR path LIKE '%/role') AND value <> ''",
    "json_request_decisions": f"""WITH {_GATE} SELECT id AS conv_turn, CASE WHEN ids IS NULL THEN 'redact' ELSE 'block' END AS action, coalesce(ids, 'email,email,sensitive_key,email') AS rule_ids,
        coalesce(spans, '0:' || (strlen(t) + 1) || ':' || (strlen(t) + 1 + strlen(mail)) || ',1:12:' || (12 + strlen(mail)) || ',2:0:' || (3 + strlen(mail)) || ',3:0:' || strlen(mail)) AS spans FROM g""",
    "json_request_redacted": f"""WITH {_GATE} SELECT id AS conv_turn, sha256(CASE WHEN ids IS NULL THEN {_gate_body('ph', 'pw')} ELSE {_gate_body('mail', "'pw ' || mail")} END) AS body_sha256,
        CAST(CASE WHEN ids IS NULL THEN 4 ELSE 0 END AS BIGINT) AS applied FROM g""",
    "json_roundtrip": f"""WITH {_GATE} SELECT id AS conv_turn, sha256({_gate_body('mail', "'pw ' || mail")}) AS body_sha256, CAST(CASE WHEN ids IS NULL THEN 4 ELSE 0 END AS BIGINT) AS n_restored FROM g""",
    "response_streams": f"""WITH e AS (SELECT conv_id, {' OR '.join(f"contains(lower(role), '{w}') OR contains(lower(text), '{w}')" for w in STOP_TURNS)} AS stop, {' OR '.join(f"contains(lower(role), '{w}') OR contains(lower(text), '{w}')" for w in RUDE_TURNS)} AS rude, turn % 3 = 0 AND turn % 5 <> 4 AS j, turn % 5 = 4 AS torn FROM conversations),
        a AS (SELECT conv_id, bool_or(j AND stop) AS stop, bool_or(j AND rude) AS rude, count(*) FILTER (torn) AS walk_skips FROM e GROUP BY conv_id)
        SELECT conv_id AS stream_id, CASE WHEN stop THEN 'block' WHEN rude THEN 'warn' ELSE 'allow' END AS action, CASE WHEN stop THEN 'stop' WHEN rude THEN 'rude' ELSE '' END AS rule_ids, walk_skips FROM a""",
    "buffered_responses": _responses(),
    "sse_restored": """WITH e AS (SELECT conv_id, turn, 'data: {"n":' || turn || ',"t":' || to_json(text || ' ') || '}' || chr(10) || chr(10) || ': ping' || chr(10) || chr(10)
            || 'data: {"n":' || turn || ',"t":' || to_json('ann' || turn || '@corp.com __PII_email_ffffffffffff__') || '}' || chr(10) || chr(10) AS x FROM conversations)
        SELECT conv_id AS stream_id, sha256(string_agg(x, '' ORDER BY turn, x)) AS body_sha256, count(*) AS n_restored FROM e GROUP BY conv_id""",
    "route_longest_prefix": """WITH p AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/') AS q FROM pages), r AS (SELECT page_id, CASE WHEN q = '' THEN '/' ELSE q END AS path FROM p)
        SELECT page_id, path, CASE WHEN path = '/fr/8' OR starts_with(path, '/fr/8/') THEN 'eight' WHEN path = '/en/1' OR starts_with(path, '/en/1/') THEN 'one'
            WHEN path = '/en' OR starts_with(path, '/en/') THEN 'english' WHEN path = '/fr' OR starts_with(path, '/fr/') THEN 'french' ELSE 'root' END AS target FROM r""",
    "body_gate": """WITH b AS (SELECT page_id, page_id % 3 AS k, CASE WHEN page_id % 2 = 0 THEN ' {' || html ELSE html END AS body FROM pages)
        SELECT page_id, CASE k WHEN 0 THEN true WHEN 1 THEN false ELSE regexp_matches(body, '^[ \\t\\r\\n]*[{\\["]') END AS is_json, strlen(body) <= 1500 AS within_cap FROM b""",
    "sse_decode": """SELECT conv_id AS stream_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS nth, 'turn' AS event,
        regexp_replace(text, '[\\r\\n]+', ' ', 'g') || chr(10) || turn AS data FROM conversations""",
}
