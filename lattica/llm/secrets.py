"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong spans (fixed base kinds) are found by pattern: ``assign``, ``access`` and ``hex``. Three weak kinds are only
candidates: ``id`` (user names, client ids), ``weak`` (short or loosely named secrets) and ``endpoint`` (URLs and host
addresses). Parts play a role: access and id spans are identifiers; assign, hex and weak spans are secrets. Parts of a
document are interval-joined within a scope of ``scope`` code points between their starts, by an equi-join on
document, bucket of start and role in which each bucket is summed up by its first and last start, so that the work
is linear in the parts. A weak secret is reported when an identifier is in its scope, an id when a secret is, and an
endpoint when both are.

Defined results: a null text is an empty one and has no span; a null doc_id keeps its row; repeated rows are scanned
one by one and give equal rows; extra columns are kept, but for ``base_spans`` and ``secret_spans`` of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import cut, table


def _either(word: str) -> str:
    """The word with its ASCII letters in either case, as character classes: the same in every regex dialect."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in word)


def _named(*words: str) -> str:
    return "(?:" + "|".join(_either(w) for w in words) + ")"


SIGN = """["']?\\x20*[:=]\\x20*["']?"""
#: kind -> pattern and least lengths of the whole match and of the value group (0: no group).
STRONG = {
    "assign": (_named("password", "passwd", "secret", "token", "api_?key") + SIGN + "([A-Za-z0-9+/_.=-]+)", 0, 8),
    "access": ("AKIA[A-Z0-9]+", 16, 0),
    "hex": ("[0-9a-f]{32,}", 32, 0),
}
WEAK = {
    "id": (_named("user_?name", "user", "login", "client_?id", "access_?key_?id", "account_?id") + SIGN + "([A-Za-z0-9@._-]+)", 0, 3),
    "weak": (_named("pwd", "passphrase", "private_?key", "credentials?", "auth_?key", "access_?key", "password", "passwd", "secret", "token", "api_?key") + SIGN + "([A-Za-z0-9+/_.=!@#$%&*-]+)", 0, 4),
    "endpoint": ("(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[A-Za-z0-9./:@_?&=%-]+", 10, 0),
}
KINDS = [*STRONG, *WEAK]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "id"), ("assign", "hex", "weak"), ("endpoint",)
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def find_spans(text: Column, kind: str, pattern: str, least: int, least_value: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; failing matches drop out afterwards."""
    empty = F.expr(f"cast(array() as {SPAN})")
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least_value else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["gap"])
        stop = begin + F.coalesce(F.length(p["hit"]), F.lit(0))
        keep = F.coalesce((F.length(p["hit"]) >= least) & (F.length(p["value"]) >= least_value), F.lit(False))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(keep, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["spans"]).otherwise(empty)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _scan(docs: DataFrame) -> DataFrame:
    """Adds the strong spans and whether a weak pattern occurs at all."""
    strong = F.concat(*[find_spans(_text(), k, *v) for k, v in STRONG.items()])
    hint = "|".join(v[0] for v in WEAK.values())
    return docs.withColumn("__strong", F.array_sort(strong)).withColumn("__hint", _text().rlike(hint))


def _link(hinted: DataFrame, scope: int) -> DataFrame:
    """``(__a, __b, __linked)``: for each document the weak spans whose complementary parts lie in scope."""
    parts = hinted.select("__a", "__b", F.explode(F.concat("__strong", "__weak")).alias("s")).distinct()
    role = F.when(F.col("s.kind").isin([KINDS.index(k) for k in IDENTIFIERS]), 0).when(F.col("s.kind").isin([KINDS.index(k) for k in SECRETS]), 1).otherwise(2)
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("s.start") / scope))
    sums = parts.where("role < 2").groupBy("__a", "__b", "bucket", "role").agg(F.min("s.start").alias("first"), F.max("s.start").alias("last"))
    probes = parts.where(F.col("s.kind") >= len(STRONG))
    needs = F.when(F.col("role") == 0, F.array(F.lit(1))).when(F.col("role") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    probes = probes.withColumn("n_needs", F.size(needs)).withColumn("need", F.explode(needs)).withColumn("near", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    probes = probes.select("__a", "__b", "s", "n_needs", "need", "near", (F.col("bucket") + F.col("near")).alias("bucket"))
    sums = sums.withColumnRenamed("role", "need")
    met = probes.join(sums, ["__a", "__b", "bucket", "need"]).where(
        ((F.col("near") == 0)) | ((F.col("near") < 0) & (F.col("last") >= F.col("s.start") - scope)) | ((F.col("near") > 0) & (F.col("first") <= F.col("s.start") + scope))
    )
    met = met.groupBy("__a", "__b", "s").agg(F.countDistinct("need").alias("n"), F.first("n_needs").alias("n_needs")).where("n = n_needs")
    return met.groupBy("__a", "__b").agg(F.array_sort(F.collect_list("s")).alias("__linked"))


def scan_secrets(docs: DataFrame, scope: int = 400) -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: sorted arrays of (start, kind, stop), kinds as in ``KINDS``."""
    seen = _scan(docs)
    plain = seen.where(~F.col("__hint")).withColumn("__linked", F.expr(f"cast(array() as {SPAN})"))
    weak = F.concat(*[find_spans(_text(), k, *v) for k, v in WEAK.items()])
    apart = F.filter(weak, lambda w: ~F.exists("__strong", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"])))
    hinted = seen.where("__hint").withColumn("__weak", apart)
    hinted = cut(hinted.withColumn("__a", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__b", F.xxhash64("text")))
    linked = hinted.join(_link(hinted, scope), ["__a", "__b"], "left").withColumn("__linked", F.coalesce("__linked", F.expr(f"cast(array() as {SPAN})")))
    both = plain.unionByName(linked.select(*plain.columns))
    both = both.withColumn("base_spans", F.col("__strong")).withColumn("secret_spans", F.array_sort(F.concat("__strong", "__linked")))
    return both.drop("__strong", "__hint", "__linked")


def redact(docs: DataFrame, scope: int = 400, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask`` and ``n_chars``, where present, brought up to date."""
    found = scan_secrets(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row")), scope)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("secret_spans", start, step)
    text = F.when(F.size("secret_spans") == 0, F.col("text")).otherwise(F.concat(done["out"], F.substr(F.col("text"), done["at"] + 1)))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("secret_spans") == 0, F.col("__row.n_chars")).otherwise(F.length(text).cast("long"))
    return found.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document, base kinds apart."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in STRONG], F.sha2(_written("base_spans"), 256).alias("base_sha256"), _written("secret_spans").alias("spans")
    )
