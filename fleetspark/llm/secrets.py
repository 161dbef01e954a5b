"""Secret scan with multipart credential linking, in DataFrame operations only.

Spans of single patterns are found by themselves (kinds assign, access, hex). Parts that mean little alone - a user or
client name, a long mixed token, an endpoint - are weak candidates. An interval join brings together the parts of a text
that start within SCOPE code points of each other, and a weak candidate is reported only next to its complements:

    user      next to a secret (assign, hex or blob)
    blob      next to an access identifier (access or user)
    endpoint  next to both an access identifier and a secret

For the join, positions fall into buckets of SCOPE code points; a bucket keeps the least and the greatest start of each
role, which decides exactly whether a part stands within reach, without forming pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "user", "blob", "endpoint")
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + VALUE + ")"
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "user": r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "blob": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"""(?i)(?:\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s"'<>]+|\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?)""",
}
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "user": "id", "endpoint": "endpoint"}
SCOPE = 300


def _found(text: Column, kind: str) -> Column:
    """Per match in order: (gap before it, its length, whether it counts); an empty array if there is none."""
    regex = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    counts = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6) if kind == "assign" else (lambda m: F.lit(True))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(hits))
    row = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), counts(m).alias("ok")))
    return F.when(F.size(hits) > 0, row).otherwise(F.array().cast("array<struct<gap:bigint,len:bigint,ok:boolean>>"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: the key, n_assign, n_access, n_hex, base_sha256, spans and n_linked (weak ones reported).

    Positions are code points of the whole text, the end exclusive; spans are kind:start:end, comma-joined by start, then
    kind. Null and empty texts have no spans: counts of 0, an empty string and its hash. Repeated rows and null keys are
    rows of their own; other columns are ignored. The text is read once and not shuffled; parts are grouped by row of
    ``docs``, so a group is never larger than what one text holds.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), *(_found(t, k).alias(k) for k in KINDS))
    rows = written(rows, "secrets")
    matches = None
    for k in KINDS:
        m = rows.where(F.size(k) > 0).select("row", F.lit(KINDS.index(k)).alias("kind"), F.lit(k).alias("name"), F.lit(ROLE[k]).alias("role"), F.posexplode(k).alias("at", "m"))
        matches = m if matches is None else matches.unionAll(m)
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    matches = matches.select("row", "kind", "name", "role", "m.ok", "m.len", (F.sum(F.col("m.gap") + F.col("m.len")).over(before) - F.col("m.len")).alias("start")).where("ok")
    parts = written(matches.select("row", "kind", "name", "role", "start", (F.col("start") + F.col("len")).alias("end")), "secret-parts")

    bucket = F.floor(F.col("start") / scope)
    near = parts.groupBy("row", bucket.alias("bucket"), "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = near.withColumnRenamed("role", "other")
    weak = parts.where(F.col("kind") >= 3).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    joined = weak.join(near, ["row", "bucket"]).where((F.col("other") != F.col("role")) & (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("start") + scope))
    beside = joined.groupBy("row", "kind", "name", "start", "end").agg(F.max((F.col("other") == "id").cast("int")).alias("id"), F.max((F.col("other") == "secret").cast("int")).alias("secret"))
    linked = beside.where(((F.col("name") == "user") & (F.col("secret") == 1)) | ((F.col("name") == "blob") & (F.col("id") == 1)) | ((F.col("name") == "endpoint") & (F.col("id") + F.col("secret") == 2)))

    spans = parts.where(F.col("kind") < 3).select("row", "kind", "name", "start", "end").unionAll(linked.select("row", "kind", "name", "start", "end"))
    one = F.struct("start", "kind", F.concat_ws(":", "name", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))
    count = lambda k: F.count_if(F.col("kind") == k)
    grouped = spans.groupBy("row").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.count_if(F.col("kind") > 2).alias("n_linked"), F.sort_array(F.collect_list(one)).alias("all"))
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["span"]))
    found = grouped.select("row", "n_assign", "n_access", "n_hex", "n_linked", joined(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), joined(F.col("all")).alias("spans"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("row", "key").join(found, "row", "left").select(
        F.col("key").alias(key), n("n_assign"), n("n_access"), n("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), n("n_linked")
    )
