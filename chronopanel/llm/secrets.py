"""Secret scans with corpus-wide ownership.

Candidates of a document are matches of fixed patterns. The value of each is hashed, and the hashes are counted over
the corpus by the documents (repositories) and sources (owners) that hold them: a value of many owners is a widely
copied example, a value of one owner looks live. Long mixed tokens, which no fixed pattern names, are added as
`opaque` spans where they are of one owner only; the spans of the fixed patterns always stay.

A null text is empty; a null source is an owner of its own. Repeated rows count as documents of their own. An empty
table gives an empty result. All other columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_or_empty

QUERY = "op2_secrets"
#: Kinds in their order, patterns, the group that holds the value, and the least length of that group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so shorter ones can be left out of the search
    ("opaque", r"[A-Za-z0-9_+/=-]{20,}", 0, 20),
)
MANY_OWNERS = 3  # a value of that many sources is an example
SPAN = "struct<start:int,stop:int,rank:int,value:string>"


def _spans(text, rank: int):
    """Spans of one kind by code points: the text between matches gives their places."""
    kind, pattern, group, least = KINDS[rank]
    full, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(full))
    pieces = F.zip_with(F.zip_with(gaps, full, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), value, lambda p, v: F.struct(p["g"].alias("g"), p["m"].alias("m"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), f"array<{SPAN}>").alias("out"))

    def step(acc, p):
        span = F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + p["m"]).alias("stop"), F.lit(rank).alias("rank"), p["v"].alias("value"))
        return F.struct((acc["at"] + p["g"] + p["m"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.filter(F.aggregate(pieces, start, step, lambda acc: acc["out"]), lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.from_json(F.lit("[]"), f"array<{SPAN}>"))


def _mixed(spans, base):
    """Tokens with capital and small letters and digits that touch no base span."""
    def keep(s):
        apart = ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        return s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]") & apart

    return F.filter(spans, keep)


def _join(spans):
    """kind:start:end by start, then by the order of kinds."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """Documents and owners of each value hash; (hash, owner) is summed first, so a hot value is a row per owner."""
    each = found.select("owner", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: F.sha2(s["value"], 256)))).alias("hash"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("docs"))
    return by_owner.groupBy("hash").agg(F.sum("docs").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, carry: list[str], many: int = MANY_OWNERS) -> DataFrame:
    """`row` (the columns to carry), `base` and `added` spans, and the number of live and copied values."""
    row, text = F.struct(*[F.col(f"`{c}`") for c in carry]), text_or_empty()
    some = docs.select(row.alias("row"), F.concat(F.lit("s"), docs["source"]).alias("owner"), text.alias("body"))
    some = some.withColumn("owner", F.coalesce("owner", F.lit("n")))
    some = some.withColumn("base", F.concat(*[_spans(F.col("body"), k) for k in range(3)])).withColumn("extra", _mixed(_spans(F.col("body"), 3), F.col("base")))
    found = staged(some.select(F.monotonically_increasing_id().alias("rid"), "row", "owner", "base", "extra"), "secrets")
    held = found.filter(F.size("base") + F.size("extra") > 0)
    spans = held.select("rid", F.explode(F.concat("base", "extra")).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    known = spans.join(ownership(held), "hash")
    by_row = known.groupBy("rid").agg(
        F.collect_list(F.when((F.col("span.rank") == 3) & (F.col("n_owners") == 1), F.col("span"))).alias("added"),
        F.count_if(F.col("n_owners") == 1).alias("n_live"), F.count_if(F.col("n_owners") >= many).alias("n_copied"),
    )
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    # documents without a candidate, nearly all, take no part in the join
    quiet = found.filter(F.size("base") + F.size("extra") == 0).select("row", "base", none.alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    loud = held.join(by_row, "rid").select("row", "base", F.coalesce("added", none).alias("added"), *[F.col(n).cast("long").alias(n) for n in ("n_live", "n_copied")])
    return quiet.unionByName(loud)


def redacted(scanned: DataFrame, columns: list[str]) -> DataFrame:
    """The documents with every span replaced by [SECRET]; n_chars follows the text."""
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    text = F.col("row.text")

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    clean = F.when(F.size(spans) == 0, text).otherwise(cut)
    out = {"text": clean, "n_chars": F.when(F.size(spans) == 0, F.col("row.n_chars")).otherwise(F.length(clean).cast("long"))}
    return scanned.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(documents(spark, sf_dir, "doc_id", "text", "source"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")
    return scanned.select(
        "row.doc_id", *[count(k) for k in range(3)],
        F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(F.concat("base", "added")).alias("spans"), "n_live", "n_copied",
    )


def _sql_spans(rank: int) -> str:
    kind, pattern, group, least = KINDS[rank]
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT rid, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, v AS value FROM (
    SELECT rid, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(full_[1:i - 1], lambda g: length(g))), 0) AS start, full_[i] AS m, val[i] AS v
    FROM (SELECT *, unnest(range(1, len(full_) + 1)) AS i FROM (
      SELECT rid, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS full_, regexp_extract_all(t, '{pattern}', {group}) AS val FROM d WHERE regexp_matches(t, '{pattern}'))))
  WHERE length(v) >= {least}"""


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS owner, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_sql_spans(k) for k in range(3))}),
extra AS MATERIALIZED (SELECT * FROM ({_sql_spans(3)}) e WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = e.rid AND b.start < e.stop AND e.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
owned AS (SELECT value, count(DISTINCT owner) AS n_owners FROM every JOIN d USING (rid) GROUP BY value),
shown AS (SELECT b.rid, b.rank, b.kind, b.start, b.stop, n_owners, b.rank < 3 OR n_owners = 1 AS listed FROM every b JOIN owned USING (value)),
per AS (
  SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (listed) AS all_spans,
    count(*) FILTER (n_owners = 1) AS live, count(*) FILTER (n_owners >= {MANY_OWNERS}) AS copied FROM shown GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(all_spans, '') AS spans, coalesce(live, 0)::BIGINT AS n_live, coalesce(copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN per USING (rid)
"""
