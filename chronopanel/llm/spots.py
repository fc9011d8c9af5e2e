"""Document fingerprints by spot signatures.

A spot is a common word with the chain of content words that directly follows it, three at most; the first three words
of a text are one more spot, so every text with a word has one. The set of a text's spots is its signature set, and its
fingerprint is the size of the set with a digest of it. Sets are put into partitions by their size, such that two sets
can reach a likeness (Jaccard) of `FLOOR` only in the same or in neighbouring partitions, and only if the smaller is
that share of the larger; all other pairs have a likeness of 0 without a comparison. Every other likeness is exact.

`likeness_of_next` compares each document with its edited text and with the next document. The order is found on ids
alone, in ranges; a document then sends its successor's place no more than the start of its text and the hashes of its
set, and each text is shuffled once.

A null text is empty. Texts without words have the empty set, which is like itself (1) and like nothing else (0). A
null doc_id stands behind all others. Rows of one doc_id stand by the MD5 of their texts; rows that are equal in both
are one document, whose answer each of them gets. A document that is alone is its own next. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, partitions, staged, text_or_empty

QUERY = "op12_spot_signatures"
CHAIN, FLOOR = 3, 0.05
BREAKS = r"""[\x20\x09-\x0D.,;:!?()"]+"""
#: Common words of English, German, French and Spanish.
COMMON = {
    "en": "a an and are as at be by for from has have he in is it its not of on or that the their this to was were which will with",
    "de": "als am auch auf aus bei das dem den der des die durch ein eine einen er es für ich im in ist mit nach nicht oder sich sie sind über um und von war wie wird zu zum zur",
    "fr": "au aux avec ce cette dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour qu que qui sa se son sont sur un une",
    "es": "al como con de del el en es ha la las lo los más no o para pero por que se si sin su sus un una y",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})


def _common() -> str:
    """One alternative for each first letter."""
    ends: dict[str, list[str]] = {}
    for w in WORDS:
        ends.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(first + "(?:" + "|".join(sorted(rest, key=len, reverse=True)) + ")" for first, rest in ends.items()) + ")(?= |$)"


SPOT = f"(?<= ){_common()}(?: (?!{_common()})[^ ]++){{1,{CHAIN}}}+"
START = f"^(?: [^ ]+){{1,{CHAIN}}}"


def spots(text: Column) -> Column:
    """The signature set: distinct spots of a text in small letters, words apart by one blank."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), BREAKS, " ")))
    start = F.regexp_extract(plain, START, 0)
    found = F.concat(F.array(start), F.regexp_extract_all(plain, F.lit(SPOT), F.lit(0)))
    return F.when(F.length(start) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def hashes(spots: Column) -> Column:
    return F.array_distinct(F.transform(spots, lambda s: F.xxhash64(s)))


def fingerprint(spots: Column) -> Column:
    return F.concat_ws("-", F.size(spots).cast("string"), F.md5(F.array_join(F.array_sort(spots), "\n").cast("binary")))


def partition(n: Column, floor: float = FLOOR) -> Column:
    """Sets in partitions further apart than one differ in size by more than the floor allows."""
    return F.floor(F.ln(F.greatest(n, F.lit(1)).cast("double")) / -F.ln(F.lit(floor))).cast("int")


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard of two sets, 0 where their sizes alone keep it below the floor."""
    n, m = F.size(a), F.size(b)
    reach = (F.abs(partition(n, floor) - partition(m, floor)) <= 1) & (F.least(n, m) >= F.greatest(n, m) * F.lit(floor))
    both = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n > 0) & (m > 0) & reach, both / (n + m - both)).otherwise(F.lit(0.0))


def before_each(docs: DataFrame) -> DataFrame:
    """The mark of each document (giver), mark and doc_id of the document before it in descending order (taker), and a
    third of the taker's length. The first comes after the last."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    keys = docs.groupBy("doc_id", "mark").agg(F.max(F.length("body")).alias("n"))
    ranged = staged(keys.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "spots-order")
    within, item = W.partitionBy("part").orderBy(*order), F.struct("mark", "n", "doc_id")
    rows = ranged.select("*", F.lag(item).over(within).alias("prior"), F.lead("mark").over(within).isNull().alias("last"))
    # one row for each range
    along = W.orderBy("part")
    ends = rows.filter("last").select("part", item.alias("end"))
    ends = ends.select(F.col("part").alias("of"), F.coalesce(F.lag("end").over(along), F.last("end").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end"))
    prior = F.coalesce("prior", "end")
    return rows.join(ends, F.col("part") == F.col("of")).select(F.col("mark").alias("giver"), prior["mark"].alias("taker"), prior["doc_id"].alias("taker_id"), F.floor(prior["n"] / 3).cast("int").alias("third"))


def likeness_of_next(docs: DataFrame) -> DataFrame:
    """Each row with the spots, fingerprints and likenesses of its text, its edited text and the next document."""
    body = text_or_empty()
    mark = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(body.cast("binary")))
    docs = docs.select("doc_id", body.alias("body"), mark.alias("mark"))
    # both joins read (body, mark) alone, so one shuffle of the texts serves the two
    texts = docs.select("body", "mark")
    sent = texts.join(before_each(docs), F.col("mark") == F.col("giver")).groupBy("taker").agg(
        F.any_value(F.struct(F.col("taker_id").alias("doc_id"), F.substring("body", F.lit(1), F.col("third")).alias("head"), hashes(spots(F.col("body"))).alias("set"))).alias("next"))
    met = texts.join(sent, F.col("mark") == F.col("taker")).withColumn("doc_id", F.col("next.doc_id"))
    n = F.length("body")
    edited = F.concat(F.substring("body", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("next.head"))
    rows = met.select("doc_id", n.cast("long").alias("n_chars"), "body", edited.alias("edited"), F.col("next.set").alias("next_set"))
    rows = rows.withColumn("spots", spots(F.col("body"))).withColumn("edited_spots", spots(F.col("edited")))
    rows = rows.withColumn("set", hashes(F.col("spots"))).withColumn("edited_set", hashes(F.col("edited_spots")))
    return rows.select(
        "doc_id", "n_chars", "edited", "spots", "edited_spots", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("set"), F.col("next_set")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = likeness_of_next(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


_STOP = ", ".join(f"'{w}'" for w in WORDS)
_CHAINS = " ".join(f"WHEN {k} THEN {' || '.join(['w', *[f''' ' ' || w{i}''' for i in range(1, k + 1)]])}" for k in range(1, CHAIN + 1))
_RUN = " + ".join(f"CASE WHEN {' AND '.join(f'c{i}' for i in range(1, k + 1))} THEN 1 ELSE 0 END" for k in range(1, CHAIN + 1))
_LEADS = ", ".join(f"lead(w, {k}) OVER o AS w{k}, coalesce(NOT lead(stop, {k}) OVER o, false) AS c{k}" for k in range(1, CHAIN + 1))
_LIKE = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE WHEN least(len({0}), len({1})) = 0 OR least(len({0}), len({1})) < greatest(len({0}), len({1})) * {2}::DOUBLE THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
SQL = f"""
WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
n AS MATERIALIZED (SELECT doc_id, t, row_number() OVER o AS rid, length(t) AS n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS next_t, coalesce(lead(row_number) OVER o, 1) AS next_rid
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(t)) AS row_number FROM d) WINDOW o AS (ORDER BY row_number)),
e AS MATERIALIZED (SELECT *, t[1:n - n // 3] || next_t[1:n // 3] AS edited FROM n),
texts AS (SELECT rid, 0 AS kind, t FROM e UNION ALL SELECT rid, 1, edited FROM e),
lists AS (SELECT rid, kind, string_split(trim(regexp_replace(lower(t), '{BREAKS}', ' ', 'g')), ' ') AS words FROM texts),
words AS (SELECT rid, kind, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lists WHERE words <> ['']),
runs AS (SELECT rid, kind, w, stop, {_LEADS}, i FROM (SELECT *, w IN ({_STOP}) AS stop FROM words) WINDOW o AS (PARTITION BY rid, kind ORDER BY i)),
found AS (SELECT rid, kind, CASE {_RUN} {_CHAINS} END AS spot FROM runs WHERE stop AND c1
  UNION ALL SELECT rid, kind, ' ' || array_to_string(words[1:{CHAIN}], ' ') FROM lists WHERE words <> ['']),
sets AS MATERIALIZED (SELECT rid, kind, list(DISTINCT spot) AS s FROM found GROUP BY ALL),
full_ AS MATERIALIZED (SELECT e.*, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b, coalesce(c.s, []) AS c
  FROM e LEFT JOIN sets a ON a.rid = e.rid AND a.kind = 0 LEFT JOIN sets b ON b.rid = e.rid AND b.kind = 1 LEFT JOIN sets c ON c.rid = e.next_rid AND c.kind = 0)
SELECT x.doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, len(a) || '-' || md5(array_to_string(list_sort(a), chr(10))) AS fingerprint,
  len(b) || '-' || md5(array_to_string(list_sort(b), chr(10))) AS edited_fingerprint, {_LIKE.format("a", "b", FLOOR)} AS near_edited, {_LIKE.format("a", "c", FLOOR)} AS near_next
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) x JOIN full_ f ON f.t = x.t AND f.doc_id IS NOT DISTINCT FROM x.doc_id
"""
