"""Landed vendor files to typed tables.

Each parser is a DataFrame function over text that ``spark.read`` delivers (one document or one line per
row), so the same code serves a landing folder and a stream. Malformed rows are counted, not guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import clock
from ..functions.scalar import tolerant_number


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body): one row per landed document."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def canonical(rows: DataFrame) -> DataFrame:
    """Canonical bars: session from the event instant, adjusted close defaults to the close."""
    return rows.withColumn("session", clock.session_of("event_time")).withColumn("adjusted_close", F.coalesce("adjusted_close", "close"))


def vendor_json(docs: DataFrame) -> DataFrame:
    """(symbol, body) with a JSON array of bars."""
    return docs.select("symbol", F.inline(F.from_json("body", schemas.VENDOR_JSON))).select(
        "symbol", F.to_date(F.substring("date", 1, 10)).alias("session"), "open", "high", "low", "close", "volume",
        F.col("adjClose").alias("adjusted_close"), F.col("divCash").alias("dividend"), F.col("splitFactor").alias("split_factor"))


def vendor_csv(lines: DataFrame) -> DataFrame:
    """(symbol, line) in Date,Open,High,Low,Close,Volume order; no actions, so a limitation is stamped."""
    r = F.from_csv("line", F.lit(schemas.VENDOR_CSV))
    x = lines.where(~F.col("line").startswith("Date")).select("symbol", r.alias("r"))
    return x.select("symbol", F.col("r.Date").alias("session"), *[F.col(f"r.{c}").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
                    F.col("r.Close").alias("adjusted_close"), F.lit("NO_ACTION_COLUMNS").alias("limitation"))


def bulk_archive(lines: DataFrame, start: str, end: str) -> DataFrame:
    """(member, line) of per-ticker text members: daily rows only, ticker must match the member name."""
    r = F.from_csv("line", F.lit(schemas.ARCHIVE_CSV))
    x = lines.where(~F.col("line").startswith("<")).select("member", r.alias("r")).select("member", "r.*")
    day = F.try_to_date("DATE", "yyyyMMdd")
    x = x.where((F.col("PER") == "D") & (F.upper("TICKER") == F.upper("member"))).withColumn("session", day).where(
        F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    n = F.count("*").over(W.partitionBy("member", "session"))
    return x.select(F.upper("TICKER").alias("symbol"), "session", *[F.col(c).alias(c.lower()) for c in ("OPEN", "HIGH", "LOW", "CLOSE")],
                    F.col("VOL").alias("volume"), (n > 1).alias("duplicate"))


def chart_json(docs: DataFrame) -> DataFrame:
    """(symbol, body) with parallel arrays and action maps keyed by epoch seconds."""
    c = F.from_json("body", schemas.CHART_JSON)
    x = docs.select("symbol", c.alias("c"))
    z = F.arrays_zip(*[F.col(f"c.{n}").alias(n) for n in ("timestamp", "open", "high", "low", "close", "volume", "adjclose")])
    x = x.select("symbol", F.col("c.dividends").alias("dividends"), F.col("c.splits").alias("splits"), F.explode(z).alias("z")).select("symbol", "dividends", "splits", "z.*")
    key = F.col("timestamp").cast("string")
    split = F.try_element_at("splits", key)
    x = x.where("close is not null").select(
        "symbol", clock.session_of(F.timestamp_seconds("timestamp")).alias("session"), "open", "high", "low", "close", "volume", F.col("adjclose").alias("adjusted_close"),
        F.coalesce(F.try_element_at("dividends", key)["amount"], F.lit(0.0)).alias("dividend"), F.coalesce(split["numerator"] / split["denominator"], F.lit(1.0)).alias("split_factor"))
    ok = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return x.withColumn("malformed", ~F.coalesce(ok, F.lit(False)))


def first_complete_provider(rows: DataFrame, priority: list[str], required: DataFrame) -> DataFrame:
    """Whole-series fallback: per symbol, all rows of the first provider with enough sessions, never a splice."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    have = rows.where("close is not null").groupBy("symbol", "provider").agg(F.count_distinct("session").alias("n"))
    ok = have.join(required, "symbol").where("n >= need").withColumn("r", rank)
    pick = ok.groupBy("symbol").agg(F.min_by("provider", "r").alias("provider"))
    return rows.join(pick, ["symbol", "provider"], "left_semi")


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Newest quote per symbol by provider time."""
    key = clock.arrival_key("provider_time", F.unix_micros("received_at") - F.unix_micros("provider_time"))
    newest = quotes.groupBy("symbol").agg(*[F.max_by(c, key).alias(c) for c in ("price", "provider_time", "received_at", "halted")])
    return newest.withColumn("delay_seconds", F.unix_timestamp("received_at") - F.unix_timestamp("provider_time"))


def factor_lines(lines: DataFrame) -> DataFrame:
    """Daily factor file: only 8-digit dated lines, percent to decimal, available next morning."""
    x = lines.where(F.col("line").rlike("^[0-9]{8},")).select(F.split("line", ",").alias("f"))
    v = lambda i: F.col("f")[i].try_cast("double") / 100
    x = x.select(F.to_date(F.col("f")[0], "yyyyMMdd").alias("session"), v(1).alias("mkt_rf"), v(2).alias("smb"), v(3).alias("hml"), v(4).alias("rf"))
    return x.withColumn("market", F.col("mkt_rf") + F.col("rf")).withColumn("available_at", clock.new_york_instant(F.date_add("session", 1), 8))


def reference_lines(lines: DataFrame, series: str, lag_hours: int) -> DataFrame:
    """DATE,VALUE lines; '.' is missing."""
    x = lines.where(F.col("line").rlike("^[0-9]{4}-")).select(F.split("line", ",").alias("f"))
    x = x.select(F.lit(series).alias("series_id"), F.to_date(F.col("f")[0]).alias("session"), F.nullif(F.col("f")[1], F.lit(".")).try_cast("double").alias("value"))
    x = x.withColumn("event_time", clock.market_close("session"))
    return x.withColumn("available_at", F.col("event_time") + F.make_interval(hours=F.lit(lag_hours)))


def wide_reference(long: DataFrame, ids: list[str]) -> DataFrame:
    """Full outer alignment of several series on the session."""
    return long.groupBy("session").pivot("series_id", ids).agg(F.max("value"))


def signed_observations(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Series values as rows, sign kept, missing dropped."""
    return wide.unpivot("session", ids, "series_id", "value").where("value is not null")


def filing_rows(docs: DataFrame) -> DataFrame:
    """(symbol, body) with column arrays of filings, one row per filing."""
    c = F.from_json("body", schemas.FILINGS)
    names = ("accessionNumber", "form", "items", "acceptanceDateTime", "primaryDocument")
    x = docs.select("symbol", c.alias("c"))
    return x.select("symbol", F.explode(F.arrays_zip(*[F.col(f"c.{n}").alias(n) for n in names])).alias("z")).select("symbol", "z.*")


def earnings_announcements(filings: DataFrame) -> DataFrame:
    return filings.where(F.col("form").isin("8-K", "8-K/A") & F.array_contains(F.split("items", ","), "2.02"))


def filing_events(filings: DataFrame) -> DataFrame:
    """Typed corporate events with exact acceptance instants; date-only rows are dropped."""
    has = lambda item: F.array_contains(F.split("items", ","), item)
    kind = (
        F.when(F.col("form").startswith("8-K") & has("2.02"), "EARNINGS").when(F.col("form").startswith("8-K") & has("7.01"), "GUIDANCE")
        .when(F.col("form").startswith("10-"), "PERIODIC_REPORT").otherwise("OTHER"))
    x = filings.where(F.length("acceptanceDateTime") > 10).withColumn("accepted_at", F.try_to_timestamp("acceptanceDateTime"))
    return x.where("accepted_at is not null").select(
        F.substring(F.sha2(F.concat_ws("|", "symbol", "accessionNumber"), 256), 1, 24).alias("event_id"), "symbol", kind.alias("kind"), "accepted_at")


def quarterly_concept(docs: DataFrame) -> DataFrame:
    """Frame-tagged quarterly EPS entries only."""
    c = F.from_json("body", schemas.CONCEPT)
    x = docs.select("symbol", F.inline(F.element_at(c["units"], "USD/shares")))
    return x.where(F.col("frame").rlike("^CY[0-9]{4}Q[1-4]$")).select("symbol", "frame", F.to_date("end").alias("end"), F.col("val").alias("value"), F.to_date("filed").alias("filed"), "form")


def sectioned_lines(lines: DataFrame) -> DataFrame:
    """(file, n, line) of a CSV whose sections each start with their own STUB_1 header, as long cells."""
    start = F.col("line").startswith("STUB_1")
    w = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    x = lines.select("file", "n", F.split("line", ",").alias("cells"), start.alias("_h"), F.sum(start.cast("int")).over(w).alias("section")).where("section > 0")
    x = x.withColumn("header", F.last(F.when(F.col("_h"), F.col("cells")), True).over(w)).where("not _h")
    slug = F.transform("header", lambda h: F.regexp_replace(F.lower(F.trim(h)), "[^a-z0-9]+", "_"))
    cells = x.select("file", "section", "n", F.explode(F.arrays_zip(slug.alias("name"), F.col("cells").alias("text"))).alias("c")).select("file", "section", "n", "c.name", "c.text")
    number = tolerant_number(F.col("text"))
    share = F.avg(number.isNotNull().cast("double")).over(W.partitionBy("file", "section", "name"))
    return cells.withColumn("value", F.when(share >= 0.5, number))


def positioning(docs: DataFrame, *contracts: str) -> DataFrame:
    """Largest open-interest record per report date of each wanted contract; usable on Friday 15:30."""
    n = lambda c: F.regexp_replace(c, "[, ]", "").try_cast("double")
    x = docs.select(F.inline(F.from_json("body", schemas.POSITIONING))).where(F.col("contract").isin(*contracts))
    x = x.select("contract", F.to_date("report_date").alias("report_date"), n("long_all").alias("long"), n("short_all").alias("short"), n("open_interest").alias("open_interest"))
    x = x.groupBy("contract", "report_date").agg(F.max(F.struct("open_interest", "long", "short")).alias("t")).select("contract", "report_date", "t.*")
    return x.select("contract", "report_date", (F.col("long") - F.col("short")).alias("net"), ((F.col("long") - F.col("short")) / F.nullif("open_interest", F.lit(0.0))).alias("net_share"), "open_interest",
                    clock.new_york_instant(F.date_add("report_date", 3), 15, 30).alias("available_at"))


def pinned(spark: SparkSession, folder: str, pins: DataFrame) -> DataFrame:
    """Landed files whose content hash equals the declared one (path, sha256, matches)."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return files.join(pins, "name", "left").withColumn("matches", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(partition, name, sha256) of the landed files below a folder; a partition is the path between the two."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    tail = F.regexp_replace(F.col("path"), F.lit(r"^.*/" + re.escape(folder.rstrip("/").split("/")[-1]) + "/"), F.lit(""))
    return files.select(F.regexp_replace(tail, "/?[^/]*$", "").alias("partition"), F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def set_digests(files: DataFrame, *by: str) -> DataFrame:
    """One digest for each set of files: a hash of the sorted content hashes, whatever the order or names of the files."""
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("digest"))


def pinned_partitions(spark: SparkSession, folder: str, pins: DataFrame) -> DataFrame:
    """(partition, n_files, digest, matches): partitions whose digest is the declared one. `pins` has (partition, expected)."""
    x = set_digests(file_hashes(spark, folder), "partition").join(pins, "partition", "left")
    return x.withColumn("matches", F.coalesce(F.col("digest") == F.col("expected"), F.lit(False)))


def verdict_csv(df: DataFrame, path: str) -> None:
    """CSV with a header even when the table is empty."""
    df.write.mode("errorifexists").option("header", True).csv(path)
