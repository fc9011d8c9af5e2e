"""Fixed schemas of landed and derived tables."""

from pyspark.sql.types import (
    ArrayType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType,
)

BARS = StructType(
    [StructField("symbol", StringType()), StructField("exchange", StringType()), StructField("asset_type", StringType()),
     StructField("session", DateType()), StructField("event_time", TimestampType()), StructField("available_at", TimestampType())]
    + [StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume", "adjusted_close", "dividend", "split_factor")]
    + [StructField("source", StringType())]
)
VENDOR_JSON = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,adjClose:double,divCash:double,splitFactor:double>>"
CHART_JSON = (
    "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>,"
    "adjclose:array<double>,dividends:map<string,struct<amount:double>>,splits:map<string,struct<numerator:double,denominator:double>>>"
)
VENDOR_CSV = "Date date, Open double, High double, Low double, Close double, Volume double"
ARCHIVE_CSV = "TICKER string, PER string, DATE string, TIME string, OPEN double, HIGH double, LOW double, CLOSE double, VOL double, OPENINT double"
QUOTES = "symbol string, price double, provider_time timestamp, received_at timestamp, delay_seconds double, halted boolean"
FILINGS = "struct<accessionNumber:array<string>,form:array<string>,items:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>>"
CONCEPT = "struct<units:map<string,array<struct<`end`:string,val:double,filed:string,form:string,frame:string>>>>"
POSITIONING = "array<struct<report_date:string,contract:string,long_all:string,short_all:string,open_interest:string>>"
MINUTE_BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
LEDGER = StructType([StructField("recommendation_id", StringType()), StructField("symbol", StringType()), StructField("event", StringType()),
                     StructField("at", TimestampType()), StructField("price", DoubleType())])
EVENT_IDS = ArrayType(LongType())
