"""Archive files beyond aggregate trades, the period rule, incremental loads, and scans of the raw store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.exchange import exact_decimal
from tapeloom.sources.tape import DAY_MS

# fixed values: columns of the published files
KLINES = "open_time open high low close volume close_time quote_volume count taker_buy_volume taker_buy_quote_volume ignore".split()
FUNDING = "calc_time funding_interval_hours last_funding_rate".split()
TRADES = "id price qty quote_qty time is_buyer_maker".split()
DEPTH_BANDS = "timestamp percentage depth notional".split()
CIVIL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


def read_text_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, and the row's file; a line that repeats the column names is a header and goes. Missing fields are null."""
    r = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), header=False)
    return r.withColumn("file", F.col("_metadata.file_path")).where(~F.col(columns[0]).eqNullSafe(F.lit(columns[0])))


def whole(text: Column) -> Column:
    return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("long"))


def split(rows: DataFrame, values: dict[str, Column], rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a row with a null value is 'unparsable'; then the first rule that holds names the reason."""
    reason = F.when(F.array_contains(F.array(*[v.isNull() for v in values.values()]), True), "unparsable")
    for name, broken in rules.items():
        reason = reason.when(broken, name)
    r = rows.withColumn("__reason", reason)
    good = r.where("__reason IS NULL").select(*[v.alias(n) for n, v in values.items()])
    return good, r.where("__reason IS NOT NULL").select(*rows.columns, F.col("__reason").alias("reason"))


def read_klines(spark: SparkSession, path: str, interval_ms: int, zero_prices: bool = False) -> tuple[DataFrame, DataFrame]:
    """IO3: (klines, quarantine). A row's span must be its interval; it counts from its close on. With ``zero_prices`` only negative prices are refused."""
    r = read_text_rows(spark, path, KLINES)
    prices = {c: exact_decimal(F.col(c)) for c in ("open", "high", "low", "close")}
    sizes = {c: exact_decimal(F.col(c)) for c in ("volume", "taker_buy_volume")}
    values = {"open_ms": whole(F.col("open_time")), "close_ms": whole(F.col("close_time")), **prices, **sizes, "n_trades": whole(F.col("count"))}
    span = values["close_ms"] - values["open_ms"] + 1 != interval_ms
    lowest = F.least(*prices.values())
    return split(r, values, {"interval": span, "price": lowest < 0 if zero_prices else lowest <= 0, "quantity": F.least(*sizes.values()) < 0})


def read_funding(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO4: (funding, quarantine). Rates may be written with an exponent; those of more than eight decimals are refused."""
    r = read_text_rows(spark, path, FUNDING)
    return split(r, {"ts_ms": whole(F.col("calc_time")), "interval_hours": whole(F.col("funding_interval_hours")), "rate": exact_decimal(F.col("last_funding_rate"), True)}, {})


def read_trades(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO6: (trades, quarantine) of individual trades."""
    r = read_text_rows(spark, path, TRADES)
    side = F.when(F.lower("is_buyer_maker") == "true", "sell").when(F.lower("is_buyer_maker") == "false", "buy")
    values = {"trade_id": whole(F.col("id")), "ts_ms": whole(F.col("time")), "price": exact_decimal(F.col("price")), "qty": exact_decimal(F.col("qty")), "aggressor": side}
    return split(r, values, {"price": values["price"] <= 0, "quantity": values["qty"] <= 0})


def civil_ms(text: Column) -> Column:
    """Milliseconds of a UTC time YYYY-MM-DD HH:MM:SS, null for other widths and times that don't exist."""
    at = F.when(text.rlike(CIVIL), text.try_cast("timestamp_ntz"))
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def read_depth_bands(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO6: (bands, quarantine) of book depth per percentage from the mid."""
    r = read_text_rows(spark, path, DEPTH_BANDS)
    return split(r, {"ts_ms": civil_ms(F.col("timestamp")), **{c: exact_decimal(F.col(c)) for c in DEPTH_BANDS[1:]}}, {})


def period_check(rows: DataFrame, name: str, ts: str) -> DataFrame:
    """IO9: per file its rows, those outside its period (the day or month at the end of its name) by more than a day, and whether it
    is accepted: one such row refuses the file. A row without a time is outside, a file without a period is refused."""
    text = F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)[^0-9]*$", 1)
    daily = F.length(text) == 10
    first = F.when(daily, text.try_cast("date")).otherwise(F.concat(text, F.lit("-01")).try_cast("date"))
    end = F.when(daily, F.date_add(first, 1)).otherwise(F.add_months(first, 1))
    ms = lambda d: F.unix_date(d).cast("long") * DAY_MS
    outside = ~F.coalesce((F.col(ts) >= ms(first) - DAY_MS) & (F.col(ts) < ms(end) + DAY_MS), F.lit(False))
    out = rows.groupBy(F.col(name).alias("file")).agg(F.count("*").alias("n_rows"), F.count_if(outside).alias("n_outside"))
    return out.withColumn("accepted", F.col("n_outside") == 0)


def load_plan(published: DataFrame, log: DataFrame) -> DataFrame:
    """IO10: what to do with each published file (file, hash), given the log (file, hash) of loads: 'load' where the log lacks it,
    'skip' where the hashes agree, 'changed' (never loaded again by itself) where they don't. The log has one row a file."""
    j = published.join(log.select("file", F.col("hash").alias("loaded")), "file", "left")
    action = F.when(F.col("loaded").isNull(), "load").when(F.col("loaded") == F.col("hash"), "skip").otherwise("changed")
    return j.select("file", "hash", action.alias("action"))


def scan(spark: SparkSession, root: str, stream: str, start_ms: int, end_ms: int) -> DataFrame:
    """IO1: rows of a store partitioned by (stream, date) with start <= ts_ms < end; partitions outside are not listed as input."""
    day = lambda ms: F.date_from_unix_date(F.lit(ms // DAY_MS).cast("int"))
    r = spark.read.parquet(root).where((F.col("stream") == stream) & F.col("date").between(day(start_ms), day(end_ms - 1)))
    return r.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))


def store_version(scanned: DataFrame) -> DataFrame:
    """IO1: number of files of a scan and a digest of their names and sizes, by way of a digest per date."""
    files = scanned.select("date", F.col("_metadata.file_name").alias("n"), F.col("_metadata.file_size").alias("s")).distinct()
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256)
    days = files.groupBy("date").agg(joined(F.concat_ws(":", "n", "s")).alias("h"), F.count("*").alias("n"))
    return days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), joined(F.concat_ws(":", "date", "h")).alias("version"))
