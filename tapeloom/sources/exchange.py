"""Readers of exchange files and payloads, and the dataset writer with its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGG_TRADES = "agg_trade_id long, price string, quantity string, first_trade_id long, last_trade_id long, transact_time long, is_buyer_maker boolean, _corrupt string"
METRICS = "create_ms long, symbol string, sum_open_interest string, _corrupt string"
#: Open interest samples become visible so many ms after their creation time.
OI_DELAY_MS = 300_000
PLAIN = r"^[+-]?[0-9]+(\.[0-9]+)?$"
SCIENTIFIC = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def exact_decimal(text: Column, exponent: bool = False) -> Column:
    """IO4, IO8: decimal(18,8), or null if the text isn't a number of at most eight decimals (trailing zeros don't count)."""
    ok = text.rlike(SCIENTIFIC if exponent else PLAIN)
    wide = F.when(ok, text.try_cast("decimal(38,20)"))
    narrow = wide.try_cast("decimal(18,8)")
    return F.when(narrow.cast("decimal(38,20)") == wide, narrow)


def read_agg_trades(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO2, IO9: (trades, quarantine). A buyer that made the market means an aggressive seller."""
    raw = spark.read.csv(path, schema=AGG_TRADES, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", header=False)
    r = raw.withColumns({"p": exact_decimal(F.col("price")), "q": exact_decimal(F.col("quantity"))})
    reason = F.when(F.col("_corrupt").isNotNull(), "unparsable").when(F.col("p").isNull() | F.col("q").isNull(), "decimal").when(F.col("q") <= 0, "quantity").when(F.col("last_trade_id") < F.col("first_trade_id"), "id_range")
    r = r.withColumn("reason", reason)
    side = F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")
    good = r.where("reason IS NULL").select(F.col("agg_trade_id").alias("trade_id"), F.col("p").alias("price"), F.col("q").alias("qty"), "first_trade_id", "last_trade_id", F.col("transact_time").alias("ts_ms"), side.alias("aggressor"))
    return good, r.where("reason IS NOT NULL").select("agg_trade_id", "reason")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """IO5: open interest, ordered at its creation time and a delay, so that no row is visible before it could be known."""
    r = spark.read.csv(path, schema=METRICS, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", header=False)
    return r.select("symbol", (F.col("create_ms") + OI_DELAY_MS).alias("ts_ms"), exact_decimal(F.col("sum_open_interest")).alias("open_interest"))


AGG_PAYLOAD = "e string, a long, p string, q string, f long, l long, T long, m boolean"


def parse_payloads(raw: DataFrame) -> DataFrame:
    """IO7: aggregate trades from JSON payloads; rows that aren't such are dropped here and kept by the quarantine rule."""
    j = raw.withColumn("j", F.from_json("payload", AGG_PAYLOAD)).where("j.e = 'aggTrade'")
    return j.select(F.col("j.a").alias("trade_id"), exact_decimal(F.col("j.p")).alias("price"), exact_decimal(F.col("j.q")).alias("qty"), F.col("j.T").alias("ts_ms"), F.when(F.col("j.m"), "sell").otherwise("buy").alias("aggressor"))


def write_dataset(tables: dict[str, DataFrame], root: str, order: str) -> DataFrame:
    """IO11, IO12: each table as LZ4 Parquet sorted within partitions, and a manifest of rows and content hashes."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        df.sortWithinPartitions(order).write.option("compression", "lz4_raw").parquet(f"{root}/{name}")
        row = content(spark.read.parquet(f"{root}/{name}"), name)
        out = row if out is None else out.unionByName(row)
    out.write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def content(df: DataFrame, name: str) -> DataFrame:
    """One row: table, rows and a hash of the content that doesn't depend on the order of rows."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    parts = [F.sum(F.pmod(F.shiftright(h, k), F.lit(1 << 16))).cast("string") for k in (0, 16, 32, 48)]
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", *parts), 256).alias("hash")).select(F.lit(name).alias("table"), "n_rows", "hash")


def verify_dataset(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """IO13: per table whether it still is what the manifest says."""
    m = spark.read.parquet(f"{root}/manifest").select("table", F.col("n_rows").alias("want"), F.col("hash").alias("want_hash"))
    now = None
    for name in names:
        row = content(spark.read.parquet(f"{root}/{name}"), name)
        now = row if now is None else now.unionByName(row)
    return now.join(m, "table").select("table", "n_rows", ((F.col("n_rows") == F.col("want")) & (F.col("hash") == F.col("want_hash"))).alias("intact"))


def write_tsv(df: DataFrame, path: str, keys: list[str]) -> None:
    """IO14: tab-separated files, ordered by the key columns, with a header."""
    df.orderBy(*keys).write.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)
