"""Registered queries: files and payloads written from the events table and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans.stream_queries import scratch
from tapeloom.plans.tape_sql import TAPE
from tapeloom.sources import exchange as X
from tapeloom.sources.tape import raw_tape, trades


def text_price(c):
    """Prices as text; each 50th one has a ninth decimal and isn't exact."""
    return F.concat((c / 100_000_000).cast("decimal(18,8)").cast("string"), F.when(F.col("trade_id") % 50 == 0, "1").otherwise(""))


def agg_file(s, d):
    t = raw_tape(s, d).where("event_type <> 'error'")
    path = scratch(s, "agg")
    t.select("trade_id", text_price(F.col("price")), F.col("qty").cast("string"), F.col("trade_id").alias("f"), (F.col("trade_id") + 1).alias("l"), "ts_ms", (F.col("aggressor") == "sell").alias("m")).write.csv(path)
    return path


def agg_trades(s, d):
    return X.read_agg_trades(s, agg_file(s, d))[0].select("trade_id", (F.col("price") * 100_000_000).cast("long").alias("price"), F.col("qty").cast("long").alias("qty"), "ts_ms", "aggressor")


def quarantine(s, d):
    return X.read_agg_trades(s, agg_file(s, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


def funding(s, d):
    t = raw_tape(s, d).where("event_type = 'signup'")
    text = F.concat(F.col("qty").cast("string"), F.lit("E-"), (F.col("trade_id") % 12).cast("string"))
    t = t.select("trade_id", X.exact_decimal(text, True).alias("rate"))
    return t.agg(F.count("*").alias("n"), F.count("rate").alias("exact"), (F.sum("rate") * 100_000_000).cast("long").alias("units"))


def metrics(s, d):
    path = scratch(s, "metrics")
    t = raw_tape(s, d).where("event_type = 'view'")
    t.select("ts_ms", F.lit("X").alias("symbol"), (F.col("price") / 100_000_000).cast("decimal(18,8)").cast("string").alias("oi")).write.csv(path)
    return X.read_metrics(s, path).select("ts_ms", (F.col("open_interest") * 100_000_000).cast("long").alias("units"))


def payloads(s, d):
    t = trades(s, d)
    body = F.to_json(F.struct(F.when(F.col("trade_id") % 10 == 0, "other").otherwise("aggTrade").alias("e"), F.col("trade_id").alias("a"), (F.col("price") / 100_000_000).cast("decimal(18,8)").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), F.col("ts_ms").alias("T"), (F.col("aggressor") == "sell").alias("m")))
    return X.parse_payloads(t.select(body.alias("payload"))).select("trade_id", (F.col("price") * 100_000_000).cast("long").alias("price"), F.col("qty").cast("long").alias("qty"), "ts_ms", "aggressor")


def dataset(s, d):
    root = scratch(s, "dataset")
    t = trades(s, d)
    X.write_dataset({"buys": t.where("aggressor = 'buy'"), "sells": t.where("aggressor = 'sell'")}, root, "trade_id")
    return X.verify_dataset(s, root, ["buys", "sells"])


def tsv(s, d):
    path = scratch(s, "tsv")
    X.write_tsv(trades(s, d).groupBy("instrument", "aggressor").agg(F.count("*").alias("n")), path, ["instrument", "aggressor"])
    return s.read.csv(path, sep="\t", header=True, schema="instrument long, aggressor string, n long")


QUERIES = {
    "io2_agg_trades_csv": agg_trades, "io4_exponent_decimals": funding, "io5_metrics_csv": metrics, "io7_json_payloads": payloads,
    "io9_quarantine": quarantine, "io11_dataset_manifest": dataset, "io14_tsv_export": tsv,
}

SQL = {
    "io2_agg_trades_csv": f"WITH {TAPE} SELECT trade_id, price, qty, ts_ms, aggressor FROM trades WHERE trade_id % 50 <> 0",
    "io4_exponent_decimals": f"WITH {TAPE}, r AS (SELECT qty, trade_id % 12 AS e FROM ev WHERE event_type = 'signup'), x AS (SELECT CASE WHEN (qty::HUGEINT * 1000000000000) % (10 ** e)::HUGEINT = 0 AND (qty::HUGEINT * 100000000) % (10 ** e)::HUGEINT = 0 THEN qty::HUGEINT * 100000000 // (10 ** e)::HUGEINT END AS u FROM r) SELECT count(*) AS n, count(u) AS exact, CAST(sum(u) AS BIGINT) AS units FROM x",
    "io5_metrics_csv": f"WITH {TAPE} SELECT ts_ms + 300000 AS ts_ms, price AS units FROM ev WHERE event_type = 'view'",
    "io7_json_payloads": f"WITH {TAPE} SELECT trade_id, price, qty, ts_ms, aggressor FROM trades WHERE trade_id % 10 <> 0",
    "io9_quarantine": f"WITH {TAPE} SELECT CASE WHEN trade_id % 50 = 0 THEN 'decimal' ELSE 'quantity' END AS reason, count(*) AS n FROM ev WHERE event_type <> 'error' AND (trade_id % 50 = 0 OR qty <= 0) GROUP BY 1",
    "io11_dataset_manifest": f"WITH {TAPE} SELECT aggressor || 's' AS \"table\", count(*) AS n_rows, true AS intact FROM trades GROUP BY 1",
    "io14_tsv_export": f"WITH {TAPE} SELECT instrument, aggressor, count(*) AS n FROM trades GROUP BY 1, 2",
}
