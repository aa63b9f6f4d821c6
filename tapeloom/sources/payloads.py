"""Live JSON payloads of each kind, with a quarantine. Keys differ by case alone, so payloads are read as maps, not structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.archive import split, whole
from tapeloom.sources.exchange import exact_decimal


def fields(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def once(value: Column) -> Column:
    """The same value, worked out once a row: the optimizer puts no expression of a generator in the place of its name."""
    return F.explode(F.array(value))


def levels(text: Column) -> Column:
    """Array of (price, qty) from pairs of texts; null if a pair isn't two exact numbers. Texts are parsed once."""
    level = lambda p: F.struct(exact_decimal(F.get(p, F.lit(0))).alias("price"), exact_decimal(F.get(p, F.lit(1))).alias("qty"), F.size(p).alias("n"))
    out = F.transform(F.from_json(text, "array<array<string>>"), level)
    broken = lambda x: F.exists(x, lambda p: (p["n"] != 2) | p["price"].isNull() | p["qty"].isNull())
    plain = lambda x: F.transform(x, lambda p: F.struct(p["price"].alias("price"), p["qty"].alias("qty")))
    return F.get(F.transform(F.array(out), lambda x: F.when(~broken(x), plain(x))), F.lit(0))


def mark_price(m: Column) -> tuple[dict, Callable]:
    v = {"ts_ms": whole(m["E"]), **{n: exact_decimal(m[k]) for n, k in (("mark_price", "p"), ("index_price", "i"), ("funding_rate", "r"))}, "next_funding_ms": whole(m["T"])}
    return v, lambda v: {"kind": ~m["e"].eqNullSafe("markPriceUpdate"), "price": F.least(v["mark_price"], v["index_price"]) <= 0}


def liquidation(m: Column, o: Column) -> tuple[dict, Callable]:
    """The order's own side: SELL closes a long."""
    v = {"ts_ms": whole(o["T"]), "aggressor": F.when(o["S"] == "SELL", "sell").when(o["S"] == "BUY", "buy"), **{n: exact_decimal(o[k]) for n, k in (("price", "p"), ("avg_price", "ap"), ("qty", "z"))}}
    return v, lambda v: {"kind": ~m["e"].eqNullSafe("forceOrder"), "price": F.least(v["price"], v["avg_price"]) <= 0, "quantity": v["qty"] < 0}


def kline(m: Column, k: Column) -> tuple[dict, Callable]:
    """One-minute bars that have closed; open ones have the reason 'open'."""
    v = {"open_ms": whole(k["t"]), "close_ms": whole(k["T"]), **{n: exact_decimal(k[n[0]]) for n in ("open", "high", "low", "close", "volume")}, "taker_buy_volume": exact_decimal(k["V"]), "n_trades": whole(k["n"])}
    return v, lambda v: {"kind": ~m["e"].eqNullSafe("kline"), "interval": ~k["i"].eqNullSafe("1m"), "open": ~k["x"].eqNullSafe("true")}


def open_interest(m: Column) -> tuple[dict, Callable]:
    v = {"ts_ms": whole(m["time"]), "open_interest": exact_decimal(m["openInterest"])}
    return v, lambda v: {"quantity": v["open_interest"] < 0}


def depth(m: Column) -> tuple[dict, Callable]:
    """A quantity of zero removes a level."""
    v = {"ts_ms": whole(m["T"]), **{n: whole(m[k]) for n, k in (("first_id", "U"), ("last_id", "u"), ("prev_id", "pu"))}, "bids": levels(m["b"]), "asks": levels(m["a"])}
    bad = lambda x: (x["price"] <= 0) | (x["qty"] < 0)
    return v, lambda v: {"kind": ~m["e"].eqNullSafe("depthUpdate"), "id_range": v["first_id"] > v["last_id"], "level": F.exists(F.concat(v["bids"], v["asks"]), bad)}


def depth_snapshot(m: Column) -> tuple[dict, Callable]:
    v = {"ts_ms": whole(m["T"]), "last_id": whole(m["lastUpdateId"]), "bids": levels(m["bids"]), "asks": levels(m["asks"])}
    return v, lambda v: {"level": F.exists(F.concat(v["bids"], v["asks"]), lambda x: (x["price"] <= 0) | (x["qty"] <= 0))}


#: Kinds whose fields lie in an object of their own.
NESTED = {"forceOrder": "o", "kline_1m": "k"}
KINDS: dict[str, Callable[..., tuple[dict[str, Column], Callable[[dict[str, Column]], dict[str, Column]]]]] = {
    "markPrice": mark_price, "forceOrder": liquidation, "kline_1m": kline, "openInterest": open_interest, "depth": depth, "depthSnapshot": depth_snapshot,
}


def parse(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """IO7: (rows of the kind, quarantine with its reason) of payloads of one stream; works on batch and streaming tables alike."""
    r = raw.withColumn("__m", once(fields(F.col("payload"))))
    if kind in NESTED:
        r = r.withColumn("__n", once(fields(F.col("__m")[NESTED[kind]])))
    values, rules = KINDS[kind](*[F.col(c) for c in ("__m", "__n") if c in r.columns])
    r = r.withColumn("__v", once(F.struct(*[v.alias(n) for n, v in values.items()])))
    known = {n: F.col(f"__v.{n}") for n in values}
    good, bad = split(r, known, rules(known))
    return good, bad.drop("__m", "__n", "__v")
