"""The tape and its bars in plain SQL, as common table expressions for the twins of the registered queries."""

TAPE = """
ev AS (SELECT user_id % 4 AS instrument, epoch_us(ts) // 1000 AS ts_ms, event_id AS trade_id,
  CAST(round(value * 100000000) AS BIGINT) AS price, CAST(json_extract(props, '$.k') AS BIGINT) AS qty,
  CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'buy' ELSE 'sell' END AS aggressor, event_type FROM events),
trades AS (SELECT instrument, ts_ms, trade_id, price, qty, aggressor FROM ev WHERE event_type <> 'error' AND qty > 0),
gaps AS (SELECT instrument, ts_ms AS start_ms, ts_ms + 300000 AS end_ms FROM ev WHERE event_type = 'error')
"""


def bars(width: int, name: str = "bars") -> str:
    return f"""
{name} AS (SELECT instrument, ts_ms - ts_ms % {width} AS bar_ms, first(price ORDER BY ts_ms, trade_id) AS open,
  max(price) AS high, min(price) AS low, last(price ORDER BY ts_ms, trade_id) AS close,
  CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(CASE WHEN aggressor = 'buy' THEN qty ELSE 0 END) AS BIGINT) AS buy_volume,
  CAST(sum(CASE WHEN aggressor = 'sell' THEN qty ELSE 0 END) AS BIGINT) AS sell_volume, count(*) AS n_trades,
  CAST(sum(CASE WHEN aggressor = 'buy' THEN qty ELSE -qty END) AS BIGINT) AS delta,
  CAST(sum(CASE WHEN price * qty >= 2000000000000 THEN qty ELSE 0 END) AS BIGINT) AS large_volume,
  count(*) FILTER (WHERE price * qty >= 2000000000000) AS n_large FROM trades GROUP BY 1, 2)
"""


def dense(width: int, source: str = "bars", name: str = "dense") -> str:
    return f"""
{name}_span AS (SELECT instrument AS i, min(bar_ms) AS a, max(bar_ms) AS b FROM {source} GROUP BY 1),
{name}_grid AS (SELECT i AS instrument, unnest(range(a, b + 1, {width})) AS bar_ms, a FROM {name}_span),
{name}_hit AS (SELECT DISTINCT instrument, unnest(range(start_ms - start_ms % {width}, end_ms - end_ms % {width} + 1, {width})) AS bar_ms FROM gaps),
{name} AS (SELECT g.instrument, g.bar_ms, b.open, b.high, b.low, b.close, coalesce(b.volume, 0) AS volume,
  coalesce(b.buy_volume, 0) AS buy_volume, coalesce(b.sell_volume, 0) AS sell_volume, coalesce(b.n_trades, 0) AS n_trades,
  coalesce(b.delta, 0) AS delta, coalesce(b.large_volume, 0) AS large_volume, g.bar_ms = g.a AS partial_start, h.bar_ms IS NOT NULL AS feed_gap
  FROM {name}_grid g LEFT JOIN {source} b USING (instrument, bar_ms) LEFT JOIN {name}_hit h ON h.instrument = g.instrument AND h.bar_ms = g.bar_ms)
"""
