"""DuckDB SQL of the adapters, shared by the oracles."""

from __future__ import annotations


def trades(key: str = "user_id") -> str:
    """CTE ``tape``: events as trades."""
    return f"""tape AS (SELECT CAST({key} AS VARCHAR) AS ticker, epoch_us(ts) / 1e6 AS ts, event_id AS seq, epoch_us(ts) AS us, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS notional,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('error', 'click') THEN -1 ELSE 0 END AS side,
  CASE event_type WHEN 'signup' THEN 'TransactionData' WHEN 'error' THEN 'OrderData' WHEN 'click' THEN 'TickData' ELSE 'TradeData' END AS kind,
  user_id, event_type FROM events)"""


def bars(interval: int) -> str:
    """CTE ``bars``: closes and sums of the tape's time buckets."""
    return f"""bars AS (SELECT ticker, CAST(floor(ts / {interval}) AS BIGINT) AS idx, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, sum(notional) AS notional, count(*) AS n_trades FROM tape GROUP BY ALL)"""


WEIGHTS = """w0 AS (SELECT event_type AS ticker, CAST(count(*) AS DOUBLE) AS raw FROM events GROUP BY 1),
weights AS (SELECT ticker, raw / (SELECT sum(raw) FROM w0) AS weight FROM w0)"""

TOD = "(ts - 86400.0 * floor(ts / 86400.0))"
SESSION = f"({TOD} >= 34200 AND {TOD} <= 54000 AND NOT ({TOD} > 41400 AND {TOD} < 46800))"
ELAPSED = f"({TOD} - 34200 - CASE WHEN {TOD} > 41400 THEN least({TOD}, 46800) - 41400 ELSE 0 END)"


def ema(source: str, value: str, alpha: float, keys: str = "ticker", order: str = "idx") -> str:
    """Recursive CTE ``ema`` over numbered rows of ``source``."""
    on = " AND ".join(f"r.{k} = e.{k}" for k in keys.split(", "))
    cols = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""rows_ AS (SELECT {keys}, {order}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {source} WHERE {value} IS NOT NULL),
ema AS (SELECT {keys}, {order}, n, x AS ema FROM rows_ WHERE n = 1
  UNION ALL SELECT {cols}, r.{order}, r.n, {alpha} * r.x + (1 - {alpha}) * e.ema FROM ema e JOIN rows_ r ON {on} AND r.n = e.n + 1)"""
