"""DuckDB spelling of the stand-in views and of a few shared steps."""

from __future__ import annotations


VIEWS = {
    "bars": """
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CAST(ts AS DATE) AS session_date,
         arg_min(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE, events.ts) AS open, max(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE) AS high,
         min(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE) AS low, arg_max(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE, events.ts) AS close,
         CAST(count(*) AS BIGINT) AS volume
  FROM events GROUP BY 1, 2, 3""",
    "index_bars": """
  SELECT date_trunc('hour', ts) AS ts, CAST(ts AS DATE) AS session_date,
         arg_min(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE, events.ts) AS open, max(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE) AS high,
         min(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE) AS low, arg_max(100.0::DOUBLE + value * 0.010471975511965976::DOUBLE, events.ts) AS close,
         CAST(count(*) AS BIGINT) AS volume
  FROM events GROUP BY 1, 2""",
    "ticks": """
  SELECT concat('U', user_id) AS symbol, ts, CAST(ts AS DATE) AS session_date, o AS open,
         greatest(o, c) + (event_id % 7)::DOUBLE * 0.5 AS high, least(o, c) - (event_id % 5)::DOUBLE * 0.5 AS low,
         c AS close, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 + event_id % 97 END::BIGINT AS volume
  FROM (SELECT *, 100.0::DOUBLE + (event_id % 50)::DOUBLE AS o, 100.0::DOUBLE + value * 1.0471975511965976::DOUBLE AS c FROM events)""",
    "trades": """
  SELECT event_id AS trade_id, concat('S', user_id % 50) AS symbol, event_type AS strategy,
         CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, ts AS exit_time,
         CAST(1 + event_id % 10 AS BIGINT) AS qty, 100.0::DOUBLE + (user_id % 50)::DOUBLE AS entry_price,
       (value - 50.0::DOUBLE) * 1.0471975511965976::DOUBLE AS pnl, (value - 50.0::DOUBLE) * 1.0471975511965976::DOUBLE / 50.0::DOUBLE AS r,
         CASE WHEN value >= 90 THEN 'TARGET' WHEN value < 20 THEN 'SL' WHEN event_id % 9 = 0 THEN 'PARTIAL'
              ELSE 'TIME_STALE' END AS outcome,
         CASE user_id % 3 WHEN 0 THEN 'view:agree(0.80)' WHEN 1 THEN 'view:disagree(0.40)' ELSE '' END AS tag
  FROM events""",
    "positions": """
  SELECT o_orderkey AS decision_id, concat('S', o_custkey % 40) AS symbol, o_orderpriority AS strategy,
         CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, o_totalprice * 0.0010471975511965976::DOUBLE AS entry,
         o_totalprice * 0.0010471975511965976::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 0.99::DOUBLE ELSE 1.01::DOUBLE END AS sl,
         CAST(1 + o_orderkey % 20 AS BIGINT) AS qty, o_orderdate AS opened_at
  FROM orders WHERE o_orderstatus = 'O'""",
    "sectors": """
  SELECT concat('S', c_custkey % 40) AS symbol, min(c_mktsegment) AS sector
  FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_custkey % 40""",
    "audit": """
  SELECT event_id, ts, user_id, concat('D', event_id % 500) AS decision_id,
         CASE event_type WHEN 'error' THEN 'order_rejected' WHEN 'signup' THEN 'signal_created'
              WHEN 'purchase' THEN 'order_submitted' WHEN 'click' THEN 'model_prediction'
              ELSE 'fallback_invoked' END AS event, props AS payload
  FROM events""",
}


def with_views(*names: str, recursive: bool = False, **steps: str) -> str:
    """``WITH`` clause over named views followed by extra steps, in order."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({body})" for n, body in steps.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
