"""SQL building blocks of the twins: the same views as ``views`` in plain SQL."""

from __future__ import annotations

K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"

TRADES = f"""trades AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
         CAST({K} + 1 AS DOUBLE) AS size,
         CASE event_id % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' ELSE 'Unknown' END AS side
  FROM events)"""


def bars(step: str = "5 minutes", source: str = "trades") -> str:
    """Bars CTE; NULL-free denominators as in the zero-safe ratio."""
    return f"""bars AS (
  SELECT symbol, time_bucket(INTERVAL '{step}', ts) AS bar,
         arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(size) AS volume,
         sum(CASE WHEN lower(side) = 'buy' THEN size ELSE 0 END) AS vol_buy,
         sum(CASE WHEN lower(side) = 'sell' THEN size ELSE 0 END) AS vol_sell,
         count(*) AS trade_count, sum(price * size) AS dollar_val,
         sum(price * size) / CASE WHEN sum(size) = 0 THEN 1 ELSE sum(size) END AS vwap,
         sum(CASE WHEN lower(side) = 'buy' THEN size ELSE 0 END)
           / CASE WHEN sum(size) = 0 THEN 1 ELSE sum(size) END AS taker_buy_ratio
  FROM {source} WHERE price IS NOT NULL GROUP BY 1, 2)"""


INDEXED = """ix AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS idx,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM {source})"""


def indexed(source: str = "bars") -> str:
    return INDEXED.format(source=source)


LEVELS = f"""levels AS (
  SELECT event_type AS symbol, event_id // 25 AS seq, ts, event_id AS pos,
         CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'a' END AS side,
         CASE WHEN user_id % 2 = 0 THEN (800 - (user_id // 2) % 25) / 8
              ELSE (801 + (user_id // 2) % 25) / 8 END AS price,
         CASE WHEN {K} % 10 = 0 THEN 0.0 ELSE value END AS size
  FROM events),
msgs AS (
  SELECT symbol, seq, max(ts) AS ts, seq % 100 = 0 AS snap FROM levels GROUP BY 1, 2)"""

# Interval form: a level lives until its next update or the next snapshot.
INTERVALS = LEVELS + """,
epochs AS (
  SELECT symbol, seq AS epoch, lead(seq) OVER (PARTITION BY symbol ORDER BY seq) AS epoch_end
  FROM msgs WHERE snap),
upd AS (
  SELECT l.*, e.epoch, e.epoch_end FROM levels l JOIN epochs e
    ON l.symbol = e.symbol AND l.seq >= e.epoch
   AND (e.epoch_end IS NULL OR l.seq < e.epoch_end)),
nx AS (
  SELECT *, lead(seq) OVER (PARTITION BY symbol, epoch, side, price ORDER BY seq, pos) AS nxt
  FROM upd),
intervals AS (
  SELECT symbol, epoch, side, price, size, seq AS seq_from,
         coalesce(nxt, epoch_end) AS seq_to
  FROM nx WHERE size <> 0 AND coalesce(nxt, epoch_end, seq + 1) > seq)"""

# Replay form, independent of intervals: last update at or before the sample.
BOOK_AT = LEVELS + """,
samples AS (
  SELECT symbol, seq, ts FROM msgs
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq) % 5 = 0),
epochs AS (
  SELECT s.symbol, s.seq, max(m.seq) AS epoch
  FROM samples s JOIN msgs m ON m.symbol = s.symbol AND m.snap AND m.seq <= s.seq
  GROUP BY 1, 2),
state AS (
  SELECT s.symbol, s.seq, s.ts, l.side, l.price, arg_max(l.size, l.pos) AS size
  FROM samples s JOIN epochs e ON e.symbol = s.symbol AND e.seq = s.seq
  JOIN levels l ON l.symbol = s.symbol AND l.seq BETWEEN e.epoch AND s.seq
  GROUP BY 1, 2, 3, 4, 5),
book AS (SELECT * FROM state WHERE size <> 0),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY symbol, seq, side ORDER BY CASE WHEN side = 'b' THEN -price ELSE price END) AS rank
  FROM book)"""


# The same book at the last message of each time step.
BOOK_AT_TIMES = BOOK_AT.replace(
    BOOK_AT[BOOK_AT.index("samples AS") : BOOK_AT.index("epochs AS")],
    """samples AS (
  SELECT symbol, max(seq) AS seq, arg_max(ts, seq) AS ts FROM msgs
  GROUP BY symbol, time_bucket(INTERVAL '30 minutes', ts)),
""",
)


def metrics(k: int, book: str = BOOK_AT) -> str:
    side = lambda s, e: f"max(CASE WHEN side = '{s}' AND rank = 1 THEN {e} END)"
    dep = lambda s: f"sum(CASE WHEN side = '{s}' THEN size END)"
    return book + f""",
agg AS (
  SELECT symbol, seq, ts, {side('b', 'price')} AS bb, {side('b', 'size')} AS bs,
         {side('a', 'price')} AS ba, {side('a', 'size')} AS sa,
         min(CASE WHEN side = 'b' THEN price END) AS b_deep,
         max(CASE WHEN side = 'a' THEN price END) AS a_deep,
         {dep('b')} AS bd, {dep('a')} AS ad
  FROM ranked WHERE rank <= {k} GROUP BY 1, 2, 3),
metrics AS (
  SELECT symbol, seq, ts, ba - bb AS spread,
         (ba * bs + bb * sa) / (bs + sa + 1e-9) - (ba + bb) / 2 AS micro_dev,
         (bd - ad) / (bd + ad + 1e-9) AS imbalance, bd AS bid_depth, ad AS ask_depth,
         CASE WHEN bd > 0 THEN (bb - b_deep) / bd ELSE 0 END AS bid_slope,
         CASE WHEN ad > 0 THEN (a_deep - ba) / ad ELSE 0 END AS ask_slope,
         CASE WHEN bd > 0 THEN bs / bd ELSE 0 END AS bid_integrity,
         CASE WHEN ad > 0 THEN sa / ad ELSE 0 END AS ask_integrity
  FROM agg WHERE bb IS NOT NULL AND ba IS NOT NULL)"""


MEANS = ["bid_depth", "ask_depth", "bid_slope", "ask_slope", "bid_integrity", "ask_integrity"]
OB_COLUMNS = [
    "ob_spread_mean", "ob_micro_dev_mean", "ob_micro_dev_std", "ob_micro_dev_last",
    "ob_imbalance_mean", "ob_imbalance_last", *[f"ob_{m}_mean" for m in MEANS],
]


def book_bars(step: str = "5 minutes", k: int = 50, std: str = "stddev_samp", source="metrics") -> str:
    head = metrics(k)
    return head + f""",
book_bars AS (
  SELECT symbol, time_bucket(INTERVAL '{step}', ts) AS bar,
         avg(spread) AS ob_spread_mean, avg(micro_dev) AS ob_micro_dev_mean,
         {std}(micro_dev) AS ob_micro_dev_std, arg_max(micro_dev, seq) AS ob_micro_dev_last,
         avg(imbalance) AS ob_imbalance_mean, arg_max(imbalance, seq) AS ob_imbalance_last,
         {", ".join(f"avg({m}) AS ob_{m}_mean" for m in MEANS)}
  FROM {source} GROUP BY 1, 2)"""


def joined(step: str = "5 minutes") -> str:
    """Bars with forward-filled book columns, zero before the first book bar."""
    fill = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}" for c in OB_COLUMNS
    )
    return (
        book_bars(step) + ", " + TRADES + ", " + bars(step)
        + f""",
joined AS (
  SELECT b.*, {fill} FROM bars b LEFT JOIN book_bars k USING (symbol, bar)
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar ROWS UNBOUNDED PRECEDING))"""
    )
