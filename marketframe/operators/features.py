"""Bar features: trend, flow, book and regime columns.

``add_features`` takes row-numbered bars (``symbol, bar, idx, n, open, high,
low, close, volume`` and optional flow and book columns).  Book groups appear
only if their inputs do.  Missing values end as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.num import ratio, ratio_or_null
from ..functions.scan import chunk_with_past
from ..functions.windows import (
    CHUNK, FAST_BLOCK, HALO, SLOW_BLOCK, Ewm, Long, add_ewm, add_long_rolling,
    lag, rolling_mean, rolling_std, rolling_sum, span,
)

# Periods of the trend indicators, in bars.
EMA_PERIODS = (9, 21, 50)
ATR_PERIOD = 14
RSI_PERIOD = 14

TREND = [
    "atr", "natr", *[f"dist_ema_{p}" for p in EMA_PERIODS], "rsi", "bb_percent_b",
    *[f"ema_{p}_slope" for p in EMA_PERIODS],
]
FLOW = [
    "taker_buy_z", "vol_z", "vwap_4h_dist", "vwap_24h_dist", "vol_intraday", "vol_macro",
]
REGIME = ["atr_z", "macro_dist_3d", "macro_dist_1d", "atr_regime", "atr_macro"]
BOOK = [
    "ob_imb_trend", "micro_pressure", "bid_depth_chg", "ask_depth_chg", "spread_z",
    "ob_spread_bps", "ob_depth_log_ratio", "ob_imbalance_z", "price_liq_div",
    "liq_dominance", "micro_dev_vol",
]
SLOPE = ["ob_bid_elasticity", "ob_ask_elasticity", "ob_slope_ratio", "bid_slope_z"]
INTEGRITY = ["ob_integrity_skew", "bid_integrity_chg", "ask_integrity_chg"]


def _c(name: str) -> Column:
    return F.col(name)


def _zscore(x: Column, n: int, centre: Column | None = None) -> Column:
    mid = rolling_mean(x, n) if centre is None else centre
    return ratio_or_null(x - mid, rolling_std(x, n))


def _movement(df: DataFrame) -> DataFrame:
    prev = lag(_c("close"))
    change = _c("close") - prev
    true_range = F.when(
        prev.isNotNull(),
        F.greatest(
            _c("high") - _c("low"), F.abs(_c("high") - prev), F.abs(_c("low") - prev)
        ),
    )
    return df.withColumns(
        {
            "_tr": true_range,
            "_chg": change,
            "_gain": F.when(change > 0, change).otherwise(0.0),
            "_loss": F.when(change < 0, -change).otherwise(0.0),
        }
    )


def _averages(df: DataFrame) -> DataFrame:
    fast = [Ewm(f"_ema_{p}", "close", span(p), True) for p in EMA_PERIODS]
    fast += [
        Ewm("atr", "_tr", span(ATR_PERIOD), False, seed=1),
        Ewm("_up", "_gain", 1.0 / RSI_PERIOD, False),
        Ewm("_down", "_loss", 1.0 / RSI_PERIOD, False),
    ]
    slow = [
        Ewm("_ema_3d", "close", span(864), True, min_periods=100),
        Ewm("_ema_1d", "close", span(288), True, min_periods=50),
    ]
    return add_ewm(add_ewm(df, fast, FAST_BLOCK), slow, SLOW_BLOCK)


def _rsi() -> Column:
    up, down = _c("_up"), _c("_down")
    return F.when(down != 0, 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))).when(
        up > 0, 100.0
    )


def _trend() -> dict[str, Column]:
    close, atr = _c("close"), _c("atr")
    mid, dev = rolling_mean(close, 20), rolling_std(close, 20)
    out = {"rsi": _rsi()}
    band = (close - (mid - 2 * dev)) / ((mid + 2 * dev) - (mid - 2 * dev) + 1e-9)
    out["bb_percent_b"] = F.coalesce(band, F.lit(0.5))
    for p in EMA_PERIODS:
        ema = _c(f"_ema_{p}")
        out[f"dist_ema_{p}"] = ratio_or_null(close - ema, atr)
        out[f"ema_{p}_slope"] = ratio(ema - lag(ema, 5), atr)
    return out


def _flow(columns: list[str]) -> dict[str, Column]:
    close, volume, atr = _c("close"), _c("volume"), _c("atr")
    out = {}
    if "taker_buy_ratio" in columns:
        out["taker_buy_z"] = _zscore(_c("taker_buy_ratio"), 24, F.lit(0.5))
    out["vol_z"] = _zscore(volume, 24)
    vwap = ratio(rolling_sum(_c("_dollar"), 48, 12), rolling_sum(volume, 48, 12))
    out["vwap_4h_dist"] = ratio(close - vwap, atr)
    out["vwap_24h_dist"] = ratio(close - ratio(_c("_usd_288"), _c("_vol_288")), atr)
    out["vol_intraday"] = ratio(rolling_mean(volume, 12, 3), _c("_vmean_288"))
    out["vol_macro"] = ratio(_c("_vmean_288"), _c("_vmean_8640"))
    return out


def _regime() -> dict[str, Column]:
    close, natr, atr = _c("close"), _c("natr"), _c("atr")
    return {
        "atr_z": _zscore(natr, 24),
        "macro_dist_3d": ratio(close - _c("_ema_3d"), atr),
        "macro_dist_1d": ratio(close - _c("_ema_1d"), atr),
        "atr_regime": ratio(rolling_mean(natr, 12), _c("_natr_288")),
        "atr_macro": ratio(_c("_natr_288"), _c("_natr_8640")),
    }


def _pct_change(x: Column) -> Column:
    prev = lag(x)
    return ratio_or_null(x - prev, prev)


def _book() -> dict[str, Column]:
    close, atr = _c("close"), _c("atr")
    bid, ask = _c("ob_bid_depth_mean"), _c("ob_ask_depth_mean")
    imb, spread = _c("ob_imbalance_mean"), _c("ob_spread_mean")
    depth = ratio(bid, ask)
    return {
        "ob_imb_trend": rolling_mean(imb, 4),
        "micro_pressure": ratio_or_null(_c("ob_micro_dev_mean"), atr),
        "bid_depth_chg": _pct_change(bid),
        "ask_depth_chg": _pct_change(ask),
        "spread_z": _zscore(spread, 24),
        "ob_spread_bps": ratio_or_null(spread, close) * 10000,
        "ob_depth_log_ratio": F.ln(F.when(depth == 0, 1e-9).otherwise(depth)),
        "ob_imbalance_z": _zscore(imb, 16),
        "price_liq_div": F.signum("_chg") * F.signum(imb - lag(imb)),
        "liq_dominance": ratio(bid + ask, _c("volume")),
        "micro_dev_vol": ratio(_c("ob_micro_dev_std"), atr),
    }


def _slope() -> dict[str, Column]:
    bid, ask = _c("ob_bid_elasticity"), _c("ob_ask_elasticity")
    return {"ob_slope_ratio": ratio(bid, ask), "bid_slope_z": _zscore(bid, 24)}


def _integrity() -> dict[str, Column]:
    bid, ask = _c("ob_bid_integrity_mean"), _c("ob_ask_integrity_mean")
    return {
        "ob_integrity_skew": bid - ask,
        "bid_integrity_chg": bid - lag(bid),
        "ask_integrity_chg": ask - lag(ask),
    }


def add_features(
    bars: DataFrame,
    groups: tuple[str, ...] = ("trend", "flow", "book", "regime"),
    chunk: int = CHUNK,
    halo: int = HALO,
    priced_only: bool = True,
) -> DataFrame:
    """Add the feature columns of ``groups`` and drop rows without a price.

    Row numbers stay dense after the drop if ``with_row_index`` was given
    ``valid = close > 0``; forward searches and sequences rely on that.
    Without ``priced_only`` all rows stay, with their numbers; ``priced`` drops them later.
    One exchange on (symbol, chunk) serves every window.  ``chunk`` and
    ``halo`` must be multiples of the slow block length.
    """
    if chunk % SLOW_BLOCK or halo % SLOW_BLOCK or halo > chunk:
        raise ValueError("chunk and halo must be multiples of the slow block")
    columns = list(bars.columns)
    df = _averages(_movement(chunk_with_past(bars, chunk, halo)))
    dollar = _c("dollar_val") if "dollar_val" in columns else _c("close") * _c("volume")
    df = df.withColumns({"natr": ratio_or_null(_c("atr"), _c("close")), "_dollar": dollar})
    longs, made = [], ["atr", "natr"]
    if "flow" in groups:
        longs += [
            Long("_usd_288", "sum", "_dollar", 288, 24),
            Long("_vol_288", "sum", "volume", 288, 24),
            Long("_vmean_288", "mean", "volume", 288, 24),
            Long("_vmean_8640", "mean", "volume", 8640, 288),
        ]
    if "regime" in groups:
        longs += [
            Long("_natr_288", "mean", "natr", 288, 288),
            Long("_natr_8640", "mean", "natr", 8640, 288),
        ]
    if longs:
        df = add_long_rolling(df, longs)
    new: dict[str, Column] = {}
    if "trend" in groups:
        new |= _trend()
    if "flow" in groups:
        new |= _flow(columns)
    if "regime" in groups:
        new |= _regime()
    if "book" in groups and "ob_imbalance_mean" in columns:
        new |= _book()
        if "ob_bid_slope_mean" in columns:
            price = F.when(_c("close") == 0, 1.0).otherwise(_c("close"))
            df = df.withColumns(
                {
                    f"ob_{s}_elasticity": _c(f"ob_{s}_slope_mean") / price * 10000
                    for s in ("bid", "ask")
                }
            )
            new |= _slope()
            made += ["ob_bid_elasticity", "ob_ask_elasticity"]
        if "ob_bid_integrity_mean" in columns:
            new |= _integrity()
    made += [m for m in new if m not in made]
    used = ("vol_buy", "vol_sell", "volume", "dollar_val")
    kept = [c for c in columns if c not in used]
    rows = df.withColumns(new).filter("_own").select(
        *kept, *[F.coalesce(_c(m), F.lit(0.0)).alias(m) for m in made]
    )
    return priced(rows) if priced_only else rows


def priced(rows: DataFrame) -> DataFrame:
    """Rows with a price, with their own dense numbers where ``with_row_index`` gave them."""
    rows = rows.filter(_c("close") > 0)
    if "valid_idx" in rows.columns:
        rows = rows.withColumns({"idx": _c("valid_idx"), "n": _c("valid_n")})
    return rows.drop("valid_idx", "valid_n")
