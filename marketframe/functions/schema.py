"""Choices made from column names only (driver metadata, no data read)."""

from __future__ import annotations

from collections.abc import Sequence

# Columns that are never model inputs.
NOT_FEATURES = [
    "open", "high", "low", "volume", "vwap", "datetime", "target_long", "target_short",
    "pred_long", "pred_short", "vol_delta", "buy_vol", "vol_sell", "trade_count", "sell_vol",
    "dollar_val", "total_val", "ob_imbalance_last", "ob_spread_mean", "ob_bid_depth_mean",
    "ob_ask_depth_mean", "ob_micro_dev_std", "ob_micro_dev_last", "ob_micro_dev_mean",
    "ob_imbalance_mean", "target_dir_long", "target_dir_short", "pred_dir_long",
    "pred_dir_short", "atr", "price_path",
]

# Book columns that are model inputs in spite of their prefix.
BOOK_FEATURES = [
    "ob_imbalance_z", "ob_spread_ratio", "ob_bid_impulse", "ob_ask_impulse", "ob_depth_ratio",
    "ob_spread_bps", "ob_depth_log_ratio", "price_liq_div", "liq_dominance", "micro_dev_vol",
    "ob_imb_trend", "micro_pressure", "bid_depth_chg", "ask_depth_chg", "spread_z",
    "ob_slope_ratio", "bid_slope_z", "ob_bid_elasticity", "ob_ask_elasticity",
    "ob_bid_integrity_mean", "ob_ask_integrity_mean", "ob_integrity_skew", "bid_integrity_chg",
    "ask_integrity_chg",
]

# Name parts of price-trend indicators.
TREND_PARTS = ("ema_", "dist_ema_", "rsi", "atr", "natr")

# Name parts of volatility and regime context columns.
CONTEXT_PARTS = ("atr", "vol", "rsi", "std", "slope")


def select_features(
    columns: Sequence[str],
    keys: Sequence[str] = ("symbol", "bar", "idx", "n", "valid_idx", "valid_n"),
    microstructure_only: bool = False,
) -> list[str]:
    """Model inputs among ``columns`` in their given order."""
    keep = []
    for name in columns:
        if name in keys:
            continue
        plain = name not in NOT_FEATURES and not name.startswith("ob_")
        if plain or name in BOOK_FEATURES:
            keep.append(name)
    if microstructure_only:
        keep = [c for c in keep if not any(part in c for part in TREND_PARTS)]
    return keep


def context_columns(features: Sequence[str], fallback: Sequence[str] | None = None) -> list[str]:
    """Volatility and regime columns among ``features``.

    Without any, the explicit ``fallback`` is used; having neither is an error.
    """
    found = [c for c in features if any(p in c.lower() for p in CONTEXT_PARTS)]
    if not found and fallback is None:
        raise ValueError("no context column among the features; name them in fallback")
    return found or list(fallback)
