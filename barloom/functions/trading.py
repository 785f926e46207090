"""Column formulas of costs, sizing, exits, fitness and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom.spec import CostSpec, ExitSpec


def sign_of(side: Column) -> Column:
    return F.when(F.upper(side) == "BUY", 1).otherwise(-1)


def gross_pnl(entry: Column, exit_: Column, qty: Column, side: Column) -> Column:
    return (exit_ - entry) * qty * sign_of(side)


def net_pnl(entry: Column, exit_: Column, qty: Column, side: Column, cost: CostSpec = CostSpec()) -> Column:
    """Slippage on both legs, taxes on both notionals, brokerage twice."""
    s = sign_of(side)
    slipped = (exit_ * (1 - s * cost.slip) - entry * (1 + s * cost.slip)) * s * qty
    return slipped - (entry + exit_) * qty * cost.tax - 2 * cost.brokerage


def net_pnl_at_fills(entry: Column, exit_: Column, qty: Column, side: Column, cost: CostSpec = CostSpec()) -> Column:
    """For prices that already contain slippage: taxes and brokerage only."""
    return gross_pnl(entry, exit_, qty, side) - (entry + exit_) * qty * cost.tax - 2 * cost.brokerage


def round_to_tick(price: Column, tick: float) -> Column:
    return F.rint(price / tick) * tick if tick > 0 else F.round(price, 2)


def entry_fill(price: Column, side: Column, cost: CostSpec = CostSpec()) -> Column:
    return round_to_tick(price * (1 + sign_of(side) * cost.slip), cost.tick)


def exit_fill(price: Column, side: Column, cost: CostSpec = CostSpec()) -> Column:
    return round_to_tick(price * (1 - sign_of(side) * cost.slip), cost.tick)


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(lo), F.least(x, as_col(hi)))


def stop_distance(entry: Column, atr: Column, spec: ExitSpec, mult: Column | None = None,
                  band: tuple[Column, Column] | None = None) -> Column:
    """ATR multiple (or a share of the price without ATR) within the allowed band."""
    m = mult if mult is not None else F.lit(spec.atr_mult)
    lo, hi = band if band is not None else (F.lit(spec.min_stop), F.lit(spec.max_stop))
    raw = F.when(atr > 0, m * atr).otherwise(spec.fallback_stop * entry)
    return F.greatest(entry * lo, F.least(raw, entry * hi))


def sl_target(entry: Column, direction: Column, atr: Column, spec: ExitSpec, mult: Column | None = None,
              ratio: Column | None = None, pick_sl: Column | None = None, pick_tgt: Column | None = None,
              band: tuple[Column, Column] | None = None) -> Column:
    """Struct (sl, tgt, dist). A positive learned pick (both in ATR) replaces multiple and ratio."""
    m = mult if mult is not None else F.lit(spec.atr_mult)
    rr = ratio if ratio is not None else F.lit(spec.reward_ratio)
    if pick_sl is not None and pick_tgt is not None:
        picked = (pick_sl > 0) & (pick_tgt > 0)
        m, rr = F.when(picked, pick_sl).otherwise(m), F.when(picked, pick_tgt / pick_sl).otherwise(rr)
    dist = stop_distance(entry, atr, spec, m, band)
    cut = (lambda c: F.round(c, spec.price_decimals)) if spec.price_decimals is not None else (lambda c: c)
    return F.struct(cut(entry - direction * dist).alias("sl"), cut(entry + direction * rr * dist).alias("tgt"), dist.alias("dist"))


def position_size(entry: Column, dist: Column, spec: ExitSpec, weight: Column | None = None) -> Column:
    """Units allowed by the weighted risk budget and by the capital limit."""
    w = clamp(weight, spec.weight_floor, spec.weight_ceiling) if weight is not None else F.lit(1.0)
    by_risk = F.floor(spec.risk_budget * w / F.nullif(dist, F.lit(0.0)))
    by_cash = F.floor(spec.max_capital / F.nullif(entry, F.lit(0.0)))
    ok = (dist > 0) & (entry > 0)
    return F.when(ok, F.greatest(F.lit(0).cast("long"), F.least(by_risk, by_cash))).otherwise(F.lit(0).cast("long"))


def vol_multiplier(vol_pct: Column, reference: float = 0.30, lo: float = 0.7, hi: float = 1.6) -> Column:
    return F.when(vol_pct.isNull() | (vol_pct <= 0), 1.0).otherwise(clamp(vol_pct / reference, lo, hi))


def forecast_exit_adjust(entry: Column, direction: Column, dist: Column, target: Column, vol_pct: Column, exp_ret: Column,
                         min_rr: float = 1.2, cap_share: float = 0.9, decimals: int | None = 2) -> Column:
    """Struct (dist, target, note): stop scaled by forecast volatility, target pulled in to the expected move.

    Without a view (null ``exp_ret``) the exits stay. The target never moves out, and never below
    ``min_rr`` times the new stop.
    """
    cut = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    usable = exp_ret.isNotNull() & (entry > 0) & (dist > 0)
    mult = vol_multiplier(vol_pct)
    scaled = cut(dist * mult)
    new_dist = F.when(scaled > 0, scaled).otherwise(dist)
    expected = cut(entry + direction * entry * (F.abs(exp_ret) / 100.0) * cap_share)
    nearer = (F.signum(exp_ret) == direction) & (F.abs(expected - entry) < F.abs(target - entry))
    pulled = cut(entry + direction * F.greatest(F.abs(expected - entry), min_rr * new_dist))
    note = F.concat(F.lit("mult"), F.format_string("%.2f", mult), F.lit("/"),
                    F.when(nearer, F.concat(F.lit("cap@"), F.format_string("%.2f", F.abs(exp_ret)), F.lit("%"))).otherwise("rr"))
    return F.struct(F.when(usable, new_dist).otherwise(dist).alias("dist"),
                    F.when(usable & nearer, pulled).otherwise(target).alias("target"),
                    F.when(exp_ret.isNull(), "na").when(~usable, "off").otherwise(note).alias("note"))


def grid_score(p: Column, sl: Column, tgt: Column, atr_frac: Column, cost: CostSpec = CostSpec()) -> Column:
    """Expected R of a (stop, target) pair at win probability p, after round-trip costs."""
    trip = 2.0 * (cost.slippage_bps + cost.taxes_bps) / 1e4
    cost_r = F.when(atr_frac > 0, trip / atr_frac / sl).otherwise(0.0)
    return p * (tgt / sl) - (1.0 - p) - cost_r


def fitness(trades: Column, expectancy_r: Column, profit_factor: Column, drawdown_pct: Column, min_trades: int = 30) -> Column:
    """Composite of expectancy and profit factor, scaled by sample credibility and drawdown."""
    credible = trades / (trades + F.lit(float(min_trades)))
    calm = F.greatest(F.lit(0.0), 1.0 - drawdown_pct / 20.0)
    score = (2.0 * expectancy_r + F.least(profit_factor, F.lit(5.0)) - 1.0) * credible * calm
    return F.when(F.coalesce(trades, F.lit(0)) <= 0, -999.0).otherwise(score)


def fitness_ma(trades: Column, return_pct: Column, sharpe: Column, win_rate: Column) -> Column:
    score = (0.5 * return_pct + 10.0 * sharpe + 0.1 * win_rate) * F.least(F.lit(1.0), trades / 30.0)
    return F.when(trades < 5, -999.0).otherwise(score)


def health(trusted: Column, expectancy: Column, pf: Column, win_rate: Column) -> Column:
    score = F.tanh(expectancy / 150.0) + 0.5 * F.tanh(pf - 1.0) + (win_rate - 50.0) / 100.0
    return F.when(F.coalesce(trusted, F.lit(False)), score).otherwise(0.0)


def health_weight(score: Column, lo: float = 0.4, hi: float = 1.5) -> Column:
    return clamp(1.0 + 0.5 * score, lo, hi)


def smoothed_weight(previous: Column, target: Column, blend: float = 0.5, lo: float = 0.4, hi: float = 1.5) -> Column:
    return clamp(previous + blend * (target - previous), lo, hi)


def limited_step(old: Column, target: Column, max_step: float = 0.15, lo: float = 0.4, hi: float = 1.5) -> Column:
    start = clamp(old, lo, hi)
    return clamp(start + clamp(target - start, -max_step, max_step), lo, hi)


def vol_scale(predicted: Column, baseline: Column, lo: float = 0.65, hi: float = 1.60) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = finite(predicted) & finite(baseline) & (baseline > 0)
    return F.when(ok, clamp(predicted / F.nullif(baseline, F.lit(0.0)), lo, hi)).otherwise(1.0)


def vol_regime(scale: Column) -> Column:
    return F.when(scale >= 1.20, "HIGH_VOL").when(scale <= 0.85, "LOW_VOL").otherwise("NORMAL")
