"""Parameter values shared by the operators.

Every rule that depends on a clock, a cost or a limit takes one of these
values as an argument, so that one process can run several rule sets at once.
Clock positions are minutes since midnight in the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


def hhmm(hour: int, minute: int = 0) -> int:
    return hour * 60 + minute


@dataclass(frozen=True)
class SessionSpec:
    # fixed values: cash-equity session of the Indian exchanges
    tz: str = "Asia/Kolkata"
    open: int = hhmm(9, 15)
    close: int = hhmm(15, 30)
    bar_minutes: int = 5
    range_end: int = hhmm(9, 30)
    scan_start: int = hhmm(9, 30)
    no_entry_after: int = hhmm(14, 30)
    square_off: int = hhmm(15, 15)
    zone_entry: tuple[int, int] = (hhmm(10), hhmm(14))
    breakout_entry: tuple[int, int] = (hhmm(9, 30), hhmm(11))
    gap_entry: tuple[int, int] = (hhmm(9, 30), hhmm(11, 30))
    candle_entry: tuple[int, int] = (hhmm(9, 30), hhmm(14, 30))
    zone_formation: tuple[int, int] = (hhmm(9), hhmm(11))
    min_range_bars: int = 3
    min_bars: int = 4
    min_candle_bars: int = 20

    def with_(self, **changes) -> "SessionSpec":
        return replace(self, **changes)


# The test tables carry round-the-clock hourly bars; the same rules then run on this clock.
AROUND_THE_CLOCK = SessionSpec(
    tz="UTC", open=0, close=hhmm(23, 59), bar_minutes=60,
    range_end=hhmm(3), scan_start=hhmm(3), no_entry_after=hhmm(20), square_off=hhmm(22),
    zone_entry=(hhmm(4), hhmm(20)), breakout_entry=(hhmm(3), hhmm(14)), gap_entry=(hhmm(3), hhmm(16)),
    candle_entry=(hhmm(3), hhmm(20)), zone_formation=(0, hhmm(18)), min_candle_bars=8,
)


@dataclass(frozen=True)
class CostSpec:
    # fixed values: basis points each way and currency per order
    slippage_bps: float = 3.0
    taxes_bps: float = 6.0
    brokerage: float = 0.0
    tick: float = 0.05

    @property
    def slip(self) -> float:
        return self.slippage_bps / 10_000

    @property
    def tax(self) -> float:
        return self.taxes_bps / 10_000


@dataclass(frozen=True)
class ExitSpec:
    # fixed values: stop and target sizing
    atr_mult: float = 1.5
    reward_ratio: float = 2.0
    fallback_stop: float = 0.005
    min_stop: float = 0.003
    max_stop: float = 0.015
    risk_budget: float = 500.0
    max_capital: float = 25_000.0
    weight_floor: float = 0.4
    weight_ceiling: float = 1.5
    min_reward_ratio: float = 1.2
    price_decimals: int | None = 2

    def with_(self, **changes) -> "ExitSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class EntrySpec:
    # fixed values: scoring and admission limits
    min_score: int = 6
    max_open: int = 5
    top_per_bar: int = 30
    min_turnover_lakhs: float = 25.0
    min_trend_strength: float = 20.0
    volume_ratio: float = 1.2
    require_confirmation: bool = False
    gate: str = "soft"
    gap_pct: tuple[float, float] = (1.0, 3.0)
    zone_slack_atr: float = 0.5
    zone_tick: float = 0.05
    zone_max_stop: float = 0.005

    def with_(self, **changes) -> "EntrySpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class DayLimits:
    # fixed values: circuit breakers of one trading day, zero switches a rule off
    max_loss: float = 1500.0
    profit_target: float = 0.0
    max_trades: int = 8
    max_loss_streak: int = 3
    cooldown_minutes: int = 30
    max_open: int = 5


@dataclass(frozen=True)
class RiskLimits:
    # fixed values: portfolio ceilings in currency
    max_heat: float = 2000.0
    max_symbol_notional: float = 50_000.0
    max_sector_notional: float = 150_000.0
    max_correlated: int = 3
    rho: float = 0.7


CAPITAL = 100_000.0
TRADING_DAYS = 252
