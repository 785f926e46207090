"""Step rules shared by the stateful streams and their batch twins: one row in, state changed, fills out."""

from __future__ import annotations

from dataclasses import dataclass, fields

from barloom.spec import DayLimits

_SQL = {"str": "string", "float": "double", "int": "bigint", "bool": "boolean"}


class _State:
    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]

    @classmethod
    def schema(cls) -> str:
        return ", ".join(f"{f.name} {_SQL[f.type]}" for f in fields(cls))


@dataclass
class Breaker(_State):
    """Day totals of one account."""

    net: float = 0.0
    streak: int = 0
    trades: int = 0
    halted: bool = False
    reason: str = ""


def pass_breaker(b: Breaker, pnl: float, limits: DayLimits) -> tuple:
    """Totals after one more closed trade; the first rule to trip stays for the day."""
    b.net += pnl
    b.trades += 1
    b.streak = 0 if pnl > 0 else b.streak + 1
    if not b.halted:
        if limits.max_loss > 0 and b.net <= -limits.max_loss:
            b.reason = "max loss"
        elif limits.profit_target > 0 and b.net >= limits.profit_target:
            b.reason = "profit target"
        elif limits.max_loss_streak > 0 and b.streak >= limits.max_loss_streak:
            b.reason = "loss streak"
        b.halted = b.reason != ""
    return b.net, b.streak, b.trades, b.halted, b.reason or None
