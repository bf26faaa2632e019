"""Parameter presets of the money-flow model; frozen, validated, comparable."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    pressure: str = "sqrt"  # dollar, sqrt, relative
    lift: str = "excess"  # off, excess, ratio
    k_out: int = 20
    k_in: int = 10
    retention: float = 1.0
    dangling: str = "self"  # self, teleport
    hot_ref: str = "uniform"  # uniform, size
    half_life_slow: float = 20.0
    half_life_fast: float = 3.0
    half_life_long: float = 120.0
    adv_window: int = 20
    vol_window: int = 20
    corr_window: int = 60
    liquidity_floor: float = 1e6
    volume_cap: float = 5.0
    stale_bars: int = 5
    horizons: tuple[int, ...] = (1, 4, 8)
    alpha: float = 0.85
    beta: float = 0.5
    tilt: float = 1.0
    sinks: int = 256  # candidates for pairing on a bar
    row_edges: int = 64  # kept for each source on a bar
    row_cap: int = 256  # kept for each source over all bars; 0: all
    whole: bool = False  # every sink of a bar and every edge: row_edges, k_out and k_in do not apply

    def __post_init__(self):
        checks = {
            "pressure": self.pressure in ("dollar", "sqrt", "relative"),
            "lift": self.lift in ("off", "excess", "ratio"),
            "dangling": self.dangling in ("self", "teleport"),
            "hot_ref": self.hot_ref in ("uniform", "size", "longrun"),
            "alpha": 0 < self.alpha < 1,
            "beta": self.beta >= 0,
            "k_out": self.k_out >= 1 and self.k_in >= 0,
            "half_life": min(self.half_life_slow, self.half_life_fast, self.half_life_long) > 0,
            "windows": min(self.adv_window, self.vol_window, self.corr_window) >= 2,
            "horizons": bool(self.horizons) and min(self.horizons) >= 1,
            "edges": self.sinks >= self.row_edges >= 1 and (self.row_cap == 0 or self.row_cap >= self.row_edges),
            "retention": self.retention >= 0,
            "whole": not self.whole or (self.tilt == 0 and self.lift == "off" and self.retention == 0 and self.row_cap == 0 and self.dangling == "teleport"),
        }
        if bad := [k for k, fine in checks.items() if not fine]:
            raise ValueError(f"invalid parameters: {', '.join(bad)}")


def legacy() -> Params:
    return Params(pressure="dollar", lift="off", k_in=0, retention=0.0, liquidity_floor=0.0, volume_cap=0.0)


def money_flow() -> Params:
    return Params(pressure="dollar", lift="off", hot_ref="size")


def rank_preset() -> Params:
    """Default of the rank queries: undecayed dollar flow, teleporting dead ends."""
    return Params(pressure="dollar", lift="off", retention=0.0, dangling="teleport", half_life_slow=1e9, volume_cap=0.0)


def intraday() -> Params:
    return replace(rank_preset(), half_life_fast=26.0, adv_window=520, corr_window=520, liquidity_floor=1e6 / 26, stale_bars=26, horizons=(1, 6, 26))
