"""Settings of a question: what a user may ask for, with the defaults and bounds that answers rest on."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# Margins are multiplied by the factor of the mode; the clearance of smoke vents is absolute.
MODE_FACTOR = {"conservative": 1.5, "recommended": 1.0, "maximum": 0.5}
RWA_CLEARANCE_M = 2.0


@dataclass(frozen=True)
class Panel:
    width: float = 1.134
    height: float = 1.762
    power_w: float = 450.0
    gap: float = 0.02
    flat_tilt_deg: float = 15.0
    design_sun_deg: float = 19.2
    row_gap_m: float | None = None


@dataclass(frozen=True)
class Settings:
    """``max_panels`` bounds a building's modules; a demand needs both consumption and existing generation (kWh a year)."""

    mode: str = "recommended"
    objective: str = "capacity"
    layout_policy: str = "recommended"
    minimum_irradiation: float = 800.0
    minimum_sun_access: float = 0.6
    minimum_array_panels: int = 4
    performance_ratio: float = 0.8
    edge_margin_m: float = 0.3
    obstacle_margin_m: float = 0.4
    pv_margin_m: float = 0.2
    max_panels: int | None = None
    annual_consumption_kwh: float | None = None
    existing_generation_kwh: float | None = None
    panel: Panel = field(default_factory=Panel)

    def __post_init__(self) -> None:
        known = {"mode": MODE_FACTOR, "objective": ("capacity", "energy"), "layout_policy": ("recommended", "physical")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is one of {', '.join(values)}")
        if not 0 <= self.minimum_sun_access <= 1 or not 0 < self.performance_ratio <= 1 or self.minimum_array_panels < 1:
            raise ValueError("sun access and performance ratio are shares, and an array has a module at least")
        numbers = [self.minimum_irradiation, self.edge_margin_m, self.obstacle_margin_m, self.pv_margin_m, self.panel.width, self.panel.height, self.panel.power_w]
        if not all(math.isfinite(v) and v >= 0 for v in numbers) or self.panel.width * self.panel.height <= 0:
            raise ValueError("margins and sizes are finite and not negative")

    @property
    def factor(self) -> float:
        return MODE_FACTOR[self.mode]

    @property
    def module_kwp(self) -> float:
        return self.panel.power_w / 1000

    @property
    def remaining_target_kwh(self) -> float | None:
        if self.annual_consumption_kwh is None or self.existing_generation_kwh is None:
            return None
        return max(0.0, self.annual_consumption_kwh - self.existing_generation_kwh)

    def margin(self, kinds: str) -> float:
        """Clearance around an object of one kind or several, joined by +: the largest of its kinds."""
        own = [self.pv_margin_m if k == "existing_pv" else self.obstacle_margin_m for k in kinds.split("+")]
        most = max(own) * self.factor
        return max(most, RWA_CLEARANCE_M) if "rwa" in kinds.split("+") else most

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)
