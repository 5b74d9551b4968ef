"""Parameters of a decomposition run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Column vocabulary shared by every operator.
SERIES = ["product_key", "stay_key", "amount_type"]
# A series is spread over the cluster by product and stay, so that the measures
# of one product and stay sit together and every later window finds its rows in place.
PLACEMENT = ["product_key", "stay_key"]


@dataclass(frozen=True)
class Regime:
    """A named stretch of the calendar; ``last`` is inclusive, ``None`` is open."""

    name: str
    last: date | None


@dataclass(frozen=True)
class Settings:
    regimes: tuple[Regime, ...]
    date_from: date
    date_to: date
    edm_from: date
    trend_cap: int = 7 * 52
    test_share: float = 0.2
    price_measure: int = 100
    volume_measure: int = 103


# The calendar of the car-park study.
CAR_PARK = Settings(
    regimes=(
        Regime("Pre-COVID", date(2020, 3, 12)),
        Regime("Transition-COVID", date(2020, 3, 26)),
        Regime("Recovery-COVID", None),
    ),
    date_from=date(2017, 1, 1),
    date_to=date(2020, 5, 31),
    edm_from=date(2018, 9, 26),
)

# The calendar of the order tables (line items ship 1995-01-02 to 2001-11-04).
ORDERS = Settings(
    regimes=(
        Regime("pre", date(1998, 6, 30)),
        Regime("transition", date(1998, 7, 14)),
        Regime("recovery", None),
    ),
    date_from=date(1995, 3, 1),
    date_to=date(2001, 10, 31),
    edm_from=date(1996, 7, 1),
)
