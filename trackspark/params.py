"""Parameters of the pipeline steps, as frozen dataclasses."""

from __future__ import annotations

import math
from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
# Word lists and numbers that decide results; they have to stay as they are.

NM_IN_KM = 1.852
EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_M = 6_371_000.0
BOX_KM_PER_DEGREE = 111.32

TIMESTAMP_PATTERN = "dd/MM/yyyy HH:mm:ss"

MOVING_MOBILE_TYPES = ("Class A", "Class B")

STATIONARY_STATUSES = (
    "At anchor",
    "Moored",
    "Aground",
    "Not under command",
    "Reserved for future use",
    "Unknown value",
    "Restricted maneuverability",
)

SERVICE_KEYWORDS = ("PILOT", "KBV", "RESCUE", "SAR", "SVITZER", "TUG")

EXCLUDED_SHIP_TYPES = (
    "Pilot",
    "Pilot vessel",
    "Tug",
    "SAR",
    "Search and rescue",
    "Law enforcement",
    "Port tender",
)

# A name in the chosen row that counts as "no name"; the look-up table over all
# fixes only leaves out the second list.
UNUSABLE_ROW_NAMES = ("", "Unknown", "None")
UNUSABLE_LOOKUP_NAMES = ("", "Unknown")

SAR_AIRCRAFT_PREFIX = "111"
SAR_AIRCRAFT_LENGTH = 9
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class CleanParams:
    """Which reports become fixes.

    ``year=0`` accepts every year. ``bbox="reference"`` keeps the customary box,
    which cuts a sliver off the circle; ``bbox="enclosing"`` uses the smallest
    box that holds the whole circle.
    """

    centre_lat: float = 55.225
    centre_lon: float = 14.245
    radius_km: float = 50.0 * NM_IN_KM
    year: int = 0
    month: int = 12
    min_sog: float = 0.5
    max_sog: float = 102.0
    bbox: str = "reference"
    mobile_types: tuple[str, ...] = MOVING_MOBILE_TYPES
    stationary_statuses: tuple[str, ...] = STATIONARY_STATUSES
    keep_null_status: bool = False

    def __post_init__(self) -> None:
        if self.bbox not in ("reference", "enclosing"):
            raise ValueError(f"bbox must be 'reference' or 'enclosing', not {self.bbox!r}")
        if not 1 <= self.month <= 12:
            raise ValueError(f"month must be 1..12, not {self.month}")

    def half_box(self) -> tuple[float, float]:
        """Half height and half width of the box, in degrees."""
        phi = math.radians(self.centre_lat)
        if self.bbox == "reference":
            return (
                self.radius_km / BOX_KM_PER_DEGREE,
                self.radius_km / (BOX_KM_PER_DEGREE * math.cos(phi)),
            )
        angle = self.radius_km / EARTH_RADIUS_KM
        # A hair wider than the circle, so rounding cannot cut its rim.
        slack = 1e-9
        return (
            math.degrees(angle) + slack,
            math.degrees(math.asin(math.sin(angle) / math.cos(phi))) + slack,
        )

    def box_holds_valid_coordinates_only(self) -> bool:
        """Whether every point of the box is a valid coordinate and not (0, 0)."""
        height, width = self.half_box()
        on_earth = abs(self.centre_lat) + height <= 90 and abs(self.centre_lon) + width <= 180
        return on_earth and not (abs(self.centre_lat) <= height and abs(self.centre_lon) <= width)


@dataclass(frozen=True)
class ProximityParams:
    """When two fixes count as close.

    ``time_mode="bucket"`` compares fixes of one time bucket only;
    ``"exact"`` finds every pair at most ``max_dt_s`` apart. ``cell_deg`` is the
    height of a grid band, ``crowd`` the positions of a cell that one task compares
    with all that reach it; both decide work, never results.
    """

    max_dist_m: float = 300.0
    min_dist_m: float = 1.0
    max_dt_s: int = 30
    min_sog: float = 2.0
    bucket_s: int = 60
    cell_deg: float = 0.01
    crowd: int = 2_000
    time_mode: str = "bucket"
    service_keywords: tuple[str, ...] = SERVICE_KEYWORDS
    excluded_ship_types: tuple[str, ...] = EXCLUDED_SHIP_TYPES
    keyword_match: str = "substring"

    def __post_init__(self) -> None:
        if self.time_mode not in ("bucket", "exact"):
            raise ValueError(f"time_mode must be 'bucket' or 'exact', not {self.time_mode!r}")
        if self.keyword_match not in ("substring", "word"):
            raise ValueError(f"keyword_match must be 'substring' or 'word', not {self.keyword_match!r}")
        if min(self.cell_deg, self.bucket_s, self.max_dist_m, self.crowd) <= 0 or self.max_dt_s < 0:
            raise ValueError("cell_deg, bucket_s, max_dist_m and crowd must be positive, max_dt_s not negative")
        if self.min_dist_m < 0:
            raise ValueError("min_dist_m must not be negative: pairs at 0 m are left out")


@dataclass(frozen=True)
class EventParams:
    """Which pairs count as one-time encounters, and how many are reported."""

    max_obs: int = 200
    k: int = 1


@dataclass(frozen=True)
class VoyageParams:
    """What a voyage can be: speeds between positions, near-equal reports, lying still, silence."""

    max_kn: float = 102.0
    patience: int = 2
    repeat_s: int = 1
    repeat_m: float = 10.0
    still_kn: float = 0.5
    silence_s: int = 600

    def __post_init__(self) -> None:
        if min(self.max_kn, self.patience, self.silence_s) <= 0 or min(self.repeat_s, self.repeat_m, self.still_kn) < 0:
            raise ValueError("max_kn, patience and silence_s must be positive, the rest not negative")


@dataclass(frozen=True)
class TrackParams:
    """Half length of the track cut out around an event."""

    half_window_s: int = 600
