"""Settings of an analysis, their validation, JSON form and identity hash."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Cleaning:
    duplicate_m: float = 0.5
    idle_kmh: float = 1.5
    idle_points: int = 5
    max_hdop: float = 30.0


@dataclass(frozen=True)
class Matching:
    sigma_gps_m: float = 12.0
    beta_m: float = 12.0
    heading_weight: float = 1.0
    sigma_heading_deg: float = 45.0
    max_candidates: int = 8
    cutoff_factor: float = 3.0
    cutoff_min_m: float = 60.0
    #: Score added for the class of a road; other classes add nothing.
    class_bonus: dict[str, float] = field(
        default_factory=lambda: {
            "motorway": 0.6, "trunk": 0.5, "primary": 0.4, "secondary": 0.3, "tertiary": 0.2,
            "residential": 0.1, "unclassified": 0.0, "service": -0.2, "living_street": 0.0,
        }
    )


@dataclass(frozen=True)
class Confidence:
    mean_high_m: float = 8.0
    mean_medium_m: float = 18.0
    max_high_m: float = 20.0
    heading_high_deg: float = 25.0
    heading_medium_deg: float = 55.0
    min_points: int = 3
    margin_high: float = 1.5


@dataclass(frozen=True)
class Outputs:
    excel: bool = True
    map_html: bool = True
    technical_json: bool = True
    geopackage: bool = False


@dataclass(frozen=True)
class Settings:
    road_buffer_m: float = 300.0
    spacing_m: float = 10.0
    simplify_tolerance_m: float = 3.0
    curve_deg: float = 20.0
    candidate_radius_m: float = 30.0
    max_distance_m: float = 50.0
    tile_km: float = 5.0
    cache_days: int = 90
    min_leg_m: float = 20.0
    max_speed_kmh: float = 200.0
    point_diagnostics: bool = False
    offline: bool = False
    refresh_cache: bool = False
    program_version: str = "1.0.0"
    cleaning: Cleaning = Cleaning()
    matching: Matching = field(default_factory=Matching)
    confidence: Confidence = Confidence()
    outputs: Outputs = Outputs()


_POSITIVE = (
    "road_buffer_m", "spacing_m", "simplify_tolerance_m", "candidate_radius_m", "max_distance_m", "tile_km", "cache_days",
    "min_leg_m", "max_speed_kmh",
)
_HASHED = (
    "road_buffer_m", "spacing_m", "simplify_tolerance_m", "curve_deg", "candidate_radius_m", "max_distance_m", "tile_km",
    "min_leg_m", "max_speed_kmh",
)


def validate(s: Settings) -> Settings:
    """Defaults for values that make no sense; the outer distance is at least the candidate radius."""
    base = Settings()
    bad = {k: getattr(base, k) for k in _POSITIVE if not getattr(s, k) > 0}
    if not 0 < s.curve_deg < 180:
        bad["curve_deg"] = base.curve_deg
    s = dataclasses.replace(s, **bad)
    return dataclasses.replace(s, max_distance_m=max(s.max_distance_m, s.candidate_radius_m))


def _build(kind, base, values: dict):
    known = {f.name for f in dataclasses.fields(kind)}
    out = {}
    for key, value in values.items():
        if key.startswith("_") or key not in known:
            continue
        old = getattr(base, key)
        if dataclasses.is_dataclass(old) and isinstance(value, dict):
            value = _build(type(old), old, value)
        elif isinstance(old, dict) and isinstance(value, dict):
            value = old | value
        out[key] = value
    return dataclasses.replace(base, **out)


def load(path: str | Path | None = None) -> Settings:
    """Defaults merged with a JSON file; keys that start with ``_`` are comments; an unreadable file means defaults."""
    try:
        values = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError):
        values = {}
    return validate(_build(Settings, Settings(), values if isinstance(values, dict) else {}))


def save(s: Settings, path: str | Path) -> None:
    Path(path).write_text(json.dumps(as_dict(s), indent=2, ensure_ascii=False), encoding="utf-8")


def as_dict(s: Settings) -> dict:
    return dataclasses.asdict(s)


def get(s: Settings, dotted: str, default=None):
    """Value at a dotted path, for example ``matching.beta_m``."""
    at = as_dict(s)
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def put(s: Settings, dotted: str, value) -> Settings:
    """A copy with the value at a dotted path."""
    head, _, rest = dotted.partition(".")
    if not rest:
        return dataclasses.replace(s, **{head: value})
    inner = getattr(s, head)
    if isinstance(inner, dict):
        return dataclasses.replace(s, **{head: inner | {rest: value}})
    return dataclasses.replace(s, **{head: put(inner, rest, value)})


def identity(s: Settings) -> str:
    """16 hex digits of what decides a matching result (cleaning and confidence do not take part)."""
    values = {k: getattr(s, k) for k in _HASHED} | {"matching": dataclasses.asdict(s.matching)}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]
