"""Settings: defaults, and nested overrides over them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Search:
    default_limit: int = 5
    half_life_days: float = 30.0
    project_scope: bool | str = "tiered"
    cross_project_penalty: float = 0.3
    min_score: float = 0.0
    hybrid: bool = False


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    head_lines: int = 20
    tail_lines: int = 5


@dataclass(frozen=True)
class Maintenance:
    enabled: bool = True
    interval_hours: float = 24.0
    retention_days: float | None = 90.0
    max_bytes: int | None = 100 * 1024 * 1024


@dataclass(frozen=True)
class Config:
    search: Search = field(default_factory=Search)
    chunking: Chunking = field(default_factory=Chunking)
    maintenance: Maintenance = field(default_factory=Maintenance)


def merged(base: object, changes: dict) -> object:
    """base with changes, nested; unknown names are errors, the penalty is held between 0 and 1, and the scope must be true, false or tiered."""
    known = {f.name for f in fields(base)}
    if extra := set(changes) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    out = replace(base, **{k: merged(getattr(base, k), v) if is_dataclass(getattr(base, k)) else v for k, v in changes.items()})
    if isinstance(out, Search):
        if out.project_scope not in (True, False, "tiered"):
            raise ValueError("project_scope is true, false or 'tiered'")
        out = replace(out, cross_project_penalty=min(max(out.cross_project_penalty, 0.0), 1.0))
    return out


def duration_hours(text: str) -> float:
    """90d, 24h or 60m."""
    units = {"d": 24.0, "h": 1.0, "m": 1 / 60}
    if not text[:-1].isdigit() or text[-1:] not in units:
        raise ValueError(f"not a duration: {text!r}")
    return int(text[:-1]) * units[text[-1]]
