"""Typed job options: environment over file over default; unknown settings are refused."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from bindery.operators.merge import FIELDS, RULES
from bindery.operators.ranking import Bands

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str | int) -> int:
    """``90m``, ``24h``, ``2d`` or 0 as seconds."""
    found = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(text))
    if found:
        return int(found[1]) * _UNITS[found[2]]
    if str(text).strip() == "0":
        return 0
    raise ValueError(f"{text!r} is not a duration such as 90m, 24h or 2d")


@dataclass(frozen=True)
class Options:
    sources: tuple[str, ...] = ("catalogue_a", "catalogue_b")
    strong_score: float = 0.89
    singleton_score: float = 0.95
    medium_score: float = 0.80
    full_scan: bool = False
    daily_calls: int = 200
    add_cover: bool = True
    dry_run: bool = False
    stable_checks: int = 2
    poll_seconds: int = 5
    backup_days: int = 30
    retry_window: str = "24h"
    genres: tuple[str, ...] = ()
    rules: Mapping[str, str] = field(default_factory=lambda: dict(RULES))
    authors: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bands  # noqa: B018  checks the bars
        seconds(self.retry_window)
        if self.stable_checks < 1 or self.poll_seconds < 1 or self.backup_days < 0 or self.daily_calls < 0:
            raise ValueError("counts and times can't be negative, checks and polls not zero")
        if odd := set(self.rules) - set(FIELDS):
            raise ValueError(f"no such fields: {sorted(odd)}")
        if odd := set(self.rules.values()) - {"overwrite", "fill", "skip"}:
            raise ValueError(f"no such rules: {sorted(odd)}")

    @property
    def bands(self) -> Bands:
        return Bands(self.strong_score, self.singleton_score, self.medium_score)


def _typed(kind: str, value: object) -> object:
    text = str(value).strip()
    if kind == "bool":
        if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{value!r} is not yes or no")
        return text.lower() in ("true", "1", "yes")
    if kind == "int":
        return int(text)
    if kind == "float":
        return float(text)
    if kind.startswith("tuple"):
        return tuple(value) if isinstance(value, (list, tuple)) else tuple(p.strip() for p in text.split(",") if p.strip())
    return dict(value) if kind.startswith("Mapping") else text


def load(path: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "BINDERY_") -> Options:
    """Options from a TOML file and ``PREFIX_NAME`` variables, the variables first."""
    kinds = {f.name: str(f.type) for f in fields(Options)}
    told: dict[str, object] = {}
    if path:
        with open(path, "rb") as file:
            told = tomllib.load(file)
    if unknown := set(told) - set(kinds):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    told |= {n: env[prefix + n.upper()] for n in kinds if prefix + n.upper() in env}
    values = {n: _typed(kinds[n], v) for n, v in told.items()}
    if "rules" in values:
        values["rules"] = RULES | values["rules"]
    return Options(**values)
