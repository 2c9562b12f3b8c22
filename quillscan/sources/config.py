"""Configuration in TOML: paths, monitoring and notification targets."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field

from quillscan.functions.catalog import SEVERITIES

DEFAULT_FILE = "quillscan.toml"
_UNITS = {"": 1, "s": 1, "sec": 1, "secs": 1, "m": 60, "min": 60, "mins": 60, "h": 3600, "hr": 3600, "hrs": 3600, "d": 86400, "day": 86400, "days": 86400}


def seconds(text: str) -> float | None:
    """A duration such as 90, 1.5h or 10 mins; None when it isn't one."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([A-Za-z]*)\s*", text)
    return float(m[1]) * _UNITS[m[2].lower()] if m and m[2].lower() in _UNITS else None


@dataclass(frozen=True)
class Target:
    url: str | None = None
    format: str = "generic"  # generic slack discord telegram
    threshold: str = "low"
    events: tuple[str, ...] = ("block", "finding")
    token: str | None = None
    chat_id: str | None = None


@dataclass(frozen=True)
class Config:
    paths: tuple[str, ...] = (".",)
    watch: bool = True
    registry: bool = False
    interval_s: float = 300.0
    registry_url: str = "https://registry.npmjs.org"
    targets: tuple[Target, ...] = field(default=())


def parse(toml: str) -> Config:
    raw = tomllib.loads(toml)
    monitor = raw.get("monitor", {})
    hooks = raw.get("webhook", raw.get("webhooks", []))
    targets = tuple(
        Target(h.get("url"), str(h.get("format", "generic")).lower(), str(h.get("threshold", "low")).lower(), tuple(h.get("events", ("block", "finding"))), h.get("token"), None if h.get("chat_id") is None else str(h["chat_id"]))
        for h in (hooks if isinstance(hooks, list) else [hooks])
    )
    own = Config()
    interval = monitor.get("interval", "5m")
    return Config(
        tuple(monitor.get("paths", raw.get("paths", own.paths))), bool(monitor.get("watch", own.watch)), bool(monitor.get("registry", own.registry)),
        (seconds(str(interval)) or own.interval_s), str(monitor.get("registry_url", own.registry_url)), targets,
    )


def load(path: str | None = None) -> Config:
    """A given file must be there and valid; the default one may be missing or broken."""
    if path is not None:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    try:
        return load(DEFAULT_FILE) if os.path.exists(DEFAULT_FILE) else Config()
    except (OSError, ValueError, KeyError, TypeError):
        return Config()


def rank_or_low(name: str) -> int:
    return SEVERITIES.index(name) + 1 if name in SEVERITIES else 1
