"""Where the store lies, how often it is polled and compiled, and what a reader may see."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from .model import ConfigError
from .operators.asof import Policy
from .sources.schema import load_yaml, only

# The keys of the file and their defaults.
TOP = {"root": "./data", "datasets_dir": "./datasets"}
BLOCKS = {
    "policy": {"min_lag_ms": 0, "refuse_derived": False, "stale_after_ms": 900_000, "skew_tolerance_ms": 5_000},
    "poll": {"timeout_seconds": 30.0, "retry_seconds": 300.0, "failures_before_alert": 3, "heartbeat_seconds": 60.0},
    "server": {"enabled": False, "host": "127.0.0.1", "port": 8431, "token": ""},
    "compile": {"every_seconds": 3600.0, "on_start": True},
}


@dataclass(frozen=True)
class Config:
    """The blocks of the file; `server` is checked and carried, as there is no HTTP view."""

    root: str
    datasets_dir: str
    policy: Policy
    poll: dict
    server: dict
    compile: dict


def _value(raw, default, what: str):
    """A value in the kind of its default."""
    if isinstance(default, bool):
        if not isinstance(raw, bool):
            raise ConfigError(f"{what} must be true or false")
        return raw
    try:
        return type(default)(raw)
    except (TypeError, ValueError):
        raise ConfigError(f"{what}: not a {type(default).__name__}: {raw!r}") from None


def parse_config(text: str = "", root: str | None = None) -> Config:
    """Unknown keys are refused; what is left out has its default; `root` goes before the file's."""
    doc = only(load_yaml(text) if text.strip() else {}, (*TOP, *BLOCKS), "config")
    blocks = {}
    for name, defaults in BLOCKS.items():
        raw = only(doc.get(name) or {}, tuple(defaults), name)
        blocks[name] = {k: _value(raw[k], d, f"{name}.{k}") if k in raw else d for k, d in defaults.items()}
    top = {k: str(doc.get(k) or d) for k, d in TOP.items()}
    p = blocks.pop("policy")
    policy = Policy(min_lag_ms=p["min_lag_ms"], refuse_derived=p["refuse_derived"], stale_after_ms=p["stale_after_ms"], skew_tolerance_ms=p["skew_tolerance_ms"])
    return Config(root or top["root"], top["datasets_dir"], policy, **blocks)


def load_config(path: str | Path | None, root: str | None = None) -> Config:
    return parse_config(Path(path).read_text(encoding="utf-8") if path else "", root)
