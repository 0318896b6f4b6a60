"""Settings of all parts as one object: defaults, a file or mapping over them, then single
overrides ``section.key=value``. An unknown section or key is a KeyError, an override that has
not that form a ValueError."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from .operators.tracking import TrackerConfig
from .plans.features import Settings
from .plans.timing import TimingSettings


@dataclass(frozen=True)
class Config:
    beat: TrackerConfig = field(default_factory=TrackerConfig)
    features: Settings = field(default_factory=Settings)
    timing: TimingSettings = field(default_factory=TimingSettings)


def _like(old: Any, new: Any) -> Any:
    return tuple(new) if isinstance(old, tuple) and isinstance(new, list) else new


def merged(given: dict | None, base: Config = Config()) -> Config:
    """``base`` with the given sections' keys replaced; an empty section changes nothing."""
    out = base
    for section, values in (given or {}).items():
        if section not in {f.name for f in dataclasses.fields(Config)}:
            raise KeyError(f"no section {section!r}")
        old = getattr(out, section)
        known = {f.name for f in dataclasses.fields(old)}
        for key in values or {}:
            if key not in known:
                raise KeyError(f"no key {key!r} in section {section!r}")
        new = {k: _like(getattr(old, k), v) for k, v in (values or {}).items()}
        out = dataclasses.replace(out, **{section: dataclasses.replace(old, **new)})
    return out


def _value(raw: str) -> Any:
    """A number, truth value, null or list as JSON (YAML where it is installed); else the text."""
    try:
        return json.loads(raw)
    except ValueError:
        pass
    try:
        import yaml
    except ModuleNotFoundError:
        return raw
    return yaml.safe_load(raw)


def override(config: Config, *items: str) -> Config:
    for item in items:
        name, found, raw = item.partition("=")
        section, dot, key = name.strip().partition(".")
        if not (found and dot and section and key) or "." in key:
            raise ValueError(f"{item!r} isn't section.key=value")
        config = merged({section: {key: _value(raw)}}, config)
    return config


def load(path: str | None = None, *items: str) -> Config:
    """Defaults, the JSON or YAML file at ``path`` (on the driver), the overrides."""
    given = None
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text)
    return override(merged(given), *items)


def frozen(config: Config, task: str) -> dict:
    """The sections that a model's metadata keeps: those its features were made with."""
    sections = {"velocity": ("beat", "features"), "timing": ("beat", "features", "timing")}[task]
    return {s: dataclasses.asdict(getattr(config, s)) for s in sections}
