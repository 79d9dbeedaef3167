"""Configuration: nested values with defaults, overridden by a JSON file, the environment or a named profile.

A plain driver-side object; nothing of it travels with a plan but the values that a caller hands to an operator.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

TRUE_WORDS = ("true", "1", "yes", "on")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; mappings on both sides merge key by key."""
    both = lambda k: isinstance(base.get(k), Mapping) and isinstance(over[k], Mapping)
    return {**base, **{k: merged(base[k], over[k]) if both(k) else over[k] for k in over}}


def _unknown(known: Mapping[str, Any], given: Mapping[str, Any], path: str = "") -> list[str]:
    out = []
    for key, value in given.items():
        if key not in known:
            out.append(path + key)
        elif isinstance(known[key], Mapping) and isinstance(value, Mapping):
            out += _unknown(known[key], value, f"{path}{key}.")
    return out


@dataclass(frozen=True)
class Settings:
    """Values, and for some paths (``section.key``) the least and largest number allowed."""

    values: Mapping[str, Any]
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for path, (least, most) in self.ranges.items():
            value = self.get(path)
            if value is not None and not least <= value <= most:
                raise ValueError(f"{path} must be between {least} and {most}")

    def get(self, path: str, default: Any = None) -> Any:
        here: Any = self.values
        for key in path.split("."):
            if not isinstance(here, Mapping) or key not in here:
                return default
            here = here[key]
        return here

    def with_values(self, over: Mapping[str, Any]) -> Settings:
        """A copy with other values; a key that no default names is an error."""
        if unknown := _unknown(self.values, over):
            raise KeyError(", ".join(unknown))
        return replace(self, values=merged(self.values, over))

    def with_file(self, path: str) -> Settings:
        """A copy with the values of a JSON file; without such a file, the same."""
        file = Path(path)
        return self.with_values(json.loads(file.read_text(encoding="utf-8"))) if file.exists() else self

    def with_environment(self, names: Mapping[str, str], environment: Mapping[str, str] | None = None) -> Settings:
        """A copy with the variables of ``names`` (variable to path), read as the type of the value they replace; what is no number where one is due is ignored."""
        found = os.environ if environment is None else environment
        out = self
        for variable, path in names.items():
            if variable not in found:
                continue
            old, value = self.get(path), found[variable]
            if isinstance(old, bool):
                value = value.lower() in TRUE_WORDS
            elif isinstance(old, int):
                try:
                    value = int(value)
                except ValueError:
                    continue
            for key in reversed(path.split(".")):
                value = {key: value}
            out = out.with_values(value)
        return out

    def save(self, path: str) -> None:
        file = Path(path)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(self.values, indent=2), encoding="utf-8")
