"""Configuration tree from INI files: dotted sections and keys, values as JSON, dates or numbers."""

from __future__ import annotations

import configparser
import json
from datetime import date
from pathlib import Path
from typing import Any

_MISSING = object()


def coerce(text: str) -> Any:
    for kind in (json.loads, date.fromisoformat, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


class Config:
    """Nested sections addressed by name or dotted path."""

    def __init__(self, values: dict[str, Any] | None = None):
        self._values: dict[str, Any] = {}
        for k, v in (values or {}).items():
            self.set(v, k)

    @classmethod
    def from_ini(cls, *paths: str | Path) -> Config:
        parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation(), allow_no_value=True)
        parser.optionxform = str
        parser.read(paths)
        out = cls()
        for section in parser.sections():
            for key, value in parser[section].items():
                out.set(coerce(value) if value is not None else None, section, key)
        return out

    @staticmethod
    def _path(address: tuple[str, ...]) -> list[str]:
        return [p for a in address for p in a.split(".")]

    def set(self, value: Any, *address: str) -> None:
        """Sections on the way are made; a value may not stand where a section is, nor the other way round."""
        *sections, key = self._path(address)
        at = self
        for s in sections:
            inner = at._values.setdefault(s, Config())
            if not isinstance(inner, Config):
                raise KeyError(f"{'.'.join(address)}: {s} is a value")
            at = inner
        if isinstance(at._values.get(key), Config) and not isinstance(value, (dict, Config)):
            raise KeyError(f"{'.'.join(address)} is a section")
        at._values[key] = Config(value) if isinstance(value, dict) else value

    def get(self, *address: str, default: Any = _MISSING) -> Any:
        at: Any = self
        for p in self._path(address):
            if not isinstance(at, Config) or p not in at._values:
                if default is _MISSING:
                    raise KeyError(".".join(address))
                return default
            at = at._values[p]
        return at

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.get(name)
        except KeyError as e:
            raise AttributeError(name) from e

    def to_dict(self) -> dict[str, Any]:
        return {k: v.to_dict() if isinstance(v, Config) else v for k, v in self._values.items()}

    def tree(self, indent: str = "") -> str:
        lines = []
        for k, v in self._values.items():
            lines += [f"{indent}{k}", v.tree(indent + "  ")] if isinstance(v, Config) else [f"{indent}{k} = {v!r}"]
        return "\n".join(lines)
