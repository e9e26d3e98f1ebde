"""The configuration of a run: five YAML files and a digest template in one folder."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

#: Files of a configuration folder. Fixed values.
PARTS = ("settings", "profile", "keywords", "institutions", "sources")
#: The group of the institutions file that is watched. Fixed value.
WATCHED = "priority_universities"
TEMPLATE = "email_template.md"


@dataclass(frozen=True)
class Settings:
    root: Path
    settings: dict[str, Any]
    profile: dict[str, Any]
    keywords: dict[str, Any]
    institutions: dict[str, Any]
    sources: dict[str, Any]
    template: str = ""

    def get(self, path: str, default: Any = None) -> Any:
        """A value of the settings by its dotted path."""
        return at(self.settings, path, default)

    def place(self, value: str | Path) -> Path:
        """A path of the configuration: absolute, or beside its folder."""
        return Path(value) if Path(value).is_absolute() else self.root / value

    def source(self, kind: str) -> dict[str, Any]:
        return at(self.sources, f"sources.{kind}", {}) or {}

    def priority_names(self) -> list[str]:
        """Names and aliases of the watched institutions."""
        entries = at(self.institutions, WATCHED, []) or []
        return [n for e in entries for n in ([e] if isinstance(e, str) else [e.get("name"), *(e.get("aliases") or [])]) if n]


def at(mapping: Any, path: str, default: Any = None) -> Any:
    for key in path.split("."):
        if not isinstance(mapping, dict) or key not in mapping:
            return default
        mapping = mapping[key]
    return mapping


def read_yaml(path: Path) -> dict[str, Any]:
    """A YAML file that holds a mapping; an empty one is an empty mapping."""
    import yaml

    found = yaml.safe_load(path.read_text("utf-8"))
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found or {}


def load(folder: str | Path = "config") -> Settings:
    """The configuration of a folder, which stands in the current folder if it is relative."""
    folder = Path(folder).resolve()
    return Settings(folder.parent, *(read_yaml(folder / f"{p}.yaml") for p in PARTS), (folder / TEMPLATE).read_text("utf-8"))
