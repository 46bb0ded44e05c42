"""Search settings from words, lists and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import fields, replace

from .errors import AddressError
from .functions.matching import Settings

#: Words for each value of a switch. auto leaves the decision to the registry.
WORDS = {True: ("on", "enable", "true", "yes"), False: ("off", "disable", "false", "no"), None: ("auto", "none", "")}
PREFIX = "ADDRSPARK_OPT_"


class SettingError(AddressError, ValueError):
    """A value that a setting cannot have."""


def coerce(name: str, value):
    """value as the setting's type: a tuple of areas, or true, false or none."""
    if name not in {f.name for f in fields(Settings)}:
        raise SettingError(f"no setting {name}")
    if name == "target_area":
        items = [] if value is None else value.split(",") if isinstance(value, str) else [str(value)] if isinstance(value, int) else list(value)
        return tuple(x for x in items if x)
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, int):
        return bool(value)
    for meaning, words in WORDS.items():
        if isinstance(value, str) and value.lower() in words:
            return meaning
    raise SettingError(f"{name} cannot be {value!r}")


def configure(settings: Settings | None = None, **values) -> Settings:
    return replace(settings or Settings(), **{k: coerce(k, v) for k, v in values.items()})


def from_environment(environ: Mapping[str, str] = os.environ) -> Settings:
    found = {k.removeprefix(PREFIX).lower(): v for k, v in environ.items() if k.startswith(PREFIX)}
    return configure(**found)
