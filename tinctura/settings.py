"""Settings of stages from plain dictionaries, such as a parsed configuration file."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any, TypeVar, get_type_hints

T = TypeVar("T")


def read(kind: type[T], raw: dict[str, Any] | None) -> T:
    """An instance of the dataclass ``kind``: its defaults, overridden by the values given.

    Unknown keys are an error, since a misspelt setting would go unnoticed; lists become tuples; nested dictionaries
    become nested dataclasses; None leaves the default.
    """
    known = {f.name: f for f in fields(kind)}  # type: ignore[arg-type]
    if unknown := sorted(set(raw or {}) - set(known)):
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(unknown)}")
    hints, given = get_type_hints(kind), {}
    for name, value in (raw or {}).items():
        if value is None:
            continue
        options = [t for t in (hints[name], *getattr(hints[name], "__args__", ())) if isinstance(t, type) and is_dataclass(t)]
        if isinstance(value, dict) and options:
            value = read(options[0], value)
        given[name] = tuple(value) if isinstance(value, list) else value
    return kind(**given)
