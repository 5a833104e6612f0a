"""One registry for all kinds of components."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Registry:
    kind: str
    entries: dict[str, tuple[Callable[..., Any], dict[str, Any]]] = field(default_factory=dict)

    def register(self, name: str, factory: Callable[..., Any], /, **defaults: Any) -> None:
        if name in self.entries:
            raise ValueError(f"a {self.kind} named {name} is there already")
        self.entries[name] = (factory, defaults)

    def load(self, name: str, /, **overrides: Any) -> Any:
        if name not in self.entries:
            raise ValueError(f"unknown {self.kind} {name}; known are {', '.join(sorted(self.entries))}")
        factory, defaults = self.entries[name]
        try:
            return factory(**defaults | overrides)
        except TypeError as wrong:
            raise TypeError(f"{self.kind} {name}: {wrong}") from wrong

    def resolve(self, value: Any, kind: type) -> Any:
        """A component from None, its name or itself."""
        if value is None or isinstance(value, kind):
            return value
        if isinstance(value, str):
            return self.load(value)
        raise TypeError(f"a {self.kind} is a name or a {kind.__name__}, not {type(value).__name__}")
