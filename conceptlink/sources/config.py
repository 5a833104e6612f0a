"""Task and service settings as JSON or YAML files."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Self


def _yaml():
    try:
        import yaml
    except ImportError as missing:
        raise ValueError("YAML settings need the yaml package") from missing
    return yaml


class _Stored:
    @classmethod
    def load(cls, path: str | Path) -> Self:
        path = Path(path)
        if path.suffix == ".json":
            values = json.loads(path.read_text())
        elif path.suffix == ".yaml":
            values = _yaml().safe_load(path.read_text())
        else:
            raise ValueError(f"settings are .json or .yaml files, not {path.suffix or path}")
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known})

    def save(self, path: str | Path) -> None:
        path, values = Path(path), dataclasses.asdict(self)
        if path.suffix == ".json":
            path.write_text(json.dumps(values, indent=2))
        elif path.suffix == ".yaml":
            path.write_text(_yaml().safe_dump(values))
        else:
            raise ValueError(f"settings are .json or .yaml files, not {path.suffix or path}")


@dataclass
class MappingTask(_Stored):
    """What to map and with which components; paths are kept as text."""

    input_file: str
    output_dir: str | None = None
    translator_id: str | None = None
    retriever_id: str | None = None
    selector_id: str | None = None
    reranker_id: str | None = None
    batch_size: int | None = None
    rate_limit: int | None = None
    column_mapping: dict[str, str] | None = None
    limit_to: int | None = None

    def __post_init__(self) -> None:
        self.input_file = str(self.input_file)
        self.output_dir = None if self.output_dir is None else str(self.output_dir)


@dataclass
class ServiceConfig(_Stored):
    batch_size: int = 100
    rate_limit: int | None = None
    host: str = "127.0.0.1"
    port: int = 8000


def load_settings(value: Any, kind: type = MappingTask) -> Any:
    return value if isinstance(value, kind) else kind.load(value)
