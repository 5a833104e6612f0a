"""Prompt templates: filling in the driver and as expressions, and checks of their arguments."""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = re.compile(r"\{([^{}]+)\}")


def fill(template: Sequence[Mapping[str, Any]], args: Mapping[str, Any]) -> list[dict[str, Any]]:
    """A copy with each ``{key}`` in text fields replaced, key after key; all else stays."""
    out = copy.deepcopy([dict(m) for m in template])
    for message in out:
        for field, value in message.items():
            if isinstance(value, str):
                for key, arg in args.items():
                    value = value.replace("{" + key + "}", str(arg))
                message[field] = value
    return out


def fill_column(text: Column, args: Mapping[str, Column]) -> Column:
    """The same for a text column."""
    for key, arg in args.items():
        text = F.replace(text, F.lit("{" + key + "}"), arg.cast("string"))
    return text


def fill_prompt(template: Sequence[Mapping[str, str]], args: Mapping[str, Column]) -> Column:
    """A column of filled messages."""
    messages = [
        F.struct(F.lit(m["role"]).alias("role"), fill_column(F.lit(m["content"]), args).alias("content")) for m in template
    ]
    return F.array(*messages)


def format_messages(template: Sequence[Mapping[str, Any]], ignore_unknown: bool = False, **args: Any) -> list[dict[str, Any]]:
    """``str.format`` on a copy; an argument that no message names is an error unless ignored."""
    out = copy.deepcopy([dict(m) for m in template])
    for key in args:
        if not ignore_unknown and not any(key in str(m.get("content", "")) for m in out):
            raise KeyError(key)
    for message in out:
        if isinstance(message.get("content"), str):
            message["content"] = message["content"].format(**args)
    return out


def placeholders(template: Sequence[Mapping[str, Any]]) -> set[str]:
    return {name for m in template if isinstance(m.get("content"), str) for name in PLACEHOLDER.findall(m["content"])}


def check_args(template: Sequence[Mapping[str, Any]], args: Mapping[str, Any] | Sequence[Mapping[str, Any]] | None, n_texts: int) -> None:
    """Every argument must have a placeholder; a list of arguments needs one entry per text."""
    named = placeholders(template)
    rows = [args] if isinstance(args, Mapping) else list(args or [])
    if args is not None and not isinstance(args, Mapping) and len(rows) != n_texts:
        raise ValueError(f"{len(rows)} sets of arguments for {n_texts} texts")
    for row in rows:
        unknown = set(row) - named
        if unknown:
            raise ValueError(f"no placeholders for {sorted(unknown)}")


_JSON_KINDS = {T.StringType: "string", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.BooleanType: "boolean"}


def json_schema(kind: T.DataType) -> dict[str, Any]:
    """A Spark type as a JSON schema; unknown keys are not allowed, all fields may be null."""
    if isinstance(kind, T.StructType):
        fields = {f.name: {"anyOf": [json_schema(f.dataType), {"type": "null"}]} for f in kind.fields}
        return {"type": "object", "properties": fields, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.DateType):
        return {"type": "string", "format": "date"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    return {"type": _JSON_KINDS.get(type(kind), "string")}


def span_offsets(text: Column, span: Column) -> Column:
    """[begin, end) of the first occurrence, counted in characters; begin is -1 where there is none."""
    begin = F.position(span, text) - 1
    return F.array(begin, begin + F.char_length(span))
