"""Leaves of JSON documents of any depth, one Arrow batch at a time with an explicit stack."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

LEAF = pa.struct([("name", pa.string()), ("type", pa.string()), ("value", pa.string())])


class _Number(str):
    """A number by its digits, so that its text survives."""


def _refuse(_: str):
    raise ValueError("no JSON number")


_read = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse).decode


_space = re.compile(r"[ \t\n\r]*").match
_number = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?").match
_WORDS = {"true": True, "false": False, "null": None}


def _read_deep(text: str):
    """As ``_read``, for documents nested beyond the interpreter's recursion."""
    def expect(at: int, char: str) -> int:
        at = _space(text, at).end()
        if text[at:at + 1] != char:
            raise ValueError(f"no {char} at {at}")
        return _space(text, at + 1).end()

    def key(at: int) -> tuple[str, int]:
        if text[at:at + 1] != '"':
            raise ValueError(f"no name at {at}")
        name, at = scanstring(text, at + 1)
        return name, expect(at, ":")

    at, stack = _space(text, 0).end(), []  # open containers with the name their next value goes by
    while True:
        char = text[at:at + 1]
        if char in ("{", "["):
            inner = _space(text, at + 1).end()
            made: dict | list = {} if char == "{" else []
            if text[inner:inner + 1] != ("}" if char == "{" else "]"):
                name, at = key(inner) if char == "{" else (None, inner)
                stack.append([made, name])
                continue
            value, at = made, inner + 1
        elif char == '"':
            value, at = scanstring(text, at + 1)
        elif found := _number(text, at):
            value, at = _Number(found.group()), found.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at = _WORDS[word], at + len(word)
        while stack:
            holder, name = stack[-1]
            is_object = isinstance(holder, dict)
            if is_object:
                holder[name] = value
            else:
                holder.append(value)
            at = _space(text, at).end()
            if text[at:at + 1] == ",":
                at = _space(text, at + 1).end()
                if is_object:
                    stack[-1][1], at = key(at)
                break
            if text[at:at + 1] != ("}" if is_object else "]"):
                raise ValueError(f"no end at {at}")
            at += 1
            value = stack.pop()[0]
        else:
            if _space(text, at).end() != len(text):
                raise ValueError(f"more at {at}")
            return value


def _plain_number(value: _Number) -> float | int:
    return float(value) if any(c in value for c in ".eE") else int(value)


def _text(value) -> str | None:
    """A string itself, the JSON of anything else."""
    if isinstance(value, str):
        return str(value)
    if value is None or isinstance(value, bool):
        return None if value is None else "true" if value else "false"
    return json_text(value)


def json_text(value) -> str:
    """Compact JSON of a document of any depth."""
    out, stack = [], [(value, None)]  # a value, or text that is ready
    while stack:
        item, ready = stack.pop()
        if ready is not None:
            out.append(ready)
        elif isinstance(item, (dict, list)):
            is_object = isinstance(item, dict)
            out.append("{" if is_object else "[")
            stack.append((None, "}" if is_object else "]"))
            entries = [(json.dumps(k, ensure_ascii=False) + ":", v) for k, v in item.items()] if is_object else [("", v) for v in item]
            for i, (name, v) in reversed(list(enumerate(entries))):
                stack.append((v, None))
                stack.append((None, ("," if i else "") + name))
        else:
            out.append(json.dumps(_plain_number(item) if isinstance(item, _Number) else item, ensure_ascii=False))
    return "".join(out)


def _kind(value) -> str:
    if isinstance(value, _Number):
        return "DOUBLE" if any(c in value for c in ".eE") else "BIGINT"
    if isinstance(value, dict):
        return "OBJECT" if value else "OBJECT<>"
    return {str: "STRING", bool: "BOOLEAN", list: "ARRAY", type(None): "VOID"}[type(value)]


def _object(text: str | None) -> dict | None:
    if text is None:
        return None
    text = text.strip(" \t\r\n")
    try:
        found = _read(text)
    except ValueError:
        return None
    except RecursionError:
        try:
            found = _read_deep(text)
        except ValueError:
            return None
    return found if isinstance(found, dict) else None


def walk(doc: dict, sep: str, deep: bool, arrays: bool, empty: str | None) -> Iterator[tuple[str, object]]:
    """(dotted name, value) of every leaf in document order.

    ``arrays`` expands an array whose first element is an object to ``name[i]``; an object without
    keys gives one leaf named ``empty``, or nothing.
    """
    stack: list[tuple[str, object]] = [(k, v) for k, v in reversed(doc.items())]
    while stack:
        name, value = stack.pop()
        if deep and isinstance(value, dict):
            if value:
                stack += [(f"{name}{sep}{k}", v) for k, v in reversed(value.items())]
            elif empty is not None:
                yield empty, value
        elif deep and arrays and isinstance(value, list) and value and isinstance(value[0], dict):
            stack += [(f"{name}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            yield name, value


def json_leaves(text: Column, sep: str = ".", deep: bool = True, arrays: bool = False, empty: str | None = None) -> Column:
    """Leaves of a JSON object as array<struct<name, type, value>>; null for anything else.

    Of a repeated key the last value counts. ``type`` is the variant type's name, ``value`` the
    string itself or the value's JSON text.
    """

    @arrow_udf("array<struct<name:string,type:string,value:string>>")
    def leaves(texts: pa.Array) -> pa.Array:
        names, kinds, values, offsets, valid = [], [], [], [0], []
        for t in texts.to_pylist():
            doc = _object(t)
            valid.append(doc is not None)
            for name, value in walk(doc or {}, sep, deep, arrays, empty):
                names.append(name)
                kinds.append(_kind(value))
                values.append(_text(value))
            offsets.append(len(names))
        flat = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], fields=list(LEAF))
        ends = pa.array([o if ok else None for o, ok in zip(offsets, valid)] + [offsets[-1]], pa.int32())
        return pa.ListArray.from_arrays(ends, flat)

    return leaves(text)
