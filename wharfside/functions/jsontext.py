"""Strict JSON reading for delivered documents (plain Python, used inside Arrow functions)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from json.decoder import scanstring
from typing import Any

#: Absent or unreadable values are told apart from JSON null.
MISSING = object()

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?", re.A)
_WORDS = {"true": True, "false": False, "null": None}
_WORD = re.compile("true|false|null")


def _no_constant(word: str) -> Any:
    raise ValueError(f"{word} is not JSON")


_READER = json.JSONDecoder(parse_constant=_no_constant)
_TEXT_READER = json.JSONDecoder(parse_constant=_no_constant, parse_float=str, parse_int=str)


def read_json(text: str | bytes | None, numbers_as_text: bool = False) -> Any:
    """The JSON value of ``text``, however deeply nested, or MISSING when it is null or not JSON.

    NaN and Infinity are refused. A leading byte-order mark is ignored.
    """
    if text is None:
        return MISSING
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    text = text.lstrip("\ufeff")
    try:
        value, end = decode_at(text, skip_space(text, 0), numbers_as_text)
    except ValueError:
        return MISSING
    return value if skip_space(text, end) == len(text) else MISSING


def skip_space(text: str, at: int) -> int:
    """Where the white space that starts at ``at`` ends."""
    return _SPACE.match(text, at).end()  # type: ignore[union-attr]


def decode_at(text: str, at: int, numbers_as_text: bool = False) -> tuple[Any, int]:
    """The JSON value that starts at ``at`` and where it ends; ValueError when there is none.

    The library's reader goes first; values nested deeper than it can follow are read with a stack of their own.
    """
    try:
        return (_TEXT_READER if numbers_as_text else _READER).raw_decode(text, at)
    except RecursionError:
        return _decode_deep(text, at, numbers_as_text)


def _member_name(text: str, at: int) -> tuple[str, int]:
    """A member's name and where its value starts."""
    if text[at : at + 1] != '"':
        raise ValueError("a name is missing")
    name, at = scanstring(text, at + 1, True)
    at = skip_space(text, at)
    if text[at : at + 1] != ":":
        raise ValueError("a colon is missing")
    return name, skip_space(text, at + 1)


def _scalar(text: str, at: int, numbers_as_text: bool) -> tuple[Any, int]:
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, True)
    if m := _WORD.match(text, at):
        return _WORDS[m[0]], m.end()
    if not (m := _NUMBER.match(text, at)):
        raise ValueError("no value")
    if numbers_as_text:
        return m[0], m.end()
    return (float(m[0]) if m[2] or m[3] else int(m[0])), m.end()


def _decode_deep(text: str, at: int, numbers_as_text: bool) -> tuple[Any, int]:
    open_boxes: list[Any] = []
    names: list[str] = []
    while True:
        sign = text[at : at + 1]
        value: Any = {} if sign == "{" else [] if sign == "[" else None
        if value is None:
            value, at = _scalar(text, at, numbers_as_text)
        else:
            at = skip_space(text, at + 1)
            if text[at : at + 1] == ("}" if sign == "{" else "]"):
                at += 1
            else:
                open_boxes.append(value)
                names.append("")
                if sign == "{":
                    names[-1], at = _member_name(text, at)
                continue
        while open_boxes:  # the value is whole: it goes into the innermost open box, which may be whole then
            box = open_boxes[-1]
            if isinstance(box, dict):
                box[names[-1]] = value
            else:
                box.append(value)
            at = skip_space(text, at)
            sign = text[at : at + 1]
            if sign == ",":
                at = skip_space(text, at + 1)
                if isinstance(box, dict):
                    names[-1], at = _member_name(text, at)
                break
            if sign != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("a separator is missing")
            value = open_boxes.pop()
            names.pop()
            at += 1
        else:
            return value, at


def unwrap(value: Any) -> Any:
    """A value that was written as JSON text inside a JSON string, however often; any other value as it is."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"'):
            return value
        inner = read_json(value)
        if inner is MISSING:
            return value
        value = inner
    return value


def member(node: dict, name: str) -> Any:
    """A member by its name in any letter case; of several, the last; None when absent."""
    found, low = None, name.lower()
    for k, v in node.items():
        if k == name or k.lower() == low:
            found = v
    return found


def as_list(value: Any) -> list:
    """A list as it is, a lone object as a list of one, anything else as an empty list."""
    value = unwrap(value)
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


def canonical(value: Any) -> str:
    """JSON text that is equal for equal values of any depth: members sorted, spacing removed, 1.0 written as 1."""
    try:
        return _SORTED.encode(_plain_numbers(value))
    except RecursionError:
        return _write_deep(value, True)


def json_text(value: Any) -> str:
    """Compact JSON text of a value of any depth; signs outside ASCII stay as they are."""
    try:
        return _COMPACT.encode(value)
    except RecursionError:
        return _write_deep(value, False)


_SORTED = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)
_COMPACT = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def _plain_number(value: Any) -> Any:
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 else value


def _plain_numbers(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain_numbers(v) for v in value]
    return _plain_number(value)


def _write_deep(value: Any, canonical: bool) -> str:
    """The text of ``canonical`` or ``json_text`` for values nested too deeply for the library's writer."""
    out: list[str] = []
    todo: list[Any] = [value]  # values to write, and in 1-tuples the text between them
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, (dict, list)):
            inner: list[Any] = []
            members = (sorted(x.items(), key=_name_of) if canonical else x.items()) if isinstance(x, dict) else ((None, v) for v in x)
            for k, v in members:
                inner += [("," if inner else "",), ("" if k is None else _COMPACT.encode(k) + ":",), v]
            start, end = "{}" if isinstance(x, dict) else "[]"
            todo += [(end,), *reversed(inner), (start,)]
        else:
            out.append(_COMPACT.encode(_plain_number(x) if canonical else x))
    return "".join(out)


def _name_of(item: tuple[str, Any]) -> str:
    return item[0]



def digest(text: str) -> bytes:
    """A 16-byte digest of a text; lone surrogates are allowed."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scalar_text(value: Any) -> str | None:
    """A scalar member as text: strings as they are, null as None, other values as JSON text without lone surrogates."""
    if value is None or value is MISSING:
        return None
    if not isinstance(value, str):
        value = canonical(value)
    return value.encode("utf-8", "replace").decode("utf-8")
