"""Members of a JSON object with the text they were written as (plain Python)."""

from __future__ import annotations

from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

from wharfside.functions.jsontext import decode_at
from wharfside.functions.jsontext import skip_space as _skip


def object_members(text: str, at: int = 0) -> Iterator[tuple[str, Any, str]]:
    """(name, value, written text) of the object that starts at ``at``; the text must be valid JSON."""
    at = _skip(text, at)
    if text[at] != "{":
        return
    at = _skip(text, at + 1)
    while text[at] != "}":
        name, at = scanstring(text, at + 1, True)
        at = _skip(text, _skip(text, at) + 1)
        value, end = decode_at(text, at)
        yield name, value, text[at:end]
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


def list_items(text: str) -> Iterator[tuple[Any, str]]:
    """(value, written text) of the items of a list; the text must be valid JSON."""
    at = _skip(text, 0)
    if text[at] != "[":
        return
    at = _skip(text, at + 1)
    while text[at] != "]":
        value, end = decode_at(text, at)
        yield value, text[at:end]
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


def written_member(text: str, name: str) -> tuple[Any, str] | None:
    """Value and written text of a member by its name in any letter case, of several the last."""
    found = None
    for key, value, written in object_members(text):
        if key.lower() == name.lower():
            found = (value, written)
    return found
