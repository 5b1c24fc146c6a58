"""A small JSON Schema (2020-12) evaluator for the keywords that the catalog schema uses, and that schema."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

_TEXT = {"type": "string"}
_TEXTS = {"type": "array", "items": _TEXT}

#: The published schema of catalog documents, without its annotations. Fixed values.
CATALOG_SCHEMA: dict[str, Any] = {
    "type": "object",
    "required": ["specVersion", "entries"],
    "properties": {
        "specVersion": {"type": "string", "enum": ["1.0"]},
        "host": {
            "type": "object",
            "required": ["displayName"],
            "properties": {"displayName": _TEXT, "identifier": _TEXT, "documentationUrl": _TEXT, "logoUrl": _TEXT, "trustManifest": {"$ref": "#/$defs/trustManifest"}},
            "additionalProperties": False,
        },
        "entries": {"type": "array", "items": {"$ref": "#/$defs/catalogEntry"}},
    },
    "additionalProperties": False,
    "$defs": {
        "catalogEntry": {
            "type": "object",
            "required": ["identifier", "displayName", "type"],
            "oneOf": [{"required": ["url"], "not": {"required": ["data"]}}, {"required": ["data"], "not": {"required": ["url"]}}],
            "properties": {
                "identifier": {"type": "string", "pattern": r"^urn:air?:[a-zA-Z0-9.-]+(:[a-zA-Z0-9._-]+)+$"},
                "displayName": _TEXT,
                "type": _TEXT,
                "url": _TEXT,
                "data": {"type": "object"},
                "description": _TEXT,
                "tags": _TEXTS,
                "capabilities": _TEXTS,
                "representativeQueries": {"type": "array", "minItems": 2, "maxItems": 5, "items": _TEXT},
                "version": _TEXT,
                "updatedAt": _TEXT,
                "metadata": {"type": "object", "additionalProperties": {"type": ["string", "number", "boolean", "null"]}},
                "trustManifest": {"$ref": "#/$defs/trustManifest"},
            },
        },
        "trustManifest": {
            "type": "object",
            "required": ["identity"],
            "properties": {
                "identity": _TEXT,
                "identityType": {"type": "string", "enum": ["spiffe", "did", "https", "other"]},
                "trustSchema": {"$ref": "#/$defs/trustSchema"},
                "attestations": {
                    "type": "array",
                    "items": {
                        "type": "object",
                        "required": ["type", "uri", "mediaType"],
                        "properties": {"type": _TEXT, "uri": _TEXT, "mediaType": _TEXT, "digest": _TEXT},
                        "additionalProperties": False,
                    },
                },
                "provenance": {
                    "type": "array",
                    "items": {
                        "type": "object",
                        "required": ["relation", "sourceId"],
                        "properties": {"relation": {"type": "string", "enum": ["derivedFrom", "publishedFrom", "copiedFrom"]}, "sourceId": _TEXT, "sourceDigest": _TEXT},
                        "additionalProperties": False,
                    },
                },
                "signature": _TEXT,
            },
            "additionalProperties": False,
        },
        "trustSchema": {
            "type": "object",
            "required": ["identifier", "version"],
            "properties": {"identifier": _TEXT, "version": _TEXT, "governanceUri": _TEXT, "verificationMethods": _TEXTS},
            "additionalProperties": False,
        },
    },
}

Failure = tuple[str, str]


def _is(value: Any, kind: str) -> bool:
    if kind == "null":
        return value is None
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, {"object": dict, "array": list, "string": str}[kind])


def failures(value: Any, schema: dict[str, Any], root: dict[str, Any] | None = None, at: str = "") -> Iterator[Failure]:
    """(JSON pointer, detail) of every failed keyword."""
    root = schema if root is None else root
    if ref := schema.get("$ref"):
        target: Any = root
        for step in ref.removeprefix("#/").split("/"):
            target = target[step]
        yield from failures(value, target, root, at)
    if kinds := schema.get("type"):
        allowed = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in allowed):
            yield at, f"expected {' or '.join(allowed)}"
            return
    if "enum" in schema and value not in schema["enum"]:
        yield at, f"value must be one of {', '.join(map(repr, schema['enum']))}"
    if "not" in schema and not any(True for _ in failures(value, schema["not"], root, at)):
        yield at, "'not' failed"
    if "oneOf" in schema:
        fits = sum(not any(True for _ in failures(value, s, root, at)) for s in schema["oneOf"])
        if fits != 1:
            yield at, f"'oneOf' failed, {fits} subschemas matched"
    if isinstance(value, str) and (pattern := schema.get("pattern")):
        if not re.search(pattern.removesuffix("$") + (r"\Z" if pattern.endswith("$") else ""), value):
            yield at, f"does not match pattern {pattern!r}"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield at, f"minItems: got {len(value)}, want {schema['minItems']}"
        if len(value) > schema.get("maxItems", len(value)):
            yield at, f"maxItems: got {len(value)}, want {schema['maxItems']}"
        if "items" in schema:
            for i, v in enumerate(value):
                yield from failures(v, schema["items"], root, f"{at}/{i}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        missing = [n for n in schema.get("required", []) if n not in value]
        if missing:
            yield at, f"missing properties {', '.join(missing)}"
        extra = schema.get("additionalProperties", True)
        for k, v in value.items():
            below = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
            if k in known:
                yield from failures(v, known[k], root, below)
            elif extra is False:
                yield at, f"additional property {k!r} not allowed"
            elif isinstance(extra, dict):
                yield from failures(v, extra, root, below)
