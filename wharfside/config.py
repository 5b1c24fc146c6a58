"""Configuration over defaults (A31, O6-O8, O10): objects merge, lists replace, unknown members are refused."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: Defaults. Fixed values.
DEFAULTS: dict[str, Any] = {
    "storage": {"path": "index"},
    "crawler": {"maxDepth": 2, "maxCatalogDepth": 3, "maxReferralDepth": 2, "maxPagesPerDomain": 200, "maxAttempts": 3, "refreshHours": 168, "leaseSeconds": 600, "maxBodyBytes": 5 << 20},
    "registry": {"harvest": True, "pageLimit": 0},
    "ard": {"fetchArtifacts": True},
    "worker": {"index": 0, "count": 1},
    "log": {"level": "info", "path": ""},
}
MOST_WORKERS = 8192
#: Smallest values of numbers, and the words that a text may be. Fixed values.
LEAST = {"crawler.maxAttempts": 1, "crawler.refreshHours": 0, "crawler.leaseSeconds": 0, "crawler.maxBodyBytes": 0, "crawler.maxDepth": 0, "crawler.maxCatalogDepth": 0, "crawler.maxReferralDepth": 0, "crawler.maxPagesPerDomain": 0, "registry.pageLimit": 0, "worker.index": 0, "worker.count": 1}
WORDS = {"log.level": ["debug", "info", "warn", "error"]}


def _kind(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else {int: "integer", str: "string", dict: "object", list: "array", float: "number"}.get(type(value), "null")


def problems(given: Any, known: Any, at: str = "config") -> list[str]:
    """Messages ``config.a.b: what`` for every member that doesn't fit."""
    if isinstance(known, dict):
        if not isinstance(given, dict):
            return [f"{at}: expected object"]
        out = [f"{at}.{k}: unknown member" for k in given if k not in known]
        return out + [m for k, v in given.items() if k in known for m in problems(v, known[k], f"{at}.{k}")]
    place = at.removeprefix("config.")
    if place in WORDS and isinstance(given, str) and given not in WORDS[place]:
        return [f"{at}: must be one of {', '.join(WORDS[place])}"]
    if place in LEAST and isinstance(given, (int, float)) and not isinstance(given, bool) and given < LEAST[place]:
        return [f"{at}: must be at least {LEAST[place]}"]
    whole = isinstance(given, float) and given.is_integer() and _kind(known) == "integer"
    return [] if whole or _kind(given) == _kind(known) else [f"{at}: expected {_kind(known)}"]


def _merged(known: Any, given: Any) -> Any:
    if isinstance(known, dict):
        return {k: _merged(v, given[k]) if k in given else copy.deepcopy(v) for k, v in known.items()}
    return int(given) if isinstance(given, float) and _kind(known) == "integer" else given


def load_text(text: str) -> dict[str, Any]:
    """A configuration from JSON text; ValueError with all messages when it doesn't fit."""
    given = json.loads(text)
    found = problems(given, DEFAULTS)
    if found:
        raise ValueError("; ".join(found))
    out = _merged(DEFAULTS, given)
    worker = out["worker"]
    if not 1 <= worker["count"] <= MOST_WORKERS or not 0 <= worker["index"] < worker["count"]:
        raise ValueError(f"config.worker: index must be below count, and count at most {MOST_WORKERS}")
    return out


def load(explicit: str = "", folders: list[str] | None = None, name: str = "wharfside.json") -> dict[str, Any]:
    """The first of: the explicit file, the working folder's, the others in ``folders``; without any the defaults. Relative storage paths count from the file."""
    places = [Path(explicit)] if explicit else [Path(f) / name for f in [".", *(folders or [])]]
    for p in places:
        if p.is_file():
            out = load_text(p.read_text())
            if out["storage"]["path"] and not Path(out["storage"]["path"]).is_absolute():
                out["storage"]["path"] = str(p.resolve().parent / out["storage"]["path"])
            return out
    return copy.deepcopy(DEFAULTS)


def worker_part(flag: str) -> tuple[int, int]:
    """(index, count) of a worker flag ``index/count``; ValueError when it is no such flag."""
    index, slash, count = flag.partition("/")
    if not slash or not index.strip().isdigit() or not count.strip().isdigit():
        raise ValueError(f"{flag!r} is not index/count")
    i, n = int(index), int(count)
    if not 1 <= n <= MOST_WORKERS or i >= n:
        raise ValueError(f"{flag!r}: index must be below count, and count from 1 to {MOST_WORKERS}")
    return i, n


def or_default(given: Any, default: Any) -> Any:
    """A setting that was given, else the default: 0, '' and empty lists count as not given."""
    return given or default


def counted(n: int, one: str, many: str = "") -> str:
    """``1 catalog``, ``2 catalogs``."""
    return f"{n} {one if n == 1 else many or one + 's'}"
