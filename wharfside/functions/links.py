"""URL resolution, HTML links, robots directives (G5, G22, G24, A9): Arrow functions over plain Python."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_TEXTS = T.ArrayType(T.StringType())
LINKS_SCHEMA = T.StructType([T.StructField(n, _TEXTS) for n in ("links", "hosts", "hints")])


def _readable(url: str) -> bool:
    if _CONTROL.search(url):
        return False
    try:
        parts = urlsplit(url)
        _ = parts.port
    except ValueError:
        return False
    head = url.split("?", 1)[0].split("#", 1)[0]
    if _BAD_ESCAPE.search(head) or " " in parts.netloc:
        return False
    return not (not _SCHEME.match(url) and ":" in head.split("/", 1)[0])


def resolve_http_url(base: str | None, ref: str | None, strip_fragment: bool = True) -> str | None:
    """``ref`` against ``base``; None unless the result is http(s) with a host and both can be read."""
    ref = (ref or "").strip()
    if not ref or base is None or not _readable(ref) or not _readable(base):
        return None
    try:
        parts = urlsplit(urljoin(base, ref))
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    if strip_fragment:
        parts = parts._replace(fragment="")
    path = re.sub(r"[ \"<>^`{|}]|[^\x00-\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), parts.path)
    return parts._replace(path=path).geturl()


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.anchors: list[str] = []
        self.hints: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k.lower(), v or "")
        href = first.get("href")
        if href is None:
            return
        if tag == "base":
            if self.base is None and href.strip():
                self.base = href
        elif tag in ("a", "area"):
            self.anchors.append(href)
        elif tag == "link" and "ai-catalog" in first.get("rel", "").lower().split():
            self.hints.append(href)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)


def extract_links(base_url: str | None, html: str | None) -> dict[str, list[str]]:
    """Sorted distinct links, hosts (with port) and catalog hints of a page, against its first base."""
    if base_url is None or not _readable(base_url):
        return {"links": [], "hosts": [], "hints": []}
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    base = base_url
    if parser.base is not None and _readable(parser.base.strip()):
        base = urljoin(base_url, parser.base.strip())
    links = {u for h in parser.anchors if (u := resolve_http_url(base, h))}
    hints = {u for h in parser.hints if (u := resolve_http_url(base, h))}
    hosts = {urlsplit(u).netloc.rpartition("@")[2] for u in links}
    return {"links": sorted(links), "hosts": sorted(hosts), "hints": sorted(hints)}


def agentmap_urls(raw: str | None, robots_url: str) -> list[str]:
    """URLs of the Agentmap lines of a robots.txt, in order, each once, fragments kept."""
    out: dict[str, None] = {}
    for line in (raw or "").split("\n"):
        line = line.strip()
        if line.lower().startswith("agentmap:") and (url := resolve_http_url(robots_url, line[len("agentmap:") :], strip_fragment=False)):
            out[url] = None
    return list(out)


def robots_allow(raw: str | None, url: str, agent: str) -> bool:
    """Whether a robots.txt lets ``agent`` fetch ``url``; without a robots.txt it does."""
    return not raw or _rules(raw).can_fetch(agent, url)


@lru_cache(256)
def _rules(raw: str) -> RobotFileParser:
    """A robots.txt parsed once for the URLs of its host that are asked in a row."""
    rules = RobotFileParser()
    rules.parse(raw.splitlines())
    return rules


@F.pandas_udf(T.StringType())
def resolve_http_url_udf(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([resolve_http_url(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


@F.pandas_udf(LINKS_SCHEMA)
def extract_links_udf(base: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_links(b, h) for b, h in zip(base, html, strict=True)], columns=["links", "hosts", "hints"])


@F.pandas_udf(_TEXTS)
def agentmap_urls_udf(raw: pd.Series, robots_url: pd.Series) -> pd.Series:
    return pd.Series([agentmap_urls(a, b) for a, b in zip(raw, robots_url, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def robots_allow_udf(raw: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    return pd.Series([robots_allow(*x) for x in zip(raw, url, agent, strict=True)])
