"""A parsing expression grammar for several values in one string (plain Python, used inside an Arrow function).

    field    <- ws (json / wrapped / bracket / brace / list) ws !.
    json     <- a JSON array; a JSON string is read again as a field
    bracket  <- '[' item (',' item)* ']'        items quoted either way, or bare
    brace    <- '{' item (',' item)* '}'
    list     <- value (sep value)*
    value    <- ws mark? (quoted ws &(sep / !.) / bare)
    mark     <- at the start of a line: '-', '*', '+', bullet or number with a following space
    quoted   <- '"' (escape / '""' / !'"' .)* '"' / "'" (escape / "''" / !"'" .)* "'"
    bare     <- (escape / !sep .)*
    sep      <- one of , ; | tab newline, ideographic and fullwidth comma, fullwidth semicolon and bar, bullet

Alternatives are ordered: a quoted value that is not followed by a separator
or the end is given up and read as a bare one. That is reported as an error
flag, as are brackets that never close.
"""

from __future__ import annotations

import re

from wharfside.functions.jsontext import MISSING, read_json, scalar_text

#: Separators between values. Fixed values.
SEPARATORS = ",;|\t\n\r，、；｜•"
#: Error flags.
BAD_QUOTE, BAD_BRACKET = 1, 2

_SPACE = re.compile(r"[^\S\t\n\r]*")
_BLANK = re.compile(r"\s*")
#: Trimmed off a value besides white space: zero-width space and byte-order mark. Fixed values.
_EDGE = " \t\n\r\f\v\u00a0\u2009\u3000\u200b\ufeff"
_MARK = re.compile(r"(?:[-*+‣◦·–]|\d{1,4}[.)])[ \t]+")
_QUOTED = {
    '"': re.compile(r'"((?:\\.|""|[^"\\])*)"', re.S),
    "'": re.compile(r"'((?:\\.|''|[^'\\])*)'", re.S),
    "“": re.compile(r"“([^”]*)”", re.S),
}
_BARE = re.compile(rf"(?:\\.|[^{re.escape(SEPARATORS)}\\]|\\$)*", re.S)
_BARE_IN = {"]": re.compile(r"(?:\\.|[^,\]\\])*", re.S), "}": re.compile(r"(?:\\.|[^,}\\])*", re.S)}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

Items = list[tuple[str, int]]


def _escaped(m: re.Match[str]) -> str:
    e = m[1]
    if len(e) == 5:
        return chr(int(e[1:], 16))
    return _SHORT.get(e, e)


def _unescape_quoted(body: str, quote: str) -> str:
    body = body.replace(quote * 2, quote) if quote in "\"'" else body
    return _ESCAPE.sub(_escaped, body)


def _unescape_bare(text: str) -> str:
    """In a bare value a backslash protects the next sign when that isn't a letter or digit."""
    return re.sub(r"\\([^\w\s]|[\t\n])", r"\1", text)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.items: Items = []
        #: Quotes that never close from here on: a quote without partner is looked for once, not from every later place.
        self.open_ended: set[str] = set()

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()  # type: ignore[union-attr]

    def quoted(self, after: str) -> bool:
        """A quoted value that a sign of ``after`` or the end follows; else nothing is consumed."""
        sign = self.text[self.at : self.at + 1]
        form = _QUOTED.get(sign)
        if not form or sign in self.open_ended:
            return False
        if not (m := form.match(self.text, self.at)):
            self.open_ended.add(sign)
            return False
        end = _SPACE.match(self.text, m.end()).end()  # type: ignore[union-attr]
        if end < len(self.text) and self.text[end] not in after:
            return False
        self.items.append((_unescape_quoted(m[1], sign), 0))
        self.at = end
        return True

    def value(self) -> None:
        self.space()
        flag = 0
        if self._line_start() and (m := _MARK.match(self.text, self.at)):
            self.at = m.end()
        if self.quoted(SEPARATORS):
            return
        if self.text[self.at : self.at + 1] in _QUOTED:
            flag = BAD_QUOTE
        m = _BARE.match(self.text, self.at)
        assert m
        self.items.append((_unescape_bare(m[0]), flag))
        self.at = m.end()

    def _line_start(self) -> bool:
        back = self.at - 1
        while back >= 0 and self.text[back] == " ":
            back -= 1
        return back < 0 or self.text[back] in "\n\r"

    def listed(self) -> Items:
        while True:
            self.value()
            if self.at >= len(self.text):
                return self.items
            self.at += 1  # the separator

    def enclosed(self, close: str) -> Items | None:
        """The values between a bracket and its partner at the end of the text; None when it isn't there."""
        self.at = 1
        while True:
            self.at = _BLANK.match(self.text, self.at).end()  # type: ignore[union-attr]
            if not self.quoted("," + close + "\n\t"):
                m = _BARE_IN[close].match(self.text, self.at)
                assert m
                bare = _unescape_bare(m[0]).strip()
                if bare not in ("null", "None", "NULL"):
                    self.items.append((bare, 0))
                self.at = m.end()
            self.at = _BLANK.match(self.text, self.at).end()  # type: ignore[union-attr]
            if self.at >= len(self.text):
                return None
            if self.text[self.at] == close:
                return self.items if self.at == len(self.text) - 1 else None
            self.at += 1


def _leaves(value: list) -> list[str]:
    """The scalars and objects of nested lists, in order."""
    out: list[str] = []
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        else:
            out.append(scalar_text(x) or "")
    return out


def _unquoted(text: str) -> str:
    """The list inside a text that was quoted as a whole as a JSON string, however often; any other text as it is."""
    inner: object = text
    while isinstance(inner, str):
        bare = inner.strip()
        if bare[:1] in ("[", "{") and bare[-1:] in ("]", "}"):
            return bare
        if bare[:1] != '"':
            break
        inner = read_json(bare)
    return text


def _field(text: str) -> Items:
    text = _unquoted(text.strip())
    head = text[:1]
    if head == "[" and isinstance(value := read_json(text), list):
        return [(v, 0) for v in _leaves(value)]
    if head == "[" and text.endswith("]"):
        if (items := _Parser(text).enclosed("]")) is not None:
            return items
    if head == "{" and text.endswith("}"):
        if (items := _Parser(text).enclosed("}")) is not None:
            return items
    if head in ("[", "{"):
        return [(v, f | BAD_BRACKET) for v, f in _Parser(text[1:].rstrip("]}")).listed()]
    return _Parser(text).listed() if text else []


def split_values(text: str | None) -> Items:
    """The values of a field in written order, trimmed, without empty ones, each with its error flags."""
    if not text:
        return []
    out = []
    for v, flag in _field(text):
        v = v.strip(_EDGE)
        if v:
            out.append((v.encode("utf-8", "replace").decode("utf-8"), flag))
    return out
