"""Export lines as text (B2, B3): JSON with HTML signs escaped, CSV with minimal quoting. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A JSON string literal that also escapes < > & and the two line separators; null as ''. Bytes that are no UTF-8 are written as an escape too."""
    given = F.coalesce(c, F.lit(""))
    text = F.replace(given, F.lit("\\"), F.lit("\\\\"))
    text = F.when(F.is_valid_utf8(given), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit(chr(0xFFFD)), F.lit("\\ufffd")))
    for sign, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    rest = [chr(i) for i in [*range(0x20)] if chr(i) not in "\n\r\t\b\f"]
    escaped = text
    for sign in rest:
        escaped = F.replace(escaped, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    # Other control signs are rare: the chain runs only for texts that hold one.
    text = F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(text)
    return F.concat(F.lit('"'), text, F.lit('"'))


def json_line(columns: list[str]) -> Column:
    """One JSON object of string members in the order of ``columns`` (B1)."""
    parts: list[Column] = []
    for i, c in enumerate(columns):
        parts += [F.lit(("," if i else "{") + f'"{c}":'), json_string(F.col(c))]
    return F.concat(*parts, F.lit("}"))


def csv_field(c: Column) -> Column:
    """A CSV field: quoted when it holds a comma, quote or line end, starts with white space, or is ``\\.``; null as ''."""
    text = F.coalesce(c, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[,"\r\n]|^[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]') | (text == "\\."), quoted).otherwise(text)


def csv_line(columns: list[str]) -> Column:
    """One CSV record."""
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])
