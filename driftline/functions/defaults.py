"""Column defaults that can be carried to another database: literals only."""

from __future__ import annotations

import re

#: What marks an expression as more than a literal.
NOT_PORTABLE = ("nextval(", "select ", "array[")
_CAST = re.compile(r"::\s*[a-z_][\w \"]*(\([\d, ]*\))?(\[\])?$", re.I)
_STRING = re.compile(r"'((?:[^']|'')*)'")
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?", re.I)
_SHAPES = {
    "date": r"\d{4}-\d{2}-\d{2}",
    "time": r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?",
    "timestamp": r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?",
    "timestamptz": r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}(:?\d{2})?|Z)?",
}
NUMERIC_TYPES = ("int2", "int4", "int8", "oid", "float4", "float8", "numeric")


def _bare(expression: str) -> str:
    """Without casts and parentheses around the whole."""
    text = expression.strip()
    while True:
        before = text
        if text.startswith("(") and text.endswith(")") and _closes_at_end(text):
            text = text[1:-1].strip()
        cast = _CAST.search(text)
        if cast and not _inside_quotes(text, cast.start()):
            text = text[: cast.start()].strip()
        if text == before:
            return text


def _inside_quotes(text: str, at: int) -> bool:
    return text[:at].count("'") % 2 == 1


def _closes_at_end(text: str) -> bool:
    depth, quoted = 0, False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if depth == 0 and i < len(text) - 1:
                return False
    return depth == 0


def parse_default(expression: str | None, pg_type: str) -> str | None:
    """The literal value of a default as text, or None where it is none or
    can't be carried over."""
    if expression is None or any(x in expression.lower() for x in NOT_PORTABLE):
        return None
    text = _bare(expression)
    if text.lower() in ("true", "false"):
        return text.lower() if pg_type == "bool" else None
    if _NUMBER.fullmatch(text):
        return text if pg_type in NUMERIC_TYPES else None
    found = _STRING.fullmatch(text)
    if not found:
        return None
    value = found[1].replace("''", "'")
    if pg_type in _SHAPES and not re.fullmatch(_SHAPES[pg_type], value):
        return None
    if pg_type in NUMERIC_TYPES and not _NUMBER.fullmatch(value):
        return None
    return value


def render_default(value: str, pg_type: str, typed: bool = True) -> str:
    """SQL text of a parsed default; numbers and truth values stand bare."""
    if pg_type in NUMERIC_TYPES or pg_type == "bool":
        return value
    quoted = "'" + value.replace("'", "''") + "'"
    return f"{pg_type.upper()} {quoted}" if typed and pg_type in ("date", "timestamp") else quoted


def parse_defaults(columns):
    """``literal`` beside rows of ``expression`` and ``type``, as
    :func:`parse_default` gives it. Catalog rows, one for each column."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        for b in batches:
            b["literal"] = [parse_default(e, t) for e, t in zip(b["expression"], b["type"], strict=True)]
            yield b

    return columns.mapInPandas(run, StructType([*columns.schema, StructField("literal", StringType())]))
