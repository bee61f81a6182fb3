"""Decoders of Postgres text values as Spark expressions.

Each takes a string column and gives a typed one. ``strict`` decoders raise on
text that isn't of the type, naming the value; others give NULL, for an audit.
Built-in expressions do all of it but quoted array literals, which take an
Arrow UDF only where a value has quotes or escapes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the COPY text format: letters after a backslash that name a control byte.
COPY_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _or_fail(good: Column, value: Column, text: Column, kind: str, strict: bool) -> Column:
    if not strict:
        return F.when(good, value)
    return F.when(text.isNull() | good, value).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)))


def bool_text(s: Column, strict: bool = True) -> Column:
    return _or_fail(s.isin("t", "f"), s == "t", s, "bool", strict)


def bytea_hex(s: Column, strict: bool = True) -> Column:
    """``\\x`` and an even number of hex digits of either case."""
    return _or_fail(s.rlike(r"^\\x([0-9A-Fa-f]{2})*$"), F.unhex(F.substring(s, 3, 1 << 30)), s, "bytea", strict)


def date_text(s: Column, strict: bool = True) -> Column:
    good = s.rlike(r"^\d{4}-\d{2}-\d{2}$")
    value = F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date")
    return _or_fail(good & value.isNotNull(), value, s, "date", strict)


_TIME = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?"
#: A UTC offset below 16 hours.
_OFFSET = r"[+-](0\d|1[0-5])(:?[0-5]\d)?(:?[0-5]\d)?"


def time_micros(s: Column, strict: bool = True) -> Column:
    """Microseconds since midnight of ``HH:MM:SS[.f]`` with up to 9 digits of a
    fraction, cut to microseconds."""
    two = lambda start: F.substring(s, start, 2).cast("long")
    fraction = F.rpad(F.substring(s, 10, 6), 6, "0").cast("long")
    return _or_fail(s.rlike(rf"^{_TIME}\z"), (two(1) * 3600 + two(4) * 60 + two(7)) * 1_000_000 + fraction, s, "time", strict)


# One pattern decides whether a text is good, and its parts are then cut out at
# their places: parts found by patterns of their own are run again wherever an
# expression names them, and their code grows too large to be compiled.


def _apart(s: Column) -> tuple[Column, Column]:
    """What is before and after the last sign, where the text before it has none."""
    marked = F.translate(s, "+", "-")
    return F.substring_index(marked, "-", 1), F.substring_index(marked, "-", -1)


def _offset_digits(s: Column) -> Column:
    """``HHMMSS`` of a good offset at the end of the text."""
    return F.rpad(F.translate(_apart(s)[1], ":", ""), 6, "0")


def _offset_negative(s: Column) -> Column:
    return ~F.contains(F.substring_index(s, "-", -1), F.lit("+"))


def _offset_value(s: Column) -> Column:
    """Seconds of a good offset at the end of the text."""
    digits = _offset_digits(s)
    two = lambda start: F.substring(digits, start, 2).cast("int")
    return F.when(_offset_negative(s), -1).otherwise(1) * (two(1) * 3600 + two(3) * 60 + two(5))


def offset_seconds(s: Column) -> Column:
    """Seconds of a UTC offset at the end of the text: ``+HH``, ``+HHMM[SS]`` or
    ``+HH:MM[:SS]``, below 16 hours; NULL for anything else."""
    return F.when(s.rlike(rf"{_OFFSET}\z"), _offset_value(s))


def _timestamp_body(s: Column) -> Column:
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?$"), F.substring(s, 1, 26))


def timestamp_text(s: Column, strict: bool = True) -> Column:
    """A timestamp without zone; digits beyond microseconds are cut."""
    value = _timestamp_body(s).try_cast("timestamp_ntz")
    return _or_fail(value.isNotNull(), value, s, "timestamp", strict)


def timestamptz_text(s: Column, strict: bool = True) -> Column:
    """A timestamp with offset, as an instant. The session's zone must be UTC."""
    good = s.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}{_OFFSET}\z")
    body = F.concat(F.substring(s, 1, 10), F.substring(_apart(F.substring(s, 11, 1 << 30))[0], 1, 16))  # cut to microseconds
    value = F.when(good, body.try_cast("timestamp_ntz").cast("timestamp") - F.make_dt_interval(secs=_offset_value(s).cast("decimal(18,6)")))
    return F.coalesce(value, F.when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a timestamptz: "), s)))) if strict else value


def timetz_text(s: Column, strict: bool = True) -> Column:
    """Canonical ``HH:MM:SS[.f]+HH[:MM[:SS]]``; zero minutes and seconds of the
    offset are left out, as are zeros at the end of the fraction."""
    time, digits = _apart(s)[0], _offset_digits(s)
    head = F.when(F.contains(time, F.lit(".")), F.rtrim(F.rtrim(time, F.lit("0")), F.lit("."))).otherwise(time)
    sign = F.when(_offset_negative(s) & (digits != "000000"), "-").otherwise("+")
    part = lambda start, shown: F.when(shown, F.concat(F.lit(":"), F.substring(digits, start, 2))).otherwise("")
    tail = F.concat(sign, F.substring(digits, 1, 2), part(3, F.substring(digits, 3, 4) != "0000"), part(5, F.substring(digits, 5, 2) != "00"))
    return _or_fail(s.rlike(rf"^{_TIME}{_OFFSET}\z"), F.concat(head, tail), s, "timetz", strict)


_NUMERIC = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def numeric_canonical(s: Column, strict: bool = True) -> Column:
    """The canonical text of a numeric without exponent: no plus sign, digit
    separators or leading zeros; zero has no sign; trailing zeros are kept.
    NaN and infinities have their usual names. Texts with an exponent go
    through DECIMAL(38,s) semantics and are NULL beyond it."""
    plain = F.regexp_replace(F.trim(s), "_", "")
    low = F.lower(plain)
    special = F.when(low == "nan", "NaN").when(low.isin("inf", "infinity", "+inf", "+infinity"), "Infinity").when(low.isin("-inf", "-infinity"), "-Infinity")
    mantissa = F.regexp_extract(plain, r"^[+-]?([\d.]*)", 1)
    whole = F.regexp_replace(F.regexp_extract(mantissa, r"^(\d*)", 1), r"^0+(?=\d)", "")
    fraction = F.regexp_extract(mantissa, r"\.(\d*)$", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(plain, r"[eE]([+-]?\d+)$", 1), F.lit("")), F.lit("0")).try_cast("int")
    scale = F.greatest(F.lit(0), F.length(fraction) - power)
    digits = F.concat(whole, fraction)
    widened = F.when(power >= F.length(fraction), F.concat(digits, F.repeat(F.lit("0"), (power - F.length(fraction)).cast("int")))).otherwise(F.lpad(digits, F.greatest(F.length(digits), scale + 1).cast("int"), "0"))
    number = F.regexp_replace(F.substring(widened, F.lit(1), (F.length(widened) - scale).cast("int")), r"^0+(?=\d)", "")
    number = F.when(number == "", "0").otherwise(number)
    shown = F.concat(number, F.when(scale > 0, F.concat(F.lit("."), F.substring(widened, (F.length(widened) - scale + 1).cast("int"), scale.cast("int")))).otherwise(""))
    sign = F.when(plain.startswith("-") & shown.rlike("[1-9]"), "-").otherwise("")
    good = special.isNotNull() | (F.trim(s).rlike(_NUMERIC) & power.between(-16383, 131072) & (scale <= 16383))
    written = _or_fail(F.coalesce(good, F.lit(False)), F.when(special.isNotNull(), special).otherwise(F.concat(sign, shown)), s, "numeric", strict)
    #: Most texts are canonical as they come.
    return F.when(s.rlike(r"^(?:-(?=[0.]*[1-9]))?(?:0|[1-9]\d*)(?:\.\d+)?$") & (F.length(s) < 16383), s).otherwise(written)


def numeric_text(s: Column, precision: int | None, scale: int | None, strict: bool = True) -> Column:
    """DECIMAL where Spark can hold every finite value of the type, NaN being
    NULL; else the text. A value with more digits than the type's scale is
    none of the type: it is never rounded."""
    if precision is None or scale is None or not decimal_fits(precision, scale):
        return numeric_canonical(s, strict)
    kind = T.DecimalType(precision, scale)
    digits = rf"(?:\d+(?:\.\d{{0,{scale}}}0*)?|\.\d{{0,{scale}}}0*)$"
    written = numeric_canonical(s, False)  # separators, signs and exponents are written out first
    value = F.when(s.rlike("^-?" + digits), s.try_cast(kind)).when(written.rlike("^-?" + digits), written.try_cast(kind))
    return F.when(F.lower(F.trim(s)) == "nan", F.lit(None).cast(kind)).otherwise(_or_fail(value.isNotNull(), value, s, "numeric", strict))


def decimal_fits(precision: int, scale: int) -> bool:
    return 1 <= precision <= 38 and 0 <= scale <= precision


def numeric_modifiers(typmod: int) -> tuple[int, int] | None:
    """Precision and scale of a numeric's type modifier; None if unbounded."""
    if typmod < 4:
        return None
    scale = (typmod - 4) & 0xFFFF
    return (typmod - 4) >> 16 & 0xFFFF, scale - 0x10000 if scale >= 0x8000 else scale


def _array_parser():
    """The parser as a local function, which workers get by value: they need
    no copy of this package."""

    def parse_array(text: str) -> list[str | None]:
        """Elements of a one-dimensional array literal.

        >>> parse_array('[0:1]={a,"b \\\\" c",NULL,"NULL"}')
        ['a', 'b " c', None, 'NULL']
        """
        if text.startswith("["):
            bounds, found, text = text.partition("=")
            if not found:
                raise ValueError("array bounds without a value")
        if len(text) < 2 or text[0] != "{" or text[-1] != "}":
            raise ValueError("an array literal stands in braces")
        out: list[str | None] = []
        body, at = text[1:-1], 0
        while body:
            item, quoted = [], False
            if at < len(body) and body[at] == '"':
                quoted, at = True, at + 1
                while at < len(body) and body[at] != '"':
                    at += body[at] == "\\"
                    item.append(body[at])
                    at += 1
                if at >= len(body):
                    raise ValueError("a quote isn't closed")
                at += 1
            while at < len(body) and body[at] != ",":
                if quoted or body[at] in '{}"':
                    raise ValueError("nested or misplaced mark in an array literal")
                at += body[at] == "\\"
                item.append(body[at])
                at += 1
            value = "".join(item)
            if not quoted and not value:
                raise ValueError("an empty element without quotes")
            out.append(None if not quoted and value.upper() == "NULL" else value)
            if at >= len(body):
                break
            at += 1
            if at == len(body):
                raise ValueError("an array literal ends in a comma")
        return out

    return parse_array


parse_array = _array_parser()


def _array_udf(parse):
    def many(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else parse(v))

    return F.pandas_udf(many, T.ArrayType(T.StringType()))


_quoted_array = _array_udf(parse_array)


def array_text(s: Column, element: str | None = None) -> Column:
    """An array of strings, or of ``element`` type by a cast. Literals without
    quotes, escapes or inner braces stay in the JVM."""
    bare = F.regexp_replace(s, r"^\[[^=]*\]=", "")
    simple = bare.rlike(r'^\{([^{}"\\,]+(,[^{}"\\,]+)*)?\}$')
    items = F.transform(F.split(F.substring(bare, F.lit(2), F.length(bare) - 2), ","), lambda x: F.when(F.upper(x) != "NULL", x))
    value = F.when(bare == "{}", F.array().cast("array<string>")).when(simple, items).otherwise(_quoted_array(F.when(~simple, s)))
    return value if element is None else F.transform(value, lambda x: x.cast(element))


def array_text_simple(s: Column, element: str | None = None) -> Column:
    """As :func:`array_text` for literals known to have no quotes: a numeric
    array's never do. No Python runs."""
    bare = F.regexp_replace(s, r"^\[[^=]*\]=", "")
    items = F.transform(F.split(F.substring(bare, F.lit(2), F.length(bare) - 2), ","), lambda x: F.when(F.upper(x) != "NULL", x))
    value = F.when(bare == "{}", F.array().cast("array<string>")).when(bare.rlike(r"^\{[^{}]*\}$"), items).otherwise(F.raise_error(F.concat(F.lit("not a flat array: "), s)))
    return value if element is None else F.transform(value, lambda x: x.cast(element))


def copy_fields(line: Column, columns: int | None = None) -> Column:
    """Raw fields of a COPY text line; raises when their number is another."""
    fields = F.split(line, "\t")
    return fields if columns is None else F.when(F.size(fields) == columns, fields).otherwise(F.raise_error(F.concat(F.lit(f"expected {columns} fields: "), line)))


def copy_unescape(field: Column) -> Column:
    r"""A field's value: ``\N`` is NULL, which is tested before anything is
    unescaped; ``\\`` is set apart first so that it can't begin an escape."""
    mark = "\x00"  # can't occur in Postgres text
    out = F.replace(field, F.lit("\\\\"), F.lit(mark))
    for letter, byte in COPY_ESCAPES.items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(byte))
    out = F.replace(F.regexp_replace(out, r"\\(?s)(.)", "$1"), F.lit(mark), F.lit("\\"))
    return F.when(field != "\\N", F.when(F.instr(field, "\\") > 0, out).otherwise(field))


def copy_values(line: Column, fields: Column) -> tuple[Column, Column]:
    """Fields with escapes resolved, and whether the line had any but NULL
    marks. Most lines have none and pass as they are; the rest go through one
    higher-order expression, which keeps the generated code of a wide table
    small enough to be compiled."""
    escaped = F.instr(F.replace(line, F.lit("\\N"), F.lit("")), "\\") > 0
    return F.when(escaped, F.transform(fields, copy_unescape)).otherwise(fields), escaped


def copy_escape(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for letter, byte in COPY_ESCAPES.items():
        out = F.replace(out, F.lit(byte), F.lit("\\" + letter))
    return F.coalesce(out, F.lit("\\N"))


#: Spark type of each scalar Postgres type; all others keep their text.
SCALARS = {
    "bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary",
}


def decode(s: Column, pg_type: str, precision: int | None = None, scale: int | None = None, strict: bool = True) -> Column:
    """A text column decoded by its Postgres type name."""
    if pg_type.endswith("[]"):
        return F.transform(array_text(s), lambda x: decode(x, pg_type[:-2], precision, scale, strict))
    special = {"bool": bool_text, "bytea": bytea_hex, "date": date_text, "time": time_micros, "timetz": timetz_text, "timestamp": timestamp_text, "timestamptz": timestamptz_text}
    if pg_type in special:
        return special[pg_type](s, strict)
    bounded = re.fullmatch(r"numeric\((\d+)(?:,\s*(-?\d+))?\)", pg_type)
    if bounded:
        return numeric_text(s, int(bounded[1]), int(bounded[2] or 0), strict)
    if pg_type == "numeric":
        return numeric_text(s, precision, scale, strict)
    if pg_type == "uuid":
        return _or_fail(s.rlike("^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(s), s, "uuid", strict)
    if pg_type in ("json", "jsonb"):
        return _or_fail(F.try_parse_json(s).isNotNull(), s, s, "json", strict)
    if pg_type in SCALARS:
        value = s.try_cast(SCALARS[pg_type])
        return _or_fail(value.isNotNull(), value, s, pg_type, strict)
    return s
