"""Canonical JSON as column expressions: the text that an audit hash covers.

Keys are sorted at every depth, nothing stands between tokens, and all but printable ASCII is escaped, so that one value has one text and two
values never share one. Types stay apart: numbers, booleans and nulls are bare, all else is quoted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with an escape of their own.
NAMED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code.cast("long")), 4, "0")))


def _escaped(ch: Column) -> Column:
    """The escape of one character; beyond the first plane as a pair of surrogates."""
    code = F.ascii(ch)
    over = code - 0x10000
    pair = F.concat(_unit(F.shiftright(over, 10) + 0xD800), _unit(over.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(code.between(32, 126) & ~ch.isin('"', "\\"), ch)
    for c, escape in NAMED.items():
        out = out.when(ch == c, F.lit(escape))
    return out.when(code > 0xFFFF, pair).otherwise(_unit(code))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _replaced(text: Column, kind: str) -> Column:
    """``text`` with the characters of the class ``kind`` escaped, each different one once. No escape has a character of ``kind``."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({kind})"), F.lit(1)))
    return F.aggregate(found, text, lambda out, ch: F.replace(out, ch, _escaped(ch)))


def json_string(text: Column) -> Column:
    """A text in quotes. Texts of plain characters only, which most are, aren't taken apart."""
    # Backslashes first, as every other escape brings one.
    bare = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    bare = F.when(text.rlike(r"[^ -~]"), _replaced(bare, "[^ -~]")).otherwise(bare)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^ !#-\[\]-~]'), bare).otherwise(text), F.lit('"'))


def json_number(x: Column) -> Column:
    """A double in its shortest form: positional from 1e-4 to under 1e16, else with an exponent of two digits at least."""
    text = F.abs(x).cast("string")
    part = lambda k: F.regexp_extract(text, r"^([0-9])\.([0-9]+)E(-?[0-9]+)$", k)
    more = F.when(part(2) == "0", "").otherwise(part(2))
    digits, power = F.concat(part(1), more), part(3).cast("int")
    whole = F.when(F.length(digits) - 1 <= power, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(part(1), F.when(more == "", "").otherwise(F.concat(F.lit("."), more)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    long_ = F.when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(scientific)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, F.when(text.contains("E"), long_).otherwise(text))


def _of_variant(value: Column) -> Column:
    """Spark prints a variant with sorted keys and without spaces; what is not ASCII is only found within its strings."""
    text = F.to_json(value)
    # Of control characters, whose last hex digits Spark prints in upper case.
    text = _once(text, lambda x: F.when(x.contains("\\u00"), reduce(lambda y, c: F.regexp_replace(y, rf"(?<!\\)((?:\\\\)*\\u00[01]){c}", rf"$1{c.lower()}"), "ABCDEF", x)).otherwise(x))
    return _once(text, lambda x: F.when(x.rlike(r"[^\x00-\x7E]"), _replaced(x, r"[^\x00-\x7E]")).otherwise(x))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a value of type ``kind``; a null is ``null``, also within lists and structs.

    Structs and maps are objects with sorted keys, a variant keeps its own types. Timestamps are written as naive UTC with microseconds, decimals, dates and
    binaries (in hex) as strings. Doubles follow Java's shortest digits.
    """
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{_plain(f.name)}":'), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    elif isinstance(kind, T.MapType):
        entry = lambda k: F.concat(json_string(k), F.lit(":"), canonical_json(value[k], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.VariantType):
        out = _of_variant(value)
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        out = json_number(value.cast("double"))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        utc = value if isinstance(kind, T.TimestampNTZType) else F.to_utc_timestamp(value, F.current_timezone())
        out = F.concat(F.lit('"'), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))
    else:
        out = json_string(F.lower(F.hex(value)) if isinstance(kind, T.BinaryType) else value.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _plain(name: str) -> str:
    import json

    return json.dumps(name)[1:-1]
