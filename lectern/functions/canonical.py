"""Canonical JSON texts inside the JVM: a VARIANT is folded back to text with its keys in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.json_schema import kind, let, parsed

#: Nesting that is written out; deeper JSON raises an error.
DEPTH = 8
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_CONTROLS = [chr(c) for c in range(32) if chr(c) not in _ESCAPES]


def quoted(text: Column) -> Column:
    """A JSON string: other characters than quotes, backslashes and controls stand as they are."""

    def escaped(t: Column) -> Column:
        for c, e in _ESCAPES.items():
            t = F.replace(t, F.lit(c), F.lit(e))
        rare = t
        for c in _CONTROLS:
            rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
        return F.when(t.rlike("[\\x00-\\x1f]"), rare).otherwise(t)

    plain = ~text.rlike('[\\x00-\\x1f"\\\\]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped(text)), F.lit('"'))


def _scalar(v: Column) -> Column:
    n = F.try_variant_get(v, "$", "double")
    whole = (kind(v).rlike("^(DOUBLE|FLOAT)")) & (n == F.floor(n)) & (F.abs(n) < 1e21)
    return (
        F.when(kind(v) == "STRING", quoted(v.cast("string")))
        .when(kind(v) == "VOID", "null")
        .when(whole, n.cast("decimal(22,0)").cast("string"))  # 1e3 is 1000
        .otherwise(v.cast("string"))
    )


def _written(v: Column, by_length: bool, comma: str, colon: str, depth: int) -> Column:
    if depth == 0:
        return F.raise_error(F.lit(f"JSON is nested deeper than {DEPTH}")).cast("string")
    named = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    rank = lambda e: F.octet_length(e.key) if by_length else F.lit(0)
    named = F.transform(named, lambda e: F.struct(rank(e).alias("size"), e.key.alias("key"), e.value.alias("value")))
    smaller = lambda a, b: (a.size < b.size) | ((a.size == b.size) & (a.key < b.key))
    named = F.array_sort(named, lambda a, b: F.when(smaller(a, b), -1).when(smaller(b, a), 1).otherwise(0))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(0).alias("size"), F.lit(None).cast("string").alias("key"), x.alias("value")))
    is_object = kind(v).startswith("OBJECT")
    # one list of children for both kinds, so that the expression grows with the depth and not with its power
    children = F.when(is_object, named).otherwise(listed)
    name = lambda c: F.when(c.key.isNotNull(), F.concat(quoted(c.key), F.lit(colon))).otherwise("")
    inner = F.array_join(F.transform(children, lambda c: F.concat(name(c), let(c.value, lambda x: _written(x, by_length, comma, colon, depth - 1)))), comma)
    # inner stands here once: twice would double the expression at every level
    nested = F.concat(F.when(is_object, "{").otherwise("["), inner, F.when(is_object, "}").otherwise("]"))
    return F.when(kind(v).rlike("^(OBJECT|ARRAY)"), nested).otherwise(_scalar(v))


def jsonb_canonical(json: Column) -> Column:
    """JSON in jsonb's order: keys by their length in UTF-8, then their bytes; ``", "`` and ``": "`` between. NULL if it is no JSON."""
    return let(parsed(json), lambda v: F.when(v.isNotNull(), _written(v, True, ", ", ": ", DEPTH)))


def jsonb_sha256(json: Column) -> Column:
    return F.sha2(jsonb_canonical(json), 256)


def sorted_canonical(json: Column) -> Column:
    """Compact JSON with keys in code point order. NULL if it is no JSON."""
    return let(parsed(json), lambda v: F.when(v.isNotNull(), _written(v, False, ",", ":", DEPTH)))
