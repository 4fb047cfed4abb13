"""Checks of JSON by declared schemas, as Spark expressions over VARIANT.

A schema is a function of (value, path) that gives the array of the paths that break it. Types
count: a number is no text, 1.0 is whole, JSON null and a missing field differ. Nested parts
are checked wherever their parent has the right type; list elements have [i] in their path.

    point = fields({"x": number(0, 9), "label": optional(text(1))})
    df.withColumn("wrong", problems(df.raw, point))

Text that is no JSON, or gives a key twice, breaks the empty path.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Schema = Callable[[Column, Column | None], Column]
#: What JavaScript's trim takes away.
SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def trimmed(text: Column) -> Column:
    """text without white space, of any kind, at both ends."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))  # most texts have none, and are not searched
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")).otherwise(text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which characters beyond the basic plane count twice."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(raw: Column) -> Column:
    """A whole JSON text as VARIANT; NULL if it is none, or if something follows it.

    The parser stops behind the first value. Inside a list and inside an object it can't: what
    closes the one too early is an error in the other.
    """

    def both(text: Column) -> Column:
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
        named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
        return let(listed, lambda own: F.when((F.size(own) == 1) & named.isNotNull(), F.get(own, F.lit(0))))

    return let(let(raw, trimmed), both)


def problems(raw: Column, schema: Schema) -> Column:
    """Paths of a JSON text that break the schema; empty if none do."""
    return let(parsed(raw), lambda v: F.when(v.isNull(), F.array(F.lit(""))).otherwise(schema(v, None)))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def part(value: Column, name: str) -> Column:
    """A field as VARIANT: NULL if missing, JSON null if null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def elements(value: Column) -> Column:
    """The elements of a list; NULL for anything else."""
    return F.when(kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def as_text(value: Column) -> Column:
    return F.when(kind(value) == "STRING", value.cast("string"))


def as_number(value: Column) -> Column:
    return F.when(kind(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


def _below(path: Column | None, name: str) -> Column:
    return F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _here(path: Column | None) -> Column:
    return F.lit("") if path is None else path


def must(ok: Column, path: Column | None) -> Column:
    """The path unless ok is true."""
    return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(F.array(_here(path)))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def text(least: int = 0, most: int | None = None, pattern: str | None = None, one_of: list[str] | None = None, trim: bool = False) -> Schema:
    """Lengths in UTF-16 units, of the text without outer white space if ``trim``."""

    def holds(s: Column) -> Column:
        rules = [s.isNotNull()]
        if least or most is not None:
            rules.append(let(utf16_length(s), lambda n: n >= least if most is None else n.between(least, most)))
        if pattern:
            rules.append(s.rlike(pattern))
        if one_of:
            rules.append(s.isin(*one_of))
        return _all(rules)

    def check(value: Column, path: Column | None) -> Column:
        s = let(value, as_text)
        return must(let(trimmed(s) if trim else s, holds), path)

    return check


def number(low: float | None = None, high: float | None = None, whole: bool = False) -> Schema:
    def holds(n: Column) -> Column:
        rules = [n.isNotNull()]
        if low is not None:
            rules.append(n >= low)
        if high is not None:
            rules.append(n <= high)
        if whole:
            rules.append(n == F.floor(n))
        return _all(rules)

    return lambda value, path: must(let(let(value, as_number), holds), path)

    return check


def whole(low: float, high: float) -> Schema:
    return number(low, high, whole=True)


def flag(only: bool | None = None) -> Schema:
    def check(value: Column, path: Column | None) -> Column:
        b = F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        return must(b.isNotNull() if only is None else b == only, path)

    return check


def nullable(schema: Schema) -> Schema:
    """JSON null, or what the schema takes."""
    return lambda value, path: F.when(kind(value) == "VOID", _none()).otherwise(schema(value, path))


def optional(schema: Schema) -> Schema:
    """Missing, or what the schema takes."""
    return lambda value, path: F.when(value.isNull(), _none()).otherwise(schema(value, path))


def items(schema: Schema, least: int = 0, most: int | None = None) -> Schema:
    def check(own: Column, path: Column | None) -> Column:
        size = F.size(own)
        fits = (size >= least) if most is None else size.between(least, most)
        each = F.flatten(F.transform(own, lambda x, i: schema(x, F.concat(_here(path), F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(own.isNull(), F.array(_here(path))).otherwise(F.concat(must(fits, path), each))

    return lambda value, path: let(let(value, elements), lambda own: check(own, path))


def fields(known: dict[str, Schema], strict: bool = False, rules: dict[str, Callable[[Column], Column]] | None = None) -> Schema:
    """An object. strict: other keys break it, by their path. rules: path below -> condition on the whole object."""

    def check(value: Column, path: Column | None) -> Column:
        found = [schema(part(value, name), _below(path, name)) for name, schema in known.items()]
        if strict:
            names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
            extra = F.array_except(names, F.array(*map(F.lit, known)))
            found.append(F.transform(F.array_sort(extra), lambda n: n if path is None else F.concat(path, F.lit("."), n)))
        found += [must(rule(value), _below(path, name)) for name, rule in (rules or {}).items()]
        return F.when(kind(value).startswith("OBJECT"), F.concat(*found)).otherwise(F.array(_here(path)))

    return lambda value, path: let(value, lambda v: check(v, path))


def by_field(name: str, cases: dict[str, Schema]) -> Schema:
    """The schema is chosen by the text in a field; no other text is taken."""

    def check(value: Column, path: Column | None) -> Column:
        told = as_text(part(value, name))
        out = F.array(_below(path, name))
        for case, schema in cases.items():
            out = F.when(told == case, schema(value, path)).otherwise(out)
        return out

    return lambda value, path: let(value, lambda v: check(v, path))
