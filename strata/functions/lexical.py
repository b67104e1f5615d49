"""Canonical lexical forms of the five value types, and names, pointers and escapes. A value that isn't valid gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; written out, each use would repeat all that is behind it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapsed(c: Column) -> Column:
    """White space as for numbers and booleans: runs become one space, ends are cut."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def boolean(c: Column) -> Column:
    t = collapsed(c)
    return F.when(t.isin("true", "1"), "true").when(t.isin("false", "0"), "false")


def integer(c: Column) -> Column:
    """Any number of digits: sign and leading zeros go, the digits stay text."""
    t = collapsed(c)
    digits = F.regexp_replace(F.regexp_replace(t, r"\A[+-]", ""), r"\A0+(?=[0-9])", "")
    negative = t.startswith("-") & (digits != "0")
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), F.concat(F.when(negative, "-").otherwise(""), digits))


def decimal(c: Column) -> Column:
    """Fixed point without exponent; always one digit at least on either side of the point."""
    return let(collapsed(c), _decimal)


def _decimal(t: Column) -> Column:
    body = F.regexp_replace(t, r"\A[+-]", "")
    whole = F.regexp_replace(F.split_part(body, F.lit("."), F.lit(1)), r"\A0+", "")
    part = F.regexp_replace(F.split_part(body, F.lit("."), F.lit(2)), r"0+\z", "")

    def text(x: Column) -> Column:
        zero = (x.whole == "") & (x.part == "")
        digits = F.concat(F.when(x.whole == "", "0").otherwise(x.whole), F.lit("."), F.when(x.part == "", "0").otherwise(x.part))
        return F.concat(F.when(t.startswith("-") & ~zero, "-").otherwise(""), digits)

    return F.when(t.rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"), let(F.struct(whole.alias("whole"), part.alias("part")), text))


def double(c: Column) -> Column:
    """NaN, INF, -INF, or the shortest ``d.dddE±n``; too large is infinite."""
    return let(collapsed(c), _double)


def _double(t: Column) -> Column:
    value = F.when(t.rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
    sign = F.when(t.startswith("-"), "-").otherwise("")

    def finite(v: Column) -> Column:
        normal = let(F.abs(v).cast("string"), _normal)
        return F.when(v == 0, F.concat(sign, F.lit("0.0E0"))).when(F.abs(v) == float("inf"), F.concat(sign, F.lit("INF"))).otherwise(F.concat(sign, normal))

    return F.when(t == "NaN", "NaN").when(t.isin("INF", "+INF"), "INF").when(t == "-INF", "-INF").otherwise(let(value, lambda v: F.when(v.isNotNull(), finite(v))))


def _normal(shown: Column) -> Column:
    """``shown`` is d.d, or d.dE±n outside of the plain range."""
    mantissa, exponent = F.split_part(shown, F.lit("E"), F.lit(1)), F.when(shown.contains("E"), F.split_part(shown, F.lit("E"), F.lit(2)).cast("int")).otherwise(0)
    parts = let(mantissa, lambda m: F.struct(F.split_part(m, F.lit("."), F.lit(1)).alias("whole"), F.split_part(m, F.lit("."), F.lit(2)).alias("part")))

    def by_digits(x: Column) -> Column:
        digits = F.concat(x.whole, x.part)
        lead = F.length(F.regexp_extract(digits, r"\A(0*)", 1))
        kept = F.regexp_replace(F.regexp_replace(digits, r"\A0+", ""), r"0+\z", "")
        return F.struct(kept.alias("kept"), (F.length(x.whole) - 1 - lead).alias("power"))

    def spelled(x: Column) -> Column:
        rest = F.substring(x.kept, F.lit(2), F.length(x.kept))
        return F.concat(F.substring(x.kept, 1, 1), F.lit("."), F.when(rest == "", "0").otherwise(rest), F.lit("E"), (exponent + x.power).cast("string"))

    return let(let(parts, by_digits), spelled)


def canonical(kind: str, c: Column) -> Column:
    return {"string": lambda x: x, "boolean": boolean, "integer": integer, "decimal": decimal, "double": double}[kind](c)


def expanded(namespace: Column, local: Column) -> Column:
    """``{namespace}local``"""
    return F.concat(F.lit("{"), namespace, F.lit("}"), local)


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_segments(c: Column) -> Column:
    """The unescaped segments of a JSON pointer; NULL where it isn't one."""
    valid = ((c == "") | c.startswith("/")) & ~c.rlike(r"~(?![01])")
    parts = F.transform(F.slice(F.split(c, "/"), 2, 1 << 20), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(valid, parts)


def index(c: Column) -> Column:
    """A canonical index without sign or leading zeros; NULL otherwise."""
    return F.when(c.rlike(r"\A(0|[1-9][0-9]*)\z"), c.try_cast("bigint"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dot_quote(c: Column) -> Column:
    """A quoted DOT string; NULL where a control character can't be written."""
    safe = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(~c.rlike(r"[\x00-\x09\x0B-\x1F\x7F-\x9F]"), F.concat(F.lit('"'), safe, F.lit('"')))


def exact_quotient(numerator: Column, denominator: int, digits: int = 12) -> Column:
    """Exact decimal text of an integer by a positive integer, NULL where the decimal doesn't end."""
    rest, twos, fives = denominator, 0, 0
    while rest % 2 == 0:
        rest, twos = rest // 2, twos + 1
    while rest % 5 == 0:
        rest, fives = rest // 5, fives + 1
    scale = max(twos, fives)
    if scale > digits:
        raise ValueError("too many digits")
    ends = numerator % rest == 0
    # integer division: a double would round what lies over 2**53
    units = F.call_function("div", numerator.cast("bigint"), F.lit(rest).cast("bigint")).cast("decimal(38,0)") * F.lit(10**scale // (denominator // rest)).cast("decimal(38,0)")
    text = F.abs(units.cast("decimal(38,0)")).cast("string")
    padded = let(text, lambda t: F.lpad(t, F.greatest(F.length(t), F.lit(scale + 1)), F.lit("0")))
    spelled = lambda p: F.concat(F.when(numerator < 0, "-").otherwise(""), F.substring(p, F.lit(1), F.length(p) - scale), F.lit("."), F.substring(p, F.length(p) - scale + 1, F.lit(scale)) if scale else F.lit("0"))
    return F.when(ends, decimal(let(padded, spelled)))


def compare_products(a: Column, b: Column, c: Column, d: Column) -> Column:
    """-1, 0 or 1 as a times b is below, equal to or above c times d, exactly, for any BIGINTs: a product of two has 38 digits at most."""
    wide = lambda x: x.cast("decimal(19,0)")
    left, right = (wide(a) * wide(b)).cast("decimal(38,0)"), (wide(c) * wide(d)).cast("decimal(38,0)")
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)
