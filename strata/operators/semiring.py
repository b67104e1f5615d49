"""Semirings as Column expressions.

``add`` and ``mul`` combine two values inside Catalyst; ``total`` is the aggregate over a group. Infinity of the cost semirings is NULL: the
sum of a NULL is NULL and ``least`` passes over it, so zero annihilates and is neutral by SQL's own rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT, MONEY = "decimal(38,0)", "decimal(38,2)"


@dataclass(frozen=True)
class Semiring:
    name: str
    type: str
    zero: Callable[[], Column]
    one: Callable[[], Column]
    add: Callable[[Column, Column], Column]
    mul: Callable[[Column, Column], Column]
    total: Callable[[Column], Column] | None = None
    exact: bool = True
    idempotent: bool = False
    ordered: bool = False  # multiplication preserves the order of witnesses
    least_first: bool = False  # the sum of two values is the smaller, by Spark's own order


def _lit(value, kind: str) -> Callable[[], Column]:
    return lambda: F.lit(value).cast(kind)


BOOLEAN = Semiring("boolean", "boolean", _lit(False, "boolean"), _lit(True, "boolean"), lambda a, b: a | b, lambda a, b: a & b, lambda c: F.coalesce(F.bool_or(c), F.lit(False)), idempotent=True)
COUNTING = Semiring("counting", COUNT, _lit(0, COUNT), _lit(1, COUNT), lambda a, b: (a + b).cast(COUNT), lambda a, b: (a * b).cast(COUNT), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(COUNT))
TROPICAL = Semiring("tropical", "bigint", _lit(None, "bigint"), _lit(0, "bigint"), lambda a, b: F.least(a, b), lambda a, b: a + b, F.min, idempotent=True, ordered=True, least_first=True)
ARCTIC = Semiring("arctic", "bigint", _lit(None, "bigint"), _lit(0, "bigint"), lambda a, b: F.greatest(a, b), lambda a, b: a + b, F.max, idempotent=True, ordered=True)
DECIMAL_TROPICAL = Semiring("decimal tropical", MONEY, _lit(None, MONEY), _lit(0, MONEY), lambda a, b: F.least(a, b), lambda a, b: (a + b).cast(MONEY), F.min, idempotent=True, ordered=True, least_first=True)
DECIMAL_ARCTIC = Semiring("decimal arctic", MONEY, _lit(None, MONEY), _lit(0, MONEY), lambda a, b: F.greatest(a, b), lambda a, b: (a + b).cast(MONEY), F.max, idempotent=True, ordered=True)


def product(a: Semiring, b: Semiring) -> Semiring:
    """Pairs, componentwise."""
    pair = lambda x, y: F.struct(x.cast(a.type).alias("a"), y.cast(b.type).alias("b"))
    total = (lambda c: pair(a.total(c["a"]), b.total(c["b"]))) if a.total and b.total else None
    return Semiring(f"({a.name}, {b.name})", f"struct<a:{a.type},b:{b.type}>", lambda: pair(a.zero(), b.zero()), lambda: pair(a.one(), b.one()), lambda x, y: pair(a.add(x.a, y.a), b.add(x.b, y.b)), lambda x, y: pair(a.mul(x.a, y.a), b.mul(x.b, y.b)), total, a.exact and b.exact, a.idempotent and b.idempotent)


def lexicographic(first: Semiring, second: Semiring) -> Semiring:
    """Prefer by ``first``, a selective semiring; ties add up in ``second``."""
    pair = lambda x, y: F.struct(x.cast(first.type).alias("a"), y.cast(second.type).alias("b"))

    def add(x: Column, y: Column) -> Column:
        best = first.add(x.a, y.a)
        x_best, y_best = x.a.eqNullSafe(best), y.a.eqNullSafe(best)
        return F.when(x_best & y_best, pair(best, second.add(x.b, y.b))).when(x_best, x).otherwise(y)

    return Semiring(f"{first.name} then {second.name}", f"struct<a:{first.type},b:{second.type}>", lambda: pair(first.zero(), second.zero()), lambda: pair(first.one(), second.one()), add, lambda x, y: pair(first.mul(x.a, y.a), second.mul(x.b, y.b)), None, True, second.idempotent, True)


def expectation(base: Semiring) -> Semiring:
    """(weight, weighted sum): products follow the rule for derivatives."""
    pair = lambda x, y: F.struct(x.cast(base.type).alias("w"), y.cast(base.type).alias("s"))
    return Semiring(f"expectation of {base.name}", f"struct<w:{base.type},s:{base.type}>", lambda: pair(base.zero(), base.zero()), lambda: pair(base.one(), base.zero()), lambda x, y: pair(base.add(x.w, y.w), base.add(x.s, y.s)), lambda x, y: pair(base.mul(x.w, y.w), base.add(base.mul(x.w, y.s), base.mul(x.s, y.w))))


PATHS_TYPE = "array<array<bigint>>"
PATH_WITNESSES = Semiring(
    "path witnesses",
    PATHS_TYPE,
    lambda: F.array().cast(PATHS_TYPE),
    lambda: F.array(F.array().cast("array<bigint>")).cast(PATHS_TYPE),
    lambda a, b: F.array_sort(F.array_distinct(F.concat(a, b))),
    lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, y)))))),
    idempotent=True,
)
PATH = lexicographic(TROPICAL, PATH_WITNESSES)


def best(k: int) -> Semiring:
    """The ``k`` cheapest different (cost, path) pairs, ties by path."""
    kind = "array<struct<v:bigint,p:array<bigint>>>"
    prune = lambda a: F.slice(F.array_sort(F.array_distinct(a)), 1, k)
    pair = lambda x, y: F.struct((x.v + y.v).alias("v"), F.concat(x.p, y.p).alias("p"))
    return Semiring(f"{k} best", kind, lambda: F.array().cast(kind), lambda: F.array(F.struct(F.lit(0).cast("bigint").alias("v"), F.array().cast("array<bigint>").alias("p"))).cast(kind), lambda a, b: prune(F.concat(a, b)), lambda a, b: prune(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y))))), ordered=True)


FRACTION = "struct<n:decimal(38,0),d:decimal(38,0)>"


def fraction(n: Column, d: Column) -> Column:
    """n/d in lowest terms, the denominator above 0; NULL where d is 0. More than 38 digits are an error."""
    n, d = n.cast(COUNT), d.cast(COUNT)
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1))
    shared = F.get(F.transform(F.array(gcd(n, d)), lambda g: F.struct((sign * n).cast(COUNT).alias("n"), F.abs(d).alias("d"), g.alias("g"))), F.lit(0))
    return F.when(d != 0, F.get(F.transform(F.array(shared), lambda x: F.struct(_over(x.n, x.g).alias("n"), _over(x.d, x.g).alias("d")).cast(FRACTION)), F.lit(0)))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor, by Euclid's steps: 190 are enough for 38 digits; most pairs need the first 6 only, and hardly any more than 40."""

    def steps(s: Column, k: int) -> Column:
        shape = f"struct<a:{COUNT},b:{COUNT}>"
        step = lambda x, _: F.when(x.b == 0, x).otherwise(F.struct(x.b.alias("a"), (x.a % x.b).cast(COUNT).alias("b"))).cast(shape)
        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), s.cast(shape), step)

    first = steps(F.struct(F.abs(a.cast(COUNT)).alias("a"), F.abs(b.cast(COUNT)).alias("b")), 6)
    second = F.get(F.transform(F.array(first), lambda s: F.when(s.b == 0, s).otherwise(steps(s, 34))), F.lit(0))
    return F.get(F.transform(F.array(second), lambda s: F.when(s.b == 0, s.a).otherwise(steps(s, 150).a)), F.lit(0))


def _over(a: Column, b: Column) -> Column:
    """The exact quotient of whole decimals, b above 0 and dividing a. Spark's quotients have 32 digits before the point; longer ones are made of two."""
    million = F.lit(1000000).cast(COUNT)
    wide = F.least(b, million) * million  # only used below a million, where it is b's millionfold
    rest = (a % wide).cast(COUNT)
    two = (((a - rest) / wide).cast(COUNT) * million + (rest / b).cast(COUNT)).cast(COUNT)
    return F.when(b == 1, a).when(b < million, two).otherwise((a / b).cast(COUNT)).cast(COUNT)


def _sum(x: Column, y: Column) -> Column:
    def made(g: Column) -> Column:
        return fraction(x.n * _over(y.d, g) + y.n * _over(x.d, g), _over(x.d, g) * y.d)

    return F.get(F.transform(F.array(gcd(x.d, y.d)), made), F.lit(0))


def _product(x: Column, y: Column) -> Column:
    """Factors are reduced crosswise first, so that nothing is longer than it must be."""
    pair = F.struct(fraction(x.n, y.d).alias("a"), fraction(y.n, x.d).alias("b"))
    return F.get(F.transform(F.array(pair), lambda p: F.struct((p.a.n * p.b.n).cast(COUNT).alias("n"), (p.a.d * p.b.d).cast(COUNT).alias("d")).cast(FRACTION)), F.lit(0))


def _whole(value: int) -> Callable[[], Column]:
    return lambda: F.struct(F.lit(value).cast(COUNT).alias("n"), F.lit(1).cast(COUNT).alias("d")).cast(FRACTION)


PROBABILITY = Semiring("exact probability", FRACTION, _whole(0), _whole(1), _sum, _product)


def fraction_text(c: Column) -> Column:
    """``n/d``, or ``n`` where d is 1."""
    return F.when(c.d == 1, c.n.cast("string")).otherwise(F.concat(c.n.cast("string"), F.lit("/"), c.d.cast("string")))


def fraction_of(text: Column) -> Column:
    """The fraction that ``fraction_text`` spells; NULL for any other text, unreduced fractions included."""
    n, d = F.split_part(text, F.lit("/"), F.lit(1)), F.when(text.contains("/"), F.split_part(text, F.lit("/"), F.lit(2))).otherwise("1")
    read = F.when(text.rlike(r"\A(0|-?[1-9][0-9]{0,37})(/[1-9][0-9]{0,37})?\z"), fraction(n.try_cast(COUNT), d.try_cast(COUNT)))
    return F.get(F.filter(F.array(read), lambda x: fraction_text(x) == text), F.lit(0))
