"""Numeric functions: doubles, with null for what isn't finite, and null for null arguments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_null, arg, finite, named


def _d(x: object) -> Column:
    return arg(x).cast("double")


def _simple(name: str, f: Callable[[Column], Column], domain: Callable[[Column], Column] | None = None, names: tuple[str, ...] = ()) -> Callable[..., Column]:
    def out(x: object) -> Column:
        x = _d(x)
        return finite(f(x)) if domain is None else F.when(domain(x), finite(f(x)))

    out.__name__ = name
    return named(name, *names, args=(1, 1))(out)


abs = _simple("abs", F.abs)
acos = _simple("acos", F.acos, lambda x: F.abs(x) <= 1)
asin = _simple("asin", F.asin, lambda x: F.abs(x) <= 1)
atan = _simple("atan", F.atan)
ceil = _simple("ceil", lambda x: F.ceil(x).cast("double"), names=("ceiling",))
cos = _simple("cos", F.cos)
cot = _simple("cot", lambda x: 1 / F.tan(x), lambda x: F.tan(x) != 0)
degrees = _simple("degrees", F.degrees)
exp = _simple("exp", F.exp)
floor = _simple("floor", lambda x: F.floor(x).cast("double"))
ln = _simple("ln", F.ln, lambda x: x > 0)
log10 = _simple("log10", F.log10, lambda x: x > 0)
log2 = _simple("log2", F.log2, lambda x: x > 0)
radians = _simple("radians", F.radians)
sin = _simple("sin", F.sin)
sqrt = _simple("sqrt", F.sqrt, lambda x: x >= 0)
tan = _simple("tan", F.tan)


@named("atan2", args=(2, 2))
def atan2(y: object, x: object) -> Column:
    return finite(F.atan2(_d(y), _d(x)))


def _values(xs: tuple[object, ...]) -> Column:
    return F.filter(F.array(*[_d(x) for x in xs]), lambda x: x.isNotNull())


@named("sum", args=(1, None))
def sum(*xs: object) -> Column:
    """The sum of the arguments that aren't null; null if all are."""
    v = _values(xs)
    return F.when(F.size(v) > 0, finite(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)))


@named("avg", args=(1, None))
def avg(*xs: object) -> Column:
    v = _values(xs)
    return F.when(F.size(v) > 0, finite(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


@named("count", args=(1, None))
def count(*xs: object) -> Column:
    return reduce(lambda a, b: a + b, [arg(x).isNotNull().cast("int") for x in xs])


@named("max", args=(1, None))
def max(*xs: object) -> Column:
    return F.array_max(_values(xs))


@named("min", args=(1, None))
def min(*xs: object) -> Column:
    return F.array_min(_values(xs))


@named("greatest", args=(1, None))
def greatest(*xs: object) -> Column:
    """Null if any argument is."""
    v = [_d(x) for x in xs]
    return F.when(~any_null(*v), F.array_max(F.array(*v)))


@named("least", args=(1, None))
def least(*xs: object) -> Column:
    v = [_d(x) for x in xs]
    return F.when(~any_null(*v), F.array_min(F.array(*v)))


@named("div", args=(2, 2))
def div(a: object, b: object) -> Column:
    """The quotient without its fraction; null for a zero divisor."""
    q = F.try_divide(_d(a), _d(b))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


@named("mod", args=(2, 2))
def mod(a: object, b: object) -> Column:
    """With the dividend's sign; null for a zero divisor."""
    return finite(F.try_mod(_d(a), _d(b)))


@named("log", args=(1, 2))
def log(a: object, b: object = None) -> Column:
    """The natural logarithm, or that of b to the base a; null outside its domain."""
    if b is None:
        return ln(a)
    base, x = _d(a), _d(b)
    return F.when((base > 0) & (base != 1) & (x > 0), finite(F.ln(x) / F.ln(base)))


@named("pi", args=(0, 0))
def pi() -> Column:
    return F.pi()


@named("pow", "power", args=(2, 2))
def pow(x: object, y: object) -> Column:
    return finite(F.pow(_d(x), _d(y)))


@named("rand", args=(0, 1))
def rand(seed: int | None = None) -> Column:
    """Uniform; with a seed the same at every run over the same partitions."""
    return F.rand() if seed is None else F.rand(int(seed))


@named("round", args=(1, 2))
def round(x: object, digits: object = 0) -> Column:
    """Halves away from zero; negative digits round to tens and more."""
    d = arg(digits).cast("int")
    p = F.pow(F.lit(10.0), F.abs(d).cast("double"))
    scaled = F.when(d >= 0, F.abs(_d(x)) * p).otherwise(F.abs(_d(x)) / p)
    whole = F.floor(scaled + 0.5).cast("double")
    return finite(F.signum(_d(x)) * F.when(d >= 0, whole / p).otherwise(whole * p))


@named("sign", args=(1, 1))
def sign(x: object) -> Column:
    return F.signum(_d(x)).cast("int")


@named("truncate", args=(2, 2))
def truncate(x: object, digits: object) -> Column:
    """Toward zero; negative digits cut tens and more."""
    d = arg(digits).cast("int")
    p = F.pow(F.lit(10.0), F.abs(d).cast("double"))
    scaled = F.floor(F.when(d >= 0, F.abs(_d(x)) * p).otherwise(F.abs(_d(x)) / p)).cast("double")
    return finite(F.signum(_d(x)) * F.when(d >= 0, scaled / p).otherwise(scaled * p))
