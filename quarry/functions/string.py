"""String functions.  Unless said otherwise a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_null, arg, named, strict


@named("ascii", args=(1, 1))
def ascii(s: object) -> Column:
    """The first byte of the UTF-8 form; 0 for the empty string."""
    s = arg(s).cast("string")
    return F.when(s == "", 0).otherwise(F.conv(F.substring(F.hex(F.encode(s, "utf-8")), 1, 2), 16, 10).cast("int"))


@named("char_length", "character_length", args=(1, 1))
def char_length(s: object) -> Column:
    return F.char_length(arg(s).cast("string"))


@named("concat", args=(1, None))
def concat(*xs: object) -> Column:
    return F.concat(*[arg(x).cast("string") for x in xs])


@named("concat_ws", "concat_w", args=(2, None))
def concat_ws(sep: object, *xs: object) -> Column:
    """Skips nulls; a null separator gives null."""
    sep = arg(sep).cast("string")
    parts = F.filter(F.array(*[arg(x).cast("string") for x in xs]), lambda x: x.isNotNull())
    joined = F.aggregate(F.slice(parts, 2, len(xs)), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), lambda a, x: F.concat(a, sep, x))
    return F.when(sep.isNotNull(), joined)


@named("field", args=(1, None))
def field(x: object, *xs: object) -> Column:
    """The place of x in the list from 1, ignoring case; 0 if it isn't there or null."""
    low = F.lower(arg(x).cast("string"))
    if not xs:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array(*[F.lower(arg(y).cast("string")) for y in xs]), low), F.lit(0)).cast("int")


@named("find_in_set", args=(2, 2))
def find_in_set(x: object, items: object) -> Column:
    """The place in a list with commas, ignoring case; 0 if x holds a comma."""
    return F.find_in_set(F.lower(arg(x).cast("string")), F.lower(arg(items).cast("string")))


@named("format", args=(2, 3))
def format(x: object, decimals: object, locale: object = None) -> Column:
    """Groups thousands, 0 to 30 decimals; de, es, fr and it swap comma and point."""
    d = F.least(F.greatest(arg(decimals).cast("int"), F.lit(0)), F.lit(30))
    out = F.call_function("format_number", arg(x).cast("double"), d)
    if locale is None:
        return out
    return F.when(F.lower(F.substring(arg(locale), 1, 2)).isin("de", "es", "fr", "it"), F.translate(out, ",.", ".,")).otherwise(out)


@named("insert", args=(4, 4))
def insert(s: object, pos: object, size: object, new: object) -> Column:
    """Replaces ``size`` characters at ``pos``; a place out of range changes nothing."""
    s, new, pos, size = arg(s).cast("string"), arg(new).cast("string"), arg(pos).cast("int"), arg(size).cast("int")
    rest = F.when((size < 0) | (pos + size > F.char_length(s)), "").otherwise(F.substr(s, pos + size))
    done = F.when((pos >= 1) & (pos <= F.char_length(s)), F.concat(F.substr(s, F.lit(1), pos - 1), new, rest)).otherwise(s)
    return strict(done, s, pos, size, new)


@named("locate", args=(2, 3))
def locate(x: object, s: object, start: object = 1) -> Column:
    """The place of x in s from 1, ignoring case."""
    x, s, start = F.lower(arg(x).cast("string")), F.lower(arg(s).cast("string")), arg(start).cast("int")
    return strict(F.position(x, s, start), x, s, start)


@named("instr", args=(2, 2))
def instr(s: object, x: object) -> Column:
    return locate(x, s)


@named("position", args=(2, 2))
def position(x: object, s: object) -> Column:
    return locate(x, s)


@named("left", args=(2, 2))
def left(s: object, n: object) -> Column:
    return F.left(arg(s).cast("string"), arg(n).cast("int"))


@named("right", args=(2, 2))
def right(s: object, n: object) -> Column:
    return F.right(arg(s).cast("string"), arg(n).cast("int"))


@named("length", args=(1, 1))
def length(s: object) -> Column:
    """Bytes, not characters."""
    return F.octet_length(arg(s).cast("string"))


def _pad(s: object, n: object, pad: object, side: object) -> Column:
    s, n, pad = arg(s).cast("string"), arg(n).cast("int"), arg(pad).cast("string")
    done = F.when(n < 0, None).when((pad == "") & (n > F.char_length(s)), None).otherwise(side(s, n, pad))
    return strict(done, s, n, pad)


@named("lpad", args=(3, 3))
def lpad(s: object, n: object, pad: object) -> Column:
    """A negative length gives null; so does an empty pad where it is needed."""
    return _pad(s, n, pad, F.lpad)


@named("rpad", args=(3, 3))
def rpad(s: object, n: object, pad: object) -> Column:
    return _pad(s, n, pad, F.rpad)


@named("ltrim", args=(1, 1))
def ltrim(s: object) -> Column:
    """Spaces only."""
    return F.ltrim(arg(s).cast("string"))


@named("rtrim", args=(1, 1))
def rtrim(s: object) -> Column:
    return F.rtrim(arg(s).cast("string"))


@named("trim", args=(1, 2))
def trim(x: object, s: object = None) -> Column:
    """Spaces; with two arguments, a whole pattern from both ends, again and again."""
    if s is None:
        return F.trim(arg(x).cast("string"))
    x, s = arg(x).cast("string"), arg(s).cast("string")
    quoted = F.concat(F.lit("(?:"), F.regexp_replace(x, r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(")+"))
    return F.when(x == "", s).otherwise(F.regexp_replace(F.regexp_replace(s, F.concat(F.lit("^"), quoted), F.lit("")), F.concat(quoted, F.lit("$")), F.lit("")))


@named("substr", "substring", args=(2, 3))
def substr(s: object, pos: object, size: object = None) -> Column:
    """Position 0 and a start before the string give the empty string."""
    s, pos = arg(s).cast("string"), arg(pos).cast("int")
    n = F.char_length(s)
    if size is None:
        done = F.substr(s, pos)
        return strict(F.when((pos == 0) | (pos < -n), "").otherwise(done), s, pos)
    size = arg(size).cast("int")
    done = F.when((pos == 0) | (pos < -n) | (size <= 0), "").otherwise(F.substr(s, pos, size))
    return strict(done, s, pos, size)


@named("mid", args=(2, 3))
def mid(s: object, pos: object, size: object = None) -> Column:
    return substr(s, pos, size)


@named("repeat", args=(2, 2))
def repeat(s: object, n: object) -> Column:
    return F.repeat(arg(s).cast("string"), F.greatest(arg(n).cast("int"), F.lit(0)) if n is not None else F.lit(None).cast("int"))


@named("replace", args=(3, 3))
def replace(s: object, old: object, new: object) -> Column:
    """Case matters; an empty pattern changes nothing."""
    s, old, new = arg(s).cast("string"), arg(old).cast("string"), arg(new).cast("string")
    return strict(F.when(old == "", s).otherwise(F.replace(s, old, new)), s, old, new)


@named("reverse", args=(1, 1))
def reverse(s: object) -> Column:
    return F.reverse(arg(s).cast("string"))


@named("space", args=(1, 1))
def space(n: object) -> Column:
    n = arg(n).cast("int")
    return strict(F.repeat(F.lit(" "), F.greatest(n, F.lit(0))), n)


@named("upper", "ucase", args=(1, 1))
def upper(s: object) -> Column:
    return F.upper(arg(s).cast("string"))


@named("lower", "lcase", args=(1, 1))
def lower(s: object) -> Column:
    return F.lower(arg(s).cast("string"))


@named("substring_index", args=(3, 3))
def substring_index(s: object, sep: object, n: object) -> Column:
    """What stands before the n-th separator, from the right for negative n; empty for an empty separator or 0."""
    s, sep, n = arg(s).cast("string"), arg(sep).cast("string"), arg(n).cast("int")
    parts = F.when(sep == "", F.array(F.lit(""))).otherwise(F.split(s, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), F.lit(-1)))
    k = F.least(F.abs(n), F.size(parts))
    picked = F.when(n > 0, F.slice(parts, F.lit(1), k)).otherwise(F.slice(parts, F.size(parts) - k + 1, k))
    joined = F.aggregate(F.slice(picked, F.lit(2), F.greatest(F.size(picked), F.lit(1))), F.get(picked, F.lit(0)), lambda a, x: F.concat(a, sep, x))
    return F.when(any_null(s, sep, n), None).when((sep == "") | (n == 0), "").otherwise(joined)
