"""Functions of text; they take the first item as text, and nothing gives nothing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumenpath.functions.registry import function
from lumenpath.lang.errors import InvalidArguments
from lumenpath.plans.coll import EMPTY, Coll, choice_item, first

LONGEST_PATTERN, DEEPEST_GROUP = 1000, 5


def check_pattern(pattern: str) -> None:
    """Refuses patterns that may run for very long: too long, groups too deep, quantifiers one after another."""
    if len(pattern) > LONGEST_PATTERN:
        raise InvalidArguments("pattern: too long")
    depth, quantified = 0, False
    for ch in pattern:  # signs count wherever they stand, escaped ones too; groups don't part quantifiers
        if ch in "()":
            depth = max(0, depth + (1 if ch == "(" else -1))
            if depth > DEEPEST_GROUP:
                raise InvalidArguments("pattern: groups too deep")
        elif ch in "*+?":
            if quantified:
                raise InvalidArguments("pattern: quantifiers one after another")
            quantified = True
        else:
            quantified = ch == "{"


def _text(c, this):
    this = choice_item(this, "string")
    return None if this.kind == "empty" else c.text(first(this))


def _argument(c, node, this):
    return _text(c, c.argument(node, this))


def _literal(c, node, this):
    got = c.argument(node, this)
    return got.literal if isinstance(got.literal, str) else None


def _pattern(c, node, this):
    """A pattern as a column. One that isn't known before rows are read is null where it is none, so that a row can't end the job."""
    known, col = _literal(c, node, this), _argument(c, node, this)
    if known is not None:
        _groups(known)
        return col
    if col is None:
        return None
    good = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), col, F.lit("")).isNotNull()
    return F.when(good & (F.length(col) <= LONGEST_PATTERN), col)


def _groups(pattern: str) -> int:
    """How many groups a pattern has."""
    check_pattern(pattern)
    try:
        return re.compile(pattern).groups
    except (re.error, OverflowError, RecursionError) as e:
        raise InvalidArguments(f"pattern: {e}") from e


def _replacement(new, groups: int):
    """Java's form of a replacement: $n and ${n} are groups, empty where the pattern has no such group; other signs stand for themselves."""
    new = F.replace(new, F.lit("\\"), F.lit("\\\\"))
    new = F.regexp_replace(F.regexp_replace(new, r"\$\{([0-9]+)\}", r"\$$1"), r"\$\{\w+\}", "")
    missing = r"[1-9][0-9]*" if not groups else rf"(?:[{groups + 1}-9](?![0-9])|[1-9][0-9]+)" if groups < 9 else r"[1-9][0-9]+"
    return F.regexp_replace(F.regexp_replace(new, rf"\${missing}", ""), r"\$(?![0-9])", r"\\\$")


def _with_one(name, kind, apply, argument=_argument):
    @function(name, 1)
    def build(c, this, args):
        x, y = _text(c, this), argument(c, args[0], this)
        return EMPTY if x is None or y is None else Coll(kind, apply(x, y))


def _plain(name, kind, apply):
    @function(name)
    def build(c, this, args):
        x = _text(c, this)
        return EMPTY if x is None else Coll(kind, apply(x))


_with_one("startsWith", "boolean", F.startswith)
_with_one("endsWith", "boolean", F.endswith)
_with_one("contains", "boolean", F.contains)
_with_one("matches", "boolean", lambda x, p: F.regexp_like(x, p), _pattern)
_with_one("indexOf", "integer", lambda x, y: (F.position(y, x) - 1).cast("long"))
_plain("lower", "string", F.lower)
_plain("upper", "string", F.upper)
_plain("trim", "string", lambda x: F.regexp_replace(x, r"^[\s \u0085]+|[\s \u0085]+$", ""))
_plain("length", "integer", lambda x: F.length(x).cast("long"))


@function("toChars")
def to_chars(c, this, args):
    x = _text(c, this)
    return EMPTY if x is None else Coll("string", F.coalesce(F.filter(F.split(x, ""), lambda ch: ch != ""), F.array().cast("array<string>")), True)


@function("replace", 2)
def replace(c, this, args):
    x, old, new = _text(c, this), _argument(c, args[0], this), _argument(c, args[1], this)
    if x is None or old is None or new is None:
        return EMPTY
    between = F.concat(new, F.array_join(F.transform(F.filter(F.split(x, ""), lambda ch: ch != ""), lambda ch: F.concat(ch, new)), ""))
    return Coll("string", F.when(old == "", between).otherwise(F.replace(x, old, new)))


@function("replaceMatches", 2)
def replace_matches(c, this, args):
    x, pattern, new = _text(c, this), _pattern(c, args[0], this), _argument(c, args[1], this)
    if x is None or pattern is None or new is None:
        return EMPTY
    known = _literal(c, args[0], this)
    return Coll("string", F.regexp_replace(x, pattern, _replacement(new, 0 if known is None else _groups(known))))


@function("substring", 1, 2)
def substring(c, this, args):
    x, start = _text(c, this), first(c.argument(args[0], this))
    if x is None or start.kind != "integer":
        return EMPTY
    length = F.length(x) if len(args) < 2 else F.greatest(first(c.argument(args[1], this)).col, F.lit(0))
    at = start.col.cast("int")
    return Coll("string", F.when((at >= 0) & (at < F.length(x)), F.substring(x, at + 1, length.cast("int"))))


@function("split", 1)
def split(c, this, args):
    x, mark = _text(c, this), _argument(c, args[0], this)
    if x is None or mark is None:
        return EMPTY
    quoted = F.when(mark == "", "").otherwise(F.regexp_replace(mark, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    parts = F.when(mark == "", F.filter(F.split(x, ""), lambda ch: ch != "")).otherwise(F.split(x, quoted, -1))
    return Coll("string", F.coalesce(parts, F.array().cast("array<string>")), True)


@function("join", 0, 1)
def join(c, this, args):
    mark = _argument(c, args[0], this) if args else F.lit("")
    if this.kind == "empty":
        return Coll("string", F.lit(""))
    return Coll("string", F.call_function("array_join", c.texts(this).col, F.lit("") if mark is None else mark))
