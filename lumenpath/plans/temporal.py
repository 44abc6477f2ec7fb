"""Columns of partial dates, times and quantities: equality, order, text, arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpath.functions.units import canonical, one_of
from lumenpath.plans.coll import DATE, DATETIME, PARTS, TIME, Coll, let

DAY_MS = 86_400_000


def of_parts(kind: str, parts: tuple) -> Column:
    return F.struct(*[F.lit(p).cast("int").alias(n) for n, p in zip(PARTS[kind], parts, strict=True)])


def day_of(x: Column) -> Column:
    """The calendar day; parts that are missing count as 1, days past a month's end run on."""
    month = F.add_months(F.make_date(x["y"], F.lit(1), F.lit(1)), F.coalesce(x["m"], F.lit(1)) - 1)
    return F.date_add(month, F.coalesce(x["d"], F.lit(1)) - 1)


def time_ms(x: Column) -> Column:
    at = [F.coalesce(x[n], F.lit(0)).cast("long") for n in TIME]
    return ((at[0] * 60 + at[1]) * 60 + at[2]) * 1000 + at[3]


def instant(x: Column) -> Column:
    return F.unix_date(day_of(x)).cast("long") * DAY_MS + time_ms(x) - F.coalesce(x["off"], F.lit(0)).cast("long") * 60_000


def _same_precision(kind: str, a: Column, b: Column) -> Column:
    out = F.lit(True)
    for n in PARTS[kind]:
        if n != "off":
            out = out & (a[n].isNull() == b[n].isNull())
    return out


def equal(kind: str, a: Column, b: Column) -> Column:
    """null if either is."""
    both = a.isNotNull() & b.isNotNull()
    if kind == "datetime":
        return F.when(both, instant(a) == instant(b))
    out = F.lit(True)
    for n in PARTS[kind]:
        out = out & a[n].eqNullSafe(b[n])
    return F.when(both, out)


def _by_parts(names: tuple, a: Column, b: Column) -> Column:
    """-1, 0, 1 at the first part that differs; null where a part is missing on one side only."""
    out = F.lit(0)
    for n in reversed(names):
        sign = F.when(a[n] < b[n], -1).when(a[n] > b[n], 1)
        out = F.when(a[n].isNull() & b[n].isNull(), 0).when(a[n].isNull() | b[n].isNull(), F.lit(None)).when(a[n] == b[n], out).otherwise(sign)
    return out


def compare(kind: str, a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is null, or their precision leaves it open."""
    by_parts = _by_parts(PARTS[kind] if kind != "datetime" else DATETIME[:-1], a, b)
    if kind == "datetime":
        by_parts = F.when(_same_precision(kind, a, b), F.signum(instant(a) - instant(b)).cast("int")).otherwise(by_parts)
    return F.when(a.isNotNull() & b.isNotNull(), by_parts)


def text(kind: str, x: Column) -> Column:
    two = lambda n: F.lpad(x[n].cast("string"), 2, "0")
    after = lambda mark, n: F.coalesce(F.concat(F.lit(mark), two(n)), F.lit(""))
    date = lambda: F.concat(F.lpad(x["y"].cast("string"), 4, "0"), after("-", "m"), after("-", "d"))
    clock = lambda: F.concat(two("h"), after(":", "mi"), after(":", "s"), F.coalesce(F.concat(F.lit("."), F.lpad(x["ms"].cast("string"), 3, "0")), F.lit("")))
    if kind == "date":
        out = date()
    elif kind == "time":
        out = clock()
    else:
        off = F.abs(x["off"])
        zone = F.when(x["off"] == 0, "Z").when(x["off"].isNotNull(), F.concat(F.when(x["off"] > 0, "+").otherwise("-"), F.lpad(F.floor(off / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((off % 60).cast("string"), 2, "0"))).otherwise("")
        out = F.concat(date(), F.when(x["h"].isNotNull(), F.concat(F.lit("T"), clock(), zone)).otherwise(""))
    return F.when(x.isNotNull(), out)


_MS = {"hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1, "ms": 1}


def _amount(unit: Column, scales: dict[str, int], n: Column) -> Column:
    """n times the scale of the unit, singular or plural; 0 for other units."""
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for name, scale in scales.items():
        out = out.when(one_of(unit, {name, f"{name}s"} if name != "ms" else {"ms"}), n * scale)
    return out.otherwise(F.lit(0).cast("long"))


def add(kind: str, x: Column, quantity: Column, sign: int, clamp: bool, unit: str | None = None) -> Column:
    """x plus or minus a calendar duration. A day past the month's end runs on, or is clamped to it.

    unit: the duration's, where it is known when the plan is made; then only the steps that it needs are planned.
    """
    n = (F.floor(F.abs(quantity["value"])) * F.signum(quantity["value"]) * sign).cast("long")

    def amount(scales: dict[str, int]) -> Column | None:
        if unit is None:
            return _amount(quantity["unit"], scales, n)
        scale = scales.get(unit) or (scales.get(unit[:-1]) if unit.endswith("s") and unit != "ms" else None)
        return n * scale if scale else None

    months, days, ms = amount({"year": 12, "month": 1}), amount({"week": 7, "day": 1}), amount(_MS) if kind == "datetime" else None
    known = F.when(x.isNotNull() & quantity.isNotNull(), True)
    if months is None and days is None and ms is None:
        return F.when(known, x)
    day, start = F.coalesce(x["d"], F.lit(1)), F.add_months(F.make_date(x["y"], F.lit(1), F.lit(1)), F.coalesce(x["m"], F.lit(1)) - 1)
    if months is not None:
        start = F.add_months(start, months.cast("int"))
        if clamp:
            day = F.when(months != 0, F.least(day, F.dayofmonth(F.last_day(start)))).otherwise(day)
    date = F.date_add(start, day - 1 if days is None else (day - 1 + days).cast("int"))
    if kind == "date":
        made = let(date, lambda d: F.struct(F.year(d).alias("y"), F.when(x["m"].isNotNull(), F.month(d)).alias("m"), F.when(x["d"].isNotNull(), F.dayofmonth(d)).alias("d")))
        if unit is None:
            made = F.when((months == 0) & (days == 0), x).otherwise(made)
        return F.when(known, made)
    total = F.unix_date(date).cast("long") * DAY_MS + time_ms(x)

    def parts(total: Column) -> Column:
        whole = F.floor(total / DAY_MS)
        date, left = F.date_from_unix_date(whole.cast("int")), total - whole * DAY_MS
        at = {"y": F.year(date), "m": F.month(date), "d": F.dayofmonth(date), "h": F.floor(left / 3_600_000), "mi": F.floor(left / 60_000) % 60, "s": F.floor(left / 1000) % 60, "ms": left % 1000}
        return F.struct(*[(F.when(x[p].isNotNull(), at[p]) if p in at else x[p]).cast("int").alias(p) for p in DATETIME])

    return F.when(known, let(total if ms is None else total + ms, parts))


_CLOCK = r"(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?"


def _int(s: Column) -> Column:
    return F.nullif(s, F.lit("")).try_cast("int")


def parse_date(s: Column) -> Column:
    part = [_int(F.regexp_extract(s, r"^(\d{4})(?:-(\d\d))?(?:-(\d\d))?$", k + 1)) for k in range(3)]
    return F.when(part[0].isNotNull(), F.struct(*[p.alias(n) for p, n in zip(part, DATE, strict=True)]))


def parse_time(s: Column) -> Column:
    at = [F.regexp_extract(s, f"^T?{_CLOCK}$", k + 1) for k in range(4)]
    at[3] = F.when(at[3] != "", F.rpad(F.substring(at[3], 1, 3), 3, "0"))
    return F.when(_int(at[0]).isNotNull(), F.struct(*[_int(p).alias(n) for p, n in zip(at, TIME, strict=True)]))


def parse_datetime(s: Column) -> Column:
    pattern = rf"^(\d{{4}})(?:-(\d\d))?(?:-(\d\d))?(?:T{_CLOCK}(Z|[+-]\d\d:\d\d)?)?$"
    at = [F.regexp_extract(s, pattern, k + 1) for k in range(8)]
    at[6] = F.when(at[6] != "", F.rpad(F.substring(at[6], 1, 3), 3, "0"))
    minutes = F.substring(at[7], 2, 2).try_cast("int") * 60 + F.substring(at[7], 5, 2).try_cast("int")
    off = F.when(at[7] == "Z", 0).when(F.startswith(at[7], F.lit("-")), -minutes).when(at[7] != "", minutes)
    return F.when(_int(at[0]).isNotNull(), F.struct(*[_int(p).alias(n) for p, n in zip(at[:7], DATETIME, strict=False)], off.cast("int").alias("off")))


def _canonical(c: Coll) -> tuple[Column, Column]:
    code, factor = canonical(c.col["unit"], c.literal if isinstance(c.literal, str) else None)
    return code, c.col["value"] * factor


def quantity_pair(a: Coll, b: Coll) -> tuple[Column, Column, Column]:
    """(comparable, value, value): the values as they are if the units are equal or one is missing, else in canonical units."""
    plain = (a.col["unit"] == b.col["unit"]) | (a.col["unit"] == "") | (b.col["unit"] == "")
    (code_a, value_a), (code_b, value_b) = _canonical(a), _canonical(b)
    return plain | (code_a == code_b), F.when(plain, a.col["value"]).otherwise(value_a), F.when(plain, b.col["value"]).otherwise(value_b)


def quantity_text(x: Column) -> Column:
    unit = F.when(F.contains(x["unit"], F.lit(" ")), F.concat(F.lit("'"), x["unit"], F.lit("'"))).otherwise(x["unit"])
    return F.when(x.isNotNull(), F.rtrim(F.concat(number_text(x["value"]), F.lit(" "), unit)))


def number_text(x: Column) -> Column:
    """A double without trailing zeros or exponent."""
    return F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"\.0+$|(\.\d*?)0+$", "$1")
