"""Units of quantities and their canonical forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit code: (canonical code, factor). They must be equal to the reference's for right results.
CANONICAL = {
    # mass
    "kg": ("g", 1000.0), "g": ("g", 1.0), "mg": ("g", 0.001), "ug": ("g", 0.000001), "ng": ("g", 0.000000001), "pg": ("g", 0.000000000001),
    "lb": ("g", 453.59237), "oz": ("g", 28.349523125), "[lb_av]": ("g", 453.59237), "[oz_av]": ("g", 28.349523125),
    # length
    "km": ("m", 1000.0), "m": ("m", 1.0), "dm": ("m", 0.1), "cm": ("m", 0.01), "mm": ("m", 0.001), "um": ("m", 0.000001), "nm": ("m", 0.000000001),
    "[in_i]": ("m", 0.0254), "[ft_i]": ("m", 0.3048), "[yd_i]": ("m", 0.9144), "[mi_i]": ("m", 1609.344), "in": ("m", 0.0254), "ft": ("m", 0.3048),
    # volume
    "L": ("L", 1.0), "l": ("L", 1.0), "dL": ("L", 0.1), "dl": ("L", 0.1), "cL": ("L", 0.01), "cl": ("L", 0.01), "mL": ("L", 0.001), "ml": ("L", 0.001),
    "uL": ("L", 0.000001), "ul": ("L", 0.000001), "[gal_us]": ("L", 3.785411784), "[qt_us]": ("L", 0.946352946), "[pt_us]": ("L", 0.473176473), "[foz_us]": ("L", 0.0295735295625),
    # time
    "a": ("s", 31557600.0), "mo": ("s", 2629800.0), "wk": ("s", 604800.0), "d": ("s", 86400.0), "h": ("s", 3600.0), "min": ("s", 60.0), "s": ("s", 1.0),
    "ms": ("s", 0.001), "us": ("s", 0.000001), "ns": ("s", 0.000000001),
    # temperature
    "K": ("K", 1.0), "Cel": ("Cel", 1.0), "[degF]": ("Cel", 1.0),
    # mass concentration
    "g/L": ("g/L", 1.0), "mg/L": ("g/L", 0.001), "ug/L": ("g/L", 0.000001), "ng/L": ("g/L", 0.000000001), "g/dL": ("g/L", 10.0), "mg/dL": ("g/L", 0.01),
    "ug/dL": ("g/L", 0.00001), "g/mL": ("g/L", 1000.0), "mg/mL": ("g/L", 1.0), "ug/mL": ("g/L", 0.001),
    # molar concentration
    "mol/L": ("mol/L", 1.0), "mmol/L": ("mol/L", 0.001), "umol/L": ("mol/L", 0.000001), "nmol/L": ("mol/L", 0.000000001), "pmol/L": ("mol/L", 0.000000000001),
    # pressure
    "Pa": ("Pa", 1.0), "kPa": ("Pa", 1000.0), "mm[Hg]": ("Pa", 133.322387415), "[psi]": ("Pa", 6894.757293168),
    # cells
    "10*9/L": ("10*9/L", 1.0), "10*12/L": ("10*9/L", 1000.0), "10*6/L": ("10*9/L", 0.001), "10*3/uL": ("10*9/L", 1.0), "/uL": ("10*9/L", 0.000001),
    # percent, rate
    "%": ("%", 1.0), "/min": ("/min", 1.0), "/h": ("/min", 1.0 / 60.0),
    # international units
    "[IU]": ("[IU]", 1.0), "[IU]/L": ("[IU]/L", 1.0), "[IU]/mL": ("[IU]/L", 1000.0), "m[IU]/L": ("[IU]/L", 0.001), "m[IU]/mL": ("[IU]/L", 1.0), "u[IU]/mL": ("[IU]/L", 0.001),
    # energy
    "J": ("J", 1.0), "kJ": ("J", 1000.0), "cal": ("J", 4.184), "kcal": ("J", 4184.0), "[Cal]": ("J", 4184.0),
}
SYSTEM = "http://unitsofmeasure.org"

_FOLDED: dict[str, tuple[str, float]] = {}
for _unit, _canonical in CANONICAL.items():
    _FOLDED.setdefault(_unit.lower(), _canonical)


def normalize(value: float, unit: str) -> tuple[float, str]:
    """(value, code) in canonical form: the exact unit, else ignoring case, else unchanged."""
    code, factor = CANONICAL.get(unit) or _FOLDED.get(unit.lower()) or (unit, 1.0)
    return value * factor, code


def normalize_with_system(value: float, unit: str, system: str) -> tuple[float, str]:
    return normalize(value, unit) if system in ("", SYSTEM) else (value, unit)


def is_known(unit: str) -> bool:
    return unit in CANONICAL or unit.lower() in _FOLDED


def canonical_unit(unit: str) -> str:
    return normalize(1.0, unit)[1]


def _table(entries: dict[str, tuple[str, float]]) -> Column:
    """unit -> (code, factor), as a map literal that Catalyst folds."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quote(u)}, named_struct('code', {quote(c)}, 'factor', {f!r}D)" for u, (c, f) in entries.items()) + ")")


def _entry(unit: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(CANONICAL), unit), F.try_element_at(_table(_FOLDED), F.lower(unit)))


def canonical(unit: Column, literal: str | None = None, system: Column | None = None) -> tuple[Column, Column]:
    """(code, factor) of a unit column, or of a unit that is known when the plan is made; units of another system stay as they are."""
    if literal is not None:
        factor, code = normalize(1.0, literal)
        return F.lit(code), F.lit(factor)
    found = _entry(unit) if system is None else F.when(one_of(F.coalesce(system, F.lit("")), ("", SYSTEM)), _entry(unit))
    return F.coalesce(found["code"], unit), F.coalesce(found["factor"], F.lit(1.0))


def known(unit: Column) -> Column:
    """Whether a unit has a canonical form."""
    return _entry(unit).isNotNull()


def scaled(quantity: Column, factor: Column) -> Column:
    """A quantity, factor times as much, in its own unit."""
    return F.struct((quantity["value"] * factor).alias("value"), quantity["unit"].alias("unit"))


def one_of(column: Column, values) -> Column:
    return reduce(lambda a, b: a | b, [column == v for v in values])
