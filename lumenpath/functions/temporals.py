"""Parts of dates and times, the clock, and trace."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from lumenpath.functions.registry import function
from lumenpath.plans.coll import DATETIME, EMPTY, TIME, Coll, choice_item, first

log = logging.getLogger("lumenpath.trace")


def _date_part(name, part):
    @function(name)
    def build(c, this, args):
        x = first(choice_item(this, "date"))
        return Coll("integer", x.col[part].cast("long")) if x.kind in ("date", "datetime") else EMPTY


def _time_part(name, part):
    @function(name)
    def build(c, this, args):
        x = first(choice_item(this, "datetime"))
        return Coll("integer", F.when(x.col.isNotNull(), F.coalesce(x.col[part], F.lit(0))).cast("long")) if x.kind in ("datetime", "time") else EMPTY


for _name, _part in (("year", "y"), ("month", "m"), ("day", "d")):
    _date_part(_name, _part)
for _name, _part in (("hour", "h"), ("minute", "mi"), ("second", "s"), ("millisecond", "ms")):
    _time_part(_name, _part)


def _now():
    now = F.current_timestamp()
    ms = (F.unix_millis(now) % 1000).cast("int")
    return {"y": F.year(now), "m": F.month(now), "d": F.dayofmonth(now), "h": F.hour(now), "mi": F.minute(now), "s": F.second(now), "ms": ms, "off": F.lit(0)}


def _clock(name, kind, parts):
    @function(name)
    def build(c, this, args):
        """The same for the whole query."""
        at = _now()
        return Coll(kind, F.struct(*[at[p].cast("int").alias(p) for p in parts]))


_clock("now", "datetime", DATETIME)
_clock("today", "date", ("y", "m", "d"))
_clock("timeOfDay", "time", TIME)


@function("trace", 1, 2)
def trace(c, this, args):
    """The input; that it is traced is logged when the plan is made. To see values, observe() the frame."""
    log.info("trace %s: %s%s", getattr(args[0], "value", args[0]), this.kind, " (many)" if this.many else "")
    return this
