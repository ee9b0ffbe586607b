"""Graph-query functions as Column expressions, with the graph language's meaning where it differs from SQL's.

Everything is built in and stays in generated code. Names follow Spark's style; each docstring
says only what differs from the Spark function of the same kind.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- text


def split(s: Column, delimiter: str) -> Column:
    """Split at a literal delimiter, not a pattern; trailing empties stay."""
    return F.split(s, re.escape(delimiter), -1)


def substring(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """0-based start."""
    at = (F.lit(start) if isinstance(start, int) else start) + 1
    return F.substr(s, at) if length is None else F.substr(s, at, F.lit(length) if isinstance(length, int) else length)


def regex_full(s: Column, pattern: str) -> Column:
    """``=~``: the whole string matches."""
    return s.rlike(rf"\A(?:{pattern})\z")


def size(x: Column, kind: str = "list") -> Column:
    """Elements of a list or characters of a string; null of null."""
    return (F.char_length(x) if kind == "string" else F.when(x.isNotNull(), F.size(x))).cast("bigint")


# -- lists


def head(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def tail(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))


def range_list(low: Column | int, high: Column | int, step: int = 1) -> Column:
    """Inclusive; empty where the step leads away from the end."""
    if step == 0:
        raise ValueError("range: the step can't be 0")
    lo, hi = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (low, high))
    runs = lo <= hi if step > 0 else lo >= hi
    return F.when(runs, F.sequence(lo, hi, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def comprehension(x: Column, where=None, value=None) -> Column:
    """``[v IN x WHERE where(v) | value(v)]``."""
    x = F.filter(x, where) if where is not None else x
    return F.transform(x, value) if value is not None else x


def in_list(v: Column, x: Column) -> Column:
    """Three-valued IN over a list column: null where v is null (and the list isn't empty) or only a null could match."""
    return F.when(F.size(x) == 0, F.lit(False)).when(v.isNull(), F.lit(None).cast("boolean")).otherwise(F.exists(x, lambda e: e == v))


def keys(*names: str, of: dict[str, Column]) -> Column:
    """Names of the properties that are set."""
    return F.filter(F.array(*(F.when(of[n].isNotNull(), F.lit(n)) for n in names)), lambda k: k.isNotNull())


def properties(**of: Column) -> Column:
    """A map of the properties that are set, as text."""
    pairs = F.filter(F.array(*(F.struct(F.lit(n), c.cast("string")) for n, c in of.items())), lambda e: e["col2"].isNotNull())
    return F.map_from_entries(pairs)


# -- numbers


def ceil(x: Column) -> Column:
    """A float."""
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x.cast("double"), digits)


def divide(a: Column, b: Column, integral: bool) -> Column:
    """``/``: integers divide to an integer, towards zero."""
    return F.call_function("div", a, b) if integral else a / b


def log(x: Column) -> Column:
    """Natural."""
    return F.ln(x)


# -- conversions: null where the value doesn't convert


def to_integer(x: Column) -> Column:
    """Cuts fractions off; null beyond the range of a long."""
    d = x.try_cast("double")
    return F.coalesce(x.try_cast("bigint"), F.when((d >= -(2.0**63)) & (d < 2.0**63), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("bigint")))


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_boolean(x: Column) -> Column:
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def to_string(x: Column) -> Column:
    return x.cast("string")


def xor(a: Column, b: Column) -> Column:
    return a != b


# -- time

#: Numbers below DAYS_BELOW are days since 1970, from MILLIS_FROM on milliseconds.
DAYS_BELOW, MILLIS_FROM = 100_000, 100_000_000_000
#: Seconds of an average year and month, for durations given in words.
YEAR_S, MONTH_S = 365.25 * 86400, 30.4375 * 86400


def duration_seconds(iso: Column) -> Column:
    """Seconds of an ISO-8601 duration such as P1Y2M10DT2H30M."""
    part = lambda unit, t: F.coalesce(F.regexp_extract(iso, t.format(unit), 1).try_cast("double"), F.lit(0.0))
    date, time = r"^-?P[^T]*?([0-9.]+){}", r"T.*?([0-9.]+){}"
    total = part("Y", date) * YEAR_S + part("M", date) * MONTH_S + part("W", date) * 604800 + part("D", date) * 86400 + part("H", time) * 3600 + part("M", time) * 60 + part("S", time)
    return F.when(iso.rlike(r"^-?P[0-9T]"), F.when(iso.startswith("-"), -total).otherwise(total))


def duration(iso: Column) -> Column:
    """(months, seconds) of an ISO-8601 duration: months and years stay calendar units."""
    part = lambda unit, t: F.coalesce(F.regexp_extract(iso, t.format(unit), 1).try_cast("double"), F.lit(0.0))
    date, time = r"^-?P[^T]*?([0-9.]+){}", r"T.*?([0-9.]+){}"
    sign = F.when(iso.startswith("-"), -1).otherwise(1)
    months = part("Y", date) * 12 + part("M", date)
    seconds = part("W", date) * 604800 + part("D", date) * 86400 + part("H", time) * 3600 + part("M", time) * 60 + part("S", time)
    return F.when(iso.rlike(r"^-?P[0-9T]"), F.struct((sign * months).cast("int").alias("months"), (sign * seconds).alias("seconds")))


def plus_duration(t: Column, d: Column) -> Column:
    """A timestamp later by a duration: first whole months of the calendar (the day is held to the month's last), then seconds."""
    moved = t + F.make_interval(F.lit(0), d["months"])
    return moved + F.make_dt_interval(secs=d["seconds"].cast("decimal(18,6)"))


def datetime_from_text(s: Column) -> Column:
    """ISO-8601 date and time (a space may stand for T); null where it is none."""
    return F.try_to_timestamp(F.replace(F.trim(s), F.lit("T"), F.lit(" ")))


def time_of_day(x: Column) -> Column:
    """Microseconds since midnight of a text such as 10:35:00.5 or 10:35, or of a timestamp's text; null where it is none."""
    text = F.regexp_extract(x.cast("string"), r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)$", 1)
    p = F.split(text, ":")
    at = lambda i: F.get(p, F.lit(i)).try_cast("decimal(10,6)")
    h, m, s = at(0), at(1), F.coalesce(at(2), F.lit(0).cast("decimal(10,6)"))
    return F.when((text != "") & (h < 24) & (m < 60) & (s < 60), ((h * 3600 + m * 60 + s) * 1_000_000).cast("bigint"))


def duration_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b).cast("bigint")


def date_from_number(n: Column) -> Column:
    """Days since 1970 below 100 000, else seconds."""
    return F.when(F.abs(n) < DAYS_BELOW, F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))).otherwise(F.to_date(F.timestamp_seconds(n)))


def datetime_from_number(n: Column) -> Column:
    """Milliseconds from 1e11 on, else seconds."""
    return F.when(F.abs(n) >= MILLIS_FROM, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


# -- places

#: Fixed value: mean radius of the earth in metres.
EARTH_M = 6_371_008.8
WGS84, WGS84_3D, CARTESIAN, CARTESIAN_3D = 4326, 4979, 7203, 9157


def point(x: Column, y: Column, z: Column | None = None, srid: int | None = None) -> Column:
    srid = srid or (CARTESIAN if z is None else CARTESIAN_3D)
    return F.struct(F.lit(srid).alias("srid"), x.cast("double").alias("x"), y.cast("double").alias("y"), (z if z is not None else F.lit(None)).cast("double").alias("z"))


def distance(a: Column, b: Column) -> Column:
    """Metres on the sphere for geographic points (x longitude, y latitude), else straight; heights count if both have one; null across systems."""
    geo = a["srid"].isin(WGS84, WGS84_3D)
    dz = F.coalesce(a["z"] - b["z"], F.lit(0.0))
    lat1, lat2 = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((F.radians(b["x"]) - F.radians(a["x"])) / 2), 2)
    arc = 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    flat = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + dz * dz)
    same = b["srid"].isin(WGS84, WGS84_3D) == geo
    return F.when(same, F.when(geo, F.sqrt(arc * arc + dz * dz)).otherwise(flat))


# -- graph


def labels(var: str) -> Column:
    return F.col(f"{var}__labels")


def type_of(var: str) -> Column:
    return F.col(f"{var}__type")


def element_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(label), F.lit(":"), key.cast("string"))


def path_length(path: str) -> Column:
    return F.col(f"{path}__length").cast("bigint")


def path_nodes(path: str) -> Column:
    return F.col(f"{path}__nodes")


def path_relationships(path: str) -> Column:
    return F.col(f"{path}__rels")


def elements(path: str) -> Column:
    """Nodes and relationships in turn, as text."""
    n, r = F.col(f"{path}__nodes").cast("array<string>"), F.col(f"{path}__rels")
    return F.concat(F.flatten(F.transform(r, lambda x, i: F.array(F.get(n, i), x))), F.slice(n, -1, 1))


def start_node(edge: str) -> Column:
    return F.col(f"{edge}__src")


def end_node(edge: str) -> Column:
    return F.col(f"{edge}__dst")


# -- vectors


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer: cosine (null with a zero vector), dot, or 1 / (1 + squared distance) for euclidean."""
    if metric == "dot":
        return _dot(a, b)
    if metric == "cosine":
        return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    if metric == "euclidean":
        d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return 1.0 / (1.0 + _dot(d, d))
    raise ValueError(f"no metric {metric!r}; there are cosine, dot and euclidean")


def call(name: str, *args: Column) -> Column:
    """Any built-in or registered function by name."""
    return F.call_function(name, *args)
