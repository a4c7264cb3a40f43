"""Boundary values: parsing, literals, sentinels, and the column form for a table of targets."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce, total_ordering

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The boundary of an empty hot tier, later than any row.
SENTINELS = {
    "datetime": "9999-12-31 23:59:59",
    "date": "9999-12-31",
    "bigint": "9999999999999",
}

# What a required column without a default is filled with, by type name.
PLACEHOLDERS = {
    "tinyint": "0",
    "smallint": "0",
    "int": "0",
    "bigint": "0",
    "decimal": "0",
    "float": "0",
    "double": "0",
    "boolean": "false",
    "string": "",
    "json": "{}",
    "date": "1970-01-01",
    "timestamp": "1970-01-01 00:00:00",
    "timestamp_ntz": "1970-01-01 00:00:00",
}

_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_PATTERNS = {
    "datetime": f"^{_DATE} [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?$",
    "date": f"^{_DATE}$",
    "bigint": "^[+-]?[0-9]+$",
}
_EXPECTED = {
    "datetime": "YYYY-MM-DD HH:MM:SS",
    "date": "YYYY-MM-DD",
    "bigint": "a 64-bit integer",
}


class BoundaryError(ValueError):
    """A boundary value does not suit the type of its time column."""


def check_kind(kind: str) -> str:
    kind = kind.lower()
    if kind not in SENTINELS:
        raise BoundaryError(f"time column type {kind!r} is not one of {', '.join(SENTINELS)}")
    return kind


@total_ordering
@dataclass(frozen=True)
class Boundary:
    """A point in time of one kind; ``value`` is a datetime, a date or an int. Points of two kinds have no order."""

    kind: str
    value: dt.datetime | dt.date | int

    def __lt__(self, other: Boundary) -> bool:
        if not isinstance(other, Boundary):
            return NotImplemented
        if self.kind != other.kind:
            raise BoundaryError(f"{other.kind} {other.text} and {self.kind} {self.text} cannot be compared")
        return self.value < other.value

    @property
    def text(self) -> str:
        if self.kind == "datetime":
            return self.value.isoformat(sep=" ")
        return str(self.value)

    def before(self) -> Boundary | None:
        """The latest point of this kind that lies before, None at the start of the range."""
        try:
            if self.kind == "bigint":
                return Boundary(self.kind, self.value - 1) if self.value > -(2**63) else None
            step = dt.timedelta(days=1) if self.kind == "date" else dt.timedelta(microseconds=1)
            return Boundary(self.kind, self.value - step)
        except OverflowError:
            return None

    def sql(self, column_type: T.DataType | None = None) -> str:
        """Typed literal; ``column_type`` tells a zoned timestamp column from a zoneless one."""
        if self.kind == "bigint":
            # The smallest BIGINT has no literal of its own: the sign is applied after parsing.
            return f"{self.value}L" if self.value > -(2**63) else f"cast('{self.value}' AS bigint)"
        if self.kind == "date":
            return f"DATE '{self.text}'"
        zoned = isinstance(column_type, T.TimestampType)
        return f"{'TIMESTAMP' if zoned else 'TIMESTAMP_NTZ'} '{self.text}'"


def sentinel(kind: str) -> Boundary:
    return parse_boundary(SENTINELS[check_kind(kind)], kind)


def parse_boundary(value: str | int | dt.date | dt.datetime, kind: str) -> Boundary:
    """Read a boundary given by a caller; outer quotes are allowed, other formats are an error."""
    kind = check_kind(kind)
    text = str(value).strip("'")
    if not re.match(_PATTERNS[kind], text) or text.endswith("\n"):
        raise BoundaryError(f"boundary {value!r} is not {_EXPECTED[kind]}")
    try:
        if kind == "bigint":
            number = int(text)
            if not -(2**63) <= number < 2**63:
                raise ValueError("out of range")
            return Boundary(kind, number)
        if kind == "date":
            return Boundary(kind, dt.date.fromisoformat(text))
        whole, _, fraction = text.replace(",", ".").partition(".")
        moment = dt.datetime.strptime(whole, "%Y-%m-%d %H:%M:%S")
        # Microseconds are the finest step a row can have, so a finer boundary rounds up to the next.
        micros = int(fraction[:6].ljust(6, "0")) if fraction else 0
        moment += dt.timedelta(microseconds=micros + (1 if fraction[6:].strip("0") else 0))
        return Boundary(kind, moment)
    except (ValueError, OverflowError) as error:
        raise BoundaryError(f"boundary {value!r} is not {_EXPECTED[kind]}: {error}") from error


def validate_targets(targets: DataFrame, kind: str = "time_type", value: str = "boundary") -> DataFrame:
    """Check a table of requested boundaries, one row each, by the rules of :func:`parse_boundary`.

    Adds ``ok``, ``normalized`` (canonical text, NULL if refused) and ``problem`` (NULL if accepted).
    """
    text = F.regexp_replace(F.col(value), "^'+|'+$", "")
    kind_name = F.lower(F.col(kind))

    def shaped(name: str) -> Column:
        # Text of another shape is not handed to the casts: a cast that fails costs far more than one that works.
        pattern = _PATTERNS[name].removesuffix("$") + "(?!(?s:.))"
        return F.when((kind_name == name) & text.rlike(pattern), text)

    # In steps, each named once more than it is computed: inside conditions Spark would compute it anew each time.
    moment_text = F.translate(shaped("datetime"), ",", ".")
    fraction = F.when(F.contains("__text", F.lit(".")), F.substring_index("__text", ".", -1))
    micros = F.coalesce(F.rpad(F.substring("__fraction", 1, 6), 6, "0").try_cast("int"), F.lit(0))
    finer = F.coalesce(F.regexp_like(F.substr("__fraction", F.lit(7)), F.lit("[1-9]")), F.lit(False))
    seconds = ((F.col("__micros") + F.col("__finer").cast("int")) / F.lit(1000000)).cast("decimal(18,6)")
    whole = F.substring_index("__text", ".", 1).try_cast("timestamp_ntz")
    steps = [
        {"__text": moment_text, "__day": shaped("date").try_cast("date"), "__number": shaped("bigint").try_cast("bigint")},
        {"__fraction": fraction},
        {"__micros": micros, "__finer": finer},
        {"__moment": whole + F.make_dt_interval(secs=seconds)},
        {"__shown": F.date_format("__moment", "yyyy-MM-dd HH:mm:ss.SSSSSS")},
    ]
    normalized = F.coalesce(
        F.when(F.year("__moment").between(1, 9999), F.regexp_replace("__shown", "[.]000000$", "")),
        F.when(F.year("__day").between(1, 9999), F.col("__day").cast("string")),
        F.col("__number").cast("string"),
    )
    expected = F.lit("time column type is not supported")
    for name, form in _EXPECTED.items():
        expected = F.when(kind_name == name, F.lit(f"expected {form}")).otherwise(expected)
    staged = reduce(DataFrame.withColumns, steps, targets)
    checked = staged.withColumn("normalized", normalized).select(*targets.columns, "normalized")
    good = F.col("normalized").isNotNull()
    return checked.withColumn("ok", good).withColumn("problem", F.when(~good, expected))


def epoch_seconds(column: Column) -> Column:
    """Whole seconds since 1970-01-01, a zoneless time being read in the session time zone."""
    return F.unix_seconds(column.cast("timestamp"))


def utc_epoch_seconds(column: Column) -> Column:
    """Whole seconds since 1970-01-01 of a zoneless time read as UTC, whatever the session zone."""
    days = F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
