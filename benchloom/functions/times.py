"""Date-times, clock times and zones on columns."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Formats tried in order after ISO 8601.
FORMATS = (
    "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss.SSSSSS",
)


def parse_datetime(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A timestamp, or null where no format fits; offsets in the text count, else the session's zone."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), s.try_cast("timestamp"))
    # Fractions have any number of digits in texts: they are filled up to six.
    full = F.when(s.rlike(r"\.[0-9]{1,6}$"), F.rpad(s, F.length(s) - F.length(F.regexp_extract(s, r"\.([0-9]{1,6})$", 1)) + 6, "0")).otherwise(s)
    return F.coalesce(iso, *[F.try_to_timestamp(full, F.lit(f)) for f in formats])


def clock_seconds(c: Column) -> Column:
    """Seconds of H:MM:SS with an optional fraction (point or comma); null for other texts."""
    pattern = r"^\s*([0-9]{1,3}):([0-5][0-9]):([0-5][0-9](?:[.,][0-9]+)?)\s*$"
    part = lambda i: F.replace(F.regexp_extract(c, pattern, i), F.lit(","), F.lit(".")).cast("double")
    return F.when(c.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def unrolled(seconds: Column, partition: list[str], row: str) -> Column:
    """Clock seconds that count on over midnight: a drop of more than twelve hours adds a day."""
    w = Window.partitionBy(*partition).orderBy(row)
    before = F.last(seconds, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return seconds, F.coalesce((seconds < before - 43200).cast("long"), F.lit(0)), w


def local_to_utc(wall: Column, zone: str) -> Column:
    """struct(utc, reason) of a wall-clock time: times that do not exist are null, of ambiguous ones the earlier is taken."""
    wall = wall.cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    later = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.expr("interval 1 hour"))
    reason = F.when(wall.isNull(), F.lit(None)).when(back != wall, "nonexistent_local_time").when(later == wall, "ambiguous_local_time")
    return F.struct(F.when(back == wall, utc).alias("utc"), reason.alias("reason"))


_OFFSET = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.,]+(?:Z|[+-][0-9]{2}:?[0-9]{2})$"


def check_zone(zone: str) -> str:
    """The name of an IANA zone; another name raises."""
    try:
        return ZoneInfo(zone).key
    except (ZoneInfoNotFoundError, ValueError, OSError):
        raise ValueError(f"unknown time zone {zone!r}") from None


def date_times(df: DataFrame, column: str, source: list[str], zone: str) -> DataFrame:
    """Adds ``us`` (epoch microseconds) and ``reason``: texts with offsets are instants, others are read in ``zone``.

    The kind that most date-times of a source have (offsets, if as many) is its kind; those of the other kind are null with
    mixed_timezone, texts that are no date-times null with invalid_timestamp. Counts are one partial sum by source.
    """
    text = F.trim(F.col(column))
    df = df.withColumn("__aware", F.coalesce(text.rlike(_OFFSET), F.lit(False))).withColumn("__t", F.when(F.col("__aware"), parse_datetime(text)))
    # A naive text is parsed in the session's zone; its wall-clock time is what that zone shows.
    wall = F.when(~F.col("__aware"), parse_datetime(text).cast("timestamp_ntz"))
    df = df.withColumn("__wall", wall)
    counts = (F.count("__t").alias("__a"), F.count("__wall").alias("__n"))
    aware = (F.col("__a") >= F.col("__n")) & (F.col("__a") > 0)
    if source:
        df = df.join(df.groupBy(*source).agg(*counts).select(*source, aware.alias("__is")), source, "left")
    else:
        df = df.withColumn("__is", F.lit(df.agg(*counts).select(aware.alias("is")).first()["is"]))
    local = local_to_utc(F.col("__wall"), check_zone(zone))
    us = F.when(F.col("__is") & F.col("__aware"), F.unix_micros("__t")).when(~F.col("__is") & ~F.col("__aware"), F.unix_micros(local["utc"].cast("timestamp")))
    there = F.col("__t").isNotNull() | F.col("__wall").isNotNull()
    reason = F.when(text.isNull() | (text == ""), F.lit(None)).when(~there, "invalid_timestamp").when(F.col("__aware") != F.col("__is"), "mixed_timezone").when(~F.col("__aware"), local["reason"])
    return df.withColumn("us", us).withColumn("reason", reason).drop("__aware", "__t", "__wall", "__is")


def date_in_text(c: Column) -> Column:
    """The first date that a text holds, year first (2026-10-12) before day first (12.10.2026); numbers that are no date are passed over."""

    def first(pattern: str, order: tuple[int, int, int]) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        part = lambda x, i: F.regexp_extract(x, pattern, i)
        whole = lambda x: F.concat_ws("-", F.lpad(part(x, order[0]), 4, "0"), F.lpad(part(x, order[1]), 2, "0"), F.lpad(part(x, order[2]), 2, "0")).try_cast("date")
        return F.get(F.array_compact(F.transform(found, whole)), F.lit(0))

    year = first(r"(?<![0-9])([0-9]{4})[-_./]([0-9]{1,2})[-_./]([0-9]{1,2})(?![0-9])", (1, 2, 3))
    return F.coalesce(year, first(r"(?<![0-9])([0-9]{1,2})[-_./]([0-9]{1,2})[-_./]([0-9]{4})(?![0-9])", (3, 2, 1)))


def origin_us(format_: str, zone: str | None, first_clock_s: float | None = None, origin: datetime | None = None, clock_date: date | None = None) -> int | None:
    """Epoch microseconds of a recording's first time: an origin, or a date for clock times; None without either.

    Both at once, a date for times that are no clock times, or either for date-times raise; so does a time that the zone skips.
    """
    if origin is not None and clock_date is not None:
        raise ValueError("either an origin or a date for clock times")
    if clock_date is not None and format_ != "clock":
        raise ValueError(f"a date needs clock times, these are {format_}")
    if format_ == "datetime" and (origin or clock_date):
        raise ValueError("date-times have their origin in themselves")
    if clock_date is not None:
        origin = datetime.combine(clock_date, time()) + timedelta(seconds=first_clock_s or 0.0)
    if origin is None:
        return None
    if origin.tzinfo is None:
        here = ZoneInfo(check_zone(zone)) if zone else ZoneInfo("UTC")
        placed = origin.replace(tzinfo=here)
        if placed.astimezone(ZoneInfo("UTC")).astimezone(here).replace(tzinfo=None) != origin:
            raise ValueError(f"{origin} does not exist in {zone}")
        origin = placed
    return (origin - datetime(1970, 1, 1, tzinfo=ZoneInfo("UTC"))) // timedelta(microseconds=1)


def cell_datetime(c: Column, day: Column) -> Column:
    """A sheet's cell as a wall-clock time: a clock time on ``day``, a serial number of days (from 30 December 1899), or a date-time."""
    plus = lambda start, s: F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + F.round(s * 1e6).cast("long"))

    def read(x: Column) -> Column:
        number = x.try_cast("double")
        clock = clock_seconds(F.when(x.rlike("^[0-9]{1,2}:[0-5][0-9]$"), F.concat(x, F.lit(":00"))).otherwise(x))
        serial = F.when(number >= 1, plus(F.lit("1899-12-30").cast("date"), number * 86400)).when(number >= 0, plus(day, number * 86400))
        return F.coalesce(plus(day, clock), serial, parse_datetime(x))

    # The cell is bound once: all readings of it written out would be too long for one compiled method.
    return F.get(F.transform(F.array(F.trim(c)), read), F.lit(0))


def master_wall(epoch_s: Column, zone: str) -> Column:
    """The wall-clock time of epoch seconds in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(check_zone(zone)), F.timestamp_micros(F.round(epoch_s * 1e6).cast("long")).cast("timestamp_ntz"))
