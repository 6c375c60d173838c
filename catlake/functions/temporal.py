"""Days, weeks and states of records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

def iso_week(day: Column) -> Column:
    """2024-12-30 -> 2025-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.trunc(day, "week")


def week_bounds(week: Column) -> tuple[Column, Column]:
    """Monday and Sunday of an ISO week id; null if it is none."""
    year, number = F.substring(week, 1, 4).cast("int"), F.substring(week, 7, 2).cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.when(week.rlike(r"^\d{4}-W\d{2}$"), F.date_add(F.trunc(fourth, "week"), (number - 1) * 7))
    valid = F.when(iso_week(monday) == week, monday)
    return valid, F.date_add(valid, 6)


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Whole periods of 24 hours between two instants."""
    return F.floor((F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))) / 86400)


def event_state(start: Column, end: Column, now: Column) -> Column:
    """past, ongoing or future at the instant ``now``; without an end, a record lasts to the end of its first day."""
    past = (end < now) | (end.isNull() & (F.to_date(start) < F.to_date(now)))
    return F.when(start.isNull(), None).when(past, "past").when(start <= now, "ongoing").otherwise("future")


def horizon_scope(start: Column, now: Column, days: int = 14) -> Column:
    ahead = elapsed_days(now, start)
    return F.when(ahead.between(0, days), "priority").otherwise("opportunistic")


def long_running(categories: Column, wanted: list[str], start_day: Column, end_day: Column, least: int = 7) -> Column:
    """Whether a record of one of the categories covers at least so many calendar days."""
    return F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, wanted))) & (F.datediff(end_day, start_day) + 1 >= least), F.lit(False))


def quick_range(name: str, today: Column) -> tuple[Column, Column]:
    """First and last day of today, tomorrow, or the current week's Friday to Sunday."""
    if name == "today":
        return today, today
    if name == "tomorrow":
        return F.date_add(today, 1), F.date_add(today, 1)
    if name == "weekend":
        friday = F.date_add(F.trunc(today, "week"), 4)
        return friday, F.date_add(friday, 2)
    raise ValueError(f"unknown range {name!r}")


#: Names of the months, folded; fixed values.
MONTHS = {
    "ledna": 1, "leden": 1, "unora": 2, "unor": 2, "brezna": 3, "brezen": 3, "dubna": 4, "duben": 4, "kvetna": 5, "kveten": 5, "cervna": 6, "cerven": 6,
    "cervence": 7, "cervenec": 7, "srpna": 8, "srpen": 8, "zari": 9, "rijna": 10, "rijen": 10, "listopadu": 11, "listopad": 11, "prosince": 12, "prosinec": 12,
}
#: Where dates may stand in an unaccented text: figures, points and dashes, with names of months among them.
DATE_RUN = rf"\.?\d(?:[\d.\-\s]++|(?:{'|'.join(sorted(MONTHS, key=len, reverse=True))})\b)*+"


#: What each run with a date has: a day with its point and a month behind it, with no blank line between, or a date with dashes.
_LIKELY_RUN = r"\d\.(?!\s*\n\s*\n)\s*(?:\d{1,2}\.|[a-z])|\d{4}-\d\d-\d\d"


def run_dates(run: Column) -> Column:
    """struct(d, m, y, start, text) of each date in a run: by its first character's place there; y is null if it isn't written.

    A run is cut into figures, points, dashes and names, and each figure is judged by its
    neighbours: day, point, month in figures, point and perhaps a year; day, point, name of a
    month and perhaps a year; year, dash, month, dash, day. Parts of other figures, as in
    1.500 or 1.2.3.4, are no dates, nor are figures with a blank line between. What a date has used isn't used again.
    """
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    gap = F.lit(" \t\n\r\f\v")
    bare = lambda x: F.ltrim(x, gap)

    def read(t: Column) -> Column:
        text = lambda i, k: F.coalesce(bare(F.get(t, i + k)), F.lit(""))
        apart = lambda i, k: F.coalesce(F.get(t, i + k).rlike(r"^\s"), F.lit(True))
        figures = lambda x, low, high: F.length(x).between(low, high) & x.rlike(r"^\d")
        near = lambda i, k: ~F.coalesce(F.get(t, i + k).rlike(r"^\s*\n\s*\n"), F.lit(False))
        glued = lambda i, k: ~apart(i, k) & text(i, k).rlike(r"^[\d.]")
        number = lambda x: x.try_cast("int")

        def at(i: Column) -> Column:
            """struct(d, m, y, n) of the date that begins with sign i, of n signs; null if there is none."""
            made = lambda d, m, y, n: F.struct(number(d).alias("d"), m.cast("int").alias("m"), number(y).alias("y"), F.lit(n).alias("n"))
            none = F.lit(None).cast("string")
            day = figures(text(i, 0), 1, 2) & (text(i, 1) == ".") & ~apart(i, 1)
            free = apart(i, 0) | (text(i, -1) != ".")
            numeric = day & free & figures(text(i, 2), 1, 2) & near(i, 2) & (text(i, 3) == ".") & ~apart(i, 3)
            numeric_year = figures(text(i, 4), 4, 4) & near(i, 4) & ~glued(i, 5)
            name = F.try_element_at(months, text(i, 2))
            dashed = figures(text(i, 0), 4, 4) & (F.concat(*[F.get(t, i + k) for k in (1, 2, 3, 4)]).rlike(r"^-\d\d-\d\d$"))
            by_name = F.when(figures(text(i, 3), 4, 4) & apart(i, 3) & near(i, 3), made(text(i, 0), name, text(i, 3), 4)).when(~glued(i, 3), made(text(i, 0), name, none, 3))
            return (
                F.when(dashed, made(text(i, 4), number(text(i, 2)), text(i, 0), 5))
                .when(numeric & numeric_year, made(text(i, 0), number(text(i, 2)), text(i, 4), 5))
                .when(numeric & ~glued(i, 4), made(text(i, 0), number(text(i, 2)), none, 4))
                .when(day & name.isNotNull() & near(i, 2), by_name)
            )

        def step(past: Column, i: Column) -> Column:
            sign = F.get(t, i)
            start = past["at"] + F.length(sign) - F.length(bare(sign))

            def taken(x: Column) -> Column:
                written = bare(F.array_join(F.slice(t, i + 1, x["n"]), ""))
                found = F.concat(past["found"], F.array(F.struct(x["d"].alias("d"), x["m"].alias("m"), x["y"].alias("y"), start.alias("start"), written.alias("text"))))
                hit = x.isNotNull()
                return F.struct((past["at"] + F.length(sign)).alias("at"), F.when(hit, x["n"] - 1).otherwise(past["skip"] - 1).alias("skip"), F.when(hit, found).otherwise(past["found"]).alias("found"))

            return let(F.when((past["skip"] <= 0) & sign.rlike(r"^\s*\d"), at(i)), taken)

        kind = "array<struct<d:int,m:int,y:int,start:int,text:string>>"
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("skip"), F.array().cast(kind).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), begin, step, lambda s: s["found"])

    # White space at the end belongs to no sign; cut off first, it isn't searched again and again.
    return let(F.regexp_extract_all(F.rtrim(run, gap), F.lit(r"\s*(?:\d+|[.\-]|[a-z]+)"), F.lit(0)), read)


def dates_in(plain: Column) -> Column:
    """The valid dates of an unaccented text, as structs (d, m, y), in its order; a day that only leap years have is valid without a year."""
    return F.transform(written_dates(plain), lambda x: F.struct(x["d"].alias("d"), x["m"].alias("m"), x["y"].alias("y")))


def written_dates(plain: Column) -> Column:
    """As ``dates_in``, with how each date is written (text)."""
    runs = F.filter(F.regexp_extract_all(plain, F.lit(DATE_RUN), F.lit(0)), lambda x: x.rlike(_LIKELY_RUN))
    return F.filter(F.flatten(F.transform(runs, run_dates)), valid_parts)


def valid_parts(p: Column) -> Column:
    """Whether a calendar has the day of a struct (d, m, y)."""
    last = F.last_day(F.make_date(F.coalesce(p["y"], F.lit(2024)), F.when(p["m"].between(1, 12), p["m"]), F.lit(1)))
    return F.coalesce(p["m"].between(1, 12) & p["d"].between(1, 31) & (p["d"] <= F.day(last)), F.lit(False))


def parse_when(text: Column, zone: str = "UTC") -> Column:
    """struct(at, day, all_day): ISO dates and times, else a text that is ``d. m. yyyy [od HH:MM]`` and nothing more; nulls if unreadable.

    A date alone is all-day; a time without an offset is in ``zone``; the written day is kept
    beside the instant, which doesn't depend on the session's zone.
    """
    iso = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
    local = r"(?i)^\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})(?:\s+(?:od\s+)?(\d{1,2}):(\d{2}))?\s*$"

    def fields(x: Column) -> Column:
        """Year, month, day, hour, minute, second and offset as they are written; each form is read only where it fits."""
        part = lambda p, k: F.nullif(F.regexp_extract(x, p, k), F.lit(""))
        names = ("year", "month", "day", "hour", "minute", "second", "offset")
        exact = F.struct(*[part(iso, k).alias(n) for k, n in enumerate(names, 1)])
        none = F.lit(None).cast("string")
        spoken = F.struct(*[c.alias(n) for c, n in zip((part(local, 3), part(local, 2), part(local, 1), part(local, 4), part(local, 5), none, none), names, strict=True)])
        return F.when(x.rlike(iso), exact).when(x.rlike(local), spoken)

    def made(f: Column) -> Column:
        whole = lambda n: F.coalesce(f[n].try_cast("int"), F.lit(0))
        offset = F.regexp_replace(F.regexp_replace(f["offset"], "^Z$", "+00:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
        # Offsets of more than 18 hours are none.
        zoned = F.when(F.abs(F.substring(offset, 1, 3).try_cast("int")) < 18, offset)
        named = F.when(f["offset"].isNull() | f["hour"].isNull(), F.lit(zone)).otherwise(zoned)
        named = F.when(f["year"] != "0000", named)
        written = F.when(named.isNotNull(), F.try_to_date(F.format_string("%s-%s-%s", f["year"], F.lpad(f["month"], 2, "0"), F.lpad(f["day"], 2, "0"))))
        at = F.when(named.isNotNull(), F.try_make_timestamp(f["year"].try_cast("int"), f["month"].try_cast("int"), f["day"].try_cast("int"), whole("hour"), whole("minute"), whole("second"), named))
        return let(F.struct(at.alias("at"), written.alias("day")), lambda x: F.struct(x["at"], F.when(x["at"].isNotNull(), x["day"]).alias("day"), F.when(x["at"].isNotNull(), f["hour"].isNull()).alias("all_day")))

    return let(text, lambda x: let(fields(x), made))
