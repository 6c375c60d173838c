"""A grammar of the line that says when something takes place.

A line is cut into signs (figures with or without a point, clocks, names of days and months,
words that join them), and a finite-state machine reads them. Only lines that it accepts have
dates; all others have a reason, as a date that merely occurs in a line may mean anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .temporal import MONTHS
from .text import unaccent

#: Names of days, of zones' suffixes and of the words of a line, folded; fixed values.
DAYS = ("po", "ut", "st", "ct", "pa", "so", "ne", "pondeli", "utery", "streda", "ctvrtek", "patek", "sobota", "nedele")
ZONES = r"cest|cet|(?:gmt|utc)[+-]\d+"
UNTIL = ("az", "do", "-", "–", "—")
AT = ("v", "ve", "od")
OTHERS = ("dalsich", "dalsimi", "dalsim", "dalsi")
#: Beginnings of lines that announce something under way, and of lines that name an organiser, folded; fixed values.
ONGOING = r"(?:prave probiha|probiha\s+prave|probiha|ongoing|happening now)\b"
ORGANIZED = r"(?:udalost vytvorena|udalost porada|event by|organizer:)"

#: What each word is.
_WORDS = {
    word: kind
    for kind, words in {"others": (*OTHERS, "more"), "and": ("a", "and"), "point": (".",), "comma": (",",), "at": AT, "until": UNTIL, "month": MONTHS, "day": DAYS}.items()
    for word in words
}
_SIGN = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d+:\d+|\d{{1,2}}\.(?!\d{{3}})|\d+|(?:{ZONES})\b|\p{{L}}+|\S"

#: The grammar: state -> kind of sign -> next state. d, m, y and t are the day, month, year and clock of the first date (1) and the second (2).
#: ``_LINE`` is the same as one pattern; the tests compare the two.
_MACHINE: dict[str, dict[str, str]] = {
    "start": {"day": "named1", "figure": "d1", "iso": "y1", "at": "start"},
    "named1": {"comma": "named1", "point": "named1", "figure": "d1", "iso": "y1"},
    "d1": {"figure": "m1", "month": "m1", "until": "until"},
    "until": {"day": "named2", "figure": "d2", "iso": "y2", "at": "at2", "clock": "t2"},
    "named2": {"comma": "named2", "point": "named2", "figure": "d2", "iso": "y2"},
    "d2": {"figure": "m2", "month": "m2"},
    "and": {"number": "n"},
    "n": {"others": "more"},
    "more": {"zone": "more"},
}
for _k, _next in ((1, {"until": "until"}), (2, {})):
    _after = {"at": f"at{_k}", "clock": f"t{_k}", "comma": f"comma{_k}", "and": "and"} | _next
    _MACHINE |= {
        f"m{_k}": {"year": f"y{_k}", "zone": f"m{_k}"} | _after,
        f"y{_k}": {"zone": f"y{_k}"} | _after,
        f"comma{_k}": {"at": f"at{_k}", "clock": f"t{_k}"},
        f"at{_k}": {"clock": f"t{_k}"},
        f"t{_k}": {"zone": f"t{_k}", "and": "and"} | _next,
    }
_ACCEPTED = ("m1", "y1", "t1", "m2", "y2", "t2", "more")
_FIELDS = ("d1", "m1", "y1", "t1", "d2", "m2", "y2", "t2")


def _any(kind: str) -> str:
    """The pattern of one sign of a kind of words."""
    words = [w for w, k in _WORDS.items() if k == kind]
    letters, marks = "|".join(w for w in words if w.isalpha()), "".join(rf"\{w}" for w in words if w in ".,-") + "".join(w for w in words if w in "–—")
    return f"(?:{'|'.join(x for x in (letters and rf'(?:{letters})(?!\p{{L}})', marks and f'[{marks}]') if x)})"


# Each matches where, and as far as, ``_SIGN`` cuts a sign of its kind.
_YEAR, _FIGURE, _CLOCK, _MONTH = r"\d{4})(?!\d|:\d|-\d{2}-\d{2})", r"\d{1,2})\.(?!\d{3})", r"\d{1,2}:\d{2})(?!\d)", rf"{_any('month')})"
_NUMBER = r"(?!\d{4}(?!\d))(?!\d{1,2}\.(?!\d{3}))(?<n>\d++)(?!:\d)"


def _line() -> str:
    """The accepted lines as a pattern; the groups of ISO dates are iy, im and id, and w is a month's name. Loops are possessive, as each sign has one reading."""
    gap = r"\s*+"
    day, at, comma, until, other = (_any(kind) + gap for kind in ("day", "at", "comma", "until", "others"))
    zones = rf"(?:(?:(?:{ZONES})\b|(?:cest|cet)(?!\p{{L}})){gap})*+"
    named = rf"(?:{day}(?:[.,]{gap})*+)?+"
    spoken = lambda k: rf"(?:(?<m{k}>{_FIGURE}|(?<w{k}>{_MONTH}){gap}{zones}(?:(?<y{k}>{_YEAR}{gap}{zones})?+"
    iso = lambda k: rf"(?<iy{k}>\d{{4}})-(?<im{k}>\d{{2}})-(?<id{k}>\d{{2}}){gap}{zones}"
    time = lambda k, name: rf"(?<{name}>{_CLOCK}{gap}{zones}"
    figure = lambda k: rf"(?<d{k}>{_FIGURE}{gap}"
    end = rf"(?:{named}(?:{figure(2)}{spoken(2)}|{iso(2)})(?:(?:{comma})?+(?:{at})?+{time(2, 't2')})?+|(?:{at})?+{time(2, 'u2')})"
    begin = rf"(?:{at})*+{named}(?:{figure(1)}(?:{spoken(1)}|(?={until}))|{iso(1)})(?:(?:{comma})?+(?:{at})?+{time(1, 't1')})?+"
    return rf"\A{gap}{begin}(?:{until}{end})?+(?:{_any('and')}{gap}{_NUMBER}{gap}{other}{zones})?+\z"


_LINE = _line()
#: Lines that have a sign of a date, wherever.
_SIGN_OF_DATE = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.(?!\d{{3}})|{_any('month')})"
_DATED = rf"\A(?:\s*+(?!{_SIGN_OF_DATE})(?>{_SIGN}))*+\s*+{_SIGN_OF_DATE}"
#: What stands for each field in what a line is replaced by.
_FOUND = {f"{f}{k}": "".join(f"${{{g}{k}}}" for g in groups) for k in (1, 2) for f, groups in {"d": ("d", "id"), "m": ("m", "w", "im"), "y": ("y", "iy"), "t": ("t", "u") if k == 2 else ("t",)}.items()}


def read_line(plain: Column) -> Column:
    """struct(accepted, d1, m1, y1, t1, d2, m2, y2, t2, more, dated) of an unaccented line; the figures of lines that aren't accepted are null. A clock is its minutes, -1 if there is no such time."""
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def number(x: Column) -> Column:
        # A cast that fails costs far more than the test.
        return F.when(x.rlike(r"^\d"), x.try_cast("int"))

    def clock(x: Column) -> Column:
        hours, minutes = (F.element_at(F.split(x, ":"), k).try_cast("int") for k in (1, -1))
        return F.when(x != "", F.when((hours < 24) & (minutes < 60), hours * 60 + minutes).otherwise(-1))

    def value(f: str, x: Column) -> Column:
        return clock(x) if f[0] == "t" else F.coalesce(number(x), F.try_element_at(months, x)) if f[0] == "m" else number(x)

    def fields(line: Column, found: Column) -> Column:
        # Without a line there are no parts, and every field is null.
        part = lambda k: F.get(found, F.lit(k))
        ok = found.isNotNull()
        return F.struct(
            ok.alias("accepted"), *[value(f, part(k)).alias(f) for k, f in enumerate(_FIELDS)], number(part(len(_FIELDS))).alias("more"),
            F.when(ok, True).otherwise(F.coalesce(line.rlike(_DATED), F.lit(False))).alias("dated"),
        )

    def read(line: Column) -> Column:
        found = F.split(F.regexp_replace(line, _LINE, "\t".join([*(_FOUND[f] for f in _FIELDS), "${n}"])), "\t")
        return let(F.when(line.rlike(_LINE), found), lambda x: fields(line, x))

    return let(plain, read)


def _made(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
    return F.when((year >= 0) & month.between(1, 12) & (day >= 1) & ((day <= 28) | (day <= days)), F.make_date(year, month, day))


def _near(as_of: Column, day: Column, month: Column, prefer: str) -> Column:
    """The year of a day without one: future, the nearest that isn't more than two days past; past, the nearest that isn't ahead; else this one."""
    this = F.year(as_of)
    made = lambda k: _made(this + k, month, day)
    fits = (lambda d: d >= F.date_sub(as_of, 2)) if prefer == "future" else (lambda d: d <= as_of)
    out = this
    for k in reversed((0, 1, -1) if prefer == "future" else (0, -1, 1)):
        out = F.when(fits(made(k)), this + k).otherwise(out)
    return out


def parse_when_range(text: Column, as_of: Column, prefer: str = "future", zone: str = "UTC", most_days: int = 60, plain: Column | None = None) -> Column:
    """struct(first, last, start_at, end_at, all_day, total_dates, reason) of a line.

    Forms: a date (``d. m. [yyyy]``, ``d. month [yyyy]`` or ISO) with a clock or without, or
    two with a word or dash between; the first may be a day alone (``15.-17. 8.``), the
    second a clock alone; a day's name may stand before a date, a zone's suffix behind, and
    ``and n more`` at the end, which gives the total. Missing years follow ``prefer`` and
    ``as_of``; the end's year anchors the start's, and a range over New Year that lasts more
    than ``most_days`` isn't one. A clock alone that is before the start is on the next day.
    A range whose end has no clock is all-day. Instants are in ``zone``, whatever the session's.
    ``plain`` is the unaccented line where it is known already.
    """
    at = lambda d, t: F.try_make_timestamp(F.year(d), F.month(d), F.day(d), F.floor(t / 60).cast("int"), (t % 60).cast("int"), F.lit(0), F.lit(zone))

    def dated(r: Column) -> Column:
        ends = r["d2"].isNotNull()
        m1 = F.coalesce(r["m1"], r["m2"])
        y2 = F.when(ends, F.coalesce(r["y2"], _near(as_of, r["d2"], r["m2"], prefer)))

        def anchored(y2: Column) -> Column:
            later = F.struct(m1.alias("m"), r["d1"].alias("d")) > F.struct(r["m2"].alias("m"), r["d2"].alias("d"))
            # A day alone has the end's month and year; there's no New Year between.
            y1 = F.coalesce(r["y1"], F.when(~ends, _near(as_of, r["d1"], m1, prefer)).otherwise(F.when(later & r["m1"].isNotNull(), y2 - 1).otherwise(y2)))
            wrapped = ends & r["y1"].isNull() & later
            return let(y1, lambda y: F.struct(_made(y, m1, r["d1"]).alias("first"), F.when(ends, _made(y2, r["m2"], r["d2"])).alias("last"), wrapped.alias("wrapped")))

        return let(y2, anchored)

    def judged(line: Column, r: Column, d: Column) -> Column:
        ends, clock = r["d2"].isNotNull(), r["t2"].isNotNull()
        start = at(d["first"], F.coalesce(r["t1"], F.lit(0)))
        same_day = at(d["first"], r["t2"])
        next_day = F.when(clock & ~ends & (same_day < start), F.date_add(d["first"], 1))
        last = F.when(ends, d["last"]).when(clock, F.coalesce(next_day, d["first"]))
        end = F.when(last.isNotNull(), at(last, F.coalesce(r["t2"], F.lit(0))))
        reason = (
            F.when(F.trim(line) == "", "empty-line")
            .when(~r["dated"], "no-date")
            .when(~r["accepted"], "unread-line")
            .when((r["t1"] < 0) | (r["t2"] < 0), "invalid-time")
            .when(d["first"].isNull() | (ends & d["last"].isNull()), "invalid-date")
            .when(d["wrapped"] & r["m1"].isNotNull() & (F.datediff(d["last"], d["first"]) > most_days), "too-long")
            .when(ends & (end < start), "end-before-start")
        )

        def told(why: Column) -> Column:
            ok = lambda c: F.when(why.isNull(), c)
            return F.struct(
                ok(d["first"]).alias("first"), ok(last).alias("last"), ok(start).alias("start_at"), ok(end).alias("end_at"),
                ok(r["t1"].isNull() | (ends & ~clock)).alias("all_day"), ok(F.try_add(r["more"], F.lit(1))).alias("total_dates"), why.alias("reason"),
            )

        return let(F.when(line.isNotNull(), reason).otherwise("empty-line"), told)

    return let(text, lambda line: let(read_line(unaccent(line) if plain is None else plain), lambda r: let(dated(r), lambda d: judged(line, r, d))))


#: How each line begins that may be accepted: with a sign that the machine takes at its start.
_BEGINNING = rf"^\s*(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.|(?:{'|'.join((*DAYS, *AT))})(?!\p{{L}}))"


def first_range(lines: Column, as_of: Column, prefer: str = "future", zone: str = "UTC") -> Column:
    """struct(line, w) of the first accepted line, with what ``parse_when_range`` has for it; lines after it, and lines that begin otherwise than the accepted, aren't read."""
    read = lambda x: F.struct(x.alias("line"), parse_when_range(x, as_of, prefer, zone).alias("w"))
    kind = "struct<line:string,w:struct<first:date,last:date,start_at:timestamp,end_at:timestamp,all_day:boolean,total_dates:int,reason:string>>"
    likely = F.filter(lines, lambda x: unaccent(x).rlike(_BEGINNING))
    return F.aggregate(
        likely, F.lit(None).cast(kind), lambda found, x: F.when(found.isNotNull(), found).otherwise(let(read(x), lambda r: F.when(r["w"]["reason"].isNull(), r)))
    )


def block_lines(text: Column) -> Column:
    """The lines of a text without those that are blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def organizer(line: Column) -> Column:
    """The name in a line that says who organises something; null for other lines."""

    # Folding may change a line's length, so the prefix is cut off by its words.
    def named(mark: Column) -> Column:
        words = F.size(F.split(mark, r"\s+"))
        return F.when(mark != "", F.nullif(F.trim(F.element_at(F.split(F.trim(line), r"\s+", F.when(F.endswith(mark, F.lit(":")), words).otherwise(words) + 1), -1)), F.lit("")))

    return let(F.regexp_extract(unaccent(line), rf"^\s*({ORGANIZED})", 1), named)
