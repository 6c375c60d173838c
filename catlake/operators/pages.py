"""Jobs over page sources: what a page is, and the items it announces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.lines import ONGOING, block_lines, first_range, organizer, parse_when_range
from ..functions.temporal import DATE_RUN, MONTHS, dates_in, run_dates, valid_parts, written_dates
from ..functions.text import clean_text, decode_entities, unaccent, unaccent_in_place

ITEM = "page_id long, position int, uid string, title string, start_at string, end_at string, venue string, url string, recurring boolean"
_ITEM_FIELDS = ["uid", "title", "start_at", "end_at", "venue", "url"]


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return clean_text(bare)


def date_mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, day, month, year): the distinct valid dates in a text; one without a year is dropped if the same day occurs with one."""
    found = texts.select(key, F.explode(F.array_distinct(dates_in(unaccent(F.col(text))))).alias("d")).select(key, F.col("d.d").alias("day"), F.col("d.m").alias("month"), F.col("d.y").alias("year"))
    dated = F.count("year").over(Window.partitionBy(key, "day", "month"))
    return found.withColumn("_n", dated).filter("year IS NOT NULL OR _n = 0").drop("_n")


def date_offsets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, day, month, year, start, end): every valid date in a text, repeats included, and which characters of it (from 0, end excluded) write it.

    ``key`` tells texts apart. A text is cut at its dates, and the lengths of what lies before a date are summed.
    """
    plain = unaccent_in_place(F.col(text))
    pieces = F.arrays_zip(F.split(plain, DATE_RUN, -1).alias("gap"), F.regexp_extract_all(plain, F.lit(DATE_RUN), F.lit(0)).alias("run"))
    runs = texts.select(key, F.posexplode(pieces).alias("_at", "p")).select(key, "_at", "p.gap", "p.run").filter("run IS NOT NULL")
    through = F.sum(F.length("gap") + F.length("run")).over(Window.partitionBy(key).orderBy("_at")).cast("int")
    dates = runs.withColumn("end", through).withColumn("d", F.explode(F.filter(run_dates(F.col("run")), valid_parts)))
    first = F.col("end") - F.length("run") + F.col("d.start")
    return dates.select(key, F.col("d.d").alias("day"), F.col("d.m").alias("month"), F.col("d.y").alias("year"), first.alias("start"), (first + F.length("d.text")).alias("end"))


#: What marks events, listings and calendars in addresses, attributes, texts and types; fixed values.
EVENT_FOLDERS = ("akce", "akci", "udalost", "udalosti", "event", "events", "program", "koncert", "koncerty", "predstaveni", "vystava", "vystavy", "detail")
PAGER_NAMES = ("pagination", "pager", "paging", "strankovani", "page-numbers")
CALENDAR_NAMES = ("kalendar", "calendar", "datepicker", "fc-daygrid", "month-grid")
CALENDAR_LINKS = (r"\.ics\b", "/ical", "format=ical", "add-to-calendar", "pridat-do-kalendare")
CALENDAR_PHRASES = ("pridat do kalendare", "add to calendar", "exportovat do kalendare")
LIST_TYPES = ("ItemList", "CollectionPage", "BreadcrumbList")
WEEKDAYS = (
    "po", "ut", "st", "ct", "pa", "so", "ne", "pon", "ute", "str", "ctv", "pat", "sob", "ned", "pondeli", "utery", "streda", "ctvrtek", "patek", "sobota", "nedele",
)
#: Characters before and after a link in which a date counts as the link's, and the least text of a page that is judged; fixed values.
BEFORE, AFTER, LEAST_TEXT = 180, 60, 400

_EVENT_FOLDER = rf"(?i)/(?:{'|'.join(EVENT_FOLDERS)})/[^/?#]+"
#: What may stand before Event in the name of a type of events; fixed values.
EVENT_KINDS = (
    "music", "theater", "theatre", "dance", "comedy", "literary", "screening", "social", "sports", "business", "childrens", "course", "delivery", "education", "exhibition", "festival",
    "food", "hackathon", "sale", "visual",
)
_EVENT_TYPE = rf"(?i)(?:^|[^a-z])(?:(?:{'|'.join(EVENT_KINDS)})?event|festival)$"
_LINK, _AIM, _END = "\x01", "\x02", "\x03"


def _marked_text(html: Column) -> Column:
    """The visible text with a mark before each link, one after its target and one at its end."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"[\x01-\x03]", " ")
    bare = F.regexp_replace(bare, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)[^>]*>""", f"{_LINK}$1{_AIM}")
    bare = F.regexp_replace(bare, r"(?i)</a\s*>", _END)
    bare = F.regexp_replace(bare, r"(?i)</?(?:p|div|br|li|h[1-6]|tr|td|th|table|ul|ol|dl|dt|dd|article|section|header|footer|nav|time|blockquote)\b[^>]*>", "\n")
    return decode_entities(F.regexp_replace(bare, r"<[^>]*>", ""))


def _links(marked: Column) -> Column:
    """struct(href, near) of each link: its target, and its text with what stands near it."""
    bare = lambda x: F.regexp_replace(x, f"{_LINK}[^{_AIM}]*{_AIM}|{_END}", "")
    pieces = F.split(marked, _LINK)
    text = lambda p, i: F.when(i == 0, bare(p)).otherwise(F.substring_index(F.replace(p, F.lit(_END), F.lit("")), _AIM, -1))

    def near(x: Column) -> Column:
        # The tail of what stands before each piece, and the head of what follows it, are carried along from piece to piece.
        nothing = F.array(F.lit(""))
        tails = F.aggregate(x["texts"], nothing, lambda past, t: F.concat(past, F.array(F.substring(F.concat(F.element_at(past, -1), t), -BEFORE, BEFORE))))
        heads = F.reverse(F.aggregate(F.reverse(x["texts"]), nothing, lambda past, t: F.concat(past, F.array(F.substring(F.concat(t, F.element_at(past, -1)), 1, AFTER)))))

        def made(y: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                inner = F.substring_index(F.substring_index(p, _AIM, -1), _END, 1)
                rest = F.when(F.contains(p, F.lit(_END)), F.substring_index(p, _END, -1)).otherwise("")
                after = F.substring(F.concat(rest, F.get(y["heads"], i + 1)), 1, AFTER)
                return F.struct(F.substring_index(p, _AIM, 1).alias("href"), F.concat(F.get(y["tails"], i), inner, after).alias("near"))

            return F.slice(F.transform(x["pieces"], one), F.lit(2), F.greatest(F.size(x["pieces"]) - 1, F.lit(0)))

        return let(F.struct(tails.alias("tails"), heads.alias("heads")), made)

    return let(pieces, lambda p: let(F.struct(p.alias("pieces"), F.transform(p, text).alias("texts")), near))


def _absorbed(dates: Column) -> Column:
    """How many different dates: a day with its year takes in the same day without."""
    each = F.array_distinct(dates)
    return let(each, lambda d: F.size(F.filter(d, lambda x: x["y"].isNotNull() | ~F.exists(d, lambda o: o["y"].isNotNull() & (o["d"] == x["d"]) & (o["m"] == x["m"])))))


def _in_years(dates: Column) -> Column:
    return F.filter(dates, lambda x: x["y"].isNull() | x["y"].between(2000, 2100))


def _meta(name: str) -> Column:
    tag = F.regexp_extract("html", rf"""(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*["']{name}["'][^>]*>""", 0)
    return F.nullif(F.trim(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)""", 1)), F.lit(""))


def signals(pages: DataFrame) -> DataFrame:
    """Counts and marks of each page (page_id, url, html), by expressions over its source.

    JSON-LD is walked as a tree: an event is in a list if an object above it, at any distance, is one of the list types;
    the first event that isn't gives title, times and venue. A page without a source has no marks.
    """
    count = lambda p: F.coalesce(F.regexp_count("html", F.lit(p)), F.lit(0))
    found = lambda p: F.coalesce(F.col("html").rlike(p), F.lit(False))
    rows = pages.select("page_id", "url", "html", _marked_text(F.coalesce("html", F.lit(""))).alias("marked"))
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    # Unreadable blocks hold nothing.
    readable = F.filter(blocks, lambda x: F.try_parse_json(x).isNotNull())
    objects = F.filter(F.flatten(F.transform(readable, _json_objects)), lambda n: n["json"].startswith("{"))
    events = F.filter(objects, lambda n: F.exists(_types(n["json"]), lambda t: F.coalesce(F.trim(t).rlike(_EVENT_TYPE), F.lit(False))))
    cells = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda x: F.rtrim(F.regexp_replace(unaccent(x), r"<[^>]*>|\s+", ""), F.lit(".")))
    times = F.transform(F.regexp_extract_all("html", F.lit(r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']\s*(\d{4}-\d{2}-\d{2})"""), F.lit(1)), lambda x: x)
    attribute = lambda names: rf"""(?i)<[^>]*\b(?:class|id|rel)\s*=\s*["'][^"']*({'|'.join(names)})"""
    text = F.regexp_replace(F.regexp_replace("marked", f"{_LINK}[^{_AIM}]*{_AIM}|{_END}", ""), r"[ \t]+", " ")
    rows = rows.select(
        "page_id", "url", "html",
        text.alias("text"),
        _links(F.col("marked")).alias("links_near"),
        F.coalesce(events, F.array().cast("array<struct<path:array<int>,json:string,listed:boolean>>")).alias("events"),
        let(cells, lambda c: F.struct(F.size(F.filter(c, lambda x: x.rlike(r"^\d{1,2}$"))).alias("numbers"), F.size(F.filter(c, lambda x: x.isin(*WEEKDAYS))).alias("weekdays"))).alias("cells"),
        times.alias("times"),
    )
    rows = rows.withColumn("plain", unaccent(F.col("text"))).withColumn("written", written_dates(F.col("plain")))
    parts = F.transform("written", lambda x: F.struct(x["d"].alias("d"), x["m"].alias("m"), x["y"].alias("y")))
    rows = rows.withColumns({"dates": _in_years(parts), "time_dates": _in_years(F.flatten(F.transform("times", dates_in)))})
    usable = F.filter("links_near", lambda x: ~x["href"].rlike(r"(?i)^(#|javascript:|mailto:|tel:)") & (x["href"] != ""))
    several = lambda x: F.size(F.array_distinct(F.transform(x, lambda y: y["href"])))
    slug = unaccent(F.regexp_extract("path", rf"(?i)/(?:{'|'.join(EVENT_FOLDERS)})/([^/?#]+)", 1))
    rows = rows.withColumns({"usable": usable, "path": F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)})
    own = F.from_json(
        F.get(F.filter("events", lambda n: ~n["listed"]), F.lit(0))["json"], "struct<name:string,startDate:string,endDate:string,location:string>"
    )
    rows = rows.withColumns({"own": own, "jsonld_events": F.size("events"), "jsonld_events_in_list": F.size(F.filter("events", lambda n: n["listed"]))})
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    location = F.col("own.location")
    venue = F.when(location.startswith("{"), F.from_json(location, "struct<name:string>")["name"]).when(~location.startswith("["), location)
    heading = clean_text(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1", 1), r"<[^>]*>", " "))
    head_title = clean_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return rows.select(
        "page_id",
        count(r"(?i)<a\s[^>]*href=").alias("links"),
        count(r"(?i)<h1\b").alias("h1"),
        count(r"(?i)<li\b").alias("list_items"),
        count(r"(?i)<p\b").alias("paragraphs"),
        "jsonld_events",
        "jsonld_events_in_list",
        count(r"(?i)itemtype\s*=\s*.https?://schema\.org/[A-Za-z]*Event\b").alias("microdata_events"),
        _absorbed(F.concat("dates", "time_dates")).alias("distinct_dates"),
        several(F.filter("usable", lambda x: F.size(_in_years(dates_in(unaccent(x["near"])))) > 0)).alias("dated_links"),
        several(F.filter("usable", lambda x: x["href"].rlike(_EVENT_FOLDER))).alias("event_links"),
        (found(attribute(rf"\b{n}\b" for n in PAGER_NAMES)) | found(r"""(?i)<[^>]*\brel\s*=\s*["']next["']""")).alias("pagination"),
        ((F.col("cells.weekdays") >= 5) | (found(attribute(CALENDAR_NAMES)) & (F.col("cells.numbers") >= 20))).alias("calendar_grid"),
        F.lower(_meta("og:type")).alias("og_type"),
        (F.exists("usable", lambda x: x["href"].rlike(f"(?i){'|'.join(CALENDAR_LINKS)}")) | F.col("plain").rlike("|".join(CALENDAR_PHRASES))).alias("calendar_link"),
        (F.coalesce(F.col("path").rlike(_EVENT_FOLDER), F.lit(False)) & ~slug.isin(*MONTHS) & ~slug.rlike(r"^\d{4}(-\d{1,2})?$")).alias("detail_url"),
        F.col("url").rlike(r"[?&]page=\d+|/page/\d+").alias("paginated"),
        F.col("url").rlike(r"/\d+/?([?#].*)?$").alias("numbered_url"),
        F.char_length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text_length"),
        F.coalesce(clean_text(F.col("own.name")), heading, _meta("og:title"), head_title).alias("title"),
        said(F.col("own.startDate")).alias("start_at"),
        said(F.col("own.endDate")).alias("end_at"),
        said(venue).alias("venue"),
        F.coalesce(said(F.col("own.startDate")), F.get("written", F.lit(0))["text"]).alias("date_text"),
    )


def classify(marks: DataFrame) -> DataFrame:
    """(page_id, kind, reasons): listing, event-detail or unknown, and the evidence.

    Strong evidence decides: of a detail, one JSON-LD event of its own or the page's type; of a listing, many events or a
    calendar. Strong evidence of both is a conflict, and unknown, as is a page with little text and no JSON-LD event. Else
    any sign of a listing makes one, then any sign of a detail; but a detail without a title or a date is unknown.
    """
    few = F.col("distinct_dates").between(1, 2)
    strong_listing = {
        "L1-many-jsonld-events": F.col("jsonld_events") >= 3,
        "L1-jsonld-list": F.col("jsonld_events_in_list") >= 2,
        "L4-calendar": F.col("calendar_grid"),
        "L5-many-microdata-events": F.col("microdata_events") >= 3,
    }
    weak_listing = {
        "L2-dated-links": (F.col("dated_links") >= 4) & (F.col("distinct_dates") >= 3),
        "L3-pagination": F.col("pagination") & (F.col("distinct_dates") >= 2),
        "L6-many-event-links": F.col("event_links") >= 8,
    }
    strong_detail = {
        "D1-one-jsonld-event": (F.col("jsonld_events") == 1) & (F.col("jsonld_events_in_list") == 0),
        "D2-page-type": F.col("og_type").isin("event", "article:event"),
    }
    weak_detail = {
        "D3-one-date-one-heading": few & (F.col("h1") == 1),
        "D4-calendar-link": F.col("calendar_link") & few,
        "D5-detail-url": F.col("detail_url") & (F.col("distinct_dates") > 0) & F.col("title").isNotNull(),
    }
    named = lambda rules: F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    rows = marks.withColumns({"ls": named(strong_listing), "lw": named(weak_listing), "ds": named(strong_detail), "dw": named(weak_detail)})
    some = lambda *names: F.size(F.concat(*names)) > 0
    whole = F.col("title").isNotNull() & F.col("date_text").isNotNull()
    kind = (
        F.when((F.col("text_length") < LEAST_TEXT) & (F.col("jsonld_events") == 0), "unknown")
        .when(some("ls") & some("ds"), "unknown")
        .when(some("ds"), F.when(whole, "event-detail").otherwise("unknown"))
        .when(some("ls", "lw"), "listing")
        .when(some("dw"), F.when(whole, "event-detail").otherwise("unknown"))
        .otherwise("unknown")
    )
    return rows.select("page_id", kind.alias("kind"), F.array_join(F.array_sort(F.concat("ls", "lw", "ds", "dw")), ",").alias("reasons"))


#: Types of events beside those whose name ends in Event; fixed values.
OTHER_EVENT_TYPES = ("CourseInstance", "EventSeries", "Festival", "Hackathon")


def _types(json: Column) -> Column:
    """The types of a JSON object: one or a list."""
    written = F.from_json(json, "struct<`@type`:string>")["@type"]
    return F.coalesce(F.when(F.ltrim(written).startswith("["), F.from_json(written, "array<string>")).otherwise(F.array(written)), F.array().cast("array<string>"))


def _json_objects(node: Column) -> Column:
    """The texts of a JSON value and of what it holds at any depth, in lists and in all fields but @type, each with its path and whether an object above it is a list of things (``listed``)."""
    made = lambda path, json, listed: F.struct(path.alias("path"), json.alias("json"), listed.alias("listed"))
    none = F.array().cast("array<string>")

    def held(json: Column) -> Column:
        fields = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: (k != "@type") & F.ltrim(v).rlike(r"^[\[{]"))
        opened = F.flatten(F.transform(F.map_values(fields), lambda v: F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))))
        return F.coalesce(F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.startswith("{"), opened), none)

    def below(nodes: Column) -> Column:
        def inner(n: Column) -> Column:
            lists = F.exists(_types(n["json"]), lambda t: F.lower(t).isin(*[x.lower() for x in LIST_TYPES]))
            return let(n["listed"] | F.coalesce(lists, F.lit(False)), lambda listed: F.transform(held(n["json"]), lambda c, i: made(F.concat(n["path"], F.array(i)), F.ltrim(c), listed)))

        return F.flatten(F.transform(nodes, inner))

    def deeper(found: Column, _: Column) -> Column:
        added = lambda new: F.struct(F.concat(found["all"], new).alias("all"), new.alias("last"))
        return F.when(F.size(found["last"]) == 0, found).otherwise(let(below(found["last"]), added))

    root = F.array(made(F.array().cast("array<int>"), F.trim(node), F.lit(False)))
    levels = F.sequence(F.lit(0), F.size(F.split(node, r"[\[{]")))  # no value is nested deeper than it has brackets
    return F.aggregate(levels, F.struct(root.alias("all"), root.alias("last")), deeper)["all"]


def jsonld_items(pages: DataFrame) -> DataFrame:
    """Event items of the JSON-LD blocks, wherever a block holds them (lists, @graph, ItemList, fields), in the order of the text;
    an unreadable block is an item of nulls."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))).alias("block", "json"))
    one = "struct<`@type`:string,`@id`:string,name:string,startDate:string,endDate:string,url:string,location:struct<name:string>>"
    kind = rf'(?:^|["/])(?:[A-Za-z]*Event|{"|".join(OTHER_EVENT_TYPES)})(?:"|$)'
    rows = blocks.select("page_id", "block", F.try_parse_json("json").isNull().alias("unparsed"), "json")
    nodes = F.when(F.col("unparsed"), F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("json"), F.lit(False).alias("listed")))).otherwise(_json_objects(F.col("json")))
    each = rows.select("page_id", "block", "unparsed", F.explode(nodes).alias("n")).filter("unparsed OR startswith(n.json, '{')")
    kept = each.withColumn("e", F.from_json("n.json", one)).filter(F.col("unparsed") | F.col("e")["@type"].rlike(kind))
    return kept.select(
        "page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("block", "n.path")) - 1).alias("position"), F.col("e")["@id"].alias("uid"), clean_text(F.col("e")["name"]).alias("title"),
        F.col("e")["startDate"].alias("start_at"), F.col("e")["endDate"].alias("end_at"), F.col("e")["location"]["name"].alias("venue"), F.col("e")["url"].alias("url"), F.lit(False).alias("recurring"),
    )


class _Microdata(HTMLParser):
    """Collects itemprop values of each event scope."""

    NAMES = {"name": "title", "startDate": "start_at", "endDate": "end_at", "location": "venue", "url": "url", "identifier": "uid"}

    def __init__(self) -> None:
        super().__init__()
        self.items: list[dict] = []
        self.into: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if "itemscope" in a and "event" in (a.get("itemtype") or "").lower():
            self.items.append({})
        prop = self.NAMES.get(a.get("itemprop") or "")
        if prop and self.items:
            value = a.get("content") or a.get("datetime") or (a.get("href") if tag == "a" else None)
            self.into = None if value else prop
            if value:
                self.items[-1].setdefault(prop, value)

    def handle_data(self, data):
        if self.into and data.strip():
            self.items[-1].setdefault(self.into, data.strip())
            self.into = None


def microdata(html: str) -> list[dict]:
    parser = _Microdata()
    parser.feed(html)
    return parser.items


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _selector(written: str) -> tuple[list[tuple[str | None, str | None, frozenset[str]]], str | None]:
    """``tag#id.class`` steps, each within the one before, and the attribute after an @."""
    path, _, attribute = written.partition("@")
    steps = []
    for step in path.split():
        tag, identity, classes = re.fullmatch(r"([\w*-]*)(#[\w-]+)?((?:\.[\w-]+)*)", step).groups()
        steps.append((None if tag in ("", "*") else tag.lower(), identity and identity[1:], frozenset(x for x in classes.split(".") if x)))
    return steps, attribute or None


class _Cards(HTMLParser):
    """Collects the fields of each element that the card's selector meets; a field belongs to the innermost card around it."""

    def __init__(self, form: dict[str, str]) -> None:
        super().__init__()
        self.card = _selector(form["card"])[0]
        self.fields = {k: _selector(v) for k, v in form.items() if k != "card"}
        self.stack: list[dict] = []
        self.items: list[dict] = []

    def _meets(self, steps, since: int) -> bool:
        """Whether the newest element meets the last step, and elements around it, from ``since`` on, those before, in order."""
        fits = lambda e, s: (s[0] in (None, e["tag"])) and s[1] in (None, e["id"]) and s[2] <= e["classes"]
        if not steps or not fits(self.stack[-1], steps[-1]):
            return False
        rest = list(steps[:-1])
        for e in reversed(self.stack[since:-1]):
            if rest and fits(e, rest[-1]):
                rest.pop()
        return not rest

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.stack.append({"tag": tag, "id": a.get("id"), "classes": frozenset((a.get("class") or "").split()), "item": None, "into": []})
        top = self.stack[-1]
        if self._meets(self.card, 0):
            top["item"] = {}
            self.items.append(top["item"])
        around = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k]["item"] is not None), None)
        if around is not None:
            item = self.stack[around]["item"]
            for name, (steps, attribute) in self.fields.items():
                if name not in item and self._meets(steps, around + 1) and top["item"] is None:
                    item[name] = a.get(attribute) if attribute else ""
                    if not attribute:
                        top["into"].append((item, name))
        if tag in _VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack):  # what was left open inside ends with it
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        for e in self.stack:
            for item, name in e["into"]:
                item[name] += data


#: Forms of cards by name: selectors of the card and, within it, of its fields. Sources name theirs; these are two common ones.
CARD_FORMS: dict[str, dict[str, str]] = {
    "card": {"card": "div.card", "title": "h3", "start_at": "time@datetime", "url": "a@href", "venue": "span.venue"},
    "row": {"card": "ul#programme li", "uid": "div.meta@data-id", "title": "a.name", "start_at": ".when .from", "end_at": ".when .to", "url": "a.name@href", "venue": ".where"},
}


def cards(html: str, form: dict[str, str] = CARD_FORMS["card"]) -> list[dict]:
    """Items of a page's cards in the order in which they open, cards within cards included; one without title or start has a reason."""
    parser = _Cards(form)
    parser.feed(html)
    parser.close()
    out = []
    for item in parser.items:
        made = {k: " ".join((v or "").split()) or None for k, v in item.items()}
        made["reason"] = "missing-title" if not made.get("title") else "missing-start" if not made.get("start_at") else None
        out.append(made)
    return out


def card_items(pages: DataFrame, forms: dict[str, dict[str, str]] = CARD_FORMS) -> DataFrame:
    """Items of pages (page_id, html, form), each by the selectors that its source's form names, with a reason for those that can't be used; pages of no known form give none."""

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, i, *[x.get(f) for f in _ITEM_FIELDS], False, x["reason"])
                for page, html, form in zip(batch["page_id"], batch["html"], batch["form"], strict=True)
                if form in forms
                for i, x in enumerate(cards(html or "", forms[form]))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "position", *_ITEM_FIELDS, "recurring", "reason"])

    return pages.select("page_id", "html", "form").mapInPandas(items, f"{ITEM}, reason string")


def calendar_feed(text: str) -> list[dict]:
    """Items of an iCalendar text: lines unfolded, unterminated components kept, recurrence flagged."""
    names = {"UID": "uid", "SUMMARY": "title", "DTSTART": "start_at", "DTEND": "end_at", "LOCATION": "venue", "URL": "url"}
    out: list[dict] = []
    inside = False
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        key, _, value = line.partition(":")
        key = key.split(";")[0].upper()
        if line == "BEGIN:VEVENT":
            out.append({})
            inside = True
        elif line == "END:VEVENT":
            inside = False
        elif inside and key in names:
            out[-1][names[key]] = value.replace("\\,", ",").replace("\\;", ";").replace("\\n", "\n").replace("\\\\", "\\")
        elif inside and key == "RRULE":
            out[-1]["recurring"] = True
    return out


def extract(pages: DataFrame, parse: Callable[[str], list[dict]]) -> DataFrame:
    """Items of each page by a small parser for one page, run on the executors page by page."""

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, i, *[x.get(f) for f in _ITEM_FIELDS], bool(x.get("recurring")))
                for page, html in zip(batch["page_id"], batch["html"], strict=True)
                for i, x in enumerate(parse(html or ""))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "position", *_ITEM_FIELDS, "recurring"])

    return pages.select("page_id", "html").mapInPandas(items, ITEM)


#: Extractors by the name a source gives as its adapter.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "jsonld": jsonld_items,
    "microdata": lambda pages: extract(pages, microdata),
    "cards": lambda pages: extract(pages, lambda html: [x for x in cards(html) if not x["reason"]]),
    "calendar": lambda pages: extract(pages, calendar_feed),
}


def run_extractors(pages: DataFrame) -> DataFrame:
    """Items of all pages, each by the extractor that its column ``adapter`` names; other adapters give none."""
    parts = [f(pages.filter(F.col("adapter") == name)).withColumn("adapter", F.lit(name)) for name, f in EXTRACTORS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Labels and ends of sections of a detail's text; fixed values.
SECTION = ("Pořadatelé", "Organizers")
SECTION_ENDS = (
    "Navrhované události", "Podrobnosti", "Transparentnost události", "Zobrazit víc", "Zajímá mě", "Sdílet", "Pozvat", "Koupit vstupenky", "Diskuse", "Diskuze",
    "Zúčastním se", "Hosté", "Další", "Informace", "Místo konání", "Suggested events", "Details", "See more", "Share", "Invite", "Tickets", "Discussion", "Guests", "Venue",
)
ADDRESS_LABELS = ("adresa:", "address:")
#: A postal code before a town, and the longest line that is an address or a name; lines of a section, and lines that may hold the date; fixed values.
POSTAL, LONGEST_ADDRESS, LONGEST_NAME, SECTION_LINES, DATE_LINES = r"\d{3}\s\d{2}\s+[^\d,]{2,}", 160, 80, 20, 60
_SUMMARY = r"(?<!\s)\s++(?:spolu s(?:e)?\s+\d+\s+dalšími|and\s+\d+\s+others)\s*$"


def listing_blocks(texts: DataFrame, key: str, text: str, as_of: str, prefer: str = "future", zone: str = "UTC") -> DataFrame:
    """(key, title, date_text, start_at, end_at, all_day, ongoing, total_dates, venue, municipality, organizers, reason) of text blocks.

    A block's first line says when (see ``functions/lines.py``) or that it is under way, which
    leaves the start open and may give the end; the second is the title. The lines after them
    are judged one by one: an organiser by its prefix, a place by the dot before it, and the
    first other line is the venue. A block whose first line has no accepted form has a reason
    and no times, and one of fewer than two lines nothing else.
    """
    def kinds(x: Column) -> Column:
        place = F.when(x.startswith("·"), F.trim(F.ltrim(x, F.lit("·"))))
        return let(organizer(x), lambda name: F.struct(F.when(name.isNotNull(), "organizer").when(place.isNotNull(), "place").otherwise("text").alias("kind"), F.coalesce(name, place).alias("value"), x.alias("line")))

    rows = texts.select(key, F.col(as_of).alias("as_of"), block_lines(F.col(text)).alias("l"))
    # What is used more than once is a column of its own, so that it is made once a row.
    rows = rows.withColumn("date_text", F.get("l", F.lit(0))).withColumn("plain", unaccent(F.col("date_text")))
    rows = rows.select(key, "as_of", "l", "date_text", "plain", F.regexp_extract("plain", rf"^{ONGOING}(.*)$", 1).alias("rest"), F.col("plain").rlike(rf"^{ONGOING}").alias("ongoing"))
    rest = F.regexp_replace(F.ltrim(F.col("rest"), F.lit(" .–—-")), r"^(?:do|az|until)\s+", "")
    rows = rows.select(
        key, "date_text", F.coalesce("ongoing", F.lit(False)).alias("ongoing"), F.get("l", F.lit(1)).alias("title"), (F.size("l") < 2).alias("short"),
        F.transform(F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))), kinds).alias("more"),
        parse_when_range(F.when(F.col("ongoing"), rest).otherwise(F.col("date_text")), F.col("as_of"), prefer, zone, plain=F.when(F.col("ongoing"), rest).otherwise(F.col("plain"))).alias("w"),
    )
    of = lambda kind: F.transform(F.filter("more", lambda x: x["kind"] == kind), lambda x: F.coalesce(x["value"], x["line"]))
    whole = lambda c: F.when(~F.col("short"), c)
    at = lambda c: whole(F.when(~F.col("ongoing"), c))
    return rows.select(
        key, whole(F.col("title")).alias("title"), "date_text",
        at(F.col("w.start_at")).alias("start_at"), whole(F.when(F.col("ongoing"), F.col("w.start_at")).otherwise(F.col("w.end_at"))).alias("end_at"), at(F.col("w.all_day")).alias("all_day"),
        "ongoing", whole(F.col("w.total_dates")).alias("total_dates"), whole(F.get(of("text"), F.lit(0))).alias("venue"), whole(F.nullif(F.try_element_at(of("place"), F.lit(-1)), F.lit(""))).alias("municipality"),
        of("organizer").alias("organizers"), F.when(F.col("short"), "short-block").when(~F.col("ongoing"), F.col("w.reason")).alias("reason"),
    )


def detail_fields(texts: DataFrame, key: str, text: str, as_of: str, prefer: str = "future", zone: str = "UTC") -> DataFrame:
    """(key, date_text, start_at, end_at, all_day, address, organizers) of the text of a detail.

    The date is the first accepted line among the first ``DATE_LINES``; the address the first
    line with a comma and a postal code, or what a label has behind it; organisers are the
    lines of their section up to the next section, else the names behind an organiser's
    prefix without "and n others", each once.
    """
    rows = texts.select(key, F.col(as_of).alias("as_of"), block_lines(F.col(text)).alias("l"))
    dated = first_range(F.filter(F.slice("l", 1, DATE_LINES), lambda x: x.rlike(r"\d")), F.col("as_of"), prefer, zone)
    label = lambda x: x.rlike(rf"(?i)^(?:{'|'.join(ADDRESS_LABELS)})")
    addressed = F.filter("l", lambda x: label(x) | (x.contains(",") & x.rlike(POSTAL) & (F.length(x) < LONGEST_ADDRESS)))
    # What is used more than once is a column of its own, so that it is made once a row.
    head = F.greatest(*[F.array_position("l", name) for name in SECTION]).cast("int")
    rows = rows.withColumn("head", head)
    rows = rows.withColumn("section", F.when(F.col("head") > 0, F.slice("l", F.col("head") + 1, F.lit(SECTION_LINES))))
    rows = rows.withColumn("ends", F.array_position(F.transform("section", lambda x: x.isin(*SECTION_ENDS)), True).cast("int"))
    head, section, ends = F.col("head"), F.col("section"), F.col("ends")
    rows = rows.withColumn("listed", F.filter(F.when(ends > 0, F.slice(section, F.lit(1), ends - 1)).otherwise(section), lambda x: F.length(x) < LONGEST_NAME))
    listed = F.col("listed")
    # A summary may stand before the section only, as what follows the section is of other sections.
    before = F.when(head > 0, F.slice("l", F.lit(1), head)).otherwise(F.col("l"))
    named = F.transform(F.filter(F.transform(before, organizer), lambda x: x.isNotNull()), lambda x: F.trim(F.regexp_replace(x, _SUMMARY, "")))
    chosen = F.when(F.size(listed) > 0, F.filter(listed, lambda x: ~x.rlike(_SUMMARY))).otherwise(named)
    rows = rows.select(
        key, dated.alias("d"), F.get(addressed, F.lit(0)).alias("a"), F.array_distinct(F.filter(chosen, lambda x: x != "")).alias("organizers")
    )
    address = F.nullif(F.trim(F.regexp_replace("a", rf"(?i)^(?:{'|'.join(ADDRESS_LABELS)})", "")), F.lit(""))
    return rows.select(key, F.col("d.line").alias("date_text"), F.col("d.w.start_at").alias("start_at"), F.col("d.w.end_at").alias("end_at"), F.col("d.w.all_day").alias("all_day"), address.alias("address"), "organizers")


def programmes(blocks: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """(key, kind, recurring, total_dates, times): a block with several dates by its own words, or with several links to times (key, time_id), is a programme."""
    known = times.groupBy(key).agg(F.count_distinct("time_id").alias("times"))
    rows = blocks.select(key, "total_dates").join(known, key, "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
    recurring = F.coalesce(F.col("total_dates") > 1, F.lit(False)) | (F.col("times") > 1)
    return rows.select(key, F.when(recurring, "programme").otherwise("single-event").alias("kind"), recurring.alias("recurring"), "total_dates", "times")


def inbox_outcomes(classified: DataFrame, pages: DataFrame) -> DataFrame:
    """What becomes of a submitted page: a candidate with a stable id, a proposed source, or a failure."""
    state = F.when(F.col("kind") == "event-detail", "candidate").when(F.col("kind") == "listing", "source-proposal").otherwise("failed")
    return classified.join(pages.select("page_id", "url"), "page_id").select("page_id", state.alias("state"), F.when(state == "candidate", F.concat(F.lit("inbox-"), F.substring(F.sha2("url", 256), 1, 24))).alias("candidate_id"))
