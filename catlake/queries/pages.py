"""Page jobs over the given pages, and over pages and feeds that Spark derives from the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import urls
from ..functions.temporal import parse_when as when_of
from ..operators import pages as g
from .registry import query

_DERIVED = "SELECT id AS page_id, CAST({position} AS INTEGER) AS position, {uid} AS uid, title, CAST(start_day AS VARCHAR) AS start_at, CAST(end_day AS VARCHAR) AS end_at, place AS venue, {url} AS url FROM pub"


def _records(spark, sf_dir, rest):
    """The published records whose id leaves ``rest``, or all where it is None."""
    rows = b.published(spark, sf_dir)
    return (rows if rest is None else rows.filter(F.col("id") % 3 == rest)).withColumns({"start": F.col("start_day").cast("string"), "end": F.col("end_day").cast("string")})


def _jsonld(spark, sf_dir, rest=0):
    item = F.struct(F.lit("MusicEvent").alias("@type"), F.concat(F.lit("e"), "id").alias("@id"), F.col("title").alias("name"), F.col("start").alias("startDate"), F.col("end").alias("endDate"), F.struct(F.col("place").alias("name")).alias("location"))
    return _records(spark, sf_dir, rest).select(F.col("id").alias("page_id"), F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), F.to_json(item), F.lit("]}</script></html>")).alias("html"))


def _microdata(spark, sf_dir, rest=1):
    prop = lambda name, value: F.coalesce(F.concat(F.lit(f'<meta itemprop="{name}" content="'), value, F.lit('">')), F.lit(""))
    return _records(spark, sf_dir, rest).select(F.col("id").alias("page_id"), F.concat(
        F.lit('<div itemscope itemtype="https://schema.org/Event"><h2 itemprop="name">'), "title", F.lit("</h2>"), prop("startDate", F.col("start")), prop("endDate", F.col("end")), prop("location", F.col("place")), F.lit("</div>"),
    ).alias("html"))


def _cards(spark, sf_dir, rest=2):
    return _records(spark, sf_dir, rest).select(F.col("id").alias("page_id"), F.concat(
        F.lit('<ul><div class="card"><h3>'), "title", F.lit('</h3><time datetime="'), "start", F.lit('">x</time><span class="venue">'), "place", F.lit('</span><a href="/e/'), F.col("id").cast("string"), F.lit('">more</a></div></ul>'),
    ).alias("html"))


def _feed(spark, sf_dir, rest=0):
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}:"), value, F.lit("\r\n")), F.lit(""))
    return _records(spark, sf_dir, rest).select(F.col("id").alias("page_id"), F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"), line("UID", F.concat(F.lit("e"), "id")), line("SUMMARY", F.col("title")), line("DTSTART", F.col("start")), line("DTEND", F.col("end")), line("LOCATION", F.concat(F.substring("place", 1, 3), F.lit("\r\n "), F.substring("place", 4, 99))),
        F.when(F.col("id") % 2 == 0, F.lit("RRULE:FREQ=WEEKLY\r\n")).otherwise(""), F.lit("END:VEVENT\r\n"),
    ).alias("html"))


_ITEM_COLUMNS = ["page_id", "position", "uid", "title", "start_at", "end_at", "venue", "url"]


_JSONLD = _DERIVED.format(position=0, uid="'e' || id", url="CAST(NULL AS VARCHAR)")


@query(_JSONLD, "pub")
def jsonld_items(spark, sf_dir):
    return g.jsonld_items(_jsonld(spark, sf_dir, None)).select(*_ITEM_COLUMNS)



_MICRODATA = _DERIVED.format(position=0, uid="CAST(NULL AS VARCHAR)", url="CAST(NULL AS VARCHAR)")


@query(_MICRODATA, "pub")
def microdata_items(spark, sf_dir):
    return g.extract(_microdata(spark, sf_dir, None), g.microdata).select(*_ITEM_COLUMNS)



_CARD_COLUMNS = "page_id, position, uid, title, start_at, end_at, venue, url, reason"


@query(f"""SELECT {_CARD_COLUMNS} FROM (
      SELECT id AS page_id, 0 AS position, NULL AS uid, title, CAST(start_day AS VARCHAR) AS start_at, NULL AS end_at, place AS venue, '/e/' || id AS url, NULL AS reason FROM pub WHERE id % 2 = 0
      UNION ALL SELECT id, 0, 'r' || id, title, CASE WHEN id % 5 <> 0 THEN CAST(start_day AS VARCHAR) END, CAST(end_day AS VARCHAR), place, '/r/' || id, CASE WHEN id % 5 = 0 THEN 'missing-start' END FROM pub WHERE id % 2 = 1
      UNION ALL SELECT id, 1, 'n' || id, region, CAST(start_day AS VARCHAR), NULL, NULL, '/n/' || id, NULL FROM pub WHERE id % 2 = 1)""", "pub")
def card_items(spark, sf_dir):
    """Two forms of cards in one table: plain ones, and rows of a list that hold another row."""
    rows, key = b.published(spark, sf_dir), F.col("id").cast("string")
    text = lambda tag, value: F.coalesce(F.concat(F.lit(f'<span class="{tag}">'), value.cast("string"), F.lit("</span>")), F.lit(""))
    plain = F.concat(
        F.lit('<h3>Menu</h3><ul><div class="big card"><h3>'), "title", F.lit(' <b></b></h3><time datetime="'), F.col("start_day").cast("string"), F.lit('">x</time><span class="venue">'), "place",
        F.lit('</span><a href="/e/'), key, F.lit('">more<br></a><img src="x"></div></ul><h3>Foot</h3>'),
    )
    row = lambda k, name, more: F.concat(F.lit(f'<li><div class="meta" data-id="{k}'), key, F.lit(f'"><a class="name" href="/{k}/'), key, F.lit('">'), name, F.lit("</a></div>"), more, F.lit("</li>"))
    when = lambda *x: F.concat(F.lit('<p class="when">'), *x, F.lit("</p>"))
    inner = row("n", F.col("region"), when(text("from", F.col("start_day"))))
    outer = row("r", F.col("title"), F.concat(when(F.when(F.col("id") % 5 != 0, text("from", F.col("start_day"))).otherwise(""), text("to", F.col("end_day"))), text("where", F.col("place")), F.lit("<ul>"), inner, F.lit("</ul>")))
    listed = F.concat(F.lit('<li>none of it</li><ul id="programme">'), outer, F.lit("</ul>"))
    even = F.col("id") % 2 == 0
    pages = rows.select(F.col("id").alias("page_id"), F.when(even, plain).otherwise(listed).alias("html"), F.when(even, "card").otherwise("row").alias("form"))
    return g.card_items(pages).select(*_CARD_COLUMNS.split(", "))


_FEED = _DERIVED.format(position=0, uid="'e' || id", url="CAST(NULL AS VARCHAR)").replace(" AS url FROM", " AS url, id % 2 = 0 AS recurring FROM")


@query(_FEED, "pub")
def calendar_feed_items(spark, sf_dir):
    return g.extract(_feed(spark, sf_dir, None), g.calendar_feed).select(*_ITEM_COLUMNS, "recurring")



@query("SELECT CASE id % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'microdata' ELSE 'cards' END AS adapter, count(*) AS n FROM pub GROUP BY 1 UNION ALL SELECT 'calendar', count(*) FROM pub WHERE id % 3 = 0", "pub")
def extractor_registry(spark, sf_dir):
    parts = [(_jsonld, "jsonld"), (_microdata, "microdata"), (_cards, "cards"), (_feed, "calendar")]
    pages = [f(spark, sf_dir).withColumn("adapter", F.lit(name)) for f, name in parts]
    every = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    return g.run_extractors(every).groupBy("adapter").agg(F.count("*").alias("n"))


_ALL = lambda p: f"CAST(len(regexp_extract_all(html, '{p}')) AS INTEGER)"
_MARKS = f"""(SELECT page_id, {_ALL('<a [^>]*href=')} AS links, {_ALL('<h1')} AS h1, {_ALL('<li>')} AS list_items, {_ALL('<p[ >]')} AS paragraphs,
      regexp_matches(url, '[?&]page=[0-9]+|/page/[0-9]+') AS paginated, regexp_matches(url, '/[0-9]+/?([?#].*)?$') AS numbered_url FROM pages)"""


@query(f"SELECT * FROM {_MARKS}")
def page_signals(spark, sf_dir):
    return g.signals(b.table(spark, sf_dir, "pages")).select("page_id", "links", "h1", "list_items", "paragraphs", "paginated", "numbered_url")


def _signal_pages(spark, sf_dir):
    """A page of each published record in one of three forms, which between them have every signal."""
    key, day = F.col("id").cast("string"), F.col("start_day").cast("string")
    event = lambda name, more="": F.concat(F.lit('{"@type":["Thing","MusicEvent"],"name":"'), name, F.lit('","startDate":"'), day, F.lit(f'"{more}}}'))
    tree = F.concat(
        F.lit('<title>head</title><script type="application/ld+json">{"@context":{"@type":"x"},"@graph":[{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":'), event(F.lit("in list")),
        F.lit("},"), event(F.lit("also")), F.lit("]},"), F.lit('{"@type":"Place","hosts":['), event(F.col("title"), ',"endDate":"2030-01-01","location":{"@type":"Place","name":"Hall"}'),
        F.lit(']}]}</script><script type="application/ld+json">{"@type":"Event",</script>'),
    )
    marked = F.concat(
        F.lit('<meta property="og:type" content=" Event "><meta property="og:title" content="og"><div itemscope itemtype="https://schema.org/Event"></div><div itemscope itemtype="http://schema.org/DanceEvent"></div><time datetime="'),
        F.date_add("start_day", 9000).cast("string"), F.lit('T10:00"></time><a href="?p=2" rel="next">2</a><table class="calendar">'), F.lit("".join(f"<td>{k}.</td>" for k in range(1, 21))), F.lit("</table>"),
    )
    linked = F.concat(
        F.lit("<h1>The "), "title", F.lit('</h1><p>1. 5.</p><p>1. 5. 2024</p><ul><li><a href="/akce/a">a</a><li><a href="/akce/a">again</a></ul><p>'), F.lit("y" * 200), F.lit('</p><a href="/x.ics">c</a><a href="#top">t</a><p>'),
        F.lit("z" * 200), F.lit('</p><a href="/far">far</a>'),
    )
    html = F.when(F.col("id") % 3 == 0, tree).when(F.col("id") % 3 == 1, marked).otherwise(linked)
    return b.published(spark, sf_dir).select(F.col("id").alias("page_id"), F.concat(F.lit("https://example.org/akce/x-"), key, F.when(F.col("id") % 2 == 0, "?page=2").otherwise("")).alias("url"), html.alias("html"), "start_day")


_BY = "CASE id % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
_EXPECTED = {
    "links": (0, 1, 5), "h1": (0, 0, 1), "list_items": (0, 0, 2), "paragraphs": (0, 0, 4), "jsonld_events": (3, 0, 0), "jsonld_events_in_list": (2, 0, 0), "microdata_events": (0, 2, 0), "distinct_dates": (0, 1, 1),
    "dated_links": (0, 0, 1), "event_links": (0, 0, 1), "pagination": ("false", "true", "false"), "calendar_grid": ("false", "true", "false"), "og_type": ("NULL", "'event'", "NULL"), "calendar_link": ("false", "false", "true"),
    "detail_url": ("CAST(id % 2 = 0 OR true AS BOOLEAN)",) * 3, "paginated": ("id % 2 = 0",) * 3, "numbered_url": ("false",) * 3, "title": ("title", "'og'", "'The ' || title"), "start_at": ("CAST(start_day AS VARCHAR)", "NULL", "NULL"),
    "end_at": ("'2030-01-01'", "NULL", "NULL"), "venue": ("'Hall'", "NULL", "NULL"), "date_text": ("CAST(start_day AS VARCHAR)", "NULL", "'1. 5.'"),
}


@query(f"SELECT id AS page_id, {', '.join(f'{_BY.format(*x)} AS {name}' for name, x in _EXPECTED.items())} FROM pub", "pub")
def page_signals_all(spark, sf_dir):
    """Every signal but the length of the text, on pages made for them."""
    return g.signals(_signal_pages(spark, sf_dir)).select("page_id", *_EXPECTED)


_LONG = "Lorem ipsum dolor sit amet consectetur. " * 12


def _shown(spark, sf_dir):
    """A page of each published record, in one of ten forms by its id."""
    rows = b.published(spark, sf_dir).withColumn("start_day", F.add_months("start_day", 120)).withColumn("day", F.date_format("start_day", "d. M. y"))
    event = F.concat(F.lit('{"@type":"MusicEvent","name":"'), "title", F.lit('","startDate":"'), F.col("start_day").cast("string"), F.lit('"}'))
    block = lambda *x: F.concat(F.lit('<script type="application/ld+json">'), *x, F.lit("</script>"))
    long, heading = F.lit(f"<p>{_LONG}</p>"), F.concat(F.lit("<h1>"), "title", F.lit("</h1>"))
    link = lambda k, folder: F.concat(F.lit(f'<li><a href="/{folder}/{k}">x{k}</a> '), F.date_format(F.date_add("start_day", k), "d. M. y"), F.lit(f"</li>{'<p>' + 'y' * 200 + '</p>'}"))
    days = "".join(f"<td>{d}</td>" for d in ("po", "ut", "st", "ct", "pa"))
    forms = [
        block(event),
        F.concat(block(event, F.lit(""),), block(event), block(event), long),
        F.concat(long, heading, F.lit("<p>"), "day", F.lit("</p>")),
        F.concat(long, *[link(k, "x") for k in range(4)]),
        F.concat(F.lit(f"<table><tr>{days}</tr></table>"), block(event), long),
        F.concat(long, F.lit('<meta property="og:type" content="event">'), heading),
        F.concat(long, *[F.lit(f'<a href="/akce/{k}">e</a>') for k in range(8)]),
        F.concat(F.lit("<p>short "), "day", F.lit("</p>"), heading),
        F.concat(long, F.lit("<p>"), "day", F.lit('</p><a href="/e.ics">c</a><title>t</title>')),
        F.concat(long, heading),
    ]
    html = F.element_at(F.array(*forms), (F.col("id") % 10 + 1).cast("int"))
    return rows.select(F.col("id").alias("page_id"), F.concat(F.lit("https://example.org/p/"), F.col("id").cast("string")).alias("url"), html.alias("html"))


_KINDS = """SELECT id AS page_id, CASE id % 10 WHEN 0 THEN 'event-detail' WHEN 1 THEN 'listing' WHEN 2 THEN 'event-detail' WHEN 3 THEN 'listing' WHEN 6 THEN 'listing' WHEN 8 THEN 'event-detail' ELSE 'unknown' END AS kind,
      CASE id % 10 WHEN 0 THEN 'D1-one-jsonld-event' WHEN 1 THEN 'L1-many-jsonld-events' WHEN 2 THEN 'D3-one-date-one-heading' WHEN 3 THEN 'L2-dated-links' WHEN 4 THEN 'D1-one-jsonld-event,L4-calendar' WHEN 5 THEN 'D2-page-type' WHEN 6 THEN 'L6-many-event-links'
        WHEN 7 THEN 'D3-one-date-one-heading' WHEN 8 THEN 'D4-calendar-link' ELSE '' END AS reasons FROM pub"""


@query(_KINDS, "pub")
def page_classify(spark, sf_dir):
    return g.classify(g.signals(_shown(spark, sf_dir)))


@query()
def page_classify_given(spark, sf_dir):
    """The given pages, which hold few dates and no events."""
    return g.classify(g.signals(b.table(spark, sf_dir, "pages")))


@query(f"""SELECT page_id, CASE kind WHEN 'event-detail' THEN 'candidate' WHEN 'listing' THEN 'source-proposal' ELSE 'failed' END AS state,
      CASE kind WHEN 'event-detail' THEN 'inbox-' || substr(sha256('https://example.org/p/' || page_id), 1, 24) END AS candidate_id FROM ({_KINDS})""", "pub")
def inbox_outcomes(spark, sf_dir):
    pages = _shown(spark, sf_dir)
    return g.inbox_outcomes(g.classify(g.signals(pages)), pages)


@query()
def inbox_outcomes_given(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages")
    return g.inbox_outcomes(g.classify(g.signals(pages)), pages)


@query("SELECT id, CAST(extract(day FROM start_day) AS INTEGER) AS day, CAST(extract(month FROM start_day) AS INTEGER) AS month, CAST(extract(year FROM start_day) AS INTEGER) AS year FROM pub UNION SELECT id, CAST(extract(day FROM end_day) AS INTEGER), CAST(extract(month FROM end_day) AS INTEGER), CAST(extract(year FROM end_day) AS INTEGER) FROM pub WHERE end_day IS NOT NULL", "pub")
def page_date_mentions(spark, sf_dir):
    text = F.concat(F.lit("Od "), F.date_format("start_day", "d. M. y"), F.lit(" ("), F.date_format("start_day", "d. M."), F.lit(") 45. 13. 1999 do "), F.coalesce(F.col("end_day").cast("string"), F.lit("?")))
    return g.date_mentions(b.published(spark, sf_dir).select("id", text.alias("text")), "id", "text")


_SPOKEN = "extract(day FROM start_day) || '. ' || extract(month FROM start_day) || '. ' || extract(year FROM start_day)"
_PARTS_OF = "CAST(extract(day FROM {0}) AS INTEGER) AS day, CAST(extract(month FROM {0}) AS INTEGER) AS month, CAST(extract(year FROM {0}) AS INTEGER) AS year"


@query(f"""SELECT id, {_PARTS_OF.format('start_day')}, CAST(length(title) + 6 AS INTEGER) AS start, CAST(length(title) + 6 + length({_SPOKEN}) AS INTEGER) AS "end" FROM pub UNION ALL
    SELECT id, {_PARTS_OF.format('start_day')}, CAST(length(title) + 9 + length({_SPOKEN}) AS INTEGER), CAST(length(title) + 9 + 2 * length({_SPOKEN}) AS INTEGER) FROM pub UNION ALL
    SELECT id, {_PARTS_OF.format('end_day')}, CAST(length(title) + 13 + 2 * length({_SPOKEN}) AS INTEGER), CAST(length(title) + 23 + 2 * length({_SPOKEN}) AS INTEGER) FROM pub WHERE end_day IS NOT NULL""", "pub")
def page_date_offsets(spark, sf_dir):
    spoken = F.date_format("start_day", "d. M. y")
    text = F.concat(F.lit("Říj "), "title", F.lit(": "), spoken, F.lit(" = "), spoken, F.lit(" až "), F.coalesce(F.col("end_day").cast("string"), F.lit("?")))
    return g.date_offsets(b.published(spark, sf_dir).select("id", text.alias("text")), "id", "text")


_MONTH_NAMES = ("ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince")


def _spoken(day, year=True):
    return F.date_format(day, "d. M. y" if year else "d. M.")


def _blocks(spark, sf_dir):
    """A text block of each published record, with its date in one of five forms."""
    k, last = F.col("id") % 5, F.coalesce("end_day", "start_day")
    named = F.concat_ws(" ", F.date_format("start_day", "d."), F.element_at(F.array(*map(F.lit, _MONTH_NAMES)), F.month("start_day")), F.date_format("start_day", "y"))
    when = (
        F.when(k == 0, F.concat(F.lit("Právě probíhá"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" do "), _spoken(last))).otherwise("")))
        .when(k == 1, F.concat(F.lit("Út, "), _spoken("start_day"), F.lit(" ve 9:00 CEST a "), (F.col("id") % 30).cast("string"), F.lit(" dalších")))
        .when(k == 2, F.concat(named, F.lit(" v 20:30 až 3:00")))
        .when(k == 3, F.concat(_spoken("start_day", False), F.lit(" – "), _spoken(last)))
        .otherwise(F.concat(F.lit("zrušeno "), _spoken("start_day"), F.lit(", nově "), _spoken(last)))
    )
    text = F.concat(
        F.lit("\n  "), when, F.lit(" \n\n"), "title", F.when(F.col("id") % 2 == 0, F.concat(F.lit("\n"), "region")).otherwise(""), F.lit("\n · "), "place", F.lit("\nUdálost vytvořena "), "title",
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("\nEvent by "), "region")).otherwise(""),
    )
    rows = b.published(spark, sf_dir).select("id", text.alias("text"), F.date_sub("start_day", 30).alias("as_of"))
    return g.listing_blocks(rows, "id", "text", "as_of")


_AT = "strftime(CAST({} AS TIMESTAMP), '%Y-%m-%d %H:%M')"


@query(f"""SELECT id, title, CASE id % 5 WHEN 1 THEN {_AT.format('start_day + INTERVAL 9 HOUR')} WHEN 2 THEN {_AT.format('start_day + INTERVAL 1230 MINUTE')} WHEN 3 THEN {_AT.format('start_day')} END AS start_at,
      CASE id % 5 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN {_AT.format('coalesce(end_day, start_day)')} END WHEN 2 THEN {_AT.format('start_day + INTERVAL 27 HOUR')} WHEN 3 THEN {_AT.format('coalesce(end_day, start_day)')} END AS end_at,
      CASE id % 5 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS all_day, id % 5 = 0 AS ongoing, CASE WHEN id % 5 = 1 THEN CAST(id % 30 + 1 AS INTEGER) END AS total_dates,
      CASE WHEN id % 2 = 0 THEN region END AS venue, place AS municipality, title || CASE WHEN id % 3 = 0 THEN ',' || region ELSE '' END AS organizers, CASE WHEN id % 5 = 4 THEN 'unread-line' END AS reason FROM pub""", "pub")
def listing_block_items(spark, sf_dir):
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return _blocks(spark, sf_dir).select("id", "title", minute("start_at"), minute("end_at"), "all_day", "ongoing", "total_dates", "venue", "municipality", F.array_join("organizers", ",").alias("organizers"), "reason")


@query(f"""SELECT id, 'So, ' || {_SPOKEN} || ' od 18:15' AS date_text, {_AT.format('start_day + INTERVAL 1095 MINUTE')} AS start_at,
      CASE WHEN id % 2 = 0 THEN 'Ulice 1, 530 02 ' || place ELSE place END AS address, CASE WHEN id % 3 = 0 THEN title || ',' || region ELSE title END AS organizers FROM pub""", "pub")
def detail_block_fields(spark, sf_dir):
    even, third = F.col("id") % 2 == 0, F.col("id") % 3 == 0
    text = F.concat(
        F.lit("30 lidí\nzrušeno 1. 5. 2024, nově 3. 5. 2024\nSo, "), _spoken("start_day"), F.lit(" od 18:15\n"),
        F.when(even, F.concat(F.lit("Ulice 1, 530 02 "), "place")).otherwise(F.concat(F.lit("Address: "), "place")),
        F.lit("\nUdálost pořádá "), "title", F.lit(" spolu s 3 dalšími"),
        F.when(third, F.concat(F.lit("\nPořadatelé\n"), "title", F.lit("\n"), "region", F.lit("\n"), "title", F.lit("\nPodrobnosti\nNikdo"))).otherwise(""),
    )
    rows = g.detail_fields(b.published(spark, sf_dir).select("id", text.alias("text"), F.date_sub("start_day", 30).alias("as_of")), "id", "text", "as_of")
    return rows.select("id", "date_text", F.date_format("start_at", "yyyy-MM-dd HH:mm").alias("start_at"), "address", F.array_join("organizers", ",").alias("organizers"))


@query("""SELECT id, CASE WHEN many OR coalesce(n, 0) > 1 THEN 'programme' ELSE 'single-event' END AS kind, many OR coalesce(n, 0) > 1 AS recurring, total_dates, coalesce(n, 0) AS times FROM
      (SELECT id, CASE WHEN id % 5 = 1 THEN CAST(id % 30 + 1 AS INTEGER) END AS total_dates, id % 5 = 1 AND id % 30 > 0 AS many FROM pub)
      LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY 1) ON id = l_orderkey""", "pub")
def programme_candidates(spark, sf_dir):
    times = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("time_id"))
    return g.programmes(_blocks(spark, sf_dir), times, "id")


@query("""SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')
      || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM (SELECT page_id, url, coalesce(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), '') AS kept FROM pages)""")
def canonical_url(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'https://' || host || '/x/' || page_id WHEN page_id % 4 = 2 THEN 'https://other.example/y' END AS url,
      CASE page_id % 4 WHEN 0 THEN 'missing-url' WHEN 3 THEN 'invalid-url' END AS reason FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages)""")
def resolve_item_url(spark, sf_dir):
    key = F.col("page_id")
    item = F.when(key % 4 == 1, F.concat(F.lit("/x/"), key.cast("string"))).when(key % 4 == 2, "http://OTHER.example:80/y/?utm_source=a#z").when(key % 4 == 3, "mailto:someone")
    rows = b.table(spark, sf_dir, "pages").select("page_id", urls.resolve_item_url(item, F.when(key % 4 != 0, F.col("url"))).alias("r"))
    return rows.select("page_id", "r.url", "r.reason")


@query("""SELECT url, count(*) AS n, string_agg(place, ',' ORDER BY place) AS places FROM (SELECT DISTINCT CASE WHEN url LIKE '%#%' THEN substr(url, 1, strpos(url, '#') - 1) ELSE url END AS url,
      CASE page_id % 3 WHEN 0 THEN 'pages' WHEN 1 THEN 'inbox' ELSE 'reports' END || '/' || page_id AS place FROM pages UNION ALL SELECT DISTINCT 'https://example.org/c/' || c_nationkey, 'customers/' || c_custkey FROM customer) GROUP BY url""")
def url_usage(spark, sf_dir):
    """Each whole address, without its fragment, and the places that use it."""
    kind = F.when(F.col("page_id") % 3 == 0, "pages").when(F.col("page_id") % 3 == 1, "inbox").otherwise("reports")
    pages = b.table(spark, sf_dir, "pages").select(F.substring_index("url", "#", 1).alias("url"), F.concat_ws("/", kind, "page_id").alias("place"))
    customers = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("https://example.org/c/"), "c_nationkey").alias("url"), F.concat(F.lit("customers/"), "c_custkey").alias("place"))
    uses = pages.unionByName(customers).distinct()
    return uses.groupBy("url").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("place")), ",").alias("places"))


@query("""SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE CAST(start_day AS VARCHAR) END AS day, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS all_day,
      CAST(CASE id % 4 WHEN 0 THEN epoch(start_day) WHEN 1 THEN epoch(start_day) + 59400 WHEN 2 THEN epoch(start_day) + 33900 END AS BIGINT) AS instant FROM pub""", "pub")
def parse_when(spark, sf_dir):
    k = F.col("id") % 4
    text = (
        F.when(k == 0, _spoken("start_day")).when(k == 1, F.concat(F.col("start_day").cast("string"), F.lit("T18:30:00+02:00")))
        .when(k == 2, F.concat(_spoken("start_day"), F.lit(" od 9:25"))).otherwise("soon")
    )
    rows = b.published(spark, sf_dir).select("id", when_of(text).alias("w"))
    return rows.select("id", F.col("w.day").cast("string").alias("day"), "w.all_day", F.unix_timestamp("w.at").alias("instant"))
