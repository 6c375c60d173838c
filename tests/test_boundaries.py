"""Boundaries of the rules on small literal tables."""

import datetime
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catlake.functions import price, temporal, text, urls
from catlake.operators import health, match, merge, normalize
from catlake.operators import pages as pages_
from catlake.operators import quality

D = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def brute_jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach, used, left = max(len(a), len(b)) // 2 - 1, set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            left.append(c)
    if not left:
        return 0.0
    n, wrong = len(left), sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) / 2
    score = (n / len(a) + n / len(b) + (n - wrong) / n) / 3
    same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
    return score + same * 0.1 * (1 - score)


def test_jaro_winkler_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 12))).strip()
    pairs = [(word(), word()) for _ in range(400)] + [("", ""), ("a", ""), ("martha", "marhta"), ("a", "b"), ("ab", "ba")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.similarity_of(F.col("a"), F.col("b")).alias("s")).collect()
    for a, b, s in rows:
        assert abs(s - brute_jaro_winkler(a, b)) < 1e-9, (a, b)


def test_price(spark):
    cases = {
        "Vstup zdarma": ("free", 0, None), "vstupné 150 Kč": ("paid", 150, None), "1 200 Kč": ("paid", 1200, None), "100 - 200 Kč": ("paid", None, None),
        "99,50 Kč": ("paid", None, None), "zdarma nebo 50 Kč": ("unknown", None, "conflicting-price"), "": ("unknown", None, None), "dohodou": ("unknown", None, None),
    }
    for raw, want in cases.items():
        got = one(spark, price.normalize_price(F.lit(raw)))
        assert (got["type"], got["amount"], got["reason"]) == want, raw


def test_urls(spark):
    cases = {
        "http://WWW.Example.org:80/a/?utm_source=x&b=2&a=1#top": "https://www.example.org/a?a=1&b=2", "https://example.org": "https://example.org/",
        "https://example.org/#!/x": "https://example.org/#!/x", "ftp://example.org/a": None, "https://exa mple.org/": None, "no url": None,
    }
    for raw, want in cases.items():
        assert one(spark, urls.canonical_url(F.lit(raw))) == want, raw


def test_dates(spark):
    when = lambda s: one(spark, temporal.parse_when(F.lit(s), "UTC"))
    assert (when("2024-05-01")["day"], when("2024-05-01")["all_day"]) == (D(2024, 5, 1), True)
    assert when("2024-05-01T10:00:00+02:00")["at"] == datetime.datetime(2024, 5, 1, 8)
    assert when("1. 5. 2024 od 19:30")["all_day"] is False
    assert when("31. 2. 2024")["day"] is None and when("soon")["day"] is None
    span = lambda s, d: one(spark, normalize.parse_when_range(F.lit(s), F.lit(d)))
    assert span("30. 12. - 2. 1.", D(2024, 12, 20))["first"] == D(2024, 12, 30)
    assert span("30. 12. - 2. 1.", D(2024, 12, 20))["last"] == D(2025, 1, 2)
    assert span("so 3. 5.", D(2024, 5, 4))["first"] == D(2024, 5, 3)
    assert span("3. 5.", D(2024, 6, 4))["first"] == D(2025, 5, 3)
    # A written range may be long; only one that would wrap over New Year mayn't.
    assert span("1. 1. 2024 - 30. 6. 2024", D(2024, 1, 1))["last"] == D(2024, 6, 30)
    assert span("15. 8. - 10. 8.", D(2024, 8, 2))["reason"] == "too-long"
    assert span("kdykoliv", D(2024, 1, 1))["reason"] == "no-date"
    assert one(spark, temporal.iso_week(F.lit(D(2024, 12, 30)))) == "2025-W01"


def history(spark, counts, hashes=None, oks=None, days=1):
    at = datetime.datetime(2024, 1, 1)
    n = len(counts)
    rows = [(1, i, at + datetime.timedelta(days=i * days), (oks or [True] * n)[i], counts[i], (hashes or range(n))[i], 1.0 if counts[i] else None) for i in range(n)]
    return spark.createDataFrame(rows, "source long, id long, fetched_at timestamp, ok boolean, items int, hash long, fill double")


def state(spark, runs, future=False):
    ahead = spark.createDataFrame([(1,)] if future else [], "source long")
    return health.source_health(runs, ["fill"], ahead).first()["state"]


def test_health_boundaries(spark):
    assert state(spark, history(spark, [40] * 10 + [0])) == "suspect"
    assert state(spark, history(spark, [40] * 10 + [10])) == "degraded"
    assert state(spark, history(spark, [40] * 10 + [20])) == "healthy"
    assert state(spark, history(spark, [2] * 10 + [0])) == "healthy"
    assert state(spark, history(spark, [3] * 10 + [0])) == "suspect"
    assert state(spark, history(spark, [5] * 5, oks=[True, True, False, False, False])) == "broken"
    assert state(spark, history(spark, [5] * 5, oks=[True, True, True, False, False])) == "healthy"
    assert state(spark, history(spark, [5] * 5, hashes=[7] * 5, days=10)) == "stale"
    assert state(spark, history(spark, [5] * 5, hashes=[7] * 5, days=10), future=True) == "healthy"
    assert state(spark, history(spark, [5] * 5, hashes=[7] * 5, days=2)) == "healthy"


def test_cancellations(spark):
    links = [(1, i, D(2024, 5, d), m) for i, d, m in ((1, 10, 0), (2, 5, 1), (3, 5, 2), (4, 20, 2))] + [(2, 5, D(2024, 5, 9), 0), (2, 6, D(2024, 5, 5), 3)]
    states = spark.createDataFrame([(1, "healthy"), (2, "broken")], "source long, state string")
    rows = health.derive_cancellations(spark.createDataFrame(links, "source long, item long, day date, missing long"), states, F.lit(D(2024, 5, 1))).collect()
    assert {r["item"]: r["reason"] for r in rows} == {2: "too-few-absences", 3: "cancelled", 4: "outside-window", 6: "source-unhealthy"}


def test_merge_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = merge.merge_by_key(old, new, ["k"], {"v": "new"})
    assert {r["k"]: r["outcome"] for r in once.collect()} == {1: "existing", 2: "updated", 3: "created"}
    again = merge.merge_by_key(once.drop("outcome"), new, ["k"], {"v": "new"})
    assert {r["outcome"] for r in again.collect()} == {"existing"}


def test_identity_conflict_names_the_field(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", None), (2, "b", None)], "id long, title string, venue string")
    assert [tuple(r) for r in match.identity_conflicts(rows, "id", ["title", "venue"]).collect()] == [(1, "venue")]


def test_offsets(spark):
    assert one(spark, quality.offset_valid(F.lit("2024-07-01T10:00:00+02:00"), "Europe/Prague")) is True
    assert one(spark, quality.offset_valid(F.lit("2024-12-01T10:00:00+02:00"), "Europe/Prague")) is False


def test_parsers():
    feed = "BEGIN:VEVENT\r\nSUMMARY:A\\, b\r\n c\r\nDTSTART;TZID=x:20240101\r\nRRULE:x\r\nBEGIN:VEVENT\r\nUID:2\r\n"
    assert pages_.calendar_feed(feed) == [{"title": "A, bc", "start_at": "20240101", "recurring": True}, {"uid": "2"}]
    assert pages_.cards("<div>none</div>") == [] and pages_.microdata("<b>x") == []


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_similarity_is_bounded(a, b):
    assert 0 <= brute_jaro_winkler(a, b) <= 1 + 1e-9
