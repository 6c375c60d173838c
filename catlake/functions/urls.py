"""Canonical URLs, as column expressions."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Query parameters that only track visits, and the prefix of more; fixed values.
TRACKING_NAMES = (
    "fbclid", "gclid", "gbraid", "wbraid", "dclid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl",
    "ref_src", "ref_url", "vgo_ee", "oly_enc_id", "oly_anon_id",
)
TRACKING_PREFIX = "utm_"
#: A line separator may stand behind the fragment only.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?[\x{85}\x{2028}\x{2029}]?\z"

#: Characters that path and query can't hold; one by one, as Java looks single characters up and tries ranges in turn.
_ODD = rf"[^{ascii_letters}{digits}/%:@!$&'()*+,;=~._?\-]"


def canonical_url(url: Column) -> Column:
    """https, lower-case host, no default port, no tracking, sorted parameters, no fragment but ``#!``, no trailing slash.

    Odd characters of path and query are escaped once, escapes are in capitals and never decoded; a host that isn't
    ASCII is put into punycode where it can be. Null for anything that is no http or https URL with a host, or that holds white space.
    """
    bare = F.when(F.contains(url, F.lit("<")) | F.contains(url, F.lit(">")), F.regexp_replace(F.trim(url), "^<|>$", "")).otherwise(F.trim(url))
    return let(bare, _canonical)


def _encoded(text: Column) -> Column:
    """Characters that a URL can't hold as their UTF-8 bytes in hexadecimal; escapes that are there stay, in capitals."""
    bytes_of = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    odd = _ODD

    def each(t: Column) -> Column:
        cut = F.struct(F.split(t, odd, -1).alias("parts"), F.regexp_extract_all(t, F.lit(odd), F.lit(0)).alias("found"))
        return let(cut, lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(bytes_of(F.get(x["found"], i)), F.lit("")))), ""))

    def capitals(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "%"), lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))).otherwise(p)), "%")

    escaped = F.when(text.rlike(odd), let(text, each)).otherwise(text)
    return F.when(F.contains(text, F.lit("%")) | text.rlike(odd), let(escaped, capitals)).otherwise(text)


def _canonical(url: Column) -> Column:
    # The parts are taken by one match and joined by what a URL without white space can't hold.
    return let(F.when(~url.rlike(r"\s"), F.split(F.regexp_replace(url, _PARTS, "$1\n$2\n$3\n$4\n$5"), "\n", -1)), _joined)


def _joined(parts: Column) -> Column:
    scheme, authority, path, query, mark = (F.get(parts, F.lit(k)) for k in range(5))
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^[^@]*@", ""), r":(80|443)?$", "")
    bare = F.rtrim(path, F.lit("/"))
    path = F.when(bare == "", "/").otherwise(let(bare, _encoded))
    untracked = lambda name: ~name.isin(*TRACKING_NAMES) & ~name.startswith(TRACKING_PREFIX)
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: (p != "") & let(F.lower(F.substring_index(p, "=", 1)), untracked))
    ordered = lambda x: F.array_sort(F.transform(x, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), p.alias("pair"))))
    joined = let(pairs, lambda x: F.when(F.size(x) > 1, F.array_join(F.transform(ordered(x), lambda p: p["pair"]), "&")).otherwise(F.coalesce(F.get(x, F.lit(0)), F.lit(""))))
    asked = F.when(query == "", "").otherwise(let(joined, lambda q: F.when(q != "", F.concat(F.lit("?"), _encoded(q))).otherwise("")))
    mark = F.when(mark.startswith("#!"), mark).otherwise("")
    good = F.lower(scheme).isin("http", "https")
    ascii_host = let(host, lambda h: F.when(h.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h), h)).otherwise(h))
    return F.when(good, let(ascii_host, lambda h: F.when(h != "", F.concat(F.lit("https://"), h, path, asked, mark))))


def resolve_item_url(item: Column, base: Column) -> Column:
    """struct(url, reason): the item's URL joined to its source's, canonical, and why if it isn't the item's own."""
    return let(F.struct(F.nullif(F.trim(item), F.lit("")).alias("item"), base.alias("base")), _resolved)


def _resolved(x: Column) -> Column:
    item, base = x["item"], x["base"]
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z]+://[^?#]*/)", 1)
    beside = let(folder, lambda f: F.when(f.rlike("://.*[^/]/|://.+/$"), f).otherwise(F.concat(root, F.lit("/"))))
    joined = (
        F.when(item.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), item)
        .when(item.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), item))
        .when(item.startswith("/"), F.concat(root, item))
        .when(item.isNotNull(), F.concat(beside, item))
    )

    def judged(own: Column) -> Column:
        reason = F.when(item.isNull() & base.isNull(), "missing-url").when(item.isNull(), "missing-item-url").when(own.isNull(), "invalid-url")
        return F.struct(own.alias("url"), reason.alias("reason"))

    return let(canonical_url(F.when(item.isNull(), base).otherwise(joined)), judged)


def generic_url(url: Column) -> Column:
    """Whether a URL names a site only: no path and no query."""
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/?(#.*)?$")
