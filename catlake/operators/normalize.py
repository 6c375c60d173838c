"""Governed normalisation: unreadable values become null with a reason, never a guess."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.price import normalize_price
from ..functions.lines import parse_when_range  # noqa: F401  one of this module's jobs
from ..functions.temporal import parse_when
from ..functions.text import clean_text, fold
from ..functions.urls import resolve_item_url


def map_place(rows: DataFrame, key: str, item: str, source: str, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, place_id, method, reason): the item's place, else the source's, by canonical name or alias.

    ``places`` is (place_id, name), ``aliases`` (place_id, name); exactly one target id matches, several are ambiguous.
    """
    own = F.nullif(F.trim(F.col(item)), F.lit(""))
    asked = rows.select(key, own.isNotNull().alias("_own"), fold(F.coalesce(own, F.col(source)), "place").alias("_k"))
    found = asked.join(_targets(places, aliases), "_k", "left")
    return found.select(key, *[c.alias(n) for n, c in _placed().items()])


def _targets(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """(_k, _n, _place, _by): how many places each folded name may mean, and one of them."""
    names = places.select(fold(F.col("name"), "place").alias("_k"), "place_id", F.lit("canonical").alias("by")).unionByName(aliases.select(fold(F.col("name"), "place").alias("_k"), "place_id", F.lit("alias").alias("by")))
    return names.groupBy("_k").agg(F.count_distinct("place_id").alias("_n"), F.min("place_id").alias("_place"), F.max("by").alias("_by"))


def _placed() -> dict[str, Column]:
    hit = F.col("_n") == 1
    return {
        "place_id": F.when(hit, F.col("_place")),
        "method": F.when(hit & (F.col("_by") == "alias"), "alias").when(hit & F.col("_own"), "item-canonical").when(hit, "source-canonical"),
        "reason": F.when(F.col("_k").isNull(), "missing-place").when(F.col("_n").isNull(), "unknown-place").when(F.col("_n") > 1, "ambiguous-place"),
    }


def unambiguous_lookup(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id) of names that occur once, and of aliases (alias, name) whose name is one of them."""
    single = names.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("id")).filter("n = 1").select("name", "id")
    more = aliases.join(single, "name").select(F.col("alias").alias("name"), "id")
    return single.unionByName(more.join(single.select("name"), "name", "left_anti"))


def map_categories(rows: DataFrame, key: str, raw: str, dictionary: DataFrame) -> DataFrame:
    """(key, categories, rejected): canonical names in the order of their first mention, and the values that have none."""
    each = rows.select(key, F.posexplode_outer(raw).alias("pos", "value")).withColumn("norm_key", fold(F.col("value"), "category"))
    # Whether the dictionary is small enough to be sent to every task is left to its size.
    found = each.join(dictionary.select("norm_key", "category"), "norm_key", "left")
    ordered = lambda cond, c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", c)))), lambda x: x[c])), ",")
    return found.groupBy(key).agg(
        ordered(F.col("category").isNotNull(), "category").alias("categories"), ordered(F.col("category").isNull() & F.col("value").isNotNull(), "value").alias("rejected")
    )


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object as text with its keys in order, also inside struct, map and array columns, nulls written, and one form for each value.

    Two rows with equal values have one text, however their keys were ordered.
    """
    return _object([(k, fields[k]) for k in sorted(fields)])


def _text(value: Column) -> Column:
    quoted = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), c) for k, c in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_value(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON text of a column of this type."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        made = _object([(f.name, json_value(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)])
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_value(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), json_value(e["value"], kind.valueType).alias("value"))))
        made = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        made = value.cast("string")
    elif isinstance(kind, T.FractionalType):
        # Whole numbers have no point, so 1 and 1.0 are one value.
        whole = value.cast("double")
        made = F.when((F.abs(whole) < 1e15) & (whole == F.floor(whole)), F.floor(whole).cast("string")).when(F.isnan(whole) | (F.abs(whole) == float("inf")), null).otherwise(whole.cast("string"))
    else:
        made = _text(value.cast("string"))
    return F.when(value.isNull(), null).otherwise(made)


def canonical_row(rows: DataFrame, *names: str) -> Column:
    """The canonical JSON of columns of a table."""
    return canonical_json({n: json_value(F.col(n), rows.schema[n].dataType) for n in names or rows.columns})


def fingerprint(source: Column, uid: Column, url: Column, title: Column, start: Column, payload: Column) -> Column:
    """The source and 24 digits of the SHA-256 of the identifying fields' canonical JSON; of the payload's if all are empty."""
    named = {"source": source, "uid": uid, "url": url, "title": title, "start": start}
    empty = uid.isNull() & url.isNull() & title.isNull() & start.isNull()
    fields = canonical_json({k: json_value(c, T.StringType()) for k, c in named.items()})
    return F.concat(source, F.lit("-"), F.substring(F.sha2(F.when(empty, payload).otherwise(fields), 256), 1, 24))


def normalize_candidates(items: DataFrame, places: DataFrame, aliases: DataFrame, zone: str = "UTC") -> DataFrame:
    """Raw items (id, source, uid, title, when, url, base_url, price, place, source_place) as candidates.

    The reasons for quarantine are distinct and in a fixed order; the state is quarantined if there are any, else new.
    Raw values stay beside the normalised ones, with the digests of what was read (``provenance``, sorted, each once).
    Every row of ``items`` gives one row, whatever its id: the place is looked up by the row's own key.
    """
    own = F.nullif(F.trim(F.col("place")), F.lit(""))
    # Digests are made of the columns as they came, before any is added.
    rows = items.select(*[F.col(c).alias(f"_raw_{c}") for c in items.columns], F.struct(*items.columns).alias("_items"))
    payload = canonical_json({c: json_value(F.col(f"_raw_{c}"), items.schema[c].dataType) for c in items.columns})
    rows = rows.select("_items.*", payload.alias("_payload")).withColumns({
        "t": clean_text(F.col("title")), "w": parse_when(F.col("when"), zone), "u": resolve_item_url(F.col("url"), F.col("base_url")), "p": normalize_price(F.col("price")),
        "_own": own.isNotNull(), "_k": fold(F.coalesce(own, F.col("source_place")), "place"),
    }).join(_targets(places, aliases), "_k", "left").withColumns({f"_{n}": c for n, c in _placed().items()})
    reasons = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("t").isNull(), F.lit("missing-title")),
        F.when(F.col("w.day").isNull(), F.when(F.col("when").isNull(), F.lit("missing-start")).otherwise(F.lit("unreadable-start"))),
        F.col("u.reason"), F.col("p.reason"), F.col("_reason"),
    )))
    digests = F.array_sort(F.array_distinct(F.transform(F.array_compact(F.array("_payload", "url", "base_url")), lambda x: F.sha2(x, 256))))
    return rows.select(
        fingerprint(F.col("source"), F.col("uid"), F.col("u.url"), F.col("t"), F.col("w.day").cast("string"), F.col("_payload")).alias("candidate_id"),
        "id", F.col("t").alias("title"), F.col("title").alias("raw_title"), F.col("w.day").alias("start_day"), F.col("w.at").alias("start_at"), "w.all_day", "u.url", F.col("p.type").alias("price_type"), F.col("p.amount").alias("amount"),
        F.col("_place_id").alias("place_id"), F.col("_method").alias("method"), digests.alias("provenance"), reasons.alias("_reasons"),
    ).withColumns({"reasons": F.array_join("_reasons", ","), "state": F.when(F.size("_reasons") > 0, "quarantined").otherwise("new")}).drop("_reasons")
