"""Data-quality rules compiled from schema documents.

A schema document (the usual JSON form: type, required, properties, items, enum, const,
pattern, minLength, minimum, maximum, minItems, uniqueItems, anyOf, $ref) becomes one column
expression over a record's struct, which yields a fault for each rule that is broken, at any
depth, with the path of the value: ``price.type``, ``categories[2]``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FAULTS = "array<struct<path:string,rule:string>>"
_NUMBERS = (T.IntegralType, T.FractionalType)


def _resolved(schema: Mapping, root: Mapping) -> tuple[Mapping, bool]:
    """A schema without references, and whether it allows null; of alternatives, the one that isn't null."""
    allows = False
    while "$ref" in schema or "anyOf" in schema:
        if "$ref" in schema:
            target: Mapping = root
            for part in schema["$ref"].removeprefix("#/").split("/"):
                target = target[part]
            schema = target
            continue
        rest = [x for x in schema["anyOf"] if x != {"type": "null"}]
        if len(rest) != 1:
            raise ValueError("alternatives other than null aren't known")
        allows, schema = allows or len(rest) < len(schema["anyOf"]), rest[0]
    kinds = schema.get("type")
    if isinstance(kinds, list):
        rest = [k for k in kinds if k != "null"]
        if len(rest) != 1:
            raise ValueError("several types aren't known")
        allows, schema = allows or "null" in kinds, {**schema, "type": rest[0]}
    return schema, allows or schema.get("type") == "null" or None in schema.get("enum", ())


def _of_type(value: Column, kind: T.DataType, wanted: str | None) -> Column:
    """Whether a value that isn't null has the schema's type; texts are read as what they say."""
    number = isinstance(kind, _NUMBERS)
    text = isinstance(kind, T.StringType)
    if wanted is None:
        return F.lit(True)
    if wanted == "integer":
        return value == F.floor(value) if number else value.rlike(r"^-?\d+$") if text else F.lit(False)
    if wanted == "number":
        return F.lit(True) if number else value.try_cast("double").isNotNull() if text else F.lit(False)
    if wanted == "boolean":
        return F.lit(True) if isinstance(kind, T.BooleanType) else value.isin("true", "false") if text else F.lit(False)
    fits = {"string": (T.StringType, T.DateType, T.TimestampType), "object": (T.StructType, T.MapType), "array": (T.ArrayType,)}[wanted]
    return F.lit(isinstance(kind, fits))


def faults(value: Column, kind: T.DataType, schema: Mapping, root: Mapping, path: Column, required: bool = True) -> Column:
    """array of struct(path, rule): what a value of this column type breaks of its schema; a value that isn't there breaks ``required`` only."""
    schema, allows = _resolved(schema, root)
    known = {"type", "required", "properties", "items", "enum", "const", "pattern", "minLength", "minimum", "maximum", "minItems", "uniqueItems"}
    notes = {"description", "title", "$schema", "$id", "$defs", "additionalProperties", "format", "default", "examples"}
    if odd := set(schema) - known - notes:
        raise ValueError(f"the rules {', '.join(sorted(odd))} aren't known")
    text = value.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else None
    rules: dict[str, Column] = {"type": ~_of_type(value, kind, schema.get("type"))}
    if text is not None:
        if "enum" in schema:
            rules["enum"] = ~text.isin(*[str(x) for x in schema["enum"] if x is not None])
        if "const" in schema:
            rules["const"] = text != str(schema["const"])
        if "pattern" in schema:
            rules["pattern"] = ~text.rlike(schema["pattern"])
        if "minLength" in schema:
            rules["minLength"] = F.char_length(text) < schema["minLength"]
        for bound, breaks in (("minimum", lambda x, y: x < y), ("maximum", lambda x, y: x > y)):
            if bound in schema:
                rules[bound] = breaks(text.try_cast("double"), float(schema[bound]))
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            rules["minItems"] = F.size(value) < schema["minItems"]
        if schema.get("uniqueItems"):
            rules["uniqueItems"] = F.size(F.array_distinct(value)) < F.size(value)
    made = lambda rule: F.struct(path.alias("path"), F.lit(rule).alias("rule"))
    own = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), made(rule)) for rule, bad in rules.items()]))
    parts = [own]
    if isinstance(kind, T.ArrayType) and "items" in schema:
        below = lambda x, i: faults(x, kind.elementType, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        parts.append(F.flatten(F.transform(value, below)))
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        for name, inner in schema.get("properties", {}).items():
            must = name in schema.get("required", ())
            at = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
            if name in fields:
                parts.append(faults(value[name], fields[name], inner, root, at, must))
            elif must and not _resolved(inner, root)[1]:
                parts.append(F.array(F.struct(at.alias("path"), F.lit("required").alias("rule"))))
        if schema.get("additionalProperties") is False:
            for name in fields.keys() - schema.get("properties", {}).keys():
                more = F.struct(F.concat(path, F.lit(f".{name}")).alias("path"), F.lit("additionalProperties").alias("rule"))
                parts.append(F.when(value[name].isNotNull(), F.array(more)).otherwise(F.array().cast(_FAULTS)))
    none = F.array().cast(_FAULTS)
    absent = F.array(made("required")) if required and not allows else none
    return F.when(value.isNull(), absent).otherwise(F.coalesce(F.concat(*parts), none))


def schema_findings(rows: DataFrame, key: str, record: str, schema: Mapping | str, check: str = "schema", level: str = "error") -> DataFrame:
    """A finding (level, check, key, message) for each fault of each row's ``record``; the message is the value's path and the broken rule."""
    document = json.loads(schema) if isinstance(schema, str) else schema
    found = faults(F.col(record), rows.schema[record].dataType, document, document, F.lit(""))
    each = rows.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("f"))
    return each.select(F.lit(level).alias("level"), F.lit(check).alias("check"), "key", F.trim(F.concat_ws(" ", "f.path", "f.rule")).alias("message"))
