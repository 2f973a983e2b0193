"""Attribute columns out of dynamic JSON: exact-type columns, key lists, inferred struct specs, projection and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What two types join to; anything not listed joins to text.
_JOIN = {("float", "integer"): "float", ("float", "unsigned"): "float", ("integer", "unsigned"): "integer"}


def pairs(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, raw, quoted) for each top-level member of a JSON object; raw: its JSON text, the string itself for strings, which are ``quoted``."""
    typed = F.from_json(json, "map<string, variant>")
    each = df.select(key, F.explode_outer(F.from_json(json, "map<string,string>")).alias("name", "raw"), typed.alias("typed")).where("name IS NOT NULL")
    return each.select(key, "name", "raw", F.coalesce(F.schema_of_variant(F.col("typed")[F.col("name")]) == "STRING", F.lit(False)).alias("quoted"))


def member(json: str, name: str) -> tuple[Column, Column]:
    """(raw, quoted) of one member; a name may hold any character."""
    return F.from_json(json, "map<string,string>")[name], F.coalesce(F.schema_of_variant(F.from_json(json, "map<string, variant>")[name]) == "STRING", F.lit(False))


def kind(raw: Column, text: Column | None = None) -> Column:
    """null, boolean, unsigned, integer, float, map, list or string, from the raw text of a member.

    Non-negative whole numbers are unsigned.  ``text`` says that the member was quoted, where that is known.
    """
    quoted = text if text is not None else F.lit(False)
    return (
        F.when(raw.isNull(), "null").when(quoted, "string").when(raw.isin("true", "false"), "boolean").when(raw.rlike("^[0-9]+$"), "unsigned").when(raw.rlike("^-[0-9]+$"), "integer")
        .when(raw.rlike("^-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "float").when(raw.startswith("{"), "map").when(raw.startswith("["), "list").otherwise("string")
    )


def keys(df: DataFrame, json: str) -> DataFrame:
    """Distinct top-level names."""
    return df.select(F.explode(F.json_object_keys(json)).alias("name")).distinct()


def column(df: DataFrame, key: str, json: str, name: str, wanted: str) -> DataFrame:
    """(key, value) where the member is exactly of the type: ``integer`` leaves out unsigned ones, ``number`` takes all."""
    raw, quoted = member(json, name)
    types = {"number": ["unsigned", "integer", "float"]}.get(wanted, [wanted])
    cast = {"float": "double", "number": "double", "integer": "bigint", "unsigned": "bigint", "boolean": "boolean"}.get(wanted, "string")
    return df.select(key, raw.alias("raw"), quoted.alias("quoted")).where(kind(F.col("raw"), F.col("quoted")).isin(*types)).select(key, F.col("raw").cast(cast).alias("value"))


def discover(df: DataFrame, family: str, json: str) -> DataFrame:
    """(family, name, type): the join of the types of each name over all rows, nulls aside, in order of name.

    Counting kinds is one aggregation with map-side combining; the join of at most eight kinds is a fold.
    """
    found = pairs(df, family, json).select(family, "name", kind(F.col("raw"), F.col("quoted")).alias("kind")).groupBy(family, "name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    known = F.filter("kinds", lambda k: k != "null")

    def join(a: Column, b: Column) -> Column:
        out = F.when(a == b, a)
        for (x, y), z in _JOIN.items():
            out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), z)
        return out.otherwise("string")

    folded = F.when(F.size(known) > 0, F.aggregate(known, F.element_at(known, 1), join)).otherwise("null")
    return found.select(family, "name", folded.alias("type"))


def project(df: DataFrame, json: str, spec: dict[str, str]) -> DataFrame:
    """A column for each (name, type) of a spec, sorted by name; text for what is no number or boolean.

    A quoted value is no number or boolean, so it is null in a column of such a type.
    """
    to = {"unsigned": "bigint", "integer": "bigint", "float": "double", "boolean": "boolean"}
    raw = {name: member(json, name) for name in sorted(spec)}
    return df.withColumns({name: (F.when(~quoted, text.try_cast(to[spec[name]])) if spec[name] in to else text) for name, (text, quoted) in raw.items()})


def deproject(df: DataFrame, names: list[str]) -> Column:
    """A JSON object from columns; nulls are left out."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))
