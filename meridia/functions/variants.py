"""Values of unknown shape (a scalar, a list, an object) as Column expressions over VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a name is looked for, first one first.
NAME_PATHS = ("$.artist.name", "$.artist.title", "$.name", "$.title", "$.common_name", "$.mbid")


def parse(text: Column) -> Column:
    """JSON text as VARIANT; null where it isn't JSON."""
    return F.try_parse_json(text)


def _trimmed(text: Column) -> Column:
    """Without white space around; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def _kind(value: Column) -> Column:
    """``ARRAY``, ``OBJECT``, ``VOID`` or a scalar's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def scalar(value: Column) -> Column:
    """A scalar as text, an object or list as JSON text."""
    return F.when(_kind(value).isin("ARRAY", "OBJECT"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def _first(value: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[_trimmed(F.try_variant_get(value, p, "string")) for p in paths])


def name_of(value: Column, paths: tuple[str, ...] = NAME_PATHS) -> Column:
    """The name of one item: by the first path that has one if it is an object, else its text; null without any."""
    return F.when(_kind(value) == "OBJECT", _first(value, paths)).otherwise(_trimmed(scalar(value)))


def _items(value: Column) -> Column:
    """The items of a list; another value is the only item."""
    return F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).when(_kind(value) != "VOID", F.array(value)).otherwise(F.array().cast("array<variant>"))


def _present(value: Column, of: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(_items(value), of), lambda x: x.isNotNull())


def names(value: Column, paths: tuple[str, ...] = NAME_PATHS) -> Column:
    """Names of all items that have one, joined by ``; ``; null if there is none."""
    return F.nullif(F.array_join(_present(value, lambda x: name_of(x, paths)), "; "), F.lit(""))


def ids(value: Column, path: str = "$.mbid") -> Column:
    """Ids of the items that are objects and have one."""
    return _present(value, lambda x: F.when(_kind(x) == "OBJECT", _first(x, (path,))))


def text_of(value: Column) -> Column:
    """Any value as one string: a scalar trimmed, an object by its name or title (else its JSON), a list item by item; null if empty."""
    one = lambda x: F.when(_kind(x) == "OBJECT", F.coalesce(_first(x, ("$.name", "$.title")), F.to_json(x))).otherwise(_trimmed(scalar(x)))
    return F.nullif(F.array_join(_present(value, one), "; "), F.lit(""))


def sections(value: Column) -> Column:
    """``start, stop, label`` of an annotation: ``intervals`` with ``labels``, or a list of objects ``time, duration, value``."""
    kind = "struct<start:double,stop:double,label:string>"
    intervals = F.try_variant_get(value, "$.intervals", "array<array<double>>")
    labels = F.try_variant_get(value, "$.labels", "array<string>")
    pairs = F.transform(intervals, lambda x, i: F.struct(F.get(x, F.lit(0)).alias("start"), F.get(x, F.lit(1)).alias("stop"), F.get(labels, i).alias("label")).cast(kind))
    number = lambda x, p: F.coalesce(F.try_variant_get(x, p, "double"), F.lit(0.0))
    items = F.transform(_items(value), lambda x: F.struct(number(x, "$.time").alias("start"), (number(x, "$.time") + number(x, "$.duration")).alias("stop"), F.try_variant_get(x, "$.value", "string").alias("label")).cast(kind))
    return F.when(_kind(value) == "ARRAY", items).otherwise(F.coalesce(pairs, F.array().cast(f"array<{kind}>")))
