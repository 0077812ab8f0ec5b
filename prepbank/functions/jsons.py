"""JSON texts as variants."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` names it."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def parse_json(c: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else; null for any other text.

    ``try_parse_json`` alone stops after the first value and lets any text follow it. So the text must hold as the
    only element of a list and as the value of an object: what follows a first value cannot close both early.
    """

    def whole(x):
        listed = F.json_array_length(F.concat(F.lit("["), x, F.lit("]")))
        keyed = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
        return F.when(listed == 1, F.try_variant_get(keyed, "$.v", "variant"))

    return let(c, whole)


def kind(v: Column, path: str = "$") -> Column:
    """JSON kind at a path: null when the key is absent, VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"\A\w+", 0)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def text_field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def list_field(v: Column, name: str) -> Column:
    """Text list under a key; empty when the key is absent, null when it holds no list."""
    path = f"$.{name}"
    return F.when(kind(v, path).isNull(), F.array().cast("array<string>")).otherwise(
        F.try_variant_get(v, path, "array<string>")
    )
