"""JSON pointers on VARIANT: strict parsing, access by pointer, and why a text didn't parse."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_INDEX = re.compile(r"0|[1-9][0-9]{0,8}")


def tokens(pointer: str) -> list[str]:
    """The keys of a JSON pointer: "" is the whole value, ~1 stands for a slash and ~0 for a tilde."""
    if pointer == "":
        return []
    if not pointer.startswith("/") or re.search("~(?![01])", pointer):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def at_pointer(value: Column, pointer: str) -> Column:
    """The part of a variant that a pointer names, as a variant; null where there is none.

    Stretches of plain names become one variant path. A number is an index of an
    array or a key of an object, whichever the value has. Any other key, which
    may hold quotes or nothing at all, is looked up in the object as a map.
    """
    path = "$"
    for token in tokens(pointer):
        if _PLAIN.fullmatch(token):
            path += f".{token}"
            continue
        here = value if path == "$" else F.try_variant_get(value, path, "variant")
        path = "$"
        found = F.element_at(F.try_variant_get(here, "$", "map<string, variant>"), F.lit(token))
        value = F.coalesce(F.try_variant_get(here, f"$[{token}]", "variant"), found) if _INDEX.fullmatch(token) else found
    return value if path == "$" else F.try_variant_get(value, path, "variant")


def parsed(text: Column) -> Column:
    """Strict JSON as a variant; null where it is none."""
    return F.try_parse_json(text)


def parse_reason(text: Column, where: Column) -> Column:
    """Why a text has no value: null if it has one."""
    return F.when(text.isNull(), F.concat(F.lit("no configuration: "), where)).when(F.try_parse_json(text).isNull(), F.concat(F.lit("cannot parse "), where))


def kind(value: Column) -> Column:
    """What a variant is: object, array, string, number, boolean, null; null for none."""
    schema = F.schema_of_variant(value)
    number = schema.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    return (
        F.when(value.isNull(), None).when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string")
        .when(number, "number").when(schema == "BOOLEAN", "boolean").otherwise("null")
    )
