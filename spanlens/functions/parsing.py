"""Entities out of model responses, with native regular expressions and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions.text import after_marker, strip

PAIR = "struct<name:string,type:string>"
NONE = f"cast(array() as array<{PAIR}>)"
#: Formats of the responses, which recorded answers have, too. So is the key "named entities".
TAGGED, CODE = r"\[ (.*?) \| (.*?) \]", r'(?s)entity_list\.append\(\{"text": "(.*?)", "type": "(.*?)"\}\)'
FINAL, UPDATED = "Final predicted entities", "Updated Predicted Entity"


def braces(text: Column) -> Column:
    """From the first opening brace to the last closing one; empty without."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def valid(ents: Column) -> Column:
    """Entities with a type and a name that is not blank."""
    return F.filter(ents, lambda x: x["name"].isNotNull() & x["type"].isNotNull() & (strip(x["name"]) != ""))


def _named(found: Column) -> Column:
    return F.coalesce(F.from_json(found, f"`named entities` array<{PAIR}>")["named entities"], F.expr(NONE))


def parse_json(text: Column) -> Column:
    """The list under "named entities"; empty where the response has no such object."""
    return valid(_named(braces(text)))


def _pairs(text: Column, pattern: str) -> Column:
    one, two = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(one.alias("name"), two.alias("type")), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))


def parse_tagged(text: Column) -> Column:
    """``[ name | type ]`` marks, each within a line."""
    return _pairs(text, TAGGED)


def parse_code(text: Column) -> Column:
    """``entity_list.append({"text": "...", "type": "..."})`` calls."""
    return _pairs(text, CODE)


def parse_reflection(text: Column) -> Column:
    """As parse_json, but of the part after the final marker where the object holds one."""
    outer = braces(text)
    last = F.when(F.contains(outer, F.lit(FINAL)), braces(after_marker(outer, FINAL))).otherwise(outer)
    return valid(_named(last))


def parse_boundary(text: Column) -> Column:
    """At most one entity: the response's object; of several braces the part after the update marker, if it has one."""
    outer = braces(text)
    many = (F.regexp_count(outer, F.lit(r"\{")) > 1) | (F.regexp_count(outer, F.lit(r"\}")) > 1)
    one = F.when(many & F.contains(text, F.lit(UPDATED)), braces(after_marker(text, UPDATED))).otherwise(outer)
    return valid(F.coalesce(F.array(F.from_json(one, "name string, type string")), F.expr(NONE)))


def boundary_parsed(text: Column) -> Column:
    """Whether the response held an object at all; an empty one asks for deletion."""
    return F.from_json(braces(text), "map<string,string>").isNotNull()
