"""Tolerant readers of model answers: labels, entity lists, graphs and scores in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("inheritance", "parallel", "peripheral")


def parse_label(answer: Column) -> Column:
    """struct(label, reason): from the first {...}; else by keyword; else unknown."""
    body = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "label string, reason string")
    said = F.lower(F.trim(body["label"]))
    found = F.lit(None).cast("string")
    for x in reversed(LABELS):
        found = F.when(F.lower(answer).contains(x), F.lit(x)).otherwise(found)
    label = F.when(said.isin(*LABELS), said).otherwise(F.coalesce(found, F.lit("unknown")))
    return F.struct(label.alias("label"), F.coalesce(body["reason"], F.lit("")).alias("reason"))


def parse_entities(answer: Column) -> Column:
    """A list of strings: as it stands, with backslashes doubled, or the outermost [...]."""
    read = lambda c: F.from_json(c, "array<string>")
    doubled = F.replace(answer, F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(read(answer), read(doubled), read(F.regexp_extract(answer, r"(?s)\[.*\]", 0)))


def parse_scores(answer: Column, name: str = "entity", value: str = "specificity") -> Column:
    """A map from name to value of a list of objects; of repeated names the last counts."""
    rows = F.from_json(answer, f"array<struct<{name}:string,{value}:double>>")
    kept = F.filter(rows, lambda r, i: r[name].isNotNull() & ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda q: q[name] == r[name]))
    return F.map_from_entries(F.transform(kept, lambda r: F.struct(r[name], r[value])))


def parse_relations(answer: Column) -> Column:
    """struct(entities, relations): relations as [a, b] pairs or {source, target} objects."""
    entities = F.from_json(answer, "entities array<string>")["entities"]
    pairs = F.from_json(answer, "relations array<array<string>>")["relations"]
    objects = F.from_json(answer, "relations array<struct<source:string,target:string>>")["relations"]
    as_pairs = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("source"), F.get(p, F.lit(1)).alias("target")))
    return F.struct(F.coalesce(entities, F.array()).alias("entities"), F.coalesce(as_pairs, objects).alias("relations"))
