"""Readers of stage truth: clusters, component splits, programs, types, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillshift.functions.positions import Abs, Edge, Position, Program
from quillshift.functions.text import bracket_labels, type_normalize

# Names of regular expressions in program files.
ESCAPES = {
    "[ESCAPESPACE]": r"\s",
    "[ESCAPEWORD]": r"\b[A-Za-z]+\b",
    "[ESCAPENUMBER]": r"\d+",
    "[ESCAPECOMMA]": r",",
    "[ESCAPEPERIOD]": r"\.",
    "[ESCAPEAT]": r"@",
    "[ESCAPEDOUBLECOLON]": r":",
    "[ESCAPEBACKSLASH]": r"\\",
    "[ESCAPESLASH]": r"/",
    "[ESCAPEIN]": r"In\s",
    "[ESCAPEDOUBLEQUOTE]": r"\"",
    "[ESCAPELEFTPAREN]": r"\(",
    "[ESCAPERIGHTPAREN]": r"\)",
    "[ESCAPEBY]": r"by\s",
}


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, row_id) from lines of comma-separated ids; an id repeated in a line counts once."""
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("place", F.monotonically_increasing_id())
    numbered = lines.select("value", F.row_number().over(Window.orderBy("place")).alias("n"))
    ids = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("long"))
    return numbered.select((F.col("n") - 1).alias("cluster_id"), F.explode(F.array_distinct(ids)).alias("row_id"))


def _lines(spark: SparkSession, path: str) -> list[str]:
    """A stage file is a page or two; it is read through Spark so that any store will do."""
    whole = spark.read.text(path, wholetext=True).collect()
    return "".join(r["value"] for r in whole).lstrip("﻿").splitlines()


def _items(lines: Iterable[str]) -> list[list[str]]:
    """Lines between [ITEM] lines; empty items at the end don't count."""
    items: list[list[str]] = [[]]
    for line in lines:
        if line.strip().upper() == "[ITEM]":
            items.append([])
        elif line.strip():
            items[-1].append(line)
    while items and not items[-1]:
        items.pop()
    return items


def parse_split(lines: Iterable[str]) -> dict[int, dict[str, str]]:
    """Components by ordinal of the item."""
    return {i: {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in item)} for i, item in enumerate(_items(lines))}


def read_split(spark: SparkSession, path: str, only: Iterable[int] | None = None) -> dict[int, dict[str, str]]:
    found = parse_split(_lines(spark, path))
    return found if only is None else {i: found[i] for i in only if i in found}


def component_rows(parts: dict[int, dict[str, str]], inputs: int) -> list[tuple[int, str, int, str, str]]:
    """(row_id, side, ord, key, value) of parsed components; ordinals from ``inputs`` on are outputs."""
    return [
        (i if i < inputs else i - inputs, "in" if i < inputs else "out", n, k, v)
        for i, comps in parts.items() for n, (k, v) in enumerate(comps.items())
    ]


def parse_position(text: str) -> Position:
    """``AbsPos(n)`` or ``RegPos([NAME],k,L|R)``; names are spelled out by ``ESCAPES``."""
    kind, _, inner = text.strip().rstrip(")").partition("(")
    if kind == "AbsPos":
        return Abs(None if inner.strip() in ("None", "") else int(inner))
    head, occ, side = inner.rsplit(",", 2)
    return Edge(ESCAPES.get(head.strip(), head.strip()), int(occ), side.strip())


def parse_programs(lines: Iterable[str]) -> dict[int, dict[str, list[Program]]]:
    """Programs by row id and key.

    Right offsets from the end are inclusive in these files: -1 is the end of the string.
    """

    def ended(p: Position) -> Position:
        return Abs(p.idx + 1 or None) if isinstance(p, Abs) and p.idx is not None and p.idx < 0 else p

    out: dict[int, dict[str, list[Program]]] = {}
    for head, *rest in _items(lines):
        table = out.setdefault(int(head.strip()), {})
        for line in rest:
            key, _, pair = line.partition(":")
            left, _, right = pair.partition("[PARAMSPLIT]")
            table.setdefault(key.strip(), []).append((parse_position(left), ended(parse_position(right))))
    return out


def read_programs(spark: SparkSession, path: str) -> dict[int, dict[str, list[Program]]]:
    return parse_programs(_lines(spark, path))


def read_types(spark: SparkSession, path: str) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in _lines(spark, path) if x.strip()))


def types_of_compositions(df: DataFrame, c: str = "composition") -> DataFrame:
    """(type): distinct normalised labels of composition strings."""
    return df.select(F.explode(bracket_labels(F.col(c))).alias("t")).select(type_normalize(F.col("t")).alias("type")).distinct()


def read_labelled(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """(row_id, label) of a headerless (string, label) file, in the order of ``rows``."""
    named = spark.read.schema("input string, label int").option("escape", '"').csv(path).dropDuplicates(["input"])
    return rows.select("row_id", "input").join(named, "input").select("row_id", "label")


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    return read_types(spark, path)


def feature_subsets(names: list[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets, small ones first."""
    subsets: list[tuple[str, ...]] = [()]
    for n in names:
        subsets += [(*s, n) for s in subsets]
    return sorted((s for s in subsets if s), key=len)
