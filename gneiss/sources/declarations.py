"""Declarations of C-family source by syntax alone, for files without a semantic model."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.hashing import file_entity_id
from gneiss.operators.outbound import strip_literals

KINDS = {"namespace": "Namespace", "class": "Class", "struct": "Struct", "interface": "Interface", "record": "Record", "enum": "Enum"}
HEAD = re.compile(r"\b(namespace|class|struct|interface|record(?:\s+(?:class|struct))?|enum)\s+([A-Za-z_][\w.]*)")
METHOD = re.compile(r"([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\([^()]*\)\s*(?:where\b[^{;]*)?$")
PROPERTY = re.compile(r"[\w>\]?]\s+([A-Za-z_]\w*)\s*$")
CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "fixed", "return", "new", "nameof", "typeof", "sizeof", "base", "this"}


def declarations(text: str | None) -> list[dict]:
    """Declarations with their full names, lines and number of base types, in order; none if a literal does not end."""
    code = strip_literals(text or "")
    if code is None:
        return []
    out, stack, start = [], [], 0
    line_of = lambda at: (text or "").count("\n", 0, at) + 1

    def add(kind, name, at, bases=0):
        parent = ".".join(s["name"] for s in stack if s)
        row = {"entity_type": kind, "name": name.rsplit(".", 1)[-1], "full_name": f"{parent}.{name}" if parent else name, "start_line": code.count("\n", 0, at) + 1, "end_line": 0, "bases": bases}
        out.append(row)
        return row

    for m in re.finditer(r"[{};]", code):
        head, at = code[start : m.start()], start + len(code[start : m.start()]) - len(code[start : m.start()].lstrip())
        start = m.end()
        found = HEAD.search(head)
        inside = stack[-1]["entity_type"] if stack and stack[-1] else None
        if m[0] == "}":
            if stack and (top := stack.pop()) is not None:
                top["row"]["end_line"] = code.count("\n", 0, m.start()) + 1
            continue
        if found:
            kind = KINDS[found[1].split()[0]]
            bases = head[found.end() :].partition(":")[2]
            row = add(kind, found[2], at, len([b for b in bases.split("where")[0].split(",") if b.strip()]))
            if m[0] == ";" and kind == "Namespace":  # a file-scoped namespace holds all that follows
                stack.insert(0, {"name": found[2], "entity_type": kind, "row": row})
            elif m[0] == "{":
                stack.append({"name": found[2], "entity_type": kind, "row": row})
            else:
                row["end_line"] = code.count("\n", 0, m.start()) + 1
            continue
        member = None
        if inside in ("Class", "Struct", "Interface", "Record"):
            bare = re.sub(r"=>.*$", "", head, flags=re.S).rstrip()
            if (x := METHOD.search(bare)) and x[1] not in CONTROL and "=" not in bare.partition("(")[0]:
                member = add("Method", x[1], at)
            elif m[0] == "{" and (x := PROPERTY.search(bare)) and x[1] not in CONTROL:
                member = add("Property", x[1], at)
        if member:
            member["end_line"] = code.count("\n", 0, m.start()) + 1
        if m[0] == "{":
            stack.append(None)
    for row in out:
        row["end_line"] = row["end_line"] or line_of(len(text or ""))
    return out


def extract(files: DataFrame, path: str = "path", text: str = "text", language: str = "C#") -> DataFrame:
    """Entities of source files; partial declarations of one full name are one, first location first.

    Each file is read alone by a vectorised function; joining partials is a shuffle of declarations, not of texts.
    """
    schema = "path string, entity_type string, name string, full_name string, start_line int, end_line int, bases int"

    def run(batches):
        for pdf in batches:
            rows = [{"path": p, **d} for p, t in zip(pdf["path"], pdf["text"]) for d in declarations(t)]
            yield pd.DataFrame(rows, columns=["path", "entity_type", "name", "full_name", "start_line", "end_line", "bases"])

    found = files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, schema)
    place = F.struct("path", "start_line", "end_line")
    grouped = found.groupBy("entity_type", "name", "full_name").agg(F.array_sort(F.collect_list(place)).alias("places"), F.max("bases").alias("bases"))
    first = F.col("places")[0]
    return grouped.select(
        file_entity_id(F.lit(language), F.col("entity_type"), first.path, F.col("full_name")).alias("id"), "name", "full_name", "entity_type", F.lit(language).alias("language"),
        first.path.alias("path"), first.start_line.alias("start_line"), first.end_line.alias("end_line"), F.lit("Syntactic").alias("resolution"),
        F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))).alias("additional_locations"), "bases",
    )
