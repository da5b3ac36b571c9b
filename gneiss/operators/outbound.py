"""Inspection of outbound texts: secrets, paths, source bodies, snapshots; fails closed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import ordinal_count
from gneiss.operators.policy import POLICIES

MOST = 99

#: Patterns of secrets, in Java's dialect with Unicode classes.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer_token": r"(?iU)\bBearer\s+[A-Za-z0-9._-]{12,}",
    "secret_assignment": r"(?iU)\b(?:password|pwd|client[_-]?secret|api[_-]?key)\s*[:=]\s*[^\s,;]{6,}",
    "connection_string": r"(?iU)\b(?:Server|Data Source)\s*=.*\b(?:Password|Pwd)\s*=",
    "provider_key": r"(?U)\bsk-[A-Za-z0-9_-]{12,}",
}
#: Patterns of absolute local paths.
PATHS = {
    "windows_path": r"[A-Za-z]:[\\/]",
    "unc_path": r"(?mU)(?:^|[\s`'\"])(?:\\\\|//)[^\\/\s]+[\\/][^\s]+",
    "file_uri": r"(?iU)\bfile://[^\s]+",
    "unix_path": r"(?mU)(?:^|[\s`'\"])/(?:home|Users|tmp|var|etc|opt|srv|workspace|mnt|Volumes)(?:/|\b)",
}
PYTHON_BODY = r"(?mU)^\s*(?:class|def)\s+\w+[^\r\n]*:\s*\r?\n[ \t]+(?!#)\S"
FILE_BLOCK = r"(?ms)^BEGIN_FILE\s+([^\r\n]+)\r?\n.*?^END_FILE\s*$"
#: Bounds of the search for embedded JSON and for bodies.
CANDIDATES, DEPTH, NODES, CHARACTERS, HEADER = 32, 64, 10_000, 1_000_000, 16_384

CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "fixed", "else", "do", "try", "finally", "return"}
SIGNATURE = re.compile(r"(?:^|[\s>\]])(?:[\w.]+(?:<[^<>]*>)?)\s*\([^{};]*\)\s*(?:where\s[^{]*|:\s*(?:base|this)\s*\([^{]*\)\s*|const\s*|noexcept\s*|throws\s+[\w.,\s]+)?$")
TYPE = re.compile(r"\b(?:class|struct|interface|record|enum|namespace)\s+[A-Za-z_]\w*[^;{}]*$")


def counts(text: Column) -> dict[str, Column]:
    """Number of matches of each pattern; a null text has none."""
    safe = F.coalesce(text, F.lit(""))
    return {name: F.regexp_count(safe, F.lit(p)) for name, p in (SECRETS | PATHS | {"python_body": PYTHON_BODY}).items()}


def file_payloads(text: Column) -> Column:
    """Number of distinct files quoted in marked blocks."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FILE_BLOCK), 1), F.trim)))


def legacy_snapshot(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains('"entities"') & low.contains('"relations"') & low.contains('"repository"')


def strip_literals(code: str) -> str | None:
    """C-family code with comments and literals blanked; None if one does not end (fail closed).

    Handles line and block comments, quoted strings and characters with escapes, verbatim strings
    with doubled quotes, and raw strings of three or more quotes.
    """
    out, i, n = [], 0, len(code)
    while i < n:
        c, two = code[i], code[i : i + 2]
        if two == "//":
            j = code.find("\n", i)
            i = n if j < 0 else j
        elif two == "/*":
            j = code.find("*/", i + 2)
            if j < 0:
                return None
            out.append(" ")
            i = j + 2
        elif code.startswith('"""', i):
            quotes = len(code[i:]) - len(code[i:].lstrip('"'))
            j = code.find('"' * quotes, i + quotes)
            if j < 0:
                return None
            out.append('""')
            i = j + quotes
        elif two in ('@"', '$@') and '"' in code[i : i + 3]:
            j = code.index('"', i) + 1
            while True:
                j = code.find('"', j)
                if j < 0:
                    return None
                if code[j : j + 2] != '""':
                    break
                j += 2
            out.append('""')
            i = j + 1
        elif c in "\"'":
            j = i + 1
            while j < n and code[j] != c and code[j] != "\n":
                j += 2 if code[j] == "\\" else 1
            if j >= n or code[j] != c:
                if c == '"':
                    return None
                out.append(c)  # an apostrophe in prose
                i += 1
                continue
            out.append(c + c)
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def c_family_bodies(text: str | None) -> int:
    """Number of braces that open a type's or a function's body with something in it.

    Code whose literals do not end, or whose header is longer than the bound, counts as one
    body if it has a brace at all.
    """
    if not text or "{" not in text:
        return 0
    code = strip_literals(text)
    if code is None:
        return 1
    found, start = 0, 0
    for m in re.finditer(r"[{};]", code):
        if m[0] == "{":
            header = code[start : m.start()]
            if len(header) > HEADER:
                return found + 1
            header = header.strip()
            rest = code[m.end() :].lstrip()
            word = re.search(r"([A-Za-z_]\w*)\s*\(", header)
            body = bool(TYPE.search(header)) or bool(SIGNATURE.search(header)) and not (word and word[1] in CONTROL)
            found += bool(body and rest and not rest.startswith("}"))
        start = m.end()
    return found


def embedded_json(text: str | None) -> list:
    """Values of the balanced objects in a text, outermost first; ``None`` marks an exhausted bound."""
    out, i, text = [], 0, text or ""
    if len(text) > CHARACTERS and "{" in text:
        return [None]
    while (i := text.find("{", i)) >= 0:
        if len(out) >= CANDIDATES:
            return [*out, None]
        depth, j, quoted, most = 0, i, False, 0
        while j < len(text):
            c = text[j]
            if quoted:
                if c == "\\":
                    j += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
                most = max(most, depth)
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        if depth or j >= len(text):
            i += 1
            continue
        if most > DEPTH:
            return [*out, None]
        try:
            out.append(json.loads(text[i : j + 1]))
            i = j + 1
        except ValueError:
            i += 1
    return out


def snapshot_shapes(text: str | None) -> tuple[bool, bool]:
    """Whether a text embeds a whole repository with contents, and a raw snapshot; exhausted bounds count as both."""
    envelope = raw = False
    stack, seen = list(embedded_json(text)), 0
    while stack:
        value = stack.pop()
        seen += 1
        if value is None and seen == 1 or seen > NODES:
            return True, True
        if isinstance(value, dict):
            low = {str(k).lower(): v for k, v in value.items()}
            raw |= all(isinstance(low.get(k), t) for k, t in (("repository", dict), ("entities", list), ("relations", list)))
            files = low.get("files")
            envelope |= isinstance(files, list) and sum(isinstance(f, dict) and {"path", "content"} <= {str(k).lower() for k in f} for f in files) >= 3
            stack += [v for v in value.values() if isinstance(v, (dict, list))]
        elif isinstance(value, list):
            stack += [v for v in value if isinstance(v, (dict, list))]
    return envelope, raw


def _structures(texts: pd.Series) -> pd.DataFrame:
    rows = [(c_family_bodies(t), *snapshot_shapes(t)) if t else (0, False, False) for t in texts]
    return pd.DataFrame(rows, columns=["bodies", "envelope", "raw"])


def inspect(requests: DataFrame, ident: str = "request_id", text: str = "text", secrets: list[str] = (), structures: bool = True) -> DataFrame:
    """``(ident, category, reason, count, capped)``: one finding per category at most, the first reason in catalogue order.

    Patterns run inside the JVM. ``structures`` adds the stateful checks for code bodies and embedded
    JSON by a vectorised function, which only sees texts with a brace.
    """
    c = counts(F.col(text))
    known = sum((ordinal_count(F.col(text), F.lit(s)) for s in secrets), F.lit(0))
    shape = "struct<bodies:int,envelope:boolean,raw:boolean>"
    braced = F.coalesce(F.when(F.col(text).contains("{"), F.col(text)), F.lit(""))
    rows = requests.withColumn("_s", F.pandas_udf(_structures, shape)(braced) if structures else F.lit(None).cast(shape))
    s = lambda n: F.coalesce(F.col(f"_s.{n}").cast("int"), F.lit(0))
    total = lambda names: sum((c[n] for n in names), F.lit(0))
    found = [
        (0, "CompleteRepository", "CompleteRepositoryPayload", (file_payloads(F.col(text)) >= 3).cast("int") + s("envelope")),
        (1, "RawSnapshot", "RawSnapshotPayload", F.greatest(legacy_snapshot(F.col(text)).cast("int"), s("raw"))),
        (2, "SourceBodies", "SourceBodyPayload", c["python_body"] + s("bodies")),
        (3, "Secrets", "KnownSecretValue", known),
        (3, "Secrets", "SecretSyntax", total(SECRETS)),
        (4, "AbsoluteLocalPaths", "AbsoluteLocalPath", total(PATHS)),
    ]
    structs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("category"), F.lit(why).alias("reason"), F.coalesce(n.cast("int"), F.lit(0)).alias("n")) for i, k, why, n in found])
    hits = rows.select(ident, F.explode(F.filter(structs, lambda x: x.n > 0)).alias("f")).select(ident, "f.*")
    first = hits.groupBy(ident, "place", "category").agg(F.min("reason").alias("reason"), F.sum("n").alias("n"))
    return first.select(ident, "category", "reason", F.least("n", F.lit(MOST)).cast("int").alias("count"), (F.col("n") > MOST).alias("capped"))


def assess(requests: DataFrame, findings: DataFrame, ident: str = "request_id") -> DataFrame:
    """``(ident, outcome, blocked_policies)``: a finding blocks by the policy of its category; an unknown category blocks too."""
    policy = F.create_map(*[F.lit(x) for p, c in POLICIES for x in (c, p)])
    per = findings.withColumn("policy", F.coalesce(F.try_element_at(policy, F.col("category")), F.lit("UNKNOWN"))).groupBy(ident).agg(F.array_sort(F.collect_set("policy")).alias("blocked_policies"))
    out = requests.select(ident).join(per, ident, "left")
    return out.select(ident, F.when(F.col("blocked_policies").isNull(), "Allowed").otherwise("Blocked").alias("outcome"), F.coalesce("blocked_policies", F.array().cast("array<string>")).alias("blocked_policies"))


def legacy_view(findings: DataFrame, ident: str = "request_id") -> DataFrame:
    """Findings as one row of counts per request."""
    wide = findings.groupBy(ident).pivot("category", [c for _, c in POLICIES]).agg(F.least(F.sum("count"), F.lit(MOST)))
    return wide.fillna(0)


def redact(text: Column, root: str | None = None, home: str | None = None, most: int = 300) -> Column:
    """A diagnostic on one line without paths of the user, values of secrets or credentials in URIs."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    if root:
        out = F.replace(out, F.lit(root), F.lit("<repository>"))
    if home:
        out = F.replace(out, F.lit(home), F.lit("~"))
    out = F.regexp_replace(out, r"(?i)\b(password|pwd|secret|token|api[_-]?key|client[_-]?secret)\b(\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)", "$1$2<redacted>")
    out = F.regexp_replace(out, r"(?i)\b([a-z][a-z0-9+.-]*://)[^/\s@]+@", "$1")
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)


def assessment_lines(assessed: DataFrame, ident: str = "request_id", kind: str = "Exact", most: int = 512) -> DataFrame:
    """``(ident, lines)``: an assessment for reading: its kind, each policy in catalogue order, and the outcome.

    Only names of the catalogue are shown, never a text that was inspected; a policy that is not of the catalogue is shown as such.
    """
    state = lambda p: F.when(F.array_contains("blocked_policies", p), "Blocked").otherwise("Allowed")
    known = F.array(*[F.lit(p) for p, _ in POLICIES])
    lines = [F.lit(f"Assessment: {kind}"), *[F.concat(F.lit(p + ": "), state(p)) for p, _ in POLICIES]]
    alien = F.when(F.size(F.array_except("blocked_policies", known)) > 0, F.array(F.lit("Diagnostic: unknown policy"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(*lines), alien, F.array(F.concat(F.lit("Overall: "), F.col("outcome"))))
    return assessed.select(ident, F.transform(every, lambda x: F.substring(F.regexp_replace(x, r"\p{Cntrl}", " "), 1, most)).alias("lines"))
