"""Hashes, identities and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that no file may have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def fingerprint(*values: Column) -> Column:
    """SHA-256 of the values, one a line; a null is ``<null>``."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(v.cast("string"), F.lit("<null>")) for v in values]), 256)


def content_hash(text: Column) -> Column:
    """SHA-256 after all line ends are read as a line feed."""
    return F.sha2(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256)


def request_fingerprint(*fields: Column) -> Column:
    """SHA-256 of each field's UTF-8 bytes behind its big-endian 32-bit length."""
    parts = []
    for f in fields:
        data = F.encode(F.coalesce(f.cast("string"), F.lit("")), "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 8, "0")), data]
    return F.sha2(F.concat(*parts), 256)


def sanitize(value: Column, most: int) -> Column:
    """Letters, digits, ``.``, ``_`` and single ``-``, cut to ``most`` characters, safe as a file name."""
    safe = F.regexp_replace(F.regexp_replace(value, r"[^\p{L}\p{Nd}._-]", "-"), "-{2,}", "-")
    bare = F.regexp_replace(safe, "^[ .-]+|[ .-]+$", "")
    named = F.when(bare == "", "unnamed").otherwise(bare)
    cut = F.when(F.length(named) > most, F.regexp_replace(F.substring(named, 1, most), "[ .-]+$", "")).otherwise(named)
    return F.when(F.upper(F.substring_index(cut, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), cut)).otherwise(cut)


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def branch_key(branch: Column) -> Column:
    return F.concat(F.lower(sanitize(branch, 48)), F.lit("--"), short_hash(branch))


def repository_key(repository: Column, most: int = 60) -> Column:
    readable = sanitize(repository, most)
    return F.when(readable == repository, readable).otherwise(F.concat(readable, F.lit("--"), short_hash(repository)))


def note_file_name(name: Column, source: Column, most: int = 60) -> Column:
    return F.concat(sanitize(name, most), F.lit("--"), short_hash(source), F.lit(".md"))


def repository_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 24)


def file_entity_id(language: Column, kind: Column, path: Column, full_name: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.concat(F.lit("entity:"), F.sha2(F.concat_ws("|", F.lit("file-v1"), F.lower(language), kind, clean, full_name), 256))


def symbol_entity_id(language: Column, project: Column, kind: Column, symbol: Column) -> Column:
    return F.concat(F.lit("entity:"), F.sha2(F.concat_ws("|", F.lit("symbol-v2"), F.lower(language), project, kind, symbol), 256))


def quote(value: Column) -> Column:
    """The text as a JSON string."""
    inner = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").otherwise(F.substr(inner, F.lit(6), F.length(inner) - 6))


def wiki_target(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"(?i)\.md$", ""), F.lit("\\"), F.lit("/"))


def single_line(text: Column, most: int) -> Column:
    """Control characters as spaces, at most so many characters."""
    return F.substring(F.regexp_replace(text, r"\p{Cntrl}", " "), 1, most)


def run_id(started: Column, *values: Column) -> Column:
    return F.concat(F.date_format(started, "yyyyMMdd'T'HHmmssSSS'Z'"), F.lit("--"), F.substring(fingerprint(*values), 1, 12))


def marker(kind: Column) -> Column:
    """PascalCase as UPPER_SNAKE."""
    return F.upper(F.regexp_replace(kind, "(?<=.)([A-Z])", "_$1"))


def render_segments(segments: Column) -> Column:
    """``segments`` of (kind, content) as marked blocks with a blank line between."""
    block = lambda s: F.concat(F.lit("BEGIN_"), marker(s.kind), F.lit("\n"), s.content, F.lit("\nEND_"), marker(s.kind))
    return F.array_join(F.transform(segments, block), "\n\n")
