"""File scans: listing, languages, exclusion, hashes, projects and git metadata."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that no scan enters, whatever their case.
EXCLUDED = [".git", ".vs", "bin", "obj", "node_modules", "packages", "dist", "build", "coverage", "TestResults"]

#: Languages by extension; others are ``Other``.
LANGUAGES = {
    ".cs": "C#", ".csproj": "MSBuild", ".props": "MSBuild", ".targets": "MSBuild", ".sln": "Solution", ".js": "JavaScript", ".ts": "TypeScript",
    ".sql": "SQL", ".cshtml": "Razor", ".json": "JSON", ".xml": "XML", ".yml": "YAML", ".yaml": "YAML", ".py": "Python", ".java": "Java",
}

HASHED_BYTES = 20 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a file named ``.env`` has that one; none is empty."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("Other"))


def excluded(path: Column) -> Column:
    """Whether a directory above the file is one that scans skip."""
    parts = F.split(F.lower(directory(path)), "/")
    return F.exists(parts, lambda p: p.isin([x.lower() for x in EXCLUDED]))


def sensitive(path: Column) -> Column:
    name = F.lower(file_name(path))
    settings = (name == "appsettings.json") | (name.startswith("appsettings.") & name.endswith(".json"))
    return name.startswith(".env") | settings | name.contains("secret") | name.contains("credential")


def hashable(path: Column, size: Column) -> Column:
    return (size <= HASHED_BYTES) & (language(path) != "Other") & ~sensitive(path)


def sanitize_remote(url: Column) -> Column:
    """An absolute URL without user, query and fragment; file URLs and other texts stay."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return F.when(url.rlike("^(?i)(?!file:)[a-z][a-z0-9+.-]*://"), plain).otherwise(url)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(relative_path, extension, language, size_bytes, content_hash, last_write_utc)`` of a tree.

    The tree is listed by Spark's binary source without contents; only files that may be hashed are read, so one of any
    size is listed. Excluded directories are left out by path. A file that may not be hashed, or
    cannot be read, has a null hash.
    """
    base = F.regexp_replace(F.lit(str(root)), "^file:/*", "/")
    under = F.concat(F.lit("^"), F.regexp_replace(base, r"([.\\+*?\[^\]$(){}=!<>|:#-])", r"\\$1"), F.lit("/?"))

    def listed():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").option("ignoreCorruptFiles", "true").load(root)
        path = F.regexp_replace(F.regexp_replace(F.url_decode("path"), "^file:/*", "/"), under, "")
        return files.withColumn("relative_path", path).where(~excluded(F.concat(F.lit("./"), F.col("relative_path"))))

    every = listed().select("relative_path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_write_utc"))
    # The source skips a file above the filter on its length before it reads it.
    read = listed().where((F.col("length") <= HASHED_BYTES) & hashable(F.col("relative_path"), F.col("length"))).select("relative_path", F.sha2("content", 256).alias("content_hash"))
    at = F.col("relative_path")
    return every.join(read, "relative_path", "left").select(at, extension(at).alias("extension"), language(at).alias("language"), "size_bytes", "content_hash", "last_write_utc")


def locate_root(path: str) -> str:
    """The nearest folder at or above ``path`` with a ``.git``, else the starting folder."""
    start = Path(path).resolve()
    start = start if start.is_dir() else start.parent
    return str(next((p for p in (start, *start.parents) if (p / ".git").exists()), start))


def git_info(root: str, timeout: float = 10.0) -> dict:
    """Branch, head, remote and cleanliness; every part that git does not give is None."""

    def ask(*args):
        try:
            out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.strip() if out.returncode == 0 else None

    inside = ask("rev-parse", "--is-inside-work-tree") == "true"
    status = ask("status", "--porcelain") if inside else None
    branch = ask("branch", "--show-current") if inside else None
    return {
        "is_repository": inside, "branch": (branch or "(detached HEAD)") if inside else None, "head_commit": ask("rev-parse", "HEAD") if inside else None,
        "remote": ask("remote", "get-url", "origin") if inside else None, "clean": None if status is None else status == "",
    }


def renames(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(previous_path, current_path)`` of the renames in ``name-status`` lines."""
    part = F.split(column, "\t")
    return lines.where(F.col(column).startswith("R") & (F.size(part) == 3)).select(part[1].alias("previous_path"), part[2].alias("current_path")).distinct()


def projects(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Project files of XML: name, frameworks and project references.

    References that hold a variable are skipped; ``..`` is resolved against the
    project's folder, and what leads outside of the root is dropped.
    """
    body = F.col(text)
    name = F.nullif(F.trim(F.regexp_extract(body, r"<AssemblyName>\s*([^<]*?)\s*</AssemblyName>", 1)), F.lit(""))
    frameworks = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(r"<TargetFrameworks?>\s*([^<]*?)\s*</TargetFrameworks?>"), 1), lambda x: F.split(x, r"\s*;\s*")))
    raw = F.regexp_extract_all(body, F.lit(r"<ProjectReference\b[^>]*\bInclude=\"([^\"]*)\""), 1)
    raw = F.filter(raw, lambda x: ~x.contains("$(") & (x != ""))

    def resolve(reference):
        parts = F.split(F.concat_ws("/", F.nullif(directory(F.col(path)), F.lit("")), F.replace(reference, F.lit("\\"), F.lit("/"))), "/")
        step = lambda acc, p: (
            F.when(acc.isNull() | ((p == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
            .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((p == ".") | (p == ""), acc)
            .otherwise(F.concat(acc, F.array(p)))
        )
        return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")

    kept = F.array_sort(F.array_distinct(F.filter(F.transform(raw, resolve), lambda x: x.isNotNull())))
    return files.where(extension(F.col(path)) == ".csproj").select(
        F.col(path).alias("relative_path"), F.coalesce(name, stem(F.col(path))).alias("name"),
        F.array_distinct(F.filter(frameworks, lambda x: x != "")).alias("target_frameworks"), kept.alias("project_references"),
    )


def solutions(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(extension(F.col(path)) == ".sln").select(F.col(path).alias("relative_path"), stem(F.col(path)).alias("name"))


def ordered(files: DataFrame) -> DataFrame:
    """Files by path, whatever its case."""
    return files.orderBy(F.upper("relative_path"), "relative_path")
