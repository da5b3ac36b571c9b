"""Versioned JSON artifacts: snapshots, suites, catalogues; and their sinks."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SNAPSHOT_VERSION = 3
LOCATION = "array<struct<path:string,start_line:int,end_line:int>>"
ENTITY = f"id string, name string, full_name string, entity_type string, language string, path string, start_line int, end_line int, project_id string, resolution string, additional_locations {LOCATION}"
RELATION = "source_id string, target_id string, relation_type string, path string, start_line int, end_line int, resolution string"
PROJECT = "id string, name string, relative_path string, language string, target_frameworks array<string>, project_references array<string>, documents array<string>, mode string"
FILE = "relative_path string, extension string, language string, size_bytes bigint, content_hash string, last_write_utc timestamp"
TABLES = {"files": FILE, "projects": PROJECT, "entities": ENTITY, "relations": RELATION}


def load(spark: SparkSession, path: str, version: int = SNAPSHOT_VERSION) -> tuple[str, dict[str, DataFrame]]:
    """Status NotFound, Corrupt, Incompatible or Loaded, and the snapshot's tables. Never raises for a bad file.

    A snapshot is a folder with ``snapshot.json`` (its version) and one JSON-lines table per part, read with a
    fixed schema; ``latest`` beside the versions names the current one.
    """
    try:
        reader = spark.read.text(f"{path}/snapshot.json", wholetext=True).first()
    except Exception as e:  # Spark's analysis errors name no common class for a missing path
        if "PATH_NOT_FOUND" in str(e):
            return "NotFound", {}
        raise
    try:
        head = json.loads(reader[0])
        found = head["schemaVersion"]
    except (ValueError, KeyError, TypeError):
        return "Corrupt", {}
    if found != version:
        return "Incompatible", {}
    return "Loaded", {name: spark.read.schema(ddl).option("mode", "FAILFAST").json(f"{path}/{name}") for name, ddl in TABLES.items()}


def save(root: str, tables: dict[str, DataFrame], head: dict) -> str:
    """Write a new version beside the old ones, then swap the pointer in one step."""
    version = hashlib.sha256(f"{time.time_ns()}".encode()).hexdigest()[:12]
    path = f"{root}/v-{version}"
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
    atomic_write(Path(path) / "snapshot.json", json.dumps({"schemaVersion": SNAPSHOT_VERSION} | head))
    atomic_write(Path(root) / "latest", path)
    return path


def latest(root: str) -> str | None:
    at = Path(root) / "latest"
    return at.read_text() if at.exists() else None


def atomic_write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_suffix(path.suffix + ".tmp")
    with open(temp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def guarded_write(path: Path, text: str, expected: str | None, wait: float = 5.0, retry: float = 0.025) -> str:
    """Replace a small artifact if it still has the ``expected`` fingerprint; Unchanged, Written or Conflict.

    An exclusive lock on a sibling file holds off other writers; ``expected`` None means that it must not exist.
    """
    mark = lambda: hashlib.sha256(path.read_bytes()).hexdigest() if path.exists() else None
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path.with_suffix(path.suffix + ".lock"), "w") as lock:
        end = time.monotonic() + wait
        while True:
            try:
                fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() >= end:
                    raise TimeoutError(f"{path} is locked by another writer") from None
                time.sleep(retry)
        if mark() != expected:
            return "Conflict"
        if path.exists() and path.read_text(encoding="utf-8") == text:
            return "Unchanged"
        atomic_write(path, text)
        return "Written"


def suite(text: str, version: int, ident: str = "id", known: set[str] | None = None) -> list[dict]:
    """Cases of a strict JSON suite: right version, no unknown members, no repeated ids, no paths that lead outside."""
    data = json.loads(text)
    if data.get("schemaVersion") != version:
        raise ValueError(f"schema version {data.get('schemaVersion')} is not {version}")
    cases = data["cases"]
    ids = [c[ident] for c in cases]
    if len(set(ids)) != len(ids):
        raise ValueError("repeated case ids")
    for c in cases:
        if known is not None and set(c) - known:
            raise ValueError(f"unknown members {sorted(set(c) - known)}")
        for key, value in c.items():
            if key.endswith("Path") and (os.path.isabs(value) or ".." in Path(value).parts):
                raise ValueError(f"{value} leads outside of the suite")
    return cases


def json_schema(kind: T.DataType) -> dict:
    """Strict JSON schema of a Spark type: every member is required and no other is allowed."""
    if isinstance(kind, T.StructType):
        props = {f.name: json_schema(f.dataType) for f in kind.fields}
        return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return {"type": "integer"}
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return {"type": "number"}
    return {"type": "string"}


def canonical_json(value) -> str:
    """Sorted keys and no spaces; lists of plain values sorted, each once."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            items = [clean(x) for x in v]
            return sorted(set(items)) if all(isinstance(x, str) for x in items) else items
        return v

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def save_results(root: str, results: DataFrame, baseline: bool = False) -> str:
    """Write an evaluation's rows beside earlier ones; they become the baseline only where that is asked for."""
    path = f"{root}/results/r-{hashlib.sha256(f'{time.time_ns()}'.encode()).hexdigest()[:12]}"
    results.write.json(path)
    if baseline:
        atomic_write(Path(root) / "baseline", path)
    return path


def baseline(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame | None:
    at = Path(root) / "baseline"
    return spark.read.schema(schema).json(at.read_text()) if at.exists() else None


class MemoryStore:
    """Snapshots of one session by repository and branch; nothing is written."""

    def __init__(self):
        self.kept: dict[tuple[str, str], dict[str, DataFrame]] = {}

    def save(self, repository: str, branch: str, tables: dict[str, DataFrame]) -> None:
        self.kept[repository, branch] = dict(tables)

    def load(self, repository: str, branch: str) -> tuple[str, dict[str, DataFrame]]:
        found = self.kept.get((repository, branch))
        return ("NotFound", {}) if found is None else ("Loaded", dict(found))
