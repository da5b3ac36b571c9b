"""Knowledge notes: building, front matter, integrity and incremental sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.hashing import content_hash, fingerprint, note_file_name, quote, wiki_target
from gneiss.operators.relational import duplicates, top_per_key

#: Bounds of the lists in notes.
COMPONENTS, MEMBERS, LOCATIONS, DIAGNOSTICS, LINKS, LANGUAGES = 100, 40, 10, 10, 50, 20
WIKI = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"


def wiki_link(path: Column, label: Column) -> Column:
    return F.concat(F.lit("[["), wiki_target(path), F.lit("|"), F.translate(label, "[]|", "()/"), F.lit("]]"))


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit(k + ": "), quote(v.cast("string"))) for k, v in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def component_notes(components: DataFrame, members: DataFrame) -> DataFrame:
    """``(identity, kind, path, source_id, source_fingerprint, content)``: a note per component, with its first members.

    ``components(id, name, full_name, path, project)``, ``members(id, member)``. What is beyond the bound is
    counted in an ``additional`` line.
    """
    shown = top_per_key(members, ["id"], [F.col("member")], MEMBERS)
    lists = shown.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "member"))), lambda x: F.concat(F.lit("- "), x.member)), "\n").alias("list"), F.max("additional").alias("more"))
    rows = components.join(lists, "id", "left")
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), F.coalesce("list", F.lit("")), F.when(F.col("more") > 0, F.concat(F.lit("- additional: "), F.col("more").cast("string"))))
    print_ = fingerprint(F.col("full_name"), F.col("path"), F.col("project"), F.col("list"), F.col("more"))
    head = front_matter([("kind", F.lit("Component")), ("source", F.col("id").cast("string")), ("fingerprint", print_)])
    ident = F.concat(F.lit("component:"), F.col("id").cast("string"))
    return rows.select(ident.alias("identity"), F.lit("Component").alias("kind"), F.concat(F.lit("components/"), note_file_name(F.col("name"), F.col("id").cast("string"))).alias("path"), F.col("id").cast("string").alias("source_id"), print_.alias("source_fingerprint"), F.concat(head, body).alias("content"))


def log_fingerprint(notes: DataFrame) -> DataFrame:
    """One row: the fingerprint of all fingerprints, in the order of paths.

    Each row is hashed where it lies; only hashes are gathered.
    """
    rows = F.array_sort(F.collect_list(F.struct("path", "source_fingerprint")))
    return notes.agg(F.sha2(F.array_join(F.transform(rows, lambda x: x.source_fingerprint), "\n"), 256).alias("fingerprint"))


def links(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(WIKI), 1))).alias("target"))


def broken_links(notes: DataFrame) -> DataFrame:
    known = notes.select(F.lower(wiki_target(F.col("path"))).alias("_t")).distinct()
    found = links(notes)
    return found.join(known, F.lower(found.target) == known._t, "left_anti")


def integrity(notes: DataFrame, projects: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of counters: repeated identities and paths, broken links, unknown sources, wrong hashes, blank contents, unsafe paths."""
    lost = notes.where("source_id is not null and kind = 'Project'").join(projects.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("identity")
    lost = lost.unionByName(notes.where("source_id is not null and kind = 'Component'").join(entities.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("identity"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    hashed = "content_hash" in notes.columns
    wrong = notes.where(F.col("content_hash") != content_hash(F.col("content"))) if hashed else notes.limit(0)
    parts = [
        one(duplicates(notes, ["identity"]), "duplicate_identities"), one(duplicates(notes.withColumn("path", F.lower("path")), ["path"]), "duplicate_paths"), one(broken_links(notes), "broken_links"),
        one(lost, "missing_sources"), one(wrong, "wrong_hashes"), one(notes.where("trim(content) = ''"), "blank_notes"), one(notes.where(F.exists(F.split("path", "/"), lambda p: p.isin("", ".", ".."))), "unsafe_paths"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def sync(desired: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """``(path, action)``: created, updated, reused or deleted for every managed note.

    A note is reused only if its fingerprint, the hash in the manifest and the hash of the stored file all
    agree. Only managed notes are ever deleted. Paths match whatever their case.
    """
    d = desired.select(F.lower("path").alias("k"), F.col("path").alias("d_path"), F.col("source_fingerprint").alias("d_f"), content_hash(F.col("content")).alias("d_h"))
    m = manifest.select(F.lower("path").alias("k"), F.col("path").alias("m_path"), F.col("source_fingerprint").alias("m_f"), F.col("content_hash").alias("m_h"))
    s = stored.select(F.lower("path").alias("k"), F.col("content_hash").alias("s_h"))
    rows = d.join(m, "k", "full").join(s, "k", "left")
    same = (F.col("d_f") == F.col("m_f")) & (F.col("d_h") == F.col("m_h")) & (F.col("s_h") == F.col("m_h"))
    action = F.when(F.col("d_path").isNull(), "deleted").when(F.col("m_path").isNull(), "created").when(F.coalesce(same, F.lit(False)), "reused").otherwise("updated")
    return rows.select(F.coalesce("d_path", "m_path").alias("path"), action.alias("action"))


def stored_state(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: managed notes that are missing or changed, and files that no manifest names."""
    both = manifest.select(F.lower("path").alias("k"), F.col("content_hash").alias("m")).join(stored.select(F.lower("path").alias("k"), F.col("content_hash").alias("s"), F.lit(True).alias("there")), "k", "full")
    return both.agg(F.count_if(F.col("m").isNotNull() & F.col("there").isNull()).alias("missing"), F.count_if(F.col("m") != F.col("s")).alias("changed"), F.count_if(F.col("m").isNull()).alias("orphaned"))


def _note(rows: DataFrame, kind: str, key, path, source, body) -> DataFrame:
    """A note per row; its fingerprint is that of its body."""
    print_ = fingerprint(F.lit(kind), body)
    head = front_matter([("kind", F.lit(kind)), ("source", source), ("fingerprint", print_)])
    return rows.select(key.alias("identity"), F.lit(kind).alias("kind"), path.alias("path"), source.alias("source_id"), print_.alias("source_fingerprint"), F.concat(head, body).alias("content"))


def _listed(rows: DataFrame, key: str, order: list, line, most: int) -> DataFrame:
    """``(key, list)``: the first ``most`` lines of each key, and how many more there are."""
    top = top_per_key(rows.select(key, *order, line.alias("_line")), [key], [F.col(o) for o in order] + [F.col("_line")], most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda x: F.concat(F.lit("- "), x._line)), "\n")
    more = F.max("additional")
    return top.groupBy(key).agg(F.concat(lines, F.when(more > 0, F.concat(F.lit("\n- additional: "), more.cast("string"))).otherwise("")).alias("list"))


def project_notes(projects: DataFrame, components: DataFrame, references: DataFrame) -> DataFrame:
    """A note per project of ``projects(id, name, relative_path)``: its ``references(id, target)``, what refers to it, and its ``components(project_id, name, path)``."""
    path = F.concat(F.lit("projects/"), note_file_name(F.col("name"), F.col("id")))
    label = projects.select(F.col("id").alias("_id"), wiki_link(path, F.col("name")).alias("_link"))
    to = references.join(label, references.target == label._id).select("id", "_link")
    back = references.select(F.col("target").alias("id"), F.col("id").alias("_from")).join(label, F.col("_from") == label._id).select("id", "_link")
    inside = components.select(F.col("project_id").alias("id"), wiki_link(F.concat(F.lit("components/"), note_file_name(F.col("name"), F.col("id"))), F.col("name")).alias("_link"))
    rows = projects
    for name, part, most in (("references", to, LINKS), ("referenced", back, LINKS), ("components", inside, COMPONENTS)):
        rows = rows.join(_listed(part, "id", ["_link"], F.col("_link"), most).withColumnRenamed("list", "_" + name), "id", "left")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.col("name")), F.concat(F.lit("path: "), F.col("relative_path")), F.lit("## References"), F.coalesce("_references", F.lit("")),
        F.lit("## Referenced by"), F.coalesce("_referenced", F.lit("")), F.lit("## Components"), F.coalesce("_components", F.lit("")),
    )
    return _note(rows, "Project", F.concat(F.lit("project:"), F.col("id")), path, F.col("id"), body)


def overview_notes(repository: DataFrame, projects: DataFrame, languages: DataFrame, relations: DataFrame) -> DataFrame:
    """The root index and the architecture overview of each ``repository(id, name)``.

    ``projects(repository_id, id, name)`` are linked from the root; ``languages(repository_id, language, files)`` and
    ``relations(repository_id, relation_type, n)`` are listed by number.
    """
    link = wiki_link(F.concat(F.lit("projects/"), note_file_name(F.col("name"), F.col("id"))), F.col("name"))
    listed = _listed(projects.select(F.col("repository_id"), link.alias("_l")), "repository_id", ["_l"], F.col("_l"), LINKS)
    spoken = _listed(languages.withColumn("_down", -F.col("files")), "repository_id", ["_down"], F.concat_ws(": ", "language", F.col("files").cast("string")), LANGUAGES).withColumnRenamed("list", "spoken")
    kinds = _listed(relations.withColumn("_down", -F.col("n")), "repository_id", ["_down"], F.concat_ws(": ", "relation_type", F.col("n").cast("string")), LINKS).withColumnRenamed("list", "kinds")
    rows = repository.withColumn("repository_id", F.col("id"))
    for part in (listed, spoken, kinds):
        rows = rows.join(part, "repository_id", "left")
    none = F.lit("")
    root = F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), F.lit("## Projects"), F.coalesce("list", none), F.lit("[[architecture|Architecture]]"))
    plan = F.concat_ws("\n", F.concat(F.lit("# Architecture of "), F.col("name")), F.lit("## Languages"), F.coalesce("spoken", none), F.lit("## Relations"), F.coalesce("kinds", none))
    none_id = F.lit(None).cast("string")
    one = _note(rows, "RootIndex", F.concat(F.lit("root:"), F.col("id")), F.lit("index.md"), none_id, root)
    return one.unionByName(_note(rows, "ArchitectureOverview", F.concat(F.lit("architecture:"), F.col("id")), F.lit("architecture.md"), none_id, plan))


def log_note(notes: DataFrame) -> DataFrame:
    """The log: how many notes of each kind there are, and the fingerprint of all."""
    counts = notes.groupBy("kind").agg(F.count("*").alias("n"))
    lines = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(F.lit("- "), x.kind, F.lit(": "), x.n.cast("string"))), "\n").alias("lines"))
    rows = lines.crossJoin(log_fingerprint(notes))
    body = F.concat_ws("\n", F.lit("# Log"), F.col("lines"), F.concat(F.lit("fingerprint: "), F.col("fingerprint")))
    return _note(rows, "Log", F.lit("log"), F.lit("log.md"), F.lit(None).cast("string"), body)
