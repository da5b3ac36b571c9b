"""Queries over the driver's tables: one for each operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.functions import hashing as H
from gneiss.functions import text as X
from gneiss.operators import concepts, evaluation, evidence, graph, incremental, knowledge, live, outbound, policy, relational, retrieval
from gneiss.plans.registry import QUERIES, SQL, query, raw_sql, sql_list, tokens_sql
from gneiss.sources import files

__all__ = ["QUERIES", "SQL"]

# ---------------------------------------------------------------- files and scalars

PATH = r"regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"
NAME = f"regexp_extract({PATH}, '([^/]*)$', 1)"
EXT = f"lower(regexp_extract({NAME}, '(\\.[^.]+)$', 1))"
LANG = f"CASE {EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.LANGUAGES.items()) + " ELSE 'Other' END"


def page_files(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"), "html")


@query(f"SELECT page_id, {PATH} AS path, {EXT} AS extension, {LANG} AS language, octet_length(encode(html)) AS size_bytes FROM pages")
def file_inventory(spark, t):
    f = page_files(t)
    return f.select("page_id", "path", files.extension(F.col("path")).alias("extension"), files.language(F.col("path")).alias("language"), F.octet_length("html").cast("long").alias("size_bytes"))


@query(f"SELECT {EXT} AS extension, {LANG} AS language, count(*) AS n_files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS total_bytes FROM pages GROUP BY 1, 2")
def extension_language(spark, t):
    f = page_files(t)
    return f.groupBy(files.extension(F.col("path")).alias("extension"), files.language(F.col("path")).alias("language")).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("html").cast("long")).alias("total_bytes"))


@query(f"SELECT page_id, len(list_filter(string_split(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/'), lambda p: list_contains({sql_list([x.lower() for x in files.EXCLUDED])}, p))) > 0 AS is_excluded FROM (SELECT page_id, replace({PATH}, '/en/', '/Build/') AS path FROM pages)")
def excluded_dirs(spark, t):
    path = F.replace("path", F.lit("/en/"), F.lit("/Build/"))
    return page_files(t).withColumn("path", path).select("page_id", files.excluded(F.col("path")).alias("is_excluded"))


@query("""SELECT page_id, octet_length(encode(html)) <= 20971520 AND ext IN (""" + ", ".join(f"'{k}'" for k in files.LANGUAGES) + """)
  AND NOT (starts_with(name, '.env') OR name = 'appsettings.json' OR (starts_with(name, 'appsettings.') AND ends_with(name, '.json')) OR contains(name, 'secret') OR contains(name, 'credential')) AS is_hashable
FROM (SELECT page_id, html, name, regexp_extract(name, '(\\.[^.]+)$', 1) AS ext FROM (SELECT page_id, html, 'f' || page_id || ['.cs', '.env', '.json', '.html', 'secret.py'][1 + page_id % 5] AS name FROM pages))""")
def hash_eligibility(spark, t):
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, [".cs", ".env", ".json", ".html", "secret.py"])), (F.col("page_id") % 5 + 1).cast("int")))
    return t.pages.withColumn("name", name).select("page_id", files.hashable(F.col("name"), F.octet_length("html")).alias("is_hashable"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(regexp_replace('https://me:pw@' || split_part(url, '://', 2), '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1') ELSE url END AS remote FROM pages")
def sanitized_remote(spark, t):
    return t.pages.select("page_id", files.sanitize_remote(F.concat(F.lit("https://me:pw@"), F.substring_index("url", "://", -1))).alias("remote"))


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_sha256(spark, t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@query("SELECT doc_id, sha256(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM documents")
def normalized_content_hash(spark, t):
    return t.documents.select("doc_id", H.content_hash(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("content_hash"))


@query("SELECT c_custkey, sha256(c_name || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '<null>' ELSE c_mktsegment END || chr(10) || CAST(c_nationkey AS VARCHAR)) AS fingerprint FROM customer")
def null_safe_fingerprint(spark, t):
    return t.customer.select("c_custkey", H.fingerprint(F.col("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), F.col("c_nationkey")).alias("fingerprint"))


@query("SELECT c_custkey, 'entity:' || sha256('file-v1|c#|Class|' || 'src/' || c_mktsegment || '/' || c_name || '|' || c_name) AS file_id, 'entity:' || sha256('symbol-v2|c#|' || c_nationkey || '|Class|' || c_name) AS symbol_id, substr(sha256(c_name), 1, 24) AS repository_id FROM customer")
def stable_entity_id(spark, t):
    path = F.concat(F.lit("/src\\"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"))
    return t.customer.select(
        "c_custkey", H.file_entity_id(F.lit("C#"), F.lit("Class"), path, F.col("c_name")).alias("file_id"),
        H.symbol_entity_id(F.lit("C#"), F.col("c_nationkey").cast("string"), F.lit("Class"), F.col("c_name")).alias("symbol_id"), H.repository_id(F.col("c_name")).alias("repository_id"),
    )


@query("SELECT c_custkey, lower(regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace(branch, '[^A-Za-z0-9._-]', '-', 'g'), '-{2,}', '-', 'g'), 1, 48), '^[ .-]+', ''), '[ .-]+$', '')) || '--' || substr(sha256(branch), 1, 12) AS branch_key FROM (SELECT c_custkey, 'feature/' || c_mktsegment || '//' || c_name AS branch FROM customer)")
def branch_key(spark, t):
    branch = F.concat(F.lit("feature/"), F.col("c_mktsegment"), F.lit("//"), F.col("c_name"))
    return t.customer.select("c_custkey", H.branch_key(branch).alias("branch_key"))


@query("SELECT c_custkey, 'entity' || '--' || substr(sha256(c_name), 1, 12) || '.md' AS note, '\"' || c_name || '\"' AS quoted, 'ROOT_INDEX' AS marker FROM customer")
def keys_and_markers(spark, t):
    return t.customer.select("c_custkey", H.note_file_name(F.lit("entity"), F.col("c_name")).alias("note"), H.quote(F.col("c_name")).alias("quoted"), H.marker(F.lit("RootIndex")).alias("marker"))


@query(f"SELECT doc_id, len(list_distinct({raw_sql('text')})) AS n_tokens, sha256(array_to_string(list_sort(list_distinct({raw_sql('text')})), ' ')) AS tokens_sha256 FROM documents")
def tokenize_distinct(spark, t):
    distinct = t.wide("documents").select("doc_id", F.array_sort(F.array_distinct(X.raw_tokens(F.col("text")))).alias("t"))
    return distinct.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"SELECT item_id, array_to_string({tokens_sql('text')}, ' ') AS phrase FROM benchmark")
def normalized_phrase(spark, t):
    return t.benchmark.select("item_id", X.phrase(F.col("text")).alias("phrase"))


@query(f"SELECT doc_id, len(tk) AS n_tokens, sha256(array_to_string(tk, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents)")
def stopword_synonym_tokens(spark, t):
    rows = t.wide("documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


DF = f"SELECT term, count(*) AS df FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term"


@query(DF)
def document_frequency(spark, t):
    return t.wide("documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT term, CAST(least(greatest(round(ln((n + 1) / (df + 1.0)) / ln(n + 1.0) * 4), 0), 4) AS INTEGER) AS points FROM ({DF}), (SELECT count(*) AS n FROM documents)")
def term_rarity_points(spark, t):
    n = t.documents.agg(F.count("*").alias("n"))
    return document_frequency(spark, t).crossJoin(n).select("term", X.rarity_points(F.col("df"), F.col("n")).alias("points"))


@query("SELECT doc_id, CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n FROM documents")
def ordinal_substring_count(spark, t):
    return t.documents.select("doc_id", X.ordinal_count(F.col("text"), F.lit("the")).alias("n"))


@query("SELECT conv_id, sha256(string_agg('BEGIN_COMPONENT_NOTE' || chr(10) || text || chr(10) || 'END_COMPONENT_NOTE', chr(10) || chr(10) ORDER BY turn, text)) AS rendered_sha256 FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def segment_render(spark, t):
    s = t.conversations.where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content"), F.lit("ComponentNote").alias("kind")))).alias("s"))
    return s.select("conv_id", F.sha2(H.render_segments(F.col("s")), 256).alias("rendered_sha256"))


# ---------------------------------------------------------------- aggregates, joins, ranks, sets


@query("SELECT lang AS language, count(*) AS file_count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents GROUP BY lang")
def language_statistics(spark, t):
    return t.documents.groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("file_count"), F.sum(F.octet_length("text").cast("long")).alias("total_bytes"))


@query("SELECT event_type, count(*) AS n, CAST(array_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) AS INTEGER) AS ordinal FROM events GROUP BY event_type")
def entity_type_statistics(spark, t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("ordinal", graph.ordinal(F.col("event_type"), ["view", "click", "signup", "purchase", "error"]))


@query("WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, (SELECT count(*) FROM g) > 10 AS has_more FROM g ORDER BY n DESC, user_id, event_type LIMIT 10")
def diagnostics_top10(spark, t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # Ranks stop at eleven, which says whether there are more than ten.
    top = g.orderBy(F.desc("n"), "user_id", "event_type").limit(11).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "user_id", "event_type")))
    return top.withColumn("has_more", F.max("r").over(W.partitionBy()) > 10).where("r <= 10").select("user_id", "event_type", "n", "has_more")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, t):
    return relational.duplicates(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT sha256(text) AS content, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content_groups(spark, t):
    return relational.duplicates(t.documents.select(F.sha2("text", 256).alias("content")), ["content"])


CLAIMED = "(SELECT l_orderkey + CASE WHEN l_linenumber = 6 THEN 10000000 ELSE 0 END AS o, l_suppkey AS s, l_partkey AS p, l_linenumber AS n FROM lineitem)"


def claimed(t):
    return t.lineitem.select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 6, 10_000_000).otherwise(0)).alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"))


@query(f"SELECT DISTINCT 'O' || o AS source_id, 'S' || s AS target_id FROM {CLAIMED} WHERE o NOT IN (SELECT o_orderkey FROM orders) OR s NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_relations(spark, t):
    return graph.dangling(reference_edges(t, True).select("source_id", "target_id"), all_nodes(t).select("id"))


@query(f"""SELECT (SELECT count(*) FROM (SELECT id FROM (SELECT 'O' || o_orderkey AS id FROM orders UNION ALL SELECT 'S' || s_suppkey FROM supplier) GROUP BY id HAVING count(*) > 1)) AS duplicate_ids,
  (SELECT count(*) FROM (SELECT o, s FROM {CLAIMED} GROUP BY o, s HAVING count(*) > 1)) AS duplicate_relations,
  (SELECT count(*) FROM (SELECT DISTINCT o, s FROM {CLAIMED} WHERE o NOT IN (SELECT o_orderkey FROM orders) OR s NOT IN (SELECT s_suppkey FROM supplier))) AS dangling, false AS is_valid""")
def integrity_summary(spark, t):
    nodes = t.orders.select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("id")).unionByName(t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id")))
    edges = claimed(t).select(F.concat(F.lit("O"), F.col("o")).alias("source_id"), F.concat(F.lit("S"), F.col("s")).alias("target_id"), F.lit("References").alias("relation_type"))
    return graph.integrity(nodes, edges)


def ident(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def all_nodes(t):
    """Region, nation, customer, order and supplier as typed nodes."""
    parts = [
        t.region.select(ident("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Namespace").alias("entity_type")),
        t.nation.select(ident("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Project").alias("entity_type")),
        t.customer.select(ident("C", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Class").alias("entity_type")),
        t.supplier.select(ident("S", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Interface").alias("entity_type")),
        t.orders.select(ident("O", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("Record").alias("entity_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contains_edges(t):
    edge = lambda df, s, d: df.select(s.alias("source_id"), d.alias("target_id"))
    out = edge(t.nation, ident("R", "n_regionkey"), ident("N", "n_nationkey"))
    for df, s, d in ((t.customer, ident("N", "c_nationkey"), ident("C", "c_custkey")), (t.supplier, ident("N", "s_nationkey"), ident("S", "s_suppkey")), (t.orders, ident("C", "o_custkey"), ident("O", "o_orderkey"))):
        out = out.unionByName(edge(df, s, d))
    return out


def reference_edges(t, corrupt=False):
    rows = claimed(t) if corrupt else t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    return rows.select("o", "s").distinct().select(ident("O", "o").alias("source_id"), ident("S", "s").alias("target_id"), F.lit("References").alias("relation_type"))


NODES = """(SELECT 'R' || r_regionkey AS id, 'Namespace' AS entity_type FROM region UNION ALL SELECT 'N' || n_nationkey, 'Project' FROM nation UNION ALL SELECT 'C' || c_custkey, 'Class' FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'Interface' FROM supplier UNION ALL SELECT 'O' || o_orderkey, 'Record' FROM orders)"""
CONTAINS = """(SELECT 'R' || n_regionkey AS source_id, 'N' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
 UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""


@query("SELECT source_id, target_id, resolution, path FROM (SELECT l_orderkey AS source_id, l_suppkey AS target_id, l_returnflag AS resolution, l_linestatus AS path, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY array_position(['A', 'N', 'R'], l_returnflag), l_linestatus, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def edge_dedup_best_evidence(spark, t):
    letters = dict(zip(["A", "N", "R"], graph.RESOLUTION))
    read = lambda names, c: F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), c)
    e = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit("References").alias("relation_type"), read(letters, F.col("l_returnflag")).alias("resolution"), F.col("l_linestatus").alias("path"), F.col("l_linenumber").alias("start_line"))
    back = read({v: k for k, v in letters.items()}, F.col("resolution"))
    return graph.dedup_edges(e).select("source_id", "target_id", back.alias("resolution"), "path")


PREVIOUS = "(SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN translate(text, 'aeiou', 'AEIOU') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)"
CURRENT = "(SELECT doc_id, source, text FROM documents WHERE doc_id % 11 <> 0)"


def previous(t):
    return t.documents.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.translate("text", "aeiou", "AEIOU")).otherwise(F.col("text")))


def current(t):
    return t.documents.where("doc_id % 11 <> 0")


@query(f"""WITH bad AS (SELECT DISTINCT source FROM documents WHERE doc_id % 13 = 0), new AS (SELECT * FROM {CURRENT} WHERE source IN (SELECT source FROM bad))
SELECT doc_id, source, sha256(text) AS content FROM {PREVIOUS} WHERE source NOT IN (SELECT source FROM bad) AND doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, source, sha256(text) FROM new""")
def graph_merge_upsert(spark, t):
    bad = t.documents.where("doc_id % 13 = 0").select("source").distinct()
    slim = lambda df: df.select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return graph.merge(slim(previous(t)), slim(current(t).join(F.broadcast(bad), "source", "left_semi")), bad, ["doc_id"], "source").select("doc_id", "source", "content")


@query(f"SELECT id FROM {NODES} n WHERE entity_type IN ('Class', 'Interface', 'Record', 'Enum') AND id NOT IN (SELECT c.target_id FROM {CONTAINS} c JOIN {NODES} p ON c.source_id = p.id WHERE p.entity_type IN ('Class', 'Interface', 'Record', 'Enum'))")
def top_level_components(spark, t):
    return graph.top_level(all_nodes(t), contains_edges(t), graph.COMPONENT).select("id")


@query(f"SELECT target_id AS child, min(source_id) AS parent FROM {CONTAINS} GROUP BY target_id")
def parent_map(spark, t):
    return graph.parents(contains_edges(t))


@query(f"SELECT source_id AS parent, array_to_string(list_sort(list(target_id)), ',') AS children FROM {CONTAINS} GROUP BY source_id")
def children_lists(spark, t):
    return graph.children(contains_edges(t)).withColumn("children", F.array_join("children", ","))


@query(f"""WITH RECURSIVE up AS (SELECT target_id AS child, min(source_id) AS parent FROM {CONTAINS} GROUP BY target_id), walk AS (SELECT id, id AS node, 0 AS d FROM {NODES} UNION ALL SELECT w.id, up.parent, d + 1 FROM walk w JOIN up ON w.node = up.child)
SELECT n.id, a.ancestor FROM {NODES} n LEFT JOIN (SELECT id, min_by(node, d) AS ancestor FROM walk WHERE d > 0 AND starts_with(node, 'R') GROUP BY id) a ON n.id = a.id""")
def nearest_ancestor(spark, t):
    return graph.nearest_ancestor(all_nodes(t), contains_edges(t), "Namespace")


@query("""WITH sel AS (SELECT n_nationkey AS query_id, 'S' || s_suppkey AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey), e AS (SELECT DISTINCT 'O' || l_orderkey AS o, 'S' || l_suppkey AS s FROM lineitem)
SELECT query_id, id, neighbour FROM (SELECT query_id, e.o AS id, e.s AS neighbour, row_number() OVER (PARTITION BY query_id ORDER BY e.o, e.s) AS r FROM sel JOIN e ON sel.id = e.s) WHERE r <= 5""")
def depth1_expansion(spark, t):
    sel = t.supplier.select(F.col("s_nationkey").alias("query_id"), ident("S", "s_suppkey").alias("id"))
    return graph.expand(sel, reference_edges(t), all_nodes(t).select("id")).select("query_id", "id", "neighbour")


BN = """(SELECT s, d FROM (SELECT c_nationkey AS s, s_nationkey AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(sum(l_extendedprice), 2) DESC, s_nationkey) AS r
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE r <= 2)"""


def nation_edges(t):
    """Each customer nation's two largest supplier nations."""
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy(F.col("c_nationkey").alias("source_id"), F.col("s_nationkey").alias("target_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return sums.withColumn("r", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("v"), "target_id"))).where("r <= 2").select("source_id", "target_id")


@query(f"WITH RECURSIVE e AS {BN}, reach AS (SELECT n_nationkey AS seed, n_nationkey AS node FROM nation UNION SELECT r.seed, e.s FROM reach r JOIN e ON e.d = r.node) SELECT seed, node FROM reach")
def transitive_dependents(spark, t):
    return graph.dependents(nation_edges(t), t.nation.select(F.col("n_nationkey").alias("seed")))


@query(f"""SELECT CASE WHEN p.doc_id IS NULL THEN 'Added' WHEN c.doc_id IS NULL THEN 'Deleted' ELSE 'Modified' END AS kind, coalesce(p.doc_id, c.doc_id) AS doc_id
FROM {PREVIOUS} p FULL OUTER JOIN {CURRENT} c ON p.doc_id = c.doc_id WHERE p.doc_id IS NULL OR c.doc_id IS NULL OR sha256(p.text) <> sha256(c.text)""")
def snapshot_diff(spark, t):
    return snapshot_changes(t).select("kind", F.coalesce("current_path", "previous_path").cast("long").alias("doc_id"))


def snapshot_changes(t):
    shape = lambda df: df.select(F.col("doc_id").cast("string").alias("relative_path"), F.sha2("text", 256).alias("content_hash"), F.length("text").alias("size_bytes"), F.lit(0).alias("last_write_utc"))
    return incremental.diff(shape(previous(t)), shape(current(t)))


@query(f"""WITH gone AS (SELECT doc_id FROM {PREVIOUS} WHERE doc_id % 11 = 0), new AS (SELECT doc_id FROM {CURRENT} WHERE doc_id % 10 = 0), r AS (SELECT g.doc_id AS p, n.doc_id AS c FROM gone g JOIN new n ON n.doc_id = g.doc_id - 1)
SELECT kind, p, c FROM (SELECT 'Renamed' AS kind, p, c FROM r UNION ALL SELECT 'Deleted', doc_id, NULL FROM gone WHERE doc_id NOT IN (SELECT p FROM r) UNION ALL SELECT 'Added', NULL, doc_id FROM new WHERE doc_id NOT IN (SELECT c FROM r))""")
def proven_renames(spark, t):
    r = t.documents.where("doc_id % 11 = 0").select(F.col("doc_id").cast("string").alias("previous_path"), (F.col("doc_id") - 1).cast("string").alias("current_path"))
    out = incremental.with_renames(snapshot_changes(t), r).where("kind <> 'Modified'")
    return out.select("kind", F.col("previous_path").cast("long").alias("p"), F.col("current_path").cast("long").alias("c"))


AFFECTED = f"""WITH RECURSIVE e AS {BN}, direct AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey % 6 = 0), reach AS (SELECT node FROM direct UNION SELECT e.s FROM reach r JOIN e ON e.d = r.node)"""


def affected_plan(t):
    e, now = nation_edges(t), t.nation.select(F.col("n_nationkey").alias("project"))
    return incremental.affected(now.where("project % 6 = 0"), e, e, now.where("project <> 12")), now


@query(AFFECTED + " SELECT node AS project, node IN (SELECT node FROM direct) AS is_direct, node <> 12 AS analyze FROM reach")
def affected_partitions(spark, t):
    return affected_plan(t)[0]


@query(AFFECTED + " SELECT n_nationkey AS project FROM nation WHERE n_nationkey NOT IN (SELECT node FROM reach WHERE node <> 12)")
def reused_partitions(spark, t):
    plan, now = affected_plan(t)
    return incremental.reused(now, plan)


PREFIXES = f"(SELECT DISTINCT regexp_extract({PATH}, '^([^/]*)', 1) AS prefix FROM pages UNION SELECT DISTINCT regexp_extract({PATH}, '^([^/]*/[^/]*)/', 1) FROM pages WHERE page_id % 2 = 0)"


@query(f"SELECT path, owner FROM (SELECT p.path, o.prefix AS owner, row_number() OVER (PARTITION BY p.path ORDER BY length(o.prefix) DESC) AS r FROM (SELECT DISTINCT {PATH} AS path FROM pages) p LEFT JOIN (SELECT prefix FROM {PREFIXES} WHERE prefix <> '') o ON starts_with(p.path, o.prefix || '/')) WHERE r = 1")
def longest_prefix_owner(spark, t):
    f = page_files(t)
    one, two = F.regexp_extract("path", "^([^/]*)", 1), F.regexp_extract("path", "^([^/]*/[^/]*)/", 1)
    owners = f.select(one.alias("prefix")).unionByName(f.where("page_id % 2 = 0").select(two.alias("prefix"))).distinct().where("prefix <> ''")
    return graph.longest_prefix_owner(f, owners.withColumn("owner", F.col("prefix")))


@query("SELECT n_nationkey FROM (SELECT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)")
def set_union(spark, t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).union(t.supplier.where("s_acctbal < 2000").select("s_nationkey")).distinct()


@query("SELECT DISTINCT c_nationkey AS n_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)")
def set_except(spark, t):
    return t.customer.select(F.col("c_nationkey").alias("n_nationkey")).subtract(t.supplier.where("s_acctbal < 2000").select("s_nationkey"))


@query("SELECT DISTINCT c_nationkey AS n_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)")
def set_intersect(spark, t):
    return t.customer.select(F.col("c_nationkey").alias("n_nationkey")).intersect(t.supplier.where("s_acctbal < 2000").select("s_nationkey"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer)) = (SELECT count(*) FROM nation) AS is_equal")
def set_equality(spark, t):
    return relational.set_equal(t.customer.select(F.col("c_nationkey").alias("k")), t.nation.select(F.col("n_nationkey").alias("k")))


@query("SELECT o_custkey, o_orderkey, rank, additional FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, greatest(count(*) OVER (PARTITION BY o_custkey) - 3, 0) AS additional FROM orders) WHERE rank <= 3")
def topn_with_remainder(spark, t):
    rows = relational.top_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", "rank", "additional")


LINES = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"
BY_LINE = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q ROWS BETWEEN UNBOUNDED PRECEDING AND"


def lines(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "q"]


@query(f"SELECT l_orderkey, l_linenumber, q, CAST(greatest(least(q, 50 - coalesce(sum(q) OVER ({BY_LINE} 1 PRECEDING), 0)), 0) AS BIGINT) AS granted FROM {LINES}")
def bounded_running_allocation(spark, t):
    return relational.bounded_points(lines(t), ["l_orderkey"], LINE_ORDER, "q", 50).select("l_orderkey", "l_linenumber", "q", F.col("granted").cast("long").alias("granted"))


@query(f"SELECT l_orderkey, l_linenumber, q FROM (SELECT *, sum(q) OVER ({BY_LINE} CURRENT ROW) AS total FROM {LINES}) WHERE total <= 60")
def prefix_truncation(spark, t):
    return relational.drop_last_until_fit(lines(t), ["l_orderkey"], LINE_ORDER, "q", 60).select("l_orderkey", "l_linenumber", "q")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE n_chars <= 4000),
f AS (SELECT source, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT source FROM d)
 UNION ALL SELECT d.source, d.r, CASE WHEN f.used + d.n_chars <= 4000 THEN f.used + d.n_chars ELSE f.used END, CASE WHEN f.used + d.n_chars <= 4000 THEN d.doc_id END FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1)
SELECT source, id FROM f WHERE id IS NOT NULL""")
def greedy_budget_pack(spark, t):
    return relational.greedy_pack(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "doc_id", "n_chars", 4000)


# ---------------------------------------------------------------- evidence, policy, outbound


@query(f"""SELECT o, n, s, o IN (SELECT o_orderkey FROM orders) AND s IN (SELECT s_suppkey FROM supplier) AND p IN (SELECT p_partkey FROM part) AS is_valid FROM {CLAIMED}""")
def evidence_validation(spark, t):
    """Three references a claim, each validated against the entities; a claim is valid if all are."""
    c = claimed(t)
    none, here = F.lit(None).cast("string"), [F.lit("r").alias("repository_id"), F.lit("b").alias("branch")]
    parts = F.array(*[F.concat(F.lit(x), F.col(x.lower())) for x in ("O", "S", "P")])
    rows = c.select("o", "n", "s", "p", F.explode(parts).alias("entity_id"))
    blank = [F.lit(None).cast("int").alias(x) for x in ("start_line", "end_line")] + [none.alias(x) for x in ("project_id", "source_entity_id", "target_entity_id", "relation_type", "relative_path", "resolution")]
    e = rows.select("o", "n", "s", "p", "entity_id", F.concat_ws(":", "o", "n", "s", "p", "entity_id").alias("evidence_id"), F.lit("Entity").alias("kind"), *here, *blank)
    known = [t.orders.select(ident("O", "o_orderkey").alias("id")), t.supplier.select(ident("S", "s_suppkey").alias("id")), t.part.select(ident("P", "p_partkey").alias("id"))]
    places = F.array().cast("array<struct<path:string,start_line:int,end_line:int>>").alias("additional_locations")
    entities = known[0].unionByName(known[1]).unionByName(known[2]).select("id", *[none.alias(x) for x in ("project_id", "entity_type", "path", "resolution")], F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), places)
    projects = t.nation.select(ident("N", "n_nationkey").alias("id"), F.col("n_name").alias("relative_path"))
    relations = spark.createDataFrame([], "source_id string, target_id string, relation_type string, path string, start_line int, end_line int, resolution string")
    done = evidence.validate(e, entities, projects, relations, "r", "b")
    claims = done.groupBy("o", "n", "s", "p").agg(F.bool_and("is_valid").alias("is_valid"), (F.count("*") / 3).cast("int").alias("k"))
    return claims.select("o", "n", "s", "is_valid", F.explode(F.sequence(F.lit(1), "k"))).drop("col")


@query(f"""WITH v AS (SELECT o % 10000000 AS id, n, o IN (SELECT o_orderkey FROM orders) AS ok, s % 2 = 0 AS entity, p % 3 = 0 AS project FROM {CLAIMED}),
f AS (SELECT id, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad, bool_or(ok AND entity) AS e, bool_or(ok AND project) AS p FROM v GROUP BY id)
SELECT id AS recommendation_id, decision, CASE WHEN sound AND decision = 'Create' THEN 'Proposal' WHEN sound THEN 'Validated' WHEN good > 0 THEN 'PartiallyValidated' ELSE 'Invalid' END AS status
FROM (SELECT id, good, decision, bad = 0 AND CASE decision WHEN 'Create' THEN id % 5 <> 0 WHEN 'Reuse' THEN e AND p WHEN 'Extend' THEN e AND p WHEN 'AvoidModifying' THEN e ELSE false END AS sound
 FROM (SELECT *, ['Reuse', 'Extend', 'AvoidModifying', 'Create', 'Other'][CAST(1 + id % 5 AS INTEGER)] AS decision FROM f))""")
def recommendation_status(spark, t):
    known = t.orders.select(F.col("o_orderkey").alias("o"), F.lit(True).alias("h"))
    v = claimed(t).join(known, "o", "left").select((F.col("o") % 10_000_000).alias("recommendation_id"), F.col("h").isNotNull().alias("is_valid"), (F.col("s") % 2 == 0).alias("entity_found"), (F.col("p") % 3 == 0).alias("project_found"))
    v = v.withColumn("path_matches", F.col("entity_found")).withColumn("is_component", F.col("entity_found"))
    decision = F.element_at(F.array(*map(F.lit, ["Reuse", "Extend", "AvoidModifying", "Create", "Other"])), (F.col("recommendation_id") % 5 + 1).cast("int"))
    r = v.select("recommendation_id").distinct().withColumn("decision", decision).withColumn("epistemic_status", F.when(F.col("recommendation_id") % 5 != 0, "Proposal").otherwise("Fact"))
    return evidence.recommendation_status(r, v).select("recommendation_id", "decision", "status")


ACTIONS = """(SELECT user_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'LocalRead' ELSE 'RemoteTransmission' END AS op, ['Remote', 'Local', 'Unknown', 'Local', 'Local', 'Local', 'Remote'][CAST(1 + event_id % 7 AS INTEGER)] AS boundary,
 ['Secrets', 'BoundedFacts', 'SourceBodies', 'Unknown', 'BoundedFacts', 'RawSnapshot', 'BoundedFacts', 'BoundedFacts', 'BoundedFacts', 'BoundedFacts', 'BoundedFacts'][CAST(1 + event_id % 11 AS INTEGER)] AS scope FROM events)"""
POLICY_SQL = "(VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in policy.POLICIES) + ") AS p(policy_id, category)"
COMPLIANCE = f"""WITH a AS {ACTIONS}, c AS (SELECT u.id, p.policy_id, CASE WHEN count(a.id) = 0 THEN 'NotApplicable' WHEN coalesce(bool_or(a.boundary = 'Remote' AND a.scope = p.category), false) THEN 'Violated'
 WHEN coalesce(bool_or(a.boundary = 'Unknown' OR (a.boundary = 'Remote' AND a.scope = 'Unknown')), false) THEN 'Unknown' WHEN coalesce(bool_or(a.boundary = 'Remote'), false) THEN 'Compliant' ELSE 'NotApplicable' END AS status
 FROM (SELECT DISTINCT id FROM a) u CROSS JOIN {POLICY_SQL} LEFT JOIN a ON a.id = u.id AND a.op = 'RemoteTransmission' GROUP BY u.id, p.policy_id)"""


def compliance_of(spark, t):
    pick = lambda names, c, n: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    facts = ["BoundedFacts"]
    a = t.events.select(
        F.col("user_id").alias("recommendation_id"), F.when(F.col("event_type").isin("view", "click"), "LocalRead").otherwise("RemoteTransmission").alias("operation"),
        pick(["Remote", "Local", "Unknown", "Local", "Local", "Local", "Remote"], "event_id", 7).alias("boundary"), pick(["Secrets", *facts, "SourceBodies", "Unknown", *facts, "RawSnapshot", *facts * 5], "event_id", 11).alias("content_scope"),
    )
    return policy.compliance(a.select("recommendation_id"), a, policy.catalogue(spark))


@query(COMPLIANCE + " SELECT id AS recommendation_id, policy_id, status FROM c")
def policy_compliance(spark, t):
    return compliance_of(spark, t).select("recommendation_id", "policy_id", "status")


@query(COMPLIANCE + " SELECT id AS recommendation_id, CASE WHEN bool_or(status = 'Violated') THEN 'Rejected' WHEN bool_or(status = 'Unknown') OR id % 2 = 1 THEN 'NeedsReview' ELSE 'Accepted' END AS disposition FROM c GROUP BY id")
def policy_disposition(spark, t):
    c = compliance_of(spark, t)
    v = c.select("recommendation_id").distinct().withColumn("status", F.when(F.col("recommendation_id") % 2 == 0, "Validated").otherwise("Invalid"))
    return policy.disposition(c, v)


@query(COMPLIANCE + " SELECT id % 4 AS grp, CASE WHEN bool_or(status = 'Violated') THEN 'Blocked' WHEN bool_or(status = 'Unknown') THEN 'Unknown' ELSE 'Allowed' END AS outcome FROM c GROUP BY 1")
def policy_outcome(spark, t):
    c = compliance_of(spark, t).withColumn("grp", F.col("recommendation_id") % 4)
    out = None
    for g in range(4):
        one = policy.outcome(c.where(F.col("grp") == g)).select(F.lit(g).cast("long").alias("grp"), "outcome")
        out = one if out is None else out.unionByName(one)
    return out


#: Fixture texts of the outbound queries, added to what the documents hold.
TOKEN_LINE = "token = \"[^\"]*\""
OUT_TEXT = "text || CASE doc_id % 5 WHEN 0 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' WHEN 1 THEN ' password = hunter22 and C:/x' WHEN 2 THEN ' Authorization: bearer abcdefghijkl.mn file:///etc/x' WHEN 3 THEN chr(10) || '/home/me sk-abcdefghijklmnop' ELSE '' END"


def outbound_texts(t):
    add = ["\n-----BEGIN RSA PRIVATE KEY-----", " password = hunter22 and C:/x", " Authorization: bearer abcdefghijkl.mn file:///etc/x", "\n/home/me sk-abcdefghijklmnop", ""]
    return t.documents.select("doc_id", F.concat("text", F.element_at(F.array(*map(F.lit, add)), (F.col("doc_id") % 5 + 1).cast("int"))).alias("text"))


COUNTS = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "bearer_token": "(?i)\\bBearer\\s+[A-Za-z0-9._-]{12,}", "secret_assignment": "(?i)\\b(?:password|pwd|client[_-]?secret|api[_-]?key)\\s*[:=]\\s*[^\\s,;]{6,}",
    "provider_key": "\\bsk-[A-Za-z0-9_-]{12,}", "windows_path": "[A-Za-z]:[\\\\/]", "file_uri": "(?i)\\bfile://[^\\s]+",
}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {n}" for n, p in COUNTS.items()) + f" FROM (SELECT doc_id, {OUT_TEXT} AS text FROM documents)")
def outbound_regex_counts(spark, t):
    rows = outbound_texts(t)
    c = outbound.counts(F.col("text"))
    return rows.select("doc_id", *[c[n].cast("int").alias(n) for n in COUNTS])


@query("WITH s AS (SELECT doc_id % 10 AS grp, len(regexp_extract_all(text, '[A-Z]')) AS n FROM documents) SELECT grp, CAST(least(sum(n), 99) AS BIGINT) AS count, sum(n) > 99 AS capped FROM s GROUP BY grp")
def outbound_findings_capped(spark, t):
    total, capped = relational.saturated(F.col("n"))
    rows = t.documents.select((F.col("doc_id") % 10).alias("grp"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n"))
    return rows.groupBy("grp").agg(total.alias("count"), capped.alias("capped"))


@query()
def outbound_findings(spark, t):
    return outbound.inspect(outbound_texts(t), "doc_id")


@query("""SELECT doc_id, CASE WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END AS redacted FROM (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text || ' token = "abc" https://me:pw@host/x', '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')),
 '(?i)\\b(password|pwd|secret|token|api[_-]?key|client[_-]?secret)\\b(\\s*[:=]\\s*)("[^"]*"|''[^'']*''|[^\\s,;]+)', '\\1\\2<redacted>', 'g'), '(?i)\\b([a-z][a-z0-9+.-]*://)[^/\\s@]+@', '\\1', 'g') AS x FROM documents)""")
def redact_assignments(spark, t):
    text = F.concat("text", F.lit(' token = "abc" https://me:pw@host/x'))
    return t.documents.select("doc_id", outbound.redact(text).alias("redacted"))


# ---------------------------------------------------------------- retrieval and concepts

FIELDS = """(SELECT doc_id AS id, 'name' AS field, unnest({name}) AS term FROM documents UNION SELECT doc_id, 'project', unnest({project}) FROM documents UNION SELECT doc_id, 'member', unnest({member}) FROM documents)""".format(
    name=tokens_sql("split_part(text, chr(10), 1)"), project=tokens_sql("source"), member=tokens_sql("text")
)
TERMS = f"(SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark)"
SCORED = f"""WITH idx AS {FIELDS}, q AS {TERMS}, n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, CAST(least(greatest(round(ln((n.n + 1) / (count(DISTINCT id) + 1.0)) / ln(n.n + 1.0) * 4), 0), 4) AS BIGINT) AS rare FROM idx, n GROUP BY term, n.n),
hits AS (SELECT q.query_id, idx.id, idx.field, idx.term FROM idx JOIN q USING (term)),
pts AS (SELECT query_id, id, CASE field WHEN 'name' THEN 8 ELSE 4 END AS points FROM hits WHERE field <> 'member'
 UNION ALL SELECT query_id, id, 2 FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, id ORDER BY term) AS r FROM hits WHERE field = 'member') WHERE r <= 3
 UNION ALL SELECT query_id, id, greatest(least(rare, 8 - coalesce(before, 0)), 0) FROM (SELECT query_id, id, rare, sum(rare) OVER (PARTITION BY query_id, id ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits JOIN df USING (term) WHERE field = 'name' AND rare > 0)),
scored AS (SELECT query_id, id, CAST(sum(points) AS INTEGER) AS score FROM pts WHERE points > 0 GROUP BY query_id, id)"""


def corpus_terms(t):
    return retrieval.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


def corpus_index(t):
    """Postings of the documents for the terms that are asked for."""
    rows = t.wide("documents").select(
        F.col("doc_id").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(name).alias("field"), X.tokens(text).alias("terms")) for name, text in (("name", F.substring_index("text", "\n", 1)), ("project", F.col("source")), ("member", F.col("text")))])).alias("f"),
    )
    # Tokens are distinct within a document, so the postings need no further distinct.
    rows = rows.select("id", "f.field", F.explode("f.terms").alias("term"))
    return rows.join(corpus_terms(t).select("term").distinct(), "term", "left_semi").select("id", "field", "term")


def corpus_scores(t):
    """Scores of all pairs; postings and scores are written once, as several parts of a query read them."""
    index = t.kept("postings", lambda: corpus_index(t))
    return t.kept("scores", lambda: retrieval.total_scores(index, corpus_terms(t), t.documents.count()))


@query(SCORED + " SELECT query_id, id, score FROM scored")
def score_components(spark, t):
    return corpus_scores(t)


TOPK = SCORED + ", top AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR), id) AS INTEGER) AS rank FROM scored)"


def corpus_top(t, most=retrieval.TOP_COMPONENTS):
    """The best documents of each item; a document's full name is its id as text."""
    names = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("full_name")).distinct()
    return retrieval.top(corpus_scores(t), names, most).select("query_id", "id", "score", "rank")


@query(TOPK + " SELECT query_id, id, score, rank FROM top WHERE rank <= 12")
def topk_components(spark, t):
    return corpus_top(t)


PROJECTS = TOPK + f""", best AS (SELECT query_id, source AS project_id, max(score) AS s FROM top JOIN documents ON id = doc_id WHERE rank <= 12 GROUP BY 1, 2),
pp AS (SELECT query_id, project_id, 3 AS points FROM (SELECT DISTINCT source AS project_id, unnest({tokens_sql("source || ' the inan thon'")}) AS term FROM documents) JOIN q USING (term) UNION ALL SELECT query_id, project_id, least(12, greatest(1, s // 2)) FROM best),
projects AS (SELECT query_id, project_id, CAST(sum(points) AS INTEGER) AS score FROM pp GROUP BY 1, 2)"""


def corpus_projects(t):
    sources = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"))
    best = corpus_top(t).join(sources, "id").groupBy("query_id", "project_id").agg(F.max("score").alias("score"))
    aliases = t.documents.select(F.col("source").alias("project_id")).distinct().withColumn("alias", F.concat("project_id", F.lit(" the inan thon")))
    return retrieval.score_projects(corpus_terms(t), aliases, best)


@query(PROJECTS + " SELECT query_id, project_id, score FROM projects")
def score_projects(spark, t):
    return corpus_projects(t)


@query(PROJECTS + " SELECT query_id, project_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project_id) AS INTEGER) AS rank FROM projects) WHERE rank <= 4")
def topk_projects(spark, t):
    return retrieval.top_projects(corpus_projects(t))


@query(TOPK + " SELECT query_id, id, CAST(score - CASE WHEN source IN ('src1', 'src2') THEN 10 ELSE 0 END AS INTEGER) AS score FROM scored JOIN documents ON id = doc_id")
def test_noise_penalty(spark, t):
    sources = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("source").isin("src1", "src2"), F.concat("source", F.lit(".Tests"))).otherwise(F.col("source")).alias("name"))
    rows = corpus_scores(t).join(sources, "id")
    points = F.when(retrieval.is_test_project(F.col("name"), F.col("name")), retrieval.TEST_PENALTY).otherwise(0)
    return rows.select("query_id", "id", (F.col("score") - points).cast("int").alias("score"))


#: Fixture: six concepts over tokens of the test items.
CONCEPTS = [("the-and", 0), ("inan-thon", 1), ("that-with-thon", 2), ("was-for-with-this", 3), ("er-in", 4), ("thth-eder-inan", 5)]


def concept_profiles(spark, t):
    c = spark.createDataFrame(CONCEPTS, "concept_id string, n int")
    ids = t.documents.select(F.col("doc_id").alias("id"))
    p = ids.join(F.broadcast(c), F.col("id") % 6 >= F.col("n"))
    none = F.array().cast("array<string>")
    return p.select("id", "concept_id", F.lit("f").alias("fingerprint"), F.lit("None").alias("anchor_policy"), F.array().cast("array<array<string>>").alias("anchor_tokens"), none.alias("qualification_tokens"))


CONCEPT_SQL = "(VALUES " + ", ".join(f"('{c}', {n})" for c, n in CONCEPTS) + ") AS c(concept_id, n)"
QUALIFIED = f"""q AS (SELECT item_id AS query_id, {tokens_sql('text')} AS terms FROM benchmark), c AS (SELECT concept_id, n, {tokens_sql('concept_id')} AS own FROM {CONCEPT_SQL}),
m AS (SELECT query_id, concept_id, n, len(own) AS k, len(list_intersect(own, terms)) AS hit FROM q, c), ok AS (SELECT *, CASE WHEN k = 0 THEN false WHEN k <= 2 THEN hit = k WHEN k = 3 THEN hit >= 2 ELSE hit >= 3 END AS good FROM m)"""


@query(f"WITH {QUALIFIED} SELECT query_id, concept_id, CAST(hit AS INTEGER) AS matched, good AS qualifies FROM ok")
def concept_qualification(spark, t):
    c = spark.createDataFrame(CONCEPTS, "concept_id string, n int").select("concept_id")
    q = t.benchmark.select(F.col("item_id").alias("query_id"), X.tokens(F.col("text")).alias("terms"))
    matched, good = concepts.qualification(F.col("concept_id"), F.lit("None"), F.array().cast("array<array<string>>"), F.array().cast("array<string>"), F.col("terms"))
    return q.crossJoin(F.broadcast(c)).select("query_id", "concept_id", F.size(matched).alias("matched"), good.alias("qualifies"))


@query(TOPK.replace(", q AS", ", qq AS", 1).replace("JOIN q USING", "JOIN qq USING").replace("q.query_id, idx.id", "qq.query_id, idx.id") + f""", {QUALIFIED},
granted AS (SELECT query_id, id, concept_id, greatest(least(2 * hit, 6 - coalesce(sum(2 * hit) OVER (PARTITION BY query_id, id ORDER BY concept_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS points FROM top JOIN ok USING (query_id) WHERE rank <= 30 AND good AND id % 6 >= n),
final AS (SELECT t.query_id, t.id, CAST(t.score + coalesce(g.p, 0) AS INTEGER) AS score FROM top t LEFT JOIN (SELECT query_id, id, sum(points) AS p FROM granted GROUP BY 1, 2) g ON g.query_id = t.query_id AND g.id = t.id WHERE t.rank <= 30)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR), id) AS INTEGER) AS rank FROM final) WHERE rank <= 12""")
def concept_rerank(spark, t):
    pool = corpus_top(t, 30).select("query_id", "id", "score", F.lit(0).alias("exact_tier"))
    terms = retrieval.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    points = concepts.concept_points(pool, concept_profiles(spark, t), terms)
    names = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("full_name"))
    return concepts.rerank(pool, points, names)


# ---------------------------------------------------------------- evaluation and live runs

GOLD = "gold AS (SELECT item_id AS case_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def golden(t):
    """Documents that contain a test item, found by an equi-join on the item's rarest long word.

    Words travel with ids alone; a text joins once, for the candidates that share the word.
    """
    split = lambda c: F.explode(F.array_distinct(F.split(c, r"[^\p{L}]+")))
    words = t.benchmark.select(F.col("item_id").alias("case_id"), split("text").alias("w")).where("length(w) > 3")
    d = t.kept("golden_words", lambda: t.wide("documents").select(F.col("doc_id").alias("id"), split("text").alias("w")).join(words.select("w").distinct(), "w", "left_semi"))
    df = d.groupBy("w").agg(F.count("*").alias("df"))
    key = words.join(df, "w").groupBy("case_id").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    pairs = d.join(key, "w").select("case_id", "id").distinct()
    pairs = pairs.join(t.benchmark.select(F.col("item_id").alias("case_id"), F.col("text").alias("item")), "case_id")
    return pairs.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id").where(F.contains("text", F.col("item"))).select("case_id", "id")


def ranked_cases(t):
    g = t.kept("golden", lambda: golden(t)).select("case_id", "id", F.lit("required").alias("role"))
    r = corpus_top(t, 10).select(F.col("query_id").alias("case_id"), "rank", "id")
    noise = t.documents.select(F.col("doc_id").alias("id"), F.col("source").isin("src1", "src2").alias("is_test"))
    r = r.join(g, ["case_id", "id"], "left").join(noise, "id")
    r = r.withColumn("role", F.when(F.col("role").isNotNull(), F.col("role")).when(F.col("id") % 9 == 0, "negative"))
    return r, g.select("case_id", F.col("id").cast("string").alias("value"), "role")


def case_metrics(t):
    """Metrics of every case, written once: a report reads them several times."""
    return t.kept("case_metrics", lambda: case_metrics_plan(t))


def case_metrics_plan(t):
    r, g = ranked_cases(t)
    m = evaluation.metrics(t.benchmark.select(F.col("item_id").alias("case_id")), r, g)
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in m.columns if c.startswith(("recall", "precision", "test", "reciprocal"))], "negative_dominates")


METRICS = TOPK + f""", {GOLD}, need AS (SELECT case_id, count(DISTINCT id) AS n FROM gold GROUP BY 1),
r AS (SELECT t.query_id AS case_id, t.rank, t.id, g.id IS NOT NULL AS req, g.id IS NULL AND t.id % 9 = 0 AS neg, d.source IN ('src1', 'src2') AS test FROM top t JOIN documents d ON d.doc_id = t.id LEFT JOIN gold g ON g.case_id = t.query_id AND g.id = t.id WHERE rank <= 10),
a AS (SELECT case_id, count(*) AS n, min(rank) FILTER (WHERE req) AS f, count(*) FILTER (WHERE rank <= 5 AND req) AS h5, count(*) FILTER (WHERE req) AS h10, count(*) FILTER (WHERE rank <= 5 AND test) AS t5, count(*) FILTER (WHERE test) AS t10,
 count(*) FILTER (WHERE rank = 1 AND neg) AS n1, count(*) FILTER (WHERE rank <= 3 AND neg) AS n3 FROM r GROUP BY 1),
cm AS (SELECT b.item_id AS case_id, round(CASE WHEN need.n IS NULL THEN 1 ELSE coalesce(h5, 0) / need.n END, 6) AS recall_at_5, round(CASE WHEN need.n IS NULL THEN 1 ELSE coalesce(h10, 0) / need.n END, 6) AS recall_at_10,
 round(CASE WHEN need.n IS NULL THEN 0 ELSE coalesce(h5, 0) / 5 END, 6) AS precision_at_5, round(CASE WHEN need.n IS NULL THEN 0 ELSE coalesce(h10, 0) / 10 END, 6) AS precision_at_10,
 round(CASE WHEN a.n IS NULL THEN 0 ELSE t5 / least(5, a.n) END, 6) AS test_ratio_at_5, round(CASE WHEN a.n IS NULL THEN 0 ELSE t10 / least(10, a.n) END, 6) AS test_ratio_at_10,
 round(CASE WHEN need.n IS NULL THEN 1 WHEN f IS NULL THEN 0 ELSE 1 / f END, 6) AS reciprocal_rank, coalesce(n1 > 0 OR n3 > least(3, a.n) // 2, false) AS negative_dominates
 FROM benchmark b LEFT JOIN need ON need.case_id = b.item_id LEFT JOIN a ON a.case_id = b.item_id)"""


@query(METRICS + " SELECT case_id, recall_at_5, recall_at_10 FROM cm")
def recall_at_k(spark, t):
    return case_metrics(t).select("case_id", "recall_at_5", "recall_at_10")


@query(METRICS + " SELECT case_id, precision_at_5, precision_at_10 FROM cm")
def precision_at_k(spark, t):
    return case_metrics(t).select("case_id", "precision_at_5", "precision_at_10")


@query(METRICS + " SELECT case_id, reciprocal_rank FROM cm")
def mrr(spark, t):
    return case_metrics(t).select("case_id", "reciprocal_rank")


@query(METRICS + " SELECT case_id, negative_dominates, test_ratio_at_5, test_ratio_at_10 FROM cm")
def negative_dominates(spark, t):
    return case_metrics(t).select("case_id", "negative_dominates", "test_ratio_at_5", "test_ratio_at_10")


@query(METRICS + """, s AS (SELECT *, CASE WHEN case_id % 2 = 0 THEN 'tuning' ELSE 'holdout' END AS split FROM cm)
SELECT coalesce(split, 'all') AS grp, count(*) AS cases, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM s GROUP BY GROUPING SETS ((split), ())""")
def aggregate_splits(spark, t):
    m = case_metrics(t).withColumn("split", F.when(F.col("case_id") % 2 == 0, "tuning").otherwise("holdout"))
    g = evaluation.grouped(m, "split", ["recall_at_10", "reciprocal_rank"])
    return g.select("grp", "cases", F.round("recall_at_10", 6).alias("recall_at_10"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(METRICS + " SELECT tag, count(*) AS cases, round(avg(recall_at_10), 6) AS recall_at_10 FROM (SELECT *, unnest(['t' || case_id % 3, 'u' || case_id % 4]) AS tag FROM cm) GROUP BY tag")
def category_metrics(spark, t):
    tags = F.array(F.concat(F.lit("t"), F.col("case_id") % 3), F.concat(F.lit("u"), F.col("case_id") % 4))
    g = evaluation.categories(case_metrics(t).withColumn("tags", tags), "tags", ["recall_at_10"])
    return g.select("tag", "cases", F.round("recall_at_10", 6).alias("recall_at_10"))


@query(METRICS + """, u AS (SELECT case_id, 'recall' AS metric, recall_at_10 AS previous, recall_at_5 AS value FROM cm UNION ALL SELECT case_id, 'precision', precision_at_5, precision_at_10 FROM cm UNION ALL SELECT case_id, 'noise', test_ratio_at_5, test_ratio_at_10 FROM cm)
SELECT case_id, metric, previous, value FROM u WHERE CASE metric WHEN 'noise' THEN value - previous > 0.1 ELSE previous - value > 0.1 END""")
def regression_report(spark, t):
    m = case_metrics(t)
    side = lambda k, p: evaluation.unpivot(m.select("case_id", F.col(f"recall_at_{k}").alias("recall"), F.col(f"precision_at_{p}").alias("precision"), F.col(f"test_ratio_at_{p}").alias("noise")), ["case_id"], ["recall", "precision", "noise"])
    return evaluation.regressions(side(10, 5), side(5, 10), ["case_id"], {"recall": "decrease", "precision": "decrease", "noise": "noise"}).drop("kind")


@query("SELECT conv_id, median(t) AS median_tokens, CAST(max(t) AS INTEGER) AS maximum_tokens, round(avg(t), 6) AS average_tokens FROM (SELECT conv_id, ceil(length(coalesce(text, '')) / 4.0) AS t FROM conversations) GROUP BY conv_id")
def median_tokens(spark, t):
    rows = t.conversations.select("conv_id", X.token_estimate(F.col("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.median("t").alias("median_tokens"), F.max("t").alias("maximum_tokens"), F.round(F.avg("t"), 6).alias("average_tokens"))


USAGE = """u AS (SELECT conv_id, role, length(text) AS i, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) // 2 END AS c, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn + 1 END AS o FROM conversations),
p(provider, i_m, c_m, o_m) AS (VALUES ('USER', 3.0, 0.5, 9.0), ('assistant', 2.5, 0.25, 10.0)),
k AS (SELECT conv_id, i, c, o, CASE WHEN p.provider IS NOT NULL THEN ((i - coalesce(c, 0)) * i_m + coalesce(c, 0) * c_m + coalesce(o, 0) * o_m) END AS cost FROM u LEFT JOIN p ON lower(p.provider) = lower(u.role))"""


def priced(spark, t):
    u = t.conversations.select(
        "conv_id", F.col("role").alias("provider"), F.lit("m").alias("model"), F.length("text").alias("actual_input"), F.when(F.col("turn") % 3 != 0, F.floor(F.length("text") / 2).cast("int")).alias("cached_input"),
        F.when(F.col("turn") % 4 != 0, F.col("turn") + 1).alias("actual_output"), F.lit(0).alias("retries"), F.lit(1).cast("long").alias("duration_ms"),
    )
    prices = spark.createDataFrame([("USER", "m", 3.0, 0.5, 9.0), ("assistant", "m", 2.5, 0.25, 10.0)], "provider string, model string, input_per_m double, cached_per_m double, output_per_m double")
    return live.cost(u, prices)


@query(f"WITH {USAGE} SELECT conv_id, count(*) AS calls, CAST(sum(coalesce(i, 0)) AS BIGINT) AS actual_input, CAST(sum(coalesce(c, 0)) AS BIGINT) AS cached_input, CAST(sum(coalesce(o, 0)) AS BIGINT) AS actual_output FROM k GROUP BY conv_id")
def usage_summary(spark, t):
    return live.usage_summary(priced(spark, t), ["conv_id"]).select("conv_id", "calls", *[F.col(c).cast("long").alias(c) for c in ("actual_input", "cached_input", "actual_output")])


@query(f"WITH {USAGE} SELECT conv_id, CASE WHEN count(cost) = count(*) THEN CAST(sum(cost) * 4 AS BIGINT) END AS cost_in_quarter_millionths FROM k GROUP BY conv_id")
def cost_all_or_null(spark, t):
    c = live.usage_summary(priced(spark, t), ["conv_id"])
    return c.select("conv_id", (F.col("cost") * 4_000_000).cast("long").alias("cost_in_quarter_millionths"))


@query("""WITH s AS (SELECT conv_id % 20 AS grp, conv_id AS run, list_distinct(list(role || turn % 3)) AS s FROM conversations GROUP BY 1, 2), p AS (SELECT a.grp, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM s a JOIN s b ON a.grp = b.grp AND a.run < b.run)
SELECT g.grp, round(coalesce(avg(j), 1), 6) AS jaccard FROM (SELECT DISTINCT grp FROM s) g LEFT JOIN p ON p.grp = g.grp GROUP BY g.grp""")
def jaccard_consistency(spark, t):
    rows = t.conversations.select((F.col("conv_id") % 20).alias("grp"), F.col("conv_id").alias("run"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("v"))
    return live.pairwise_jaccard(rows, ["grp"], "run", "v").select("grp", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT conv_id, round(max(n) / sum(n), 6) AS agreement FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def mode_agreement(spark, t):
    return live.mode_agreement(t.conversations, ["conv_id"], "role").select("conv_id", F.round("agreement", 6).alias("agreement"))


@query(f"""WITH e AS (SELECT item_id % 5 AS case_id, item_id, {tokens_sql("text")} AS own FROM benchmark), a AS (SELECT case_id, list_distinct(flatten(list(tk))) AS have FROM (SELECT doc_id % 5 AS case_id, {tokens_sql('text')} AS tk FROM documents) GROUP BY 1)
SELECT e.case_id, count(*) AS n_expected, count(*) FILTER (WHERE len(list_filter(own, lambda x: NOT list_contains(have, x))) = 0) AS n_covered FROM e JOIN a USING (case_id) GROUP BY e.case_id""")
def field_coverage(spark, t):
    e = t.benchmark.select((F.col("item_id") % 5).alias("case_id"), F.col("text").alias("value"), "item_id")
    a = t.wide("documents").select((F.col("doc_id") % 5).alias("case_id"), F.col("text").alias("value"))
    return live.field_coverage(e.select("case_id", "value"), a).select("case_id", "n_expected", "n_covered")


@query(f"""WITH a AS (SELECT item_id % 5 AS case_id, item_id // 5 AS expectation, i AS alternative, list_filter({tokens_sql('text')}, lambda x, k: k % 3 = i) AS own FROM benchmark, (SELECT unnest([0, 1, 2]) AS i)), o AS (SELECT doc_id % 5 AS case_id, doc_id AS item, {tokens_sql('text')} AS have FROM documents),
h AS (SELECT a.case_id, expectation, alternative, item FROM a JOIN o USING (case_id) WHERE len(own) > 0 AND len(list_intersect(own, have)) = len(own)) SELECT case_id, expectation, alternative, item FROM (SELECT *, row_number() OVER (PARTITION BY case_id, expectation ORDER BY alternative, item) AS r FROM h) WHERE r = 1""")
def expectation_match(spark, t):
    b = t.benchmark.select((F.col("item_id") % 5).alias("case_id"), F.floor(F.col("item_id") / 5).alias("expectation"), X.tokens(F.col("text")).alias("own"), F.explode(F.array(*map(F.lit, range(3)))).alias("alternative"))
    alternatives = b.select("case_id", "expectation", "alternative", F.filter("own", lambda x, k: (k + 1) % 3 == F.col("alternative")).alias("tokens"))
    observed = t.wide("documents").select((F.col("doc_id") % 5).alias("case_id"), F.col("doc_id").alias("item"), X.tokens(F.col("text")).alias("tokens"))
    return live.expectation_hits(alternatives, observed)


HREF = "regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)"


@query(f"WITH l AS (SELECT DISTINCT page_id, unnest({HREF}) AS target FROM pages), known AS (SELECT DISTINCT target FROM (SELECT page_id, unnest({HREF}) AS target FROM pages) WHERE page_id % 3 = 0) SELECT page_id, target FROM l WHERE lower(target) NOT IN (SELECT lower(target) FROM known)")
def wiki_links_broken(spark, t):
    """Pages as notes whose links are written as wiki links; every third page's targets are notes too."""
    targets = t.pages.select("page_id", F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), "\n")
    notes = targets.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), text.alias("content"))
    known = targets.where("page_id % 3 = 0").select(F.explode("t").alias("path")).distinct().select(F.concat("path", F.lit(".md")).alias("path"), F.lit("").alias("content"))
    broken = knowledge.broken_links(notes.unionByName(known))
    return broken.select(F.substring_index("path", "/", -1).cast("long").alias("page_id"), "target")


@query("""WITH m AS (SELECT o_custkey AS id, 'order ' || o_orderkey AS member FROM orders), r AS (SELECT id, member, row_number() OVER (PARTITION BY id ORDER BY member) AS k, count(*) OVER (PARTITION BY id) AS n FROM m),
l AS (SELECT id, string_agg('- ' || member, chr(10) ORDER BY k) AS list, greatest(max(n) - 40, 0) AS more FROM r WHERE k <= 40 GROUP BY id),
c AS (SELECT c_custkey AS id, c_name AS name, c_name || chr(10) || c_mktsegment || chr(10) || c_nationkey || chr(10) || coalesce(list, '<null>') || chr(10) || coalesce(CAST(more AS VARCHAR), '<null>') AS facts, list, more FROM customer LEFT JOIN l ON l.id = c_custkey),
f AS (SELECT *, sha256(facts) AS fp FROM c)
SELECT 'component:' || id AS identity, 'Component' AS kind, 'components/' || replace(name, '#', '-') || '--' || substr(sha256(CAST(id AS VARCHAR)), 1, 12) || '.md' AS path, CAST(id AS VARCHAR) AS source_id, fp AS source_fingerprint,
 '---' || chr(10) || 'kind: "Component"' || chr(10) || 'source: "' || id || '"' || chr(10) || 'fingerprint: "' || fp || '"' || chr(10) || '---' || chr(10) || '# ' || name || chr(10) || coalesce(list, '') || CASE WHEN more > 0 THEN chr(10) || '- additional: ' || more ELSE '' END AS content FROM f""")
def knowledge_notes(spark, t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("path"), F.col("c_nationkey").cast("string").alias("project"))
    m = t.orders.select(F.col("o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("member"))
    return knowledge.component_notes(c, m)


@query("""SELECT 'n' || c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN 'deleted' WHEN c_custkey % 7 = 0 THEN 'created' WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'updated' ELSE 'reused' END AS action FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 7 = 0)""")
def note_sync(spark, t):
    c = t.customer.select("c_custkey", F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("content"))
    h = H.content_hash(F.col("content"))
    desired = c.where("c_custkey % 5 <> 0").select("path", F.sha2("content", 256).alias("source_fingerprint"), "content")
    manifest = c.where("c_custkey % 7 <> 0").select("path", F.sha2(F.when(F.col("c_custkey") % 3 == 0, "old").otherwise(F.col("content")), 256).alias("source_fingerprint"), h.alias("content_hash"))
    stored = c.select(F.upper("path").alias("path"), F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(h).alias("content_hash"))
    return knowledge.sync(desired, manifest, stored)
