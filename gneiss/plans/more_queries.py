"""Further queries: operators that the first catalogue runs only as parts of others, or not at all."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import hashing as H
from gneiss.functions import text as X
from gneiss.operators import concepts, context, evaluation, evidence, graph, harness, incremental, knowledge, live, outbound, policy, projects, retrieval
from gneiss.plans import analysis
from gneiss.plans.catalogue import BN, CONTAINS, NODES, POLICY_SQL, SCORED, all_nodes, contains_edges, corpus_index, corpus_terms, ident, nation_edges, page_files, reference_edges
from gneiss.plans.registry import QUERIES, SQL, query, tokens_sql
from gneiss.sources import declarations, files

__all__ = ["QUERIES", "SQL"]

PLACES = "array<struct<path:string,start_line:int,end_line:int>>"

# ---------------------------------------------------------------- hashes and texts


@query("""SELECT c_custkey, sha256(from_hex(printf('%08x', strlen(c_name))) || encode(c_name) || from_hex(printf('%08x', strlen(coalesce(s, '')))) || encode(coalesce(s, ''))) AS fingerprint
FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || 'é' END AS s FROM customer)""")
def request_fingerprint(spark, t):
    return t.customer.select("c_custkey", H.request_fingerprint(F.col("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit("é")))).alias("fingerprint"))


@query("SELECT c_custkey, '[[a/' || c_name || '|(' || c_mktsegment || ')/x]]' AS link FROM customer")
def wiki_link(spark, t):
    return t.customer.select("c_custkey", knowledge.wiki_link(F.concat(F.lit("a\\"), F.col("c_name"), F.lit(".MD")), F.concat(F.lit("["), F.col("c_mktsegment"), F.lit("]|x"))).alias("link"))


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), 1, 40) AS line FROM documents")
def single_line(spark, t):
    return t.documents.select("doc_id", H.single_line(F.col("text"), 40).alias("line"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || lpad(CAST((date_part('millisecond', ts) % 1000) AS INTEGER)::VARCHAR, 3, '0') || 'Z--' || substr(sha256(user_id || chr(10) || event_type), 1, 12) AS run FROM events")
def run_id(spark, t):
    return t.events.select("event_id", H.run_id(F.col("ts"), F.col("user_id"), F.col("event_type")).alias("run"))


@query("SELECT doc_id, list_sort(list_distinct(tk)) AS search_terms, text AS summary FROM (SELECT doc_id, text, " + tokens_sql("text") + " AS tk FROM documents)")
def interpretation(spark, t):
    return analysis.interpret(t.wide("documents").withColumnRenamed("doc_id", "query_id")).select(F.col("query_id").alias("doc_id"), "search_terms", "summary")


# ---------------------------------------------------------------- outbound structures

#: Fixture texts by doc_id modulo six, and what each must count as.
SHAPES = [
    "\ndef work(a):\n    return a\n", "\nclass A { int f() { return 1; } void g() { } }\n", '\n{"repository": {"x": 1}, "entities": [], "relations": [1]}\n',
    "\nBEGIN_FILE a.cs\nx\nEND_FILE\nBEGIN_FILE b.cs\ny\nEND_FILE\nBEGIN_FILE a.cs\nz\nEND_FILE\n", '\n{"files": [{"path": "a", "content": ""}, {"path": "b", "content": ""}, {"path": "c", "content": ""}]}\n', "\nplain { words } only\n",
]
EXPECTED = "(VALUES (0, 1, 0, 0, false, false), (1, 0, 2, 0, false, false), (2, 0, 0, 0, true, true), (3, 0, 0, 2, false, false), (4, 0, 0, 0, false, false), (5, 0, 0, 0, false, false)) AS e(k, python, bodies, payloads, legacy, raw)"


def shaped(t):
    add = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("doc_id") % 6 + 1).cast("int"))
    # Documents are prose: a quote, brace or open header of their own would make the inspection fail closed.
    return t.documents.select("doc_id", F.concat(F.translate("text", "\"'{}*", "     "), F.lit(" ;"), add).alias("text"))


@query(f"SELECT doc_id, CAST(python AS INTEGER) AS python_bodies, CAST(payloads AS INTEGER) AS payloads, legacy FROM documents JOIN {EXPECTED} ON doc_id % 6 = k")
def outbound_shapes(spark, t):
    x = F.col("text")
    return shaped(t).select("doc_id", outbound.counts(x)["python_body"].cast("int").alias("python_bodies"), outbound.file_payloads(x).alias("payloads"), outbound.legacy_snapshot(x).alias("legacy"))


FOUND = """(SELECT doc_id, 'SourceBodies' AS category, 'SourceBodyPayload' AS reason, CASE doc_id % 6 WHEN 0 THEN 1 ELSE 2 END AS count FROM documents WHERE doc_id % 6 IN (0, 1)
 UNION ALL SELECT doc_id, 'RawSnapshot', 'RawSnapshotPayload', 1 FROM documents WHERE doc_id % 6 = 2 UNION ALL SELECT doc_id, 'CompleteRepository', 'CompleteRepositoryPayload', 1 FROM documents WHERE doc_id % 6 = 4)"""


def shape_findings(t):
    """Findings of whole texts in the categories that the fixtures are of; others depend on the documents."""
    return outbound.inspect(shaped(t), "doc_id").where(F.col("category").isin("SourceBodies", "RawSnapshot", "CompleteRepository"))


@query(f"SELECT doc_id, category, reason, CAST(count AS INTEGER) AS count FROM {FOUND}")
def outbound_structures(spark, t):
    return shape_findings(t).select("doc_id", "category", "reason", "count")


@query(f"""SELECT d.doc_id, CASE WHEN f.category IS NULL THEN 'Allowed' ELSE 'Blocked' END AS outcome, coalesce(p.policy_id, '') AS policies,
 'Overall: ' || CASE WHEN f.category IS NULL THEN 'Allowed' ELSE 'Blocked' END AS last_line FROM documents d LEFT JOIN {FOUND} f ON f.doc_id = d.doc_id LEFT JOIN {POLICY_SQL} ON p.category = f.category""")
def outbound_assessment(spark, t):
    a = outbound.assess(t.documents.select("doc_id"), shape_findings(t), "doc_id")
    lines = outbound.assessment_lines(a, "doc_id")
    return a.join(lines, "doc_id").select("doc_id", "outcome", F.array_join("blocked_policies", ",").alias("policies"), F.element_at("lines", -1).alias("last_line"))


# ---------------------------------------------------------------- graph and projects


@query("SELECT DISTINCT 'O' || l_orderkey AS source_id, 'S' || l_suppkey AS target_id FROM lineitem WHERE l_orderkey % 3 = 0 AND l_suppkey % 2 = 0")
def inside_edges(spark, t):
    some = all_nodes(t).where("(id like 'O%' and cast(substr(id, 2) as long) % 3 = 0) or (id like 'S%' and cast(substr(id, 2) as long) % 2 = 0)")
    return graph.inside(reference_edges(t), some).select("source_id", "target_id")


@query(f"SELECT c.source_id, c.target_id, CASE WHEN a.entity_type = 'Interface' OR b.entity_type <> 'Interface' THEN 'Inherits' ELSE 'Implements' END AS relation_type FROM {CONTAINS} c JOIN {NODES} a ON a.id = c.source_id JOIN {NODES} b ON b.id = c.target_id")
def type_relations(spark, t):
    n = all_nodes(t).select("id", "entity_type")
    e = contains_edges(t).join(n.withColumnsRenamed({"id": "source_id", "entity_type": "s"}), "source_id").join(n.withColumnsRenamed({"id": "target_id", "entity_type": "d"}), "target_id")
    return e.select("source_id", "target_id", graph.type_relation(F.col("s"), F.col("d")).alias("relation_type"))


@query("SELECT 'entity S' || s_suppkey || ' Interface n/' || s_nationkey || ':1-5' AS line FROM supplier UNION ALL SELECT 'relation N' || s_nationkey || ' Contains S' || s_suppkey FROM supplier")
def graph_evidence_lines(spark, t):
    one = lambda v: F.lit(v).alias("start_line" if v == 1 else "end_line")
    n = t.supplier.select(ident("S", "s_suppkey").alias("id"), F.lit("Interface").alias("entity_type"), F.concat(F.lit("n/"), F.col("s_nationkey").cast("string")).alias("path"), one(1), one(5))
    e = t.supplier.select(ident("N", "s_nationkey").alias("source_id"), F.lit("Contains").alias("relation_type"), ident("S", "s_suppkey").alias("target_id"))
    return graph.evidence_lines(n, e)


@query(f"""SELECT 'p/' || n.n_nationkey || '.csproj' AS path, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n.n_nationkey AS VARCHAR) END AS name,
 CASE WHEN n_nationkey % 3 = 0 THEN coalesce(r.l, '') WHEN n_nationkey % 2 = 0 THEN 'p/old.csproj' ELSE '' END AS refs
FROM nation n LEFT JOIN (SELECT s, string_agg('p/' || d || '.csproj', ',' ORDER BY 'p/' || d || '.csproj') AS l FROM (SELECT DISTINCT s, d FROM {BN} x) GROUP BY s) r ON r.s = n_nationkey""")
def project_dependencies(spark, t):
    at = lambda c: F.concat(F.lit("p/"), F.col(c).cast("string"), F.lit(".csproj"))
    now = t.nation.select(at("n_nationkey").alias("relative_path"))
    e = nation_edges(t).select(at("source_id").alias("path"), at("target_id").alias("r")).groupBy("path").agg(F.collect_list("r").alias("references"))
    read = t.nation.where("n_nationkey % 3 = 0").select(at("n_nationkey").alias("path")).join(e, "path", "left").select("path", F.coalesce("references", F.array().cast("array<string>")).alias("references"))
    before = t.nation.where("n_nationkey % 2 = 0").select(at("n_nationkey").alias("path"), F.col("n_name").alias("name"), F.array(F.lit("p/old.csproj"), F.lit("p/old.csproj")).alias("references"))
    return projects.dependency_graph(now, read, before).select("path", "name", F.array_join("references", ",").alias("refs"))


@query(f"SELECT DISTINCT 'P' || s AS source_id, 'P' || d AS target_id, CASE WHEN s % 2 = 0 THEN 'Exact' ELSE 'Syntactic' END AS resolution, CASE WHEN s % 5 = 0 THEN 1 ELSE s END AS start_line FROM {BN} x WHERE d % 4 <> 3 AND s % 4 <> 3")
def project_reference_edges(spark, t):
    p = t.nation.select(ident("P", "n_nationkey").alias("id"), F.concat(F.lit("p/"), "n_nationkey").alias("path"), "n_nationkey")
    line = F.when(F.col("source_id") % 5 != 0, F.col("source_id")).cast("int")
    r = nation_edges(t).select(F.concat(F.lit("p/"), "source_id").alias("path"), F.concat(F.lit("P/"), "target_id").alias("target_path"), line.alias("line"), (F.col("source_id") % 2 == 0).alias("evaluated"))
    known = p.where("n_nationkey % 4 <> 3").select("id", "path")
    return projects.reference_edges(r.unionByName(r), known).select("source_id", "target_id", "resolution", "start_line")


@query("SELECT 'R' || n_regionkey AS source_id, 'N' || n_nationkey AS target_id, 'Contains' AS relation_type FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 4")
def solution_edges(spark, t):
    m = t.nation.select(F.concat(F.lit("s/"), "n_regionkey").alias("solution_path"), F.concat(F.lit("p/"), "n_nationkey").alias("project_path"))
    s = t.region.where("r_regionkey <> 4").select(ident("R", "r_regionkey").alias("id"), F.concat(F.lit("s/"), "r_regionkey").alias("path"))
    p = t.nation.where("n_nationkey % 2 = 0").select(ident("N", "n_nationkey").alias("id"), F.concat(F.lit("p/"), "n_nationkey").alias("path"))
    return projects.solution_edges(m, s, p).select("source_id", "target_id", "relation_type")


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'P' || c_nationkey WHEN c_custkey % 4 = 1 THEN 'N' || c_nationkey ELSE 'K' || (c_custkey - c_custkey % 4 + 1) END AS source_id, 'K' || c_custkey AS target_id
FROM customer WHERE c_custkey % 4 <= 1 OR c_custkey - c_custkey % 4 + 1 IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'P' || n_nationkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || c_nationkey, 'K' || c_custkey FROM customer WHERE c_custkey % 4 > 1 AND c_custkey - c_custkey % 4 + 1 NOT IN (SELECT c_custkey FROM customer)""")
def containment_edges(spark, t):
    """Namespaces of nations; of four customers the second holds the third and fourth, and the first has no ancestor."""
    place = [F.lit("f").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("Syntactic").alias("resolution")]
    n = t.nation.select(ident("N", "n_nationkey").alias("id"), F.concat(F.lit("Ns"), "n_nationkey").alias("full_name"), F.lit("all").alias("project_id"), *place)
    k = F.col("c_custkey")
    home = k - k % 4 + 1
    space = F.concat(F.lit("Ns"), F.col("c_nationkey"))
    holder = t.customer.select(F.col("c_custkey").alias("_h"), F.col("c_nationkey").alias("_n"))
    c = t.customer.join(holder, home == F.col("_h"), "left")
    full = F.when(k % 4 == 0, F.concat(F.lit("K"), k)).when(k % 4 == 1, F.concat(space, F.lit(".K"), k)).when(F.col("_n").isNotNull(), F.concat(F.lit("Ns"), "_n", F.lit(".K"), home, F.lit(".X.K"), k)).otherwise(F.concat(space, F.lit(".Y.K"), k))
    c = c.select(ident("K", "c_custkey").alias("id"), full.alias("full_name"), F.lit("all").alias("project_id"), *place, "c_nationkey", (k % 4).alias("m"))
    edges = projects.containment_edges(n.unionByName(c.drop("c_nationkey", "m")), spark.createDataFrame([("all",)], "id string"))
    nation = c.select(F.col("id").alias("target_id"), "c_nationkey").unionByName(t.nation.select(ident("N", "n_nationkey").alias("target_id"), F.col("n_nationkey").alias("c_nationkey")))
    source = F.when(F.col("source_id") == "all", F.concat(F.lit("P"), "c_nationkey")).otherwise(F.col("source_id"))
    return edges.join(nation, "target_id").select(source.alias("source_id"), "target_id")


@query("""SELECT 'K' || c_custkey AS source_id, CASE c_custkey % 4 WHEN 0 THEN 'own' || c_nationkey WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'there' || c_nationkey END WHEN 2 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'again' || c_nationkey END END AS target_id FROM customer""")
def base_targets(spark, t):
    n = F.col("n_nationkey")
    p, q = F.concat(F.lit("p"), n), F.concat(F.lit("q"), n)
    e = t.nation.select(F.concat(F.lit("own"), n).alias("id"), p.alias("project_id"), F.lit("Own").alias("symbol")).unionByName(t.nation.select(F.concat(F.lit("there"), n).alias("id"), q.alias("project_id"), F.lit("There").alias("symbol")))
    asm = t.nation.select(F.concat(F.lit("a"), n).alias("assembly"), q.alias("project_id")).unionByName(t.nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit("a"), n).alias("assembly"), p.alias("project_id")))
    again = t.nation.select(F.concat(F.lit("again"), n).alias("id"), q.alias("project_id"), F.lit("Again").alias("symbol"))
    symbol = F.element_at(F.array(*map(F.lit, ["Own", "There", "Again", "Lost"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    bases = t.customer.select(ident("K", "c_custkey").alias("source_id"), F.concat(F.lit("p"), "c_nationkey").alias("project_id"), symbol.alias("symbol"), F.concat(F.lit("a"), "c_nationkey").alias("assembly"))
    return projects.base_targets(bases, e, asm, again).select("source_id", "target_id")


@query("SELECT 'd' || doc_id || '/p.csproj' AS path, 'Name' || doc_id AS name, 'net8.0,net9.0' AS frameworks, 'd' || doc_id || '/sub/b.csproj,lib/a.csproj' AS refs FROM documents")
def project_files(spark, t):
    body = F.concat(
        F.lit("<Project><AssemblyName> Name"), F.col("doc_id"), F.lit(" </AssemblyName><TargetFrameworks>net8.0; net9.0;</TargetFrameworks>"),
        F.lit('<ProjectReference Include="..\\lib\\a.csproj" /><ProjectReference Include="sub/b.csproj"/><ProjectReference Include="$(X)/c.csproj"/><ProjectReference Include="../../out.csproj"/></Project>'),
    )
    f = t.documents.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit("/p.csproj")).alias("path"), body.alias("text"))
    return files.projects(f).select(F.col("relative_path").alias("path"), "name", F.array_join("target_frameworks", ",").alias("frameworks"), F.array_join("project_references", ",").alias("refs"))


@query("SELECT 'a/s' || doc_id || '.sln' AS path, 's' || doc_id AS name FROM documents WHERE doc_id % 2 = 0")
def solution_files(spark, t):
    name = F.concat(F.lit("a/s"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".sln").otherwise(".txt"))
    return files.solutions(t.documents.select(name.alias("path"))).select(F.col("relative_path").alias("path"), "name")


@query("SELECT 'N' || doc_id || '.C' AS full_name, 'Class' AS entity_type, 'f' || doc_id || '.cs' AS path, 1 AS more FROM documents UNION ALL SELECT 'N' || doc_id || '.C.Go', 'Method', 'f' || doc_id || '.cs', 0 FROM documents UNION ALL SELECT 'N' || doc_id, 'Namespace', 'f' || doc_id || '.cs', 1 FROM documents")
def syntactic_declarations(spark, t):
    n = F.concat(F.lit("N"), F.col("doc_id"))
    one = F.concat(F.lit("namespace "), n, F.lit(" { // class Not { }\n partial class C : B { public int Go(int a) { if (a > 0) { return 1; } return 0; } } }"))
    two = F.concat(F.lit("namespace "), n, F.lit(" { partial class C { string s = \"class No { }\"; } }"))
    rows = t.documents.select(F.concat(F.lit("f"), "doc_id", F.lit(".cs")).alias("path"), one.alias("text")).unionByName(t.documents.select(F.concat(F.lit("g"), "doc_id", F.lit(".cs")).alias("path"), two.alias("text")))
    return declarations.extract(rows).select("full_name", "entity_type", "path", F.size("additional_locations").alias("more"))


# ---------------------------------------------------------------- incremental


@query("""SELECT path, reason FROM (SELECT path, CASE WHEN ends_with(path, 'global.json') THEN 'global configuration' WHEN ends_with(path, '.sln') THEN 'solution' WHEN ends_with(path, '.cs') AND NOT starts_with(path, 'src/') THEN 'unmapped source' END AS reason
 FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'x/' ELSE 'z/' END || page_id || CASE page_id % 7 WHEN 3 THEN '/global.json' WHEN 4 THEN '.sln' WHEN 5 THEN '.cs' ELSE '.md' END AS path FROM pages)) WHERE reason IS NOT NULL ORDER BY path LIMIT 1""")
def full_scan_reason(spark, t):
    k = F.col("page_id")
    path = F.concat(F.when(k % 5 == 0, "src/").when(k % 5 == 1, "x/").otherwise("z/"), k, F.when(k % 7 == 3, "/global.json").when(k % 7 == 4, ".sln").when(k % 7 == 5, ".cs").otherwise(".md"))
    changes = t.pages.select(F.lit("Modified").alias("kind"), path.alias("current_path"), F.lit(None).cast("string").alias("previous_path"))
    return incremental.full_reason(changes, spark.createDataFrame([("src", "p")], "prefix string, owner string"))


@query("SELECT n, path FROM (SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS n, path FROM (SELECT 'f' || page_id AS path FROM pages)) WHERE n <= 20")
def ordered_changes(spark, t):
    k = F.concat(F.lit("f"), F.col("page_id"))
    c = t.pages.select(F.element_at(F.array(*map(F.lit, incremental.KINDS)), (F.col("page_id") % 4 + 1).cast("int")).alias("kind"), F.when(F.col("page_id") % 4 != 2, k).alias("current_path"), k.alias("previous_path"))
    first = incremental.ordered(c).limit(20).agg(F.collect_list(F.coalesce("current_path", "previous_path")).alias("p"))
    return first.select(F.posexplode("p").alias("n", "path")).select((F.col("n") + 1).alias("n"), "path")


# ---------------------------------------------------------------- retrieval

SIGNALS = "CASE field " + " ".join(f"WHEN '{f}' THEN '{s}'" for f, (s, _) in retrieval.TOKEN_SIGNALS.items()) + " END"
REASONS = SCORED + f""", reasons AS (SELECT query_id, id, {SIGNALS} AS signal, term AS value, CASE field WHEN 'name' THEN 8 ELSE 4 END AS points FROM hits WHERE field <> 'member'
 UNION ALL SELECT query_id, id, 'member name', term, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY term) AS r FROM hits WHERE field = 'member') WHERE r <= 3
 UNION ALL SELECT query_id, id, 'component name rarity', term, granted FROM (SELECT query_id, id, term, greatest(least(rare, 8 - coalesce(sum(rare) OVER (PARTITION BY query_id, id ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS granted FROM hits JOIN df USING (term) WHERE field = 'name' AND rare > 0) WHERE granted > 0),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY points DESC, signal, value) AS r, count(*) OVER (PARTITION BY query_id, id) AS n, sum(points) OVER (PARTITION BY query_id, id) AS s FROM reasons)"""


@query(REASONS + " SELECT query_id, id, CAST(s AS INTEGER) AS score, CAST(n AS INTEGER) AS n_reasons, signal, value FROM first WHERE r = 1")
def score_reasons(spark, t):
    index = t.kept("postings", lambda: corpus_index(t))
    c = retrieval.candidates(retrieval.score(index, corpus_terms(t), t.documents.count()))
    return c.select("query_id", "id", "score", F.size("reasons").alias("n_reasons"), F.col("reasons")[0].signal.alias("signal"), F.col("reasons")[0].matched_value.alias("value"))


@query("SELECT conv_id, turn, len(list_intersect(tk, ['coverage', 'integration', 'prueba', 'pruebas', 'qa', 'test', 'testing', 'tests', 'unit'])) > 0 AS intent FROM (SELECT conv_id, turn, " + tokens_sql("coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' UnitTests' WHEN 1 THEN ' contest' ELSE ' QA' END") + " AS tk FROM conversations)")
def test_intent(spark, t):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " UnitTests").when(F.col("turn") % 3 == 1, " contest").otherwise(" QA"))
    return t.conversations.select("conv_id", "turn", retrieval.has_test_intent(X.tokens(text)).alias("intent"))


@query("SELECT c_custkey, c_custkey % 5 IN (0, 2, 4) AS named FROM customer")
def identity_mentioned(spark, t):
    k = F.col("c_custkey") % 5
    name = F.concat(F.lit("Order"), F.col("c_custkey"), F.lit("Book"))
    text = F.when(k == 0, F.concat(F.lit("see (orde"), F.substring(F.concat(F.lit("rORDER"), F.col("c_custkey"), F.lit("BOOK")), 2, 0), F.lit(") "), F.upper(name), F.lit("."))).when(k == 1, F.concat(F.lit("my"), name, F.lit("s"))).when(
        k == 2, F.concat(F.lit("the order "), F.concat(F.col("c_custkey"), F.lit(" book")))).when(k == 3, F.concat(F.lit("xx_"), name)).otherwise(F.concat(name, F.lit(", please")))
    ident_ = F.when(k == 2, F.concat(F.lit("Order "), F.col("c_custkey"), F.lit("Book"))).otherwise(name)
    return t.customer.select("c_custkey", X.mentions(text, ident_).alias("named"))


@query("""SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN 48 WHEN 1 THEN 32 END AS INTEGER) AS points FROM customer WHERE c_custkey % 3 < 2""")
def exact_identities(spark, t):
    """A query per customer names its own full name, its name, or neither; identities are unlike each other."""
    k = F.col("c_custkey").cast("string")
    name, full = F.concat(F.lit("Agent"), k), F.concat(F.lit("Desk"), k, F.lit(".Agent"), k)
    q = t.customer.select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ask "), full, F.lit(" now"))).when(F.col("c_custkey") % 3 == 1, name).otherwise(F.concat(F.lit("pre"), name, F.lit("post"))).alias("text"))
    e = t.customer.select(F.col("c_custkey").alias("id"), name.alias("name"), full.alias("full_name"))
    return retrieval.exact_matches(q, e).where("query_id = id").select(F.col("id").alias("c_custkey"), "points")


@query("""SELECT 'K' || c_custkey AS id, field, text FROM (SELECT c_custkey, 'name' AS field, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'path', 'src/' || c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 'project', n_name || ' n' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0
 UNION ALL SELECT o_custkey, 'member', 'order ' || o_orderkey FROM orders UNION ALL SELECT c_custkey, 'related', 'full ' || (c_custkey + 1) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT c_custkey, 'related', 'full ' || (c_custkey - 1) FROM customer WHERE c_custkey % 2 = 1 AND c_custkey - 1 IN (SELECT c_custkey FROM customer))""")
def retrieval_fields(spark, t):
    e = t.customer.select(ident("K", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("full "), F.col("c_custkey")).alias("full_name"), F.concat(F.lit("src/"), "c_mktsegment").alias("path"), F.when(F.col("c_custkey") % 5 != 0, ident("N", "c_nationkey")).alias("project_id"))
    o = t.orders.select(ident("O", "o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"), F.lit("x").alias("full_name"), F.lit("y").alias("path"), F.lit(None).cast("string").alias("project_id"))
    p = t.nation.select(ident("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("a/n"), F.col("n_nationkey"), F.lit(".csproj")).alias("relative_path"))
    contains = t.orders.select(ident("K", "o_custkey").alias("source_id"), ident("O", "o_orderkey").alias("target_id"))
    typed = t.customer.where("c_custkey % 2 = 0").select(ident("K", "c_custkey").alias("source_id"), F.concat(F.lit("K"), F.col("c_custkey") + 1).alias("target_id"), F.lit("Implements").alias("relation_type"))
    none = spark.createDataFrame([], "id string, ancestor string")
    return projects.retrieval_fields(e, e.unionByName(o), p, contains, typed, none)


@query("SELECT o_custkey AS query_id, path FROM (SELECT o_custkey, o_orderkey, 'n' || (o_orderkey % 97) || '/0' AS path FROM orders WHERE o_orderkey % 97 < 50)")
def candidate_notes(spark, t):
    c = t.orders.select(F.col("o_custkey").alias("query_id"), F.lit(1).alias("rank"), (F.col("o_orderkey") % 97).cast("string").alias("id"))
    n = spark.range(50).select(F.col("id").cast("string").alias("source_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal"))
    n = n.withColumn("path", F.concat(F.lit("n"), "source_id", F.lit("/"), "ordinal")).withColumn("content", F.lit("c"))
    return projects.candidate_notes(c, n).select("query_id", "path")


# ---------------------------------------------------------------- concepts, evidence, notes


@query("""SELECT c_custkey, c_custkey % 6 IN (0, 5) AS reference, c_custkey % 6 IN (0, 4) AS relative FROM customer""")
def source_references(spark, t):
    v = F.element_at(F.array(*map(F.lit, ["a/b.cs:3", "a/../b.cs", "/a/b.cs", "a//../b", "a\\b.cs", "C/b.cs:7"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    v = F.when(F.col("c_custkey") % 6 == 5, F.lit("a/b.cs:07")).otherwise(v)
    return t.customer.select("c_custkey", concepts.is_source_reference(v).alias("reference"), (concepts.is_relative(v) & (F.col("c_custkey") % 6 != 5)).alias("relative"))


@query("""SELECT 'c' || c_custkey AS concept_id, code FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'RC201' WHEN 2 THEN 'RC203' WHEN 3 THEN 'RC300' WHEN 4 THEN 'RC302' WHEN 5 THEN 'RC400' WHEN 6 THEN 'RC401' END AS code FROM customer) WHERE code IS NOT NULL
 UNION ALL SELECT 'c' || c_custkey, 'RC402' FROM customer WHERE c_custkey % 7 = 4 UNION ALL SELECT 'c' || c_custkey, 'RC401' FROM customer WHERE c_custkey % 7 = 3""")
def concept_violations(spark, t):
    k, kind = F.concat(F.lit("c"), F.col("c_custkey")), F.col("c_custkey") % 7
    none = F.array().cast("array<string>")
    entity = F.when(kind == 5, F.concat(F.lit("gone"), F.col("c_custkey"))).otherwise(F.concat(F.lit("e"), F.col("c_custkey")))
    ref = F.when(kind == 3, "../x.cs").when(kind == 6, "other.cs").otherwise("a/x.cs")
    d = t.customer.select(
        k.alias("concept_id"), F.when(kind == 1, " ").otherwise("meaning").alias("definition"), F.lit("None").alias("anchor_policy"), F.array(F.when(kind == 2, F.array(F.lit("alien"))).otherwise(none)).alias("anchor_tokens"), none.alias("qualification_tokens"),
        F.array(F.struct(entity.alias("entity_id"), ref.alias("source_reference"), F.when(kind == 4, "").otherwise("h").alias("source_fingerprint"))).alias("assignments"),
    )
    known = t.customer.select(F.concat(F.lit("e"), F.col("c_custkey")).alias("entity_id"), F.lit("a/x.cs").alias("source_reference"), F.lit("h").alias("source_fingerprint"))
    return concepts.violations(d, known).select("concept_id", "code")


@query("SELECT 'e' || c_custkey AS entity_id, CASE c_custkey % 4 WHEN 1 THEN 'RC400' WHEN 2 THEN 'RC401' WHEN 3 THEN 'RC402' END AS code FROM customer")
def concept_assignments(spark, t):
    kind = F.col("c_custkey") % 4
    e = F.concat(F.lit("e"), F.col("c_custkey"))
    a = t.customer.select(e.alias("entity_id"), F.when(kind == 2, "b").otherwise("a").alias("source_reference"), F.when(kind == 3, "x").otherwise("h").alias("source_fingerprint"))
    return concepts.resolve(a, t.customer.where("c_custkey % 4 <> 1").select(e.alias("entity_id"), F.lit("a").alias("source_reference"), F.lit("h").alias("source_fingerprint"))).select("entity_id", "code")


@query("SELECT 'e' || c_custkey AS entity_id, CASE WHEN c_custkey % 4 <> 1 THEN 'n/' || c_custkey END AS new_reference, CASE WHEN c_custkey % 4 = 1 THEN 'RC400' END AS code FROM customer")
def concept_refresh(spark, t):
    e = F.concat(F.lit("e"), F.col("c_custkey"))
    now = t.customer.where("c_custkey % 4 <> 1").select(e.alias("entity_id"), F.concat(F.lit("n/"), F.col("c_custkey")).alias("source_reference"), F.lit("h").alias("source_fingerprint"))
    return concepts.rebind(t.customer.select(e.alias("entity_id")), now).select("entity_id", "new_reference", "code")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'f' ELSE 'e' END || c_custkey AS entity_id, 'm/' || c_custkey AS new_reference FROM customer")
def concept_remap(spark, t):
    old, new = F.concat(F.lit("e"), F.col("c_custkey")), F.concat(F.lit("f"), F.col("c_custkey"))
    gone = F.col("c_custkey") % 3 == 0
    now = t.customer.select(F.when(gone, new).otherwise(old).alias("entity_id"), F.concat(F.lit("m/"), F.col("c_custkey")).alias("source_reference"), F.lit("h").alias("source_fingerprint"))
    return concepts.remap(t.customer.select(old.alias("entity_id")), t.customer.where(gone).select(old.alias("old_entity_id"), new.alias("new_entity_id")), now).select("entity_id", "new_reference")


@query("SELECT 'e' || c_custkey AS entity_id, 'p' || c_custkey AS source_reference FROM customer")
def concept_promotion(spark, t):
    e = F.concat(F.lit("e"), F.col("c_custkey"))
    notes = t.customer.select(F.lit("Component").alias("kind"), e.alias("source_id"), F.lit("h").alias("source_fingerprint"))
    entities = t.customer.select(e.alias("id"), F.concat(F.lit("p"), F.col("c_custkey")).alias("path"), F.lit(None).cast("int").alias("start_line"))
    a = t.customer.select(e.alias("entity_id"), F.lit("old").alias("source_reference"), F.lit("old").alias("source_fingerprint"))
    return concepts.promote(a, concepts.evidence_context(notes, entities)).select("entity_id", "source_reference")


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN false ELSE false END AS is_valid FROM customer""")
def evidence_kinds(spark, t):
    """Entities, projects, relations and places, right and wrong."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 8
    e = F.concat(F.lit("e"), k)
    none = F.lit(None).cast("string")
    ev = t.customer.select(
        "c_custkey", k.cast("string").alias("evidence_id"), F.when(kind <= 2, "Entity").when(kind <= 4, "Project").when(kind == 5, "Relation").otherwise("SourceLocation").alias("kind"),
        F.lit("r").alias("repository_id"), F.when(kind == 2, "other").otherwise("b").alias("branch"), F.when((kind <= 2) | (kind >= 6), e).alias("entity_id"), F.when(kind == 3, F.concat(F.lit("N"), "c_nationkey")).when(kind == 4, F.lit("lost")).alias("project_id"),
        F.when(kind == 5, e).alias("source_entity_id"), F.when(kind == 5, F.lit("t")).alias("target_entity_id"), F.when(kind == 5, F.lit("Calls")).alias("relation_type"),
        F.when(kind == 1, F.concat(F.lit("SRC/"), k)).when(kind == 6, F.lit("elsewhere")).alias("relative_path"), F.when(kind == 1, 7).cast("int").alias("start_line"), F.when(kind == 1, 9).cast("int").alias("end_line"), none.alias("resolution"),
    )
    more = F.array(F.struct(F.lit("more").alias("path"), F.lit(7).alias("start_line"), F.lit(9).alias("end_line")))
    ents = t.customer.select(e.alias("id"), none.alias("project_id"), F.lit("Class").alias("entity_type"), F.concat(F.lit("src/"), k).alias("path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"), F.lit("Exact").alias("resolution"), more.alias("additional_locations"))
    rel = t.customer.select(e.alias("source_id"), F.lit("t").alias("target_id"), F.lit("Calls").alias("relation_type"), F.lit("x").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("Exact").alias("resolution"))
    return evidence.validate(ev, ents, t.nation.select(ident("N", "n_nationkey").alias("id"), F.col("n_name").alias("relative_path")), rel, "r", "b").select("c_custkey", "is_valid")


@query("""SELECT count(*) FILTER (WHERE c_custkey % 10 = 0) AS duplicate_identities, count(*) FILTER (WHERE c_custkey % 10 = 0) AS duplicate_paths, count(*) FILTER (WHERE c_custkey % 6 = 0) + count(*) FILTER (WHERE c_custkey % 30 = 0) AS broken_links,
 count(*) FILTER (WHERE c_custkey % 5 = 0) + count(*) FILTER (WHERE c_custkey % 10 = 0) AS missing_sources FROM customer""")
def note_integrity(spark, t):
    k = F.col("c_custkey")
    n = t.customer.select(F.concat(F.lit("component:"), k).alias("identity"), F.lit("Component").alias("kind"), F.concat(F.lit("c/"), k, F.lit(".md")).alias("path"), F.concat(F.lit("e"), k).alias("source_id"), F.when(k % 6 == 0, F.concat(F.lit("see [[lost/"), k, F.lit("|x]]"))).otherwise(F.concat(F.lit("see [[C/"), k, F.lit("#top]]"))).alias("content"))
    twice = n.where("cast(substr(source_id, 2) as long) % 10 = 0").withColumn("path", F.upper("path"))
    ents = t.customer.where("c_custkey % 5 <> 0").select(F.concat(F.lit("e"), k).alias("id"))
    return knowledge.integrity(n.unionByName(twice), t.nation.select(ident("N", "n_nationkey").alias("id")), ents).select("duplicate_identities", "duplicate_paths", "broken_links", "missing_sources")


@query("SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS missing, count(*) FILTER (WHERE c_custkey % 4 = 1) AS changed, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0) AS orphaned FROM customer")
def stored_notes(spark, t):
    k = F.concat(F.lit("n"), F.col("c_custkey"))
    manifest = t.customer.select(k.alias("path"), F.lit("h").alias("content_hash"))
    stored = t.customer.where("c_custkey % 4 <> 0").select(F.upper(k).alias("path"), F.when(F.col("c_custkey") % 4 == 1, "x").otherwise("h").alias("content_hash"))
    other = t.customer.where("c_custkey % 3 = 0 and c_custkey % 4 <> 0").select(F.concat(F.lit("own"), F.col("c_custkey")).alias("path"), F.lit("h").alias("content_hash"))
    return knowledge.stored_state(manifest, stored.unionByName(other))


@query(f"""WITH r AS (SELECT DISTINCT s, d FROM {BN} x), c AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1)
SELECT 'project:N' || n_nationkey AS identity, coalesce(o.k, 0) AS n_references, coalesce(i.k, 0) AS n_referenced, least(coalesce(c.k, 0), 100) AS n_components FROM nation
LEFT JOIN (SELECT s, count(*) AS k FROM r GROUP BY s) o ON o.s = n_nationkey LEFT JOIN (SELECT d, count(*) AS k FROM r GROUP BY d) i ON i.d = n_nationkey LEFT JOIN c ON c.n = n_nationkey""")
def project_notes(spark, t):
    p = t.nation.select(ident("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("p").alias("relative_path"))
    c = t.customer.select(ident("N", "c_nationkey").alias("project_id"), F.col("c_name").alias("name"), ident("C", "c_custkey").alias("id"))
    r = nation_edges(t).select(ident("N", "source_id").alias("id"), ident("N", "target_id").alias("target"))
    n = knowledge.project_notes(p, c, r)
    part = lambda a, b: F.regexp_count(F.regexp_extract("content", f"(?s)## {a}\n(.*?)" + (f"\n## {b}" if b else "$"), 1), F.lit(r"- \[\["))
    return n.select("identity", part("References", "Referenced by").cast("long").alias("n_references"), part("Referenced by", "Components").cast("long").alias("n_referenced"), part("Components", "").cast("long").alias("n_components"))


@query("SELECT 'index.md' AS path, (SELECT count(*) FROM nation) AS links UNION ALL SELECT 'architecture.md', (SELECT count(DISTINCT lang) FROM documents) UNION ALL SELECT 'log.md', 2")
def overview_notes(spark, t):
    repo = spark.createDataFrame([("r", "repo")], "id string, name string")
    p = t.nation.select(F.lit("r").alias("repository_id"), ident("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    langs = t.documents.groupBy(F.lit("r").alias("repository_id"), F.col("lang").alias("language")).agg(F.count("*").alias("files"))
    none = spark.createDataFrame([], "repository_id string, relation_type string, n long")
    notes = knowledge.overview_notes(repo, p, langs, none)
    return notes.unionByName(knowledge.log_note(notes)).select("path", F.regexp_count("content", F.lit("(?m)^- ")).cast("long").alias("links"))


@query("""SELECT c_custkey AS query_id, CAST(c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AS INTEGER) AS kept_big FROM customer""")
def context_build(spark, t):
    """Contexts whose large project note is there or not, and is above its budget for every seventh query."""
    k = F.col("c_custkey")
    q = t.customer.select(k.alias("query_id"))
    text = lambda n: F.repeat(F.lit("abcd"), n)
    note = lambda rows, cls, rank, path, content, req: rows.select(k.alias("query_id"), F.lit(cls).alias("class"), F.lit(rank).alias("rank"), (k * 10 + rank).alias("note_id"), F.lit(path).alias("path"), content.alias("content"), F.lit(req).alias("required"))
    big = F.when(k % 7 == 0, text(10_001)).otherwise(text(300))
    notes = note(t.customer, "RootAndArchitecture", 1, "index.md", text(10), True).unionByName(note(t.customer.where("c_custkey % 3 <> 0"), "ProjectNote", 2, "big.md", big, False)).unionByName(note(t.customer, "ComponentNote", 3, "c.md", text(5), False))
    facts = q.withColumn("content", F.lit("repositoryId: r"))
    lines = q.withColumn("line", F.lit("entity x"))
    done = context.build(q.withColumn("content", F.lit("{}")), facts, notes, lines)
    return done.select("query_id", F.col("content").contains("big.md").cast("int").alias("kept_big"))


# ---------------------------------------------------------------- evaluation and live runs


@query("SELECT item_id AS case_id, CAST(r AS INTEGER) AS rank, CASE r WHEN 1 THEN 'required' WHEN 2 THEN 'acceptable' WHEN 3 THEN 'negative' END AS role FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS r)")
def identity_match(spark, t):
    ranked = t.benchmark.select(F.col("item_id").alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).withColumn("id", F.concat(F.lit("x"), "case_id", F.lit("_"), "rank"))
    names = ranked.select("id", F.concat(F.lit("Name"), "id").alias("name"), F.concat(F.lit("a.b."), "id").alias("full_name")).distinct()
    want = t.benchmark.select(F.col("item_id").alias("case_id"), F.explode(F.array(
        F.struct(F.concat(F.lit("X"), "item_id", F.lit("_1")).alias("value"), F.lit("required").alias("role")), F.struct(F.concat(F.lit("nameX"), "item_id", F.lit("_2")).alias("value"), F.lit("acceptable").alias("role")),
        F.struct(F.concat(F.lit("A.B.x"), "item_id", F.lit("_3")).alias("value"), F.lit("negative").alias("role")), F.struct(F.concat(F.lit("A.B.x"), "item_id", F.lit("_1")).alias("value"), F.lit("negative").alias("role")),
    )).alias("w")).select("case_id", "w.*")
    return evaluation.match(ranked, want, names).select("case_id", "rank", "role")


@query("SELECT item_id AS case_id, item_id % 6 = 0 AS passed, CASE WHEN item_id % 6 = 1 THEN 0.5 ELSE 1.0 END AS recall_at_10, CASE WHEN item_id % 6 = 4 THEN 50100 ELSE 100 END AS call2 FROM benchmark")
def harness_cases(spark, t):
    """Six kinds of cases: sound, a missing entity, a wrong type, invalid evidence, a context above the limit, a clarification that did not come."""
    b = t.benchmark.select(F.col("item_id").alias("case_id"), (F.col("item_id") % 6).alias("m"))
    cases = b.select("case_id", (F.col("m") == 5).alias("clarification_expected"), F.lit(False).alias("clarification_actual"))
    ranked = b.select("case_id", F.lit(1).alias("rank"), F.lit("required").alias("role"), F.lit("A").alias("value"), F.lit(False).alias("is_test")).unionByName(b.where("m <> 1").select("case_id", F.lit(2).alias("rank"), F.lit("required").alias("role"), F.lit("B").alias("value"), F.lit(False).alias("is_test")))
    want = b.select("case_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("value"), F.lit("required").alias("role"))
    p = b.select("case_id", F.lit(1).alias("rank"), F.lit("required").alias("role"), F.lit("P").alias("value"), F.lit(False).alias("is_test"))
    wp = b.select("case_id", F.lit("p").alias("value"), F.lit("required").alias("role"))
    rec = b.select("case_id", F.lit("Reuse").alias("decision"), F.when(F.col("m") == 2, F.lit(None)).when(F.col("m") == 3, "Invalid").otherwise("Validated").alias("status"), F.lit(True).alias("expected"))
    seg = b.select(F.col("case_id").alias("query_id"), F.lit("ProjectNote").alias("kind"), F.when(F.col("m") == 4, 50_000).otherwise(0).alias("tokens"))
    ctx = harness.context_metrics(seg, 100).withColumnRenamed("query_id", "case_id")
    return harness.evaluate(cases, ranked, want, p, wp, rec, ctx).select("case_id", "passed", "recall_at_10", F.col("call2").cast("int").alias("call2"))


@query("SELECT item_id AS case_id, decision, CASE decision WHEN 'Create' THEN 'Proposal' ELSE 'Fact' END AS epistemic_status, CASE WHEN decision <> 'Create' AND item_id % 3 <> 0 THEN 'd' || item_id END AS entity_id FROM benchmark, (SELECT unnest(['Create', 'Reuse']) AS decision)")
def golden_analysis(spark, t):
    k = F.col("item_id")
    c = t.benchmark.select(k.alias("case_id"), F.array(F.lit("Create"), F.lit("Reuse")).alias("recommendation_types"), F.array(F.lit("lost"), F.when(k % 3 != 0, F.concat(F.lit("NAME"), k)).otherwise("none"), F.lit("namez")).alias("evidence_entities"))
    e = t.benchmark.select(F.concat(F.lit("d"), k).alias("id"), F.concat(F.lit("name"), k).alias("name"), F.lit("f").alias("full_name"))
    return harness.golden_analysis(c, e)


@query("SELECT item_id AS case_id, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS recall_at_5, CASE item_id % 3 WHEN 2 THEN 0.0 ELSE 1.0 / (1 + item_id % 3) END AS reciprocal_rank, len(['x', 'y'][1:[0, 1, 2][1 + item_id % 3]]) AS n_missing FROM benchmark")
def live_retrieval(spark, t):
    """Two required entities, of which both, one, or none are ranked."""
    k = F.col("item_id")
    b = t.benchmark.select(k.alias("case_id"))
    names = t.benchmark.select(F.explode(F.array(F.concat(F.lit("A"), k), F.concat(F.lit("B"), k))).alias("id")).withColumn("name", F.concat(F.lit("n"), "id"))
    want = t.benchmark.select(k.alias("case_id"), F.explode(F.array(F.concat(F.lit("a"), k), F.concat(F.lit("Nb"), k))).alias("value"))
    ranked = t.benchmark.where("item_id % 3 = 0").select(k.alias("case_id"), F.concat(F.lit("A"), k).alias("id"), F.lit(1).alias("rank"))
    ranked = ranked.unionByName(t.benchmark.where("item_id % 3 < 2").select(k.alias("case_id"), F.concat(F.lit("B"), k).alias("id"), F.lit(2).alias("rank")))
    ranks = harness.first_ranks(want, ranked, names)
    return harness.live_retrieval(b, ranks, ranks.limit(0)).select("case_id", "recall_at_5", "reciprocal_rank", F.size("missing_entities").cast("long").alias("n_missing"))


@query("SELECT conv_id AS case_id, bool_or(turn % 3 = 0) AS decision_hit, count(*) FILTER (WHERE turn % 4 = 0) AS validated, CASE WHEN count(*) FILTER (WHERE turn % 4 <> 3) = 0 THEN 1 ELSE count(*) FILTER (WHERE turn % 4 = 0) / count(*) FILTER (WHERE turn % 4 <> 3) END AS evidence_rate FROM conversations GROUP BY conv_id")
def call2_metrics(spark, t):
    k = F.col("turn")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    r = t.conversations.select(F.col("conv_id").alias("case_id"), pick(["Reuse", "Extend", "Create"], 3).alias("decision"), pick(["Validated", "Invalid", "PartiallyValidated", "Proposal"], 4).alias("validation"), F.lit(1).alias("n_evidence"), (k % 4 == 0).cast("int").alias("n_valid"))
    c = t.conversations.select(F.col("conv_id").alias("case_id")).distinct().select("case_id", F.array(F.lit("Reuse")).alias("acceptable_decisions"), F.array(F.lit("Complete")).alias("acceptable_statuses"), F.lit("Complete").alias("status"))
    h = c.select("case_id", F.lit("x").alias("value"), F.lit(True).alias("required"), F.lit(True).alias("referenced"))
    return harness.call2(c, r, h).select("case_id", "decision_hit", "validated", "evidence_rate")


@query("""SELECT user_id AS case_id, CASE WHEN bool_or(event_id % 5 = 0) THEN 1.0 ELSE 0.0 END AS activation_accuracy, count(*) FILTER (WHERE event_id % 5 = 0 AND event_id % 2 = 0) AS escapes FROM events GROUP BY user_id""")
def policy_metrics(spark, t):
    e = t.events.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("recommendation_id"), F.lit(policy.POLICIES[0][0]).alias("policy_id"), F.lit("Block").alias("severity"), F.when(F.col("event_id") % 5 == 0, "Violated").otherwise("NotApplicable").alias("status"))
    want = e.select("case_id", "policy_id", F.lit(True).alias("expected_active")).distinct()
    d = e.select("case_id", "recommendation_id", F.when(F.col("recommendation_id") % 2 == 0, "Accepted").otherwise("Rejected").alias("disposition"))
    return harness.policy_metrics(want, e, d)


@query(f"""WITH a AS (SELECT conv_id AS case_id, unnest({tokens_sql("coalesce(text, '')")}) AS term FROM conversations), g AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM benchmark), v AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM documents)
SELECT DISTINCT case_id, term, term NOT IN (SELECT term FROM v) AS harmful FROM a WHERE term NOT IN (SELECT term FROM g)""")
def extra_terms(spark, t):
    a = t.conversations.select(F.col("conv_id").alias("case_id"), F.explode(X.tokens(F.col("text"))).alias("term"))
    golden = t.benchmark.select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    mine = a.join(golden, "term", "left_semi").select("case_id", "term").distinct()
    return live.extra_terms(a, mine, t.wide("documents").select(F.explode(X.tokens(F.col("text"))).alias("term")))


@query("SELECT n, path FROM (SELECT CAST(row_number() OVER (ORDER BY upper(path), path) AS INTEGER) AS n, path FROM (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN upper(p) ELSE p END AS path FROM (SELECT page_id, 'p/' || page_id AS p FROM pages))) WHERE n <= 30")
def ordered_files(spark, t):
    p = F.concat(F.lit("p/"), F.col("page_id"))
    first = files.ordered(page_files(t).select(F.when(F.col("page_id") % 2 == 0, F.upper(p)).otherwise(p).alias("relative_path")).distinct()).limit(30)
    return first.agg(F.collect_list("relative_path").alias("p")).select(F.posexplode("p").alias("n", "path")).select((F.col("n") + 1).alias("n"), "path")
