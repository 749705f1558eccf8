"""The library's operators bound to the shared tables, each with SQL for another engine where SQL can say it.

Keys begin with the survey's row ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import causal, graph, ledger, retrieval, views
from .plans import adapters as A
from .plans import contract, dag
from .session import run_folder, settle, table
from .ship import ship
from .sources import catalog
from .streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def r6(name: str):
    return (F.round(F.col(name), 6) + 0.0).alias(name)


V = A.with_views

# -- graph -----------------------------------------------------------------------------------


@query("g20_adoption", V("nodes", "implements") + """
SELECT p.label AS plan, CAST(coalesce(n, 0) AS BIGINT) AS documents FROM nodes p
LEFT JOIN (SELECT d.plan_id, count(*) AS n FROM (SELECT DISTINCT source FROM implements) i JOIN nodes d ON d.id = i.source WHERE d.kind = 'document' GROUP BY 1) x
ON x.plan_id = p.plan_id WHERE p.kind = 'plan'""")
def adoption(spark, d):
    return graph.adoption(A.nodes(spark, d), A.implements(spark, d))


@query("a02_adoption_reach", V("nodes", "implements") + """
SELECT target AS letter, count(DISTINCT plan_id) AS plans, count(*) AS documents FROM implements JOIN nodes ON id = source WHERE kind = 'document' GROUP BY 1""")
def adoption_reach(spark, d):
    return graph.reach(A.nodes(spark, d), A.implements(spark, d))


@query("j03_stale_citations", V("implements", "supersedes") + """
SELECT i.source AS document, i.target AS cited, s.source AS superseded_by FROM implements i JOIN supersedes s ON s.target = i.target""")
def stale(spark, d):
    return graph.stale_citations(A.implements(spark, d).unionByName(A.supersedes(spark, d)))


def letter_docs(spark, d) -> DataFrame:
    """Documents whose titles are the letters they implement."""
    words = A.implements(spark, d).groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("letter"), F.replace("target", F.lit("apl:"), F.lit(""))))), " ").alias("title"))
    return words.join(A.nodes(spark, d).where("kind = 'document'").select("id", "plan_id"), "id")


SHARED = """has AS (SELECT i.source AS id, plan_id, i.target AS term FROM implements i JOIN nodes n ON n.id = i.source WHERE kind = 'document'),
band AS (SELECT term FROM has GROUP BY term HAVING count(*) BETWEEN 2 AND 60),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM has a JOIN has b ON a.term = b.term AND a.id < b.id AND a.plan_id <> b.plan_id JOIN band ON band.term = a.term GROUP BY 1, 2)"""


@query("j02_cross_plan_pairs", V("nodes", "implements") + ", " + SHARED + """
SELECT a, b, shared, x.plan_id AS plan_a, x.label AS label_a, y.plan_id AS plan_b, y.label AS label_b FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b
WHERE lower(x.label) LIKE '%1%' OR lower(y.label) LIKE '%1%'""")
def cross_plan(spark, d):
    pairs = graph.shared_terms(letter_docs(spark, d), least=1, stop=[])
    return graph.cross_plan(pairs, A.nodes(spark, d), "1").select("a", "b", "shared", "plan_a", "label_a", "plan_b", "label_b")


@query("a01_graph_counts", V("nodes", "implements", "supersedes", "structural", "edges") + """
SELECT kind AS name, count(*) AS n, 'node' AS what FROM nodes GROUP BY 1 UNION ALL SELECT relationship_type, count(*), 'edge' FROM edges GROUP BY 1""")
def graph_counts(spark, d):
    return graph.counts(A.nodes(spark, d), A.edges(spark, d))


@query("j05_plan_profile", V("nodes", "implements") + """
SELECT plan_id, count(*) AS documents, count(*) FILTER (WHERE id IN (SELECT source FROM implements)) AS implementing FROM nodes WHERE kind = 'document' GROUP BY 1""")
def plan_profile(spark, d):
    return graph.plan_profile(A.nodes(spark, d), A.edges(spark, d))


@query("a19_degree_topk", V("implements", "supersedes", "structural", "edges") + """
SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1 ORDER BY degree DESC, id LIMIT 20""")
def degree_topk(spark, d):
    return graph.top_degrees(A.edges(spark, d), 20)


def _lineage_sql(a: str, b: str) -> str:
    return V("supersedes", recursive=True) + f""", walk AS (
SELECT 'apl:' || p_partkey AS start, 'apl:' || p_partkey AS node, 0 AS depth FROM part
UNION ALL SELECT start, {b}, depth + 1 FROM walk JOIN supersedes ON {a} = node WHERE depth < 12)
SELECT DISTINCT start, node, CAST(depth AS INTEGER) AS depth FROM walk"""


def _seeds(spark, d):
    return table(spark, d, "part").select(X.node_id("apl", F.col("p_partkey")).alias("id"))


@query("g17_lineage_down", _lineage_sql("source", "target"))
def lineage_down(spark, d):
    return graph.lineage(A.supersedes(spark, d), _seeds(spark, d))


@query("g17_lineage_up", _lineage_sql("target", "source"))
def lineage_up(spark, d):
    return graph.lineage(A.supersedes(spark, d), _seeds(spark, d), down=False)


@query("g18_longest_chains", V("supersedes", recursive=True) + """, walk AS (
SELECT source AS head, source AS node, 1 AS length, source AS path FROM supersedes WHERE source NOT IN (SELECT target FROM supersedes)
UNION ALL SELECT head, target, length + 1, path || '>' || target FROM walk JOIN supersedes ON source = node)
SELECT head, CAST(length AS INTEGER) AS length, path FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY length DESC, path) AS r FROM walk) WHERE r = 1""")
def longest_chains(spark, d):
    return graph.longest_chains(A.supersedes(spark, d))


STATUS = V("nodes", "implements", "supersedes", recursive=True) + """, sup AS (SELECT target AS letter, max(source) AS newer_by FROM supersedes GROUP BY 1),
later AS (SELECT letter, newer_by AS later FROM sup UNION ALL SELECT l.letter, s.newer_by FROM later l JOIN sup s ON s.letter = l.later),
newer AS (SELECT DISTINCT i.source, i.target FROM implements i JOIN later ON later.letter = i.target JOIN implements j ON j.source = i.source AND j.target = later.later),
status AS (SELECT i.source AS document, n.plan_id, i.target AS letter, s.newer_by IS NOT NULL AS replaced, s.newer_by IS NOT NULL AND w.source IS NULL AS old_only
FROM implements i JOIN nodes n ON n.id = i.source LEFT JOIN sup s ON s.letter = i.target LEFT JOIN newer w ON w.source = i.source AND w.target = i.target) """


@query("a16_citation_currency", STATUS + """
SELECT plan_id, count(*) AS citations, count(*) FILTER (WHERE NOT replaced) AS "current", count(*) FILTER (WHERE replaced) AS replaced, count(*) FILTER (WHERE old_only) AS replaced_old_only,
count(DISTINCT document) AS docs_citing, count(DISTINCT CASE WHEN old_only THEN document END) AS docs_old_only FROM status GROUP BY 1""")
def citation_currency(spark, d):
    s = graph.citation_status(A.nodes(spark, d), A.implements(spark, d).unionByName(A.supersedes(spark, d)))
    return s.groupBy("plan_id").agg(
        F.count("*").alias("citations"), F.count_if(~F.col("replaced")).alias("current"), F.count_if("replaced").alias("replaced"), F.count_if("old_only").alias("replaced_old_only"),
        F.countDistinct("document").alias("docs_citing"), F.countDistinct(F.when(F.col("old_only"), F.col("document"))).alias("docs_old_only"),
    )


@query("a17_replaced_letters", STATUS + """
SELECT letter, count(*) AS citations, count(*) FILTER (WHERE old_only) AS old_only, count(DISTINCT plan_id) AS plans FROM status WHERE replaced GROUP BY 1""")
def replaced_letters(spark, d):
    s = graph.citation_status(A.nodes(spark, d), A.implements(spark, d).unionByName(A.supersedes(spark, d)))
    return s.where("replaced").groupBy("letter").agg(F.count("*").alias("citations"), F.count_if("old_only").alias("old_only"), F.countDistinct("plan_id").alias("plans"))


@query("a18_replacements_by_year", V("supersedes") + """
SELECT CAST(2000 + yy AS INTEGER) AS year, count(*) AS n FROM (SELECT CAST(substr(source, 5) AS BIGINT) % 100 AS yy FROM supersedes) WHERE 2000 + yy <= 2026 GROUP BY 1""")
def replacements_by_year(spark, d):
    key = F.concat(F.lpad((F.substring("source", 5, 20).cast("bigint") % 100).cast("string"), 2, "0"), F.lit("-001"))
    return A.supersedes(spark, d).select(X.replacement_year(key).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("n"))


@query("g06_k_hop", V("nodes", "implements", "supersedes") + """, und AS (
SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM (SELECT source, target FROM implements UNION ALL SELECT source, target FROM supersedes)),
step AS (SELECT a, b FROM und UNION ALL SELECT b, a FROM und),
seed AS (SELECT id FROM nodes WHERE kind = 'document' AND plan_id = '7'),
one AS (SELECT DISTINCT b AS id FROM step WHERE a IN (SELECT id FROM seed) AND b NOT IN (SELECT id FROM seed)),
two AS (SELECT DISTINCT b AS id FROM step WHERE a IN (SELECT id FROM one) AND b NOT IN (SELECT id FROM seed) AND b NOT IN (SELECT id FROM one))
SELECT id, split_part(id, ':', 1) AS kind, CAST(hops AS INTEGER) AS hops FROM (SELECT id, 1 AS hops FROM one UNION ALL SELECT id, 2 FROM two)""")
def k_hop(spark, d):
    seeds = A.nodes(spark, d).where("kind = 'document' and plan_id = '7'").select("id")
    return graph.neighbours(A.edges(spark, d), seeds, 2, most=None)


@query("g08_components", V("supersedes", recursive=True) + """, step AS (SELECT source AS a, target AS b FROM supersedes UNION SELECT target, source FROM supersedes),
walk AS (SELECT a AS start, a AS node FROM step UNION SELECT start, b FROM walk JOIN step ON a = node)
SELECT start AS id, min(node) AS component FROM walk GROUP BY 1""")
def component_labels(spark, d):
    return graph.components(graph.undirected(A.supersedes(spark, d), once=False))


@query("g11_reach", V("supersedes", recursive=True) + """, step AS (SELECT source AS a, target AS b FROM supersedes UNION SELECT target, source FROM supersedes),
walk AS (SELECT a AS start, a AS node FROM step UNION SELECT start, b FROM walk JOIN step ON a = node),
sizes AS (SELECT component, count(*) AS n FROM (SELECT start, min(node) AS component FROM walk GROUP BY 1) GROUP BY 1)
SELECT count(*) AS components, max(n) AS largest, round(CAST(sum(n * (n - 1)) AS DOUBLE) / (sum(n) * (sum(n) - 1)), 6) AS reach FROM sizes""")
def reachability(spark, d):
    found = graph.components(graph.undirected(A.supersedes(spark, d), once=False))
    return graph.reachable_share(found).select("components", *long("largest"), r6("reach"))


def _doc_graph(spark, d):
    return settle(graph.shared_terms(letter_docs(spark, d), least=1, stop=[]).select("a", "b"))


@query("g09_clustering", V("nodes", "implements") + ", " + SHARED + """, ends AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs), deg AS (SELECT id, count(*) AS d FROM ends GROUP BY 1),
tri AS (SELECT count(*) AS n FROM pairs p JOIN pairs q ON q.a = p.b JOIN pairs r ON r.a = p.a AND r.b = q.b)
SELECT CAST((SELECT n FROM tri) AS BIGINT) AS triangles, CAST(sum(d * (d - 1) / 2) AS BIGINT) AS triples, round(3.0 * (SELECT n FROM tri) / sum(d * (d - 1) / 2), 6) AS clustering FROM deg""")
def clustering(spark, d):
    return graph.clustering(_doc_graph(spark, d)).select("triangles", "triples", r6("clustering"))


@query("g10_mean_path", V("nodes", "implements", recursive=True) + ", " + SHARED + """, step AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (SELECT DISTINCT a AS start, a AS node, 0 AS depth FROM step UNION SELECT start, b, depth + 1 FROM walk JOIN step ON a = node WHERE depth < 12),
best AS (SELECT start, node, min(depth) AS hops FROM walk GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(hops), 6) AS mean_path FROM best WHERE hops > 0""")
def mean_path(spark, d):
    return graph.mean_path(_doc_graph(spark, d)).select("pairs", r6("mean_path"))


@query("p12_dangling_dedupe", V("implements", "supersedes", "structural", "edges") + """,
known AS (SELECT 'apl:' || p_partkey AS id FROM part WHERE p_size <= 25 UNION ALL SELECT 'doc:' || s_suppkey FROM supplier UNION ALL SELECT 'plan:' || n_nationkey FROM nation)
SELECT DISTINCT source, target, relationship_type FROM edges WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)""")
def dangling_dedupe(spark, d):
    small = table(spark, d, "part").where("p_size <= 25").select(X.node_id("apl", F.col("p_partkey")).alias("id"))
    known = A.nodes(spark, d).where("kind in ('document', 'plan')").select("id").unionByName(small)
    e = A.edges(spark, d)
    e = e.unionByName(e)  # each twice
    met = e.join(known, e["source"] == known["id"], "left_semi").join(known, e["target"] == known["id"], "left_semi")
    return met.select("source", "target", "relationship_type").distinct()


def titles(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("plan_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))


TERMS = "string_split_regex(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9 ]+', ' ', 'g'), ' +')"
STOP = ", ".join(f"'{w}'" for w in X.TITLE_STOP)
TITLE_PAIRS = f"""WITH has AS (SELECT DISTINCT doc_id AS id, source AS plan_id, unnest({TERMS}) AS term FROM documents),
kept AS (SELECT * FROM has WHERE length(term) > 3 AND term NOT IN ({STOP})), band AS (SELECT term FROM kept GROUP BY term HAVING count(*) BETWEEN 2 AND 60)
SELECT a.id AS a, b.id AS b, count(*) AS shared FROM kept a JOIN kept b ON a.term = b.term AND a.id < b.id AND a.plan_id <> b.plan_id JOIN band ON band.term = a.term GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("j12_shared_terms", TITLE_PAIRS)
def shared_terms(spark, d):
    return graph.shared_terms(titles(spark, d))


@query("g05_shared_terms_capped", f"""WITH RECURSIVE pairs AS ({TITLE_PAIRS}), p AS (SELECT a, b, row_number() OVER (ORDER BY shared DESC, a, b) AS rn FROM pairs),
greedy(k, rn, ends) USING KEY (k) AS (SELECT 1, 0::BIGINT, []::BIGINT[] UNION ALL
SELECT 1, p.rn, CASE WHEN len(list_filter(ends, lambda x: x = a)) < 6 AND len(list_filter(ends, lambda x: x = b)) < 6 THEN ends || [a, b] ELSE ends END FROM greedy JOIN p ON p.rn = greedy.rn + 1),
taken AS (SELECT ends, unnest(range(1, len(ends), 2)) AS i FROM greedy) SELECT pairs.a, pairs.b, pairs.shared FROM taken JOIN pairs ON pairs.a = ends[i] AND pairs.b = ends[i + 1]""")
def shared_terms_capped(spark, d):
    return graph.capped(graph.shared_terms(titles(spark, d)))


# -- text ------------------------------------------------------------------------------------

def literal(spark, column: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k int, {column} string")


def values_sql(column: str, values: list[str]) -> str:
    rows = ", ".join(f"({i}, '{v.replace(chr(39), chr(39) * 2)}')" for i, v in enumerate(values))
    return f"t(k, {column}) AS (VALUES {rows})"


@query("f01_letter_ids", V("letters") + " SELECT DISTINCT k, unnest(ids) AS id FROM letters")
def letter_ids(spark, d):
    return A.letters(spark, d).select("k", F.explode(X.letter_ids(F.col("s"))).alias("id"))


#: What the default prefilter passes of A.WAYS: a singular followed by an id with a plain hyphen.
PASSED = "(0, 1, 2, 3, 5, 9)"


@query("g04_implements_mined", V("letters") + f""", hits AS (SELECT source AS plan_id, lang, doc_id, ids FROM documents JOIN letters ON k = doc_id WHERE k % 10 IN {PASSED} AND text IS NOT NULL),
each AS (SELECT DISTINCT plan_id, lang, doc_id, unnest(ids) AS id FROM hits)
SELECT 'doc:' || plan_id || '/' || lang AS source, 'apl:' || id AS target, CAST(count(*) AS DOUBLE) AS weight FROM each GROUP BY 1, 2""")
def implements_mined(spark, d):
    # the tables' prose names no letters: each document gets a sentence with some in front of its whole text
    docs = table(spark, d, "documents").join(A.letters(spark, d), F.col("doc_id") == F.col("k"))
    return graph.mined_edges(docs.select(F.col("source").alias("plan_id"), F.col("lang").alias("filename"), F.concat("s", F.lit(".\n"), "text").alias("text"))).select("source", "target", "weight")


SUPERSEDING = {  # how a title says what it replaces, and the edges (newer, older) in it: ids one and two, and a third
    "APL {1}: {n} (Supersedes APL {2})": [(1, 2)], "APL {1} {n} superseded by APL {2}": [(2, 1)], "APL {1} {n}": [],
    "APL {1} Supersedes APL {2} and 88-613; superseded by APL 45-214": [("45-214", 1), (1, 2), (1, "88-613")],
}


def _superseding_sql() -> str:
    name = lambda x: {1: "one", 2: "two"}.get(x, f"'{x}'")
    rows = " ".join(f"WHEN {i} THEN [" + ", ".join(f"{{'a': {name(a)}, 'b': {name(b)}}}" for a, b in e) + "]" for i, e in enumerate(SUPERSEDING.values()) if e)
    return V("letters") + f", e AS (SELECT unnest(CASE k % 4 {rows} ELSE [] END) AS e FROM letters) SELECT 'apl:' || e.a AS source, 'apl:' || e.b AS target, 3.0::DOUBLE AS weight FROM e WHERE e.a <> e.b"


@query("g03_supersede_edges", _superseding_sql())
def supersede_edges(spark, d):
    ways = " ".join(f"WHEN {i} THEN concat('" + w.replace("{1}", "', one, '").replace("{2}", "', two, '").replace("{n}", "', p_name, '") + "')" for i, w in enumerate(SUPERSEDING))
    cat = A.letters(spark, d).select(F.lit("apl").alias("doc_kind"), F.lit("").alias("policy_number"), F.expr(f"CASE CAST(k % 4 AS INT) {ways} END").alias("title"))
    return graph.supersede_edges(cat).select("source", "target", "weight")


@query("f04_labels", """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN p_name ELSE upper(p_brand) || ': ' || p_name END AS label FROM part""")
def labels(spark, d):
    p = table(spark, d, "part").withColumn("m", F.col("p_partkey") % 4)
    number = F.when(F.col("m") == 2, F.lit("  ")).when(F.col("m") == 0, F.concat(F.lit(" "), "p_brand", F.lit("\t"))).otherwise(F.col("p_brand"))
    title = F.when(F.col("m") == 1, F.concat("p_brand", F.lit(" "), "p_name")).when(F.col("m") == 3, F.concat(F.upper("p_brand"), F.lit(": "), "p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    return p.select(F.col("p_partkey").alias("k"), X.label(number, title).alias("label"))


@query("f06_safe_names", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, substr(regexp_replace(regexp_replace(p_name || ' & ' || p_type, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 90) AS name FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.safe_name(F.concat("p_name", F.lit(" & "), "p_type")).alias("name"))


#: Addresses and words of links: folder, name and text by a part's number; {n}: its name with spaces as escapes or as they are.
FOLDERS = ["um-rules", "rx", "credential-files", "qm-plans", "claims", "guidelines", "library"]
FILES = ["{n}.pdf", "{n}%20form.pdf", "formulary-{n}.PDF", "ops%20guide-{n}.pdf", "{n}_handbook.pdf", "manual-{n}.pdf"]
WORDS = ["{n} rules", "Download", "here", "AB-12 {n}", "QX7: {n} list", "Weekly bulletin {n}", "Checklist for {n}", "View »", "CDE9 {n} »", "Drug list {n}", "eoc"]
_PICK = lambda xs, key: "CASE CAST(" + key + f" % {len(xs)} AS INT) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
LINK_EXPR = ("'https://site' || (p_size % 5) || '.example/' || " + _PICK(FOLDERS, "p_size") + " || '/' || replace(" + _PICK(FILES, "p_partkey") + ", '{n}', replace(p_name, ' ', '%20'))", "replace(" + _PICK(WORDS, "p_partkey") + ", '{n}', p_name)")
LINK_SQL = f"WITH p AS (SELECT p_partkey AS k, {LINK_EXPR[0]} AS url, {LINK_EXPR[1]} AS txt FROM part) "


def links(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(LINK_EXPR[0]).alias("url"), F.expr(LINK_EXPR[1]).alias("txt"))


def case_sql(rules, other: str, subject: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE {other} END"


@query("f08_doc_kind", LINK_SQL + "SELECT k, " + case_sql(X.KINDS, "'policy'", "lower(txt || ' ' || url_decode(url))") + " AS kind FROM p")
def doc_kind(spark, d):
    return links(spark, d).select("k", X.doc_kind(F.col("url"), F.col("txt")).alias("kind"))


@query("f09_department", LINK_SQL + "SELECT k, " + case_sql(X.DEPARTMENTS, "CASE WHEN contains(lower(url), 'manual') THEN 'Provider Manual' ELSE 'Provider Resources' END", "lower(url || ' ' || txt)") + " AS department FROM p")
def department(spark, d):
    return links(spark, d).select("k", X.department(F.col("url"), F.col("txt")).alias("department"))


#: A code's form and what should be read from it as a site's and as a vendor's code, {m}: a number below a thousand.
CODES = {
    "AB-{m} {n}": ("AB-{m}", ""), "QZ{m} {n}": ("QZ{m}", "QZ{m}"), "RS-TU{m}: {n}": ("RS-TU{m}", ""), "{m} {n}": ("", ""), "VWX{m}  {n}": ("VWX{m}", "VWX{m}"), "APL {m}-014 {n}": ("", ""),
    "lower{m} {n}": ("", ""), "KL{m}b, {n}": ("KL{m}b", "KL{m}b"),
}


def _codes_sql() -> str:
    put = lambda w: "'" + w.replace("{m}", "' || m || '").replace("{n}", "' || p_name || '") + "'"
    pick = lambda xs: f"CASE k % {len(CODES)} " + " ".join(f"WHEN {i} THEN {put(x)}" for i, x in enumerate(xs)) + " END"
    rest = [w.replace(v, "", 1).lstrip(" ") if v else w for w, (_, v) in CODES.items()]
    return f"SELECT k, {pick([s for s, _ in CODES.values()])} AS site, {pick([v for _, v in CODES.values()])} AS vendor, {pick(rest)} AS rest FROM (SELECT p_partkey AS k, p_name, p_partkey % 1000 AS m FROM part)"


@query("f10_codes", _codes_sql())
def codes(spark, d):
    ways = " ".join(f"WHEN {i} THEN concat('" + w.replace("{m}", "', p_partkey % 1000, '").replace("{n}", "', p_name, '") + "')" for i, w in enumerate(CODES))
    s = F.col("s")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(f"CASE CAST(p_partkey % {len(CODES)} AS INT) {ways} END").alias("s")).select("k", X.site_code(s).alias("site"), X.vendor_code(s).alias("vendor"), X.vendor_title(s).alias("rest"))


@query("f07_titles", LINK_SQL + f""", t AS (SELECT k, url, trim(regexp_replace(txt, '[»]+\\s*$', '')) AS txt FROM p) SELECT k, CASE WHEN lower(txt) NOT IN ({", ".join(f"'{g}'" for g in X.GENERIC)}) AND length(txt) >= 4 THEN txt
ELSE regexp_replace(regexp_replace(url_decode(regexp_extract(url, '([^/]*)$', 1)), '\\.[A-Za-z0-9]+$', ''), '_|-', ' ', 'g') END AS title FROM t""")
def doc_titles(spark, d):
    return links(spark, d).select("k", X.doc_title(F.col("txt"), F.col("url")).alias("title"))


@query("f14_years", """SELECT p_partkey, CAST(CASE WHEN yy >= 90 THEN 1900 + yy ELSE 2000 + yy END AS INTEGER) AS year, CAST(CASE WHEN yy <= 26 THEN 2000 + yy ELSE 0 END AS INTEGER) AS replaced FROM (SELECT p_partkey, p_partkey % 100 AS yy FROM part)""")
def years(spark, d):
    key = F.concat(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("-001"))
    return table(spark, d, "part").select("p_partkey", X.letter_year(key).alias("year"), F.coalesce(X.replacement_year(key), F.lit(0)).alias("replaced"))


@query("f15_clock_seconds", """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN p_size * 86400.0::DOUBLE WHEN 1 THEN p_size * 3600.0::DOUBLE WHEN 2 THEN p_size * 3600.0::DOUBLE WHEN 3 THEN NULL ELSE p_size * 86400.0::DOUBLE END AS seconds FROM part""")
def clock_seconds(spark, d):
    ways = ["concat(p_size, ' calendar days')", "concat('within ', p_size, ' Hours')", "concat(p_size, ' hours of ', p_size + 1)", "concat('at ', p_name)", "concat('in ', p_size, ' or 9 days')"]
    s = F.expr("CASE CAST(p_partkey % 5 AS INT) " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.clock_seconds(s).alias("seconds"))


ROBOTS = "User-agent: bad\nDisallow: /\n\nUser-agent: a\nUser-agent: *\nDisallow: /fr/8  # comment\nDisallow: /*?page=2\nDisallow:\nAllow: /x\n\nUser-agent: other\nDisallow: /en"


@query("f13_robots", """SELECT page_id, NOT (regexp_matches(path, '^/fr/8') OR regexp_matches(path, '^/.*\\?page=2')) AS allowed
FROM (SELECT page_id, CASE WHEN regexp_replace(url, '^https?://[^/]+', '') = '' THEN '/' ELSE regexp_replace(url, '^https?://[^/]+', '') END AS path FROM pages)""")
def robots(spark, d):
    rules = F.transform(X.robots_rules(F.lit(ROBOTS)), lambda r: r)
    return table(spark, d, "pages").select("page_id", X.robots_allowed(F.col("url"), rules).alias("allowed"))


# -- sources ---------------------------------------------------------------------------------


@query("s06_page_links", """SELECT page_id, regexp_extract(a, '<a href="([^"]*)">', 1) AS href, regexp_extract(a, '">([^<]*)</a>', 1) AS text
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS a FROM pages)""")
def page_links(spark, d):
    return catalog.simple_links(table(spark, d, "pages"))


@query("j10_chunk_pages", """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE length(text) > 0),
starts AS (SELECT doc_id, page, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM lines),
cuts AS (SELECT doc_id, unnest(generate_series(1, length(text), 800)) AS at FROM documents WHERE length(text) > 0)
SELECT c.doc_id, CAST(c.at AS BIGINT) AS at, count(*) AS page FROM cuts c JOIN starts s ON s.doc_id = c.doc_id AND s.start <= c.at GROUP BY 1, 2""")
def chunk_pages(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 0")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    starts = catalog.page_starts(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))  # a document's own pages
    cuts = docs.select("doc_id", F.explode(F.expr("sequence(1, length(text), 800)")).alias("at"))
    return cuts.join(starts, "doc_id").select("doc_id", *long("at"), catalog.page_of(F.col("starts"), F.col("at")).cast("bigint").alias("page"))


@query("w05_filename_dedupe", """WITH c AS (SELECT source AS plan_id, lang || '.pdf' AS filename, CAST(doc_id AS VARCHAR) AS doc_id FROM documents),
one AS (SELECT *, row_number() OVER (PARTITION BY plan_id, filename ORDER BY doc_id) - 1 AS r FROM c),
two AS (SELECT plan_id, doc_id, CASE WHEN r > 0 THEN replace(filename, '.pdf', '') || '_' || substr(doc_id, 1, 6) || '.pdf' ELSE filename END AS filename FROM one),
three AS (SELECT *, row_number() OVER (PARTITION BY plan_id, filename ORDER BY doc_id) - 1 AS r FROM two)
SELECT plan_id, doc_id, CASE WHEN r > 0 THEN replace(filename, '.pdf', '') || '_' || r || '.pdf' ELSE filename END AS filename FROM three""")
def filename_dedupe(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("plan_id"), F.concat("lang", F.lit(".pdf")).alias("filename"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("source_url"))
    return catalog.dedupe_filenames(c).select("plan_id", "doc_id", "filename")


@query("s13_merge_by_plan", """WITH old AS (SELECT source AS plan_id, doc_id, 'old' AS edition FROM documents), new AS (SELECT source AS plan_id, doc_id + 1000000 AS doc_id, 'new' AS edition FROM documents WHERE source IN ('src1', 'src2'))
SELECT * FROM old WHERE plan_id NOT IN (SELECT plan_id FROM new) UNION ALL SELECT * FROM new""")
def merge_by_plan(spark, d):
    old = table(spark, d, "documents").select(F.col("source").alias("plan_id"), "doc_id", F.lit("old").alias("edition"))
    new = table(spark, d, "documents").where("source in ('src1', 'src2')").select(F.col("source").alias("plan_id"), (F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("edition"))
    return catalog.merged_by_plan(old, new)


@query("s18_incremental_diff", """SELECT doc_id, md5(text) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'en' AND o.doc_id = d.doc_id)""")
def incremental_diff(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("origin"), F.md5("text").alias("hash"), "lang")
    return catalog.changed(docs.select("origin", "hash"), docs.where("lang = 'en'").select("origin", "hash")).select(F.col("origin").alias("doc_id"), "hash")


# -- retrieval -------------------------------------------------------------------------------


@query("t02_density_scope", V("chunks") + """
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(lower(text), 'tion')) AS hits, count(*) AS total, round(count(*) FILTER (WHERE regexp_matches(lower(text), 'tion')) * 1.0 / count(*), 6) AS density
FROM chunks GROUP BY 1 HAVING count(*) FILTER (WHERE regexp_matches(lower(text), 'tion')) >= 3 AND count(*) FILTER (WHERE regexp_matches(lower(text), 'tion')) * 1.0 / count(*) >= 0.15""")
def density_scope(spark, d):
    return retrieval.density_scope(A.chunks(spark, d), "doc_id", "tion").select("doc_id", "hits", "total", r6("density"))


BM25_QUERY = "heitung cionmente oftion thation"


def _bm25_sql(stems: list[str]) -> str:
    tf = ", ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{s}', ''))) / {len(s)} AS INTEGER) AS tf{i}" for i, s in enumerate(stems))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(stems)))
    part = " + ".join(f"CASE WHEN df{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) ELSE 0 END" for i in range(len(stems)))
    return V("chunks") + f""", f AS (SELECT chunk_id, length(text) AS len, {tf} FROM chunks), s AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM f)
SELECT chunk_id, round(score, 6) AS score FROM (SELECT chunk_id, {part} AS score FROM f, s) WHERE score > 0"""


@query("t01_bm25", _bm25_sql(retrieval.question_stems(BM25_QUERY)))
def bm25(spark, d):
    return retrieval.bm25(A.chunks(spark, d), BM25_QUERY).select("chunk_id", r6("score"))


RARE_QUERY = "what must thation with heitung ofthand"


def _rarity_sql(stems: list[str]) -> str:
    df = ", ".join(f"greatest(count(*) FILTER (WHERE contains(lower(text), '{s}')), 1) AS df{i}" for i, s in enumerate(stems))
    part = " + ".join(f"round(1 / ln(1 + df{i}), 4) * CAST(contains(lower(text), '{s}') AS INTEGER)" for i, s in enumerate(stems))
    return V("chunks") + f", s AS (SELECT {df} FROM chunks) SELECT chunk_id, round(hits, 6) AS hits FROM (SELECT chunk_id, {part} AS hits FROM chunks, s WHERE length(text) > 200) WHERE hits > 0"


@query("t04_rarity_score", _rarity_sql(retrieval.question_stems(RARE_QUERY, 3, 7, tuple(X.QUESTION_STOP))))
def rarity_score(spark, d):
    return retrieval.rarity(A.chunks(spark, d), RARE_QUERY, None, stop=tuple(X.QUESTION_STOP)).select("chunk_id", r6("hits"))


@query("t10_facets", V("chunks") + """, hits AS (SELECT c.*, d.lang FROM chunks c JOIN documents d ON d.doc_id = c.doc_id WHERE contains(lower(c.text), 'tion'))
SELECT 'plan_id' AS facet, plan_id AS name, count(*) AS n FROM hits GROUP BY 2 UNION ALL SELECT 'page', CAST(page AS VARCHAR), count(*) FROM hits GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM hits GROUP BY 2""")
def facets(spark, d):
    hits = A.chunks(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where(F.lower("text").contains("tion"))
    return retrieval.facets(hits, ["plan_id", "page", "lang"])


@query("t05_first_page", V("chunks") + """ SELECT doc_id, CAST(min(page) AS INTEGER) AS page FROM chunks WHERE regexp_matches(lower(text), 'heitung|thation') GROUP BY 1""")
def first_page(spark, d):
    return retrieval.first_page(A.chunks(spark, d), ["heitung", "thation"])


@query("t06_authority_passage", V("chunks") + """ SELECT doc_id, chunk_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(lower(text), 'heitung|thation') THEN 0 ELSE 1 END, page, start) AS r FROM chunks WHERE length(text) > 300) WHERE r = 1""")
def authority_passage(spark, d):
    return retrieval.authority_passage(A.chunks(spark, d), ["heitung", "thation"]).select("doc_id", "chunk_id")


@query("t07_applicable", V("nodes", "implements") + """ SELECT source AS id, plan_id, label, weight AS mentions FROM implements JOIN nodes ON id = source WHERE target = 'apl:7'""")
def applicable(spark, d):
    return retrieval.applicable(A.nodes(spark, d), A.implements(spark, d), "apl:7", top=None)


SNIPPET_SQL = """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents),
p AS (SELECT *, instr(lower(flat), 'heitung') AS a, instr(lower(flat), 'thation') AS b FROM f),
s AS (SELECT doc_id, flat, greatest(1, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 1 END - 90) AS start FROM p),
c AS (SELECT doc_id, start, replace(replace(replace(substr(flat, start, 321), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS cut FROM s)
SELECT doc_id, CASE WHEN start > 1 THEN '… ' ELSE '' END || regexp_replace(regexp_replace(cut, '(?i)(heitung)', '<mark>\\1</mark>', 'g'), '(?i)(thation)', '<mark>\\1</mark>', 'g') || ' …' AS snippet FROM c"""


@query("f19_snippets", SNIPPET_SQL)
def snippets(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.snippet(F.col("text"), ["heitung", "thation"]).alias("snippet"))


UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))"


@query("a08_centroids", """WITH v AS (SELECT DISTINCT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM v),
m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2) SELECT label, CAST(pos AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) + 0.0 AS value FROM m""")
def centroids(spark, d):
    return retrieval.centroids(table(spark, d, "embeddings"), "label").select("label", "pos", r6("value"))


@query("o05_vector_topk", f"""WITH q AS (SELECT [1.0::DOUBLE] || list_transform(range(63), lambda i: 0.0::DOUBLE) AS q), s AS (SELECT label, vec_id, list_dot_product({UNIT}, q) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 32),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) SELECT label, vec_id, round(score, 6) AS score FROM b WHERE r = 1 ORDER BY score DESC, vec_id LIMIT 8""")
def vector_topk(spark, d):
    return retrieval.vector_top(table(spark, d, "embeddings"), [1.0] + [0.0] * 63, "label").select("label", "vec_id", r6("score"))


PAIR_SQL = f"""WITH u AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS r FROM s WHERE sim >= 0.25 - 1e-12), alike AS (SELECT a, b, sim FROM r WHERE r <= 3) """


@query("j11_similar_pairs", PAIR_SQL + "SELECT a, b, round(sim, 6) AS sim FROM alike")
def similar_pairs(spark, d):
    return retrieval.similar_pairs(table(spark, d, "embeddings"), "label", 0.25).select("a", "b", r6("sim"))


@query("g15_shortcut_candidates", PAIR_SQL.rstrip() + """, step AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings))
SELECT a, b, round(sim, 6) AS sim FROM alike WHERE b - a >= 4""")
def shortcut_candidates(spark, d):
    e = table(spark, d, "embeddings")
    line = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(e.select(F.col("vec_id").alias("b")), "b", "left_semi").select("a", "b")
    return graph.shortcut_candidates(retrieval.similar_pairs(e, "label", 0.25), line).select("a", "b", r6("sim"))


# -- ledger ----------------------------------------------------------------------------------


def fields(spark, d) -> DataFrame:
    """The events with all fields of a digest as strings; a case's events are its ledger."""
    e = ledger.with_iso(A.ledger(spark, d)).withColumn("case_id", F.col("case_id").cast("string"))
    for f in ledger.FIELDS[1:]:
        if f not in e.columns:
            e = e.withColumn(f, F.lit("NA" if f == "supersedes" else None).cast("string"))
    return e


DIGEST = """sha256(concat_ws(chr(31), {prev}, 'e' || event_id, CAST(user_id AS VARCHAR), '', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '', '',
CASE event_type WHEN 'signup' THEN 'case.created' WHEN 'view' THEN 'evidence.retrieved' WHEN 'click' THEN 'assistance.requested' WHEN 'purchase' THEN 'disposition.recorded' WHEN 'error' THEN 'correction.recorded' END, '', '', '', '', props, 'NA'))"""
CHAIN_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
chain AS (SELECT user_id, n, event_id, '' AS prev_hash, {DIGEST.format(prev="''")} AS hash FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, c.hash, {DIGEST.format(prev="c.hash").replace("user_id", "e.user_id").replace("event_id", "e.event_id")} FROM chain c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1) """


@query("w03_chained_events", CHAIN_SQL + "SELECT event_id AS seq, prev_hash, hash FROM chain")
def chained_events(spark, d):
    return ledger.chained(fields(spark, d), "case_id").select("seq", "prev_hash", "hash")


@query("l02_hash_chain_verify", """WITH e AS (SELECT event_id AS seq, user_id, event_id % 89 = 5 AS gone, event_id % 97 = 3 AS changed FROM events),
kept AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY user_id ORDER BY seq) AS after_gone FROM e),
bad AS (SELECT user_id, seq, CASE WHEN after_gone THEN 'link' WHEN changed THEN 'digest' END AS why FROM kept WHERE NOT gone)
SELECT CAST(user_id AS VARCHAR) AS case_id, count(why) = 0 AS ok, count(*) AS n, min(seq) FILTER (WHERE why IS NOT NULL) AS broken_at, arg_min(why, seq) FILTER (WHERE why IS NOT NULL) AS why FROM bad GROUP BY 1""")
def hash_chain_verify(spark, d):
    # some events are taken out of the ledgers and some are changed after they were chained
    e = ledger.chained(fields(spark, d), "case_id").where("seq % 89 <> 5").withColumn("payload", F.when(F.col("seq") % 97 == 3, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return ledger.verify(e, none="NA", by=F.col("case_id")).select(F.col("ledger").alias("case_id"), "ok", "n", "broken_at", "why")


@query("f26_event_digest", """SELECT event_id AS seq, sha256(concat_ws(chr(31), '', 'e' || event_id, CAST(user_id AS VARCHAR), '', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '', '',
CASE event_type WHEN 'signup' THEN 'case.created' WHEN 'view' THEN 'evidence.retrieved' WHEN 'click' THEN 'assistance.requested' WHEN 'purchase' THEN 'disposition.recorded' WHEN 'error' THEN 'correction.recorded' END, '', '', '', '', props, '')) AS hash FROM events""")
def event_digest(spark, d):
    e = ledger.with_iso(A.ledger(spark, d))
    for f in ledger.FIELDS[1:]:
        if f not in e.columns:
            e = e.withColumn(f, F.lit(None).cast("string"))
    return e.select("seq", ledger.digest(F.lit("")).alias("hash"))


@query("l03_ledger_current", """SELECT event_id AS seq FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.event_id = e.event_id + 1)""")
def ledger_current(spark, d):
    e = A.ledger(spark, d).withColumn("supersedes", F.when(F.col("event_type") == "correction.recorded", F.concat(F.lit("e"), F.col("seq") - 1)))
    return ledger.current(e).select("seq")


GATE_SQL = V("ledger") + """, gates(gate_id, seconds) AS (VALUES ('ACK', 432000.0::DOUBLE), ('RESOLVE_STANDARD', 2592000.0), ('RESOLVE_EXPEDITED', 259200.0), ('CLASSIFY', NULL)),
cases AS (SELECT case_id, min(occurred_at) AS received, case_id % 3 = 0 AS expedited FROM ledger WHERE event_type = 'case.created' GROUP BY 1),
met AS (SELECT DISTINCT case_id, CASE WHEN seq % 2 = 0 THEN 'ACK' ELSE 'RESOLVE_STANDARD' END AS gate_id FROM ledger WHERE event_type = 'disposition.recorded'),
g AS (SELECT c.case_id, g.gate_id, seconds, (epoch_us(received) + coalesce(seconds, 0) * 1e6 - epoch_us(TIMESTAMP '2024-01-20 00:00:00')) / 3.6e9 AS remaining, m.gate_id IS NOT NULL AS met
FROM cases c JOIN gates g ON g.gate_id <> CASE WHEN expedited THEN 'RESOLVE_STANDARD' ELSE 'RESOLVE_EXPEDITED' END LEFT JOIN met m ON m.case_id = c.case_id AND m.gate_id = g.gate_id),
status AS (SELECT case_id, gate_id, CASE WHEN seconds IS NULL THEN NULL ELSE round(remaining, 6) + 0.0 END AS remaining,
CASE WHEN met THEN 'met' WHEN seconds IS NULL THEN 'open' WHEN remaining < 0 THEN 'breached' WHEN remaining < 24 THEN 'due soon' ELSE 'open' END AS status FROM g) """


def _gates(spark, d) -> DataFrame:
    e = A.ledger(spark, d)
    cases = e.where("event_type = 'case.created'").groupBy("case_id").agg(F.min("occurred_at").alias("received")).withColumn("expedited", F.col("case_id") % 3 == 0)
    events = e.withColumn("gate_id", F.when(F.col("seq") % 2 == 0, "ACK").otherwise("RESOLVE_STANDARD")).withColumn("supersedes", F.lit(None).cast("string"))
    return ledger.gate_status(cases, ledger.gates(spark), events, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("l04_gate_status", GATE_SQL + "SELECT * FROM status")
def gate_status(spark, d):
    return _gates(spark, d).select("case_id", "gate_id", r6("remaining"), "status")


@query("p15_case_status", GATE_SQL + """SELECT case_id, CASE max(CASE status WHEN 'breached' THEN 3 WHEN 'due soon' THEN 2 WHEN 'met' THEN 0 ELSE 1 END) WHEN 3 THEN 'breached' WHEN 2 THEN 'due soon' WHEN 1 THEN 'open' ELSE 'all met' END AS status FROM status GROUP BY 1""")
def case_status(spark, d):
    return ledger.case_status(_gates(spark, d))


@query("l05_conflicts", """WITH RECURSIVE above AS (SELECT 1 AS hops, n_nationkey AS person, n_regionkey + 100 AS above FROM nation UNION ALL SELECT hops + 1, person, 999 FROM above WHERE above BETWEEN 100 AND 104),
decided AS (SELECT event_id, user_id AS case_id, user_id % 10 AS subject, CASE WHEN event_id % 4 = 0 THEN 100 + event_id % 5 ELSE event_id % 25 END AS by_, event_type FROM events WHERE event_type IN ('purchase', 'view')),
asked AS (SELECT DISTINCT user_id AS case_id, user_id % 25 AS actor, user_id % 10 AS subject FROM events),
met AS (SELECT a.case_id, a.actor, d.event_id, d.by_ FROM asked a JOIN decided d ON (d.event_type = 'view' AND d.case_id = a.case_id) OR (d.subject = a.subject AND (d.event_type = 'view' OR d.case_id <> a.case_id)))
SELECT DISTINCT m.case_id, m.event_id FROM met m LEFT JOIN above b ON b.person = m.actor AND b.above = m.by_ WHERE m.actor = m.by_ OR b.above IS NOT NULL""")
def conflicts(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')")
    by = F.when(F.col("event_id") % 4 == 0, 100 + F.col("event_id") % 5).otherwise(F.col("event_id") % 25).cast("string")
    kind = F.when(F.col("event_type") == "view", "prior_decision.attested").otherwise("disposition.recorded")
    events = e.select(F.col("event_id"), F.col("user_id").alias("case_id"), (F.col("user_id") % 10).cast("string").alias("subject_ref"), by.alias("actor"), kind.alias("event_type"))
    asked = table(spark, d, "events").select(F.col("user_id").alias("case_id"), (F.col("user_id") % 25).cast("string").alias("actor"), (F.col("user_id") % 10).cast("string").alias("subject_ref")).distinct()
    n = table(spark, d, "nation")
    chart = n.select(F.col("n_nationkey").cast("string").alias("person"), (F.col("n_regionkey") + 100).cast("string").alias("boss"))
    chart = chart.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("string").alias("person"), F.lit("999").alias("boss")))
    return ledger.conflicting(asked, events, ledger.supervisors(chart))


@query("a22_backlog", V("ledger") + """, f AS (SELECT case_id, min(occurred_at) FILTER (WHERE event_type = 'case.created') AS o, min(occurred_at) FILTER (WHERE event_type = 'disposition.recorded') AS c FROM ledger GROUP BY 1),
m AS (SELECT date_trunc('day', o) AS t, 1 AS up, 0 AS down FROM f WHERE o IS NOT NULL UNION ALL SELECT date_trunc('day', greatest(o, c)), 0, 1 FROM f WHERE o IS NOT NULL AND c IS NOT NULL),
s AS (SELECT t, sum(up) AS opened, sum(down) AS closed FROM m GROUP BY 1)
SELECT strftime(t, '%Y-%m-%d') AS day, CAST(opened AS BIGINT) AS opened, CAST(closed AS BIGINT) AS closed, CAST(sum(opened - closed) OVER (ORDER BY t) AS BIGINT) AS queued FROM s""")
def backlog(spark, d):
    return ledger.backlog(A.ledger(spark, d)).select(F.date_format("at", "yyyy-MM-dd").alias("day"), *long("opened", "closed"), F.col("open").cast("bigint").alias("queued"))


CASES_SQL = V("ledger") + """, g AS (SELECT case_id, min(occurred_at) FILTER (WHERE event_type = 'case.created') AS o, min(occurred_at) FILTER (WHERE event_type = 'disposition.recorded') AS c, min(occurred_at) FILTER (WHERE event_type = 'assistance.requested') AS a,
arg_min(payload, seq) FILTER (WHERE event_type = 'case.created') AS p FROM ledger GROUP BY 1),
cases AS (SELECT case_id, o, c, CAST(a IS NOT NULL AS INTEGER) AS assisted_any, CAST(coalesce(a < c, false) AS INTEGER) AS assisted_before, CAST(c IS NOT NULL AS INTEGER) AS resolved, (epoch_us(c) - epoch_us(o)) / 3.6e9 AS hours, TRY_CAST(json_extract_string(p, '$.k') AS DOUBLE) AS k FROM g WHERE o IS NOT NULL) """


@query("l07_case_outcomes", CASES_SQL + "SELECT case_id, assisted_any, assisted_before, resolved, round(hours, 6) + 0.0 AS hours_to_resolution, k FROM cases")
def case_outcomes(spark, d):
    return ledger.case_outcomes(A.ledger(spark, d)).select("case_id", "assisted_any", "assisted_before", "resolved", r6("hours_to_resolution"), "k")


@query("l08_rollout_panel", CASES_SQL + """, used AS (SELECT case_id % 25 AS actor, min(occurred_at) AS first_use FROM ledger WHERE event_type = 'assistance.requested' AND case_id % 25 <> 3 GROUP BY 1), common AS (SELECT median(epoch_us(first_use)) AS t FROM used)
SELECT case_id, CAST(u.actor IS NOT NULL AS INTEGER) AS adopter, CAST(epoch_us(o) >= floor(t) AS INTEGER) AS post FROM cases LEFT JOIN used u ON u.actor = case_id % 25, common""")
def rollout_panel(spark, d):
    e = A.ledger(spark, d).withColumn("actor", F.col("case_id") % 25)
    cases = ledger.case_outcomes(A.ledger(spark, d)).withColumn("actor", F.col("case_id") % 25)
    return ledger.rollout_panel(cases, e.where("actor <> 3")).select("case_id", "adopter", "post")


@query("l09_readiness", CASES_SQL + "SELECT count(*) AS cases, count(DISTINCT case_id % 25) AS actors, CASE WHEN count(*) < 30 THEN 'too few cases: ' || count(*) || ' of 30' ELSE 'satisfiable' END AS message FROM cases")
def readiness(spark, d):
    cases = ledger.case_outcomes(A.ledger(spark, d)).withColumn("operator", F.col("case_id") % 25)
    r = ledger.readiness(cases, ["case_id", "operator", "hours_to_resolution"])
    return spark.createDataFrame([(r["cases"], r["actors"], r["message"])], "cases bigint, actors bigint, message string")


@query("l10_passport_controls", """WITH c AS (SELECT 'C-' || p_partkey AS id, p_name AS title, p_size > 40 AS low, p_partkey % 50 = 0 AS withdrawn, p_size AS n FROM part), plus AS (SELECT 'C-' || p_partkey AS id FROM part WHERE p_size IN (1, 45)), own AS (SELECT 'C-' || p_partkey AS id FROM part WHERE p_size IN (2, 50))
SELECT id, title, 'baseline:low' AS origin, '' AS reason, n AS n_params FROM c WHERE low AND NOT withdrawn UNION ALL SELECT c.id, title, 'addition', 'why not', n FROM plus JOIN c USING (id) WHERE NOT low UNION ALL SELECT c.id, title, 'inherited', 'from: host', n FROM own JOIN c USING (id)""")
def passport_controls(spark, d):
    p = table(spark, d, "part").withColumn("id", F.concat(F.lit("C-"), F.col("p_partkey")))
    cat = p.select("id", F.col("p_name").alias("title"), (F.col("p_partkey") % 50 == 0).alias("withdrawn"), F.when(F.col("p_size") > 40, F.array(F.lit("low"), F.lit("high"))).otherwise(F.array(F.lit("high"))).alias("baselines"), F.col("p_size").alias("n_params"))
    add = p.where("p_size in (1, 45)").select("id", F.lit(" why \n not ").alias("reason"))
    own = p.where("p_size in (2, 50)").select("id", F.lit("host").alias("source"))
    return contract.passport_controls(cat, "low", add, own)[0]


@query("f28_json_payload", "SELECT event_id AS seq, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_payload(spark, d):
    return A.ledger(spark, d).select("seq", X.tolerant_number(F.col("payload"), "$.k").alias("k"))


#: Answers about letters one and two of a part, shown as (letter, page): one on pages 3 and 5; what they cite, how much of it isn't shown, and whether nothing counts.
ANSWERS = {
    "See APL {1} page 3 and page 5; apl {2} page 4.": (3, 1), "page 3 alone, then APL {1}": (0, 0), "Nothing of {n}.": (0, 0), "APL {1}, page 9": (1, 1), "APL {1} page 3, page 3": (1, 0),
}


def _answers_sql() -> str:
    pick = lambda i: f"CASE k % {len(ANSWERS)} " + " ".join(f"WHEN {j} THEN {v[i]}" for j, v in enumerate(ANSWERS.values())) + " END"
    shown = "'APL ' || one || '#' || p"
    cited = "CASE k % 5 " + " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(["['APL ' || one || '#3', 'APL ' || one || '#5', 'APL ' || two || '#4']", "[]", "[]", "['APL ' || one || '#9']", "['APL ' || one || '#3']"])) + " END"
    return V("letters") + f""", shown AS (SELECT DISTINCT {shown} AS c FROM letters, (VALUES (3), (5)) v(p)), cited AS (SELECT DISTINCT k, unnest({cited}) AS c FROM letters)
SELECT k AS id, count(cited.c) AS cited, count(cited.c) FILTER (WHERE cited.c NOT IN (SELECT c FROM shown)) AS unverified, count(cited.c) = 0 AS uncited FROM letters LEFT JOIN cited USING (k) GROUP BY 1"""


@query("f21_citation_tokens", _answers_sql())
def citation_tokens(spark, d):
    ways = " ".join(f"WHEN {i} THEN concat('" + w.replace("{1}", "', one, '").replace("{2}", "', two, '").replace("{n}", "', p_name, '") + "')" for i, w in enumerate(ANSWERS))
    letters = A.letters(spark, d)
    answers = letters.select(F.col("k").alias("id"), F.expr(f"CASE CAST(k % {len(ANSWERS)} AS INT) {ways} END").alias("answer"))
    shown = letters.select(F.concat(F.lit("APL "), "one").alias("policy_number"), F.explode(F.array(F.lit(3), F.lit(5))).alias("page"))
    return retrieval.verified_citations(answers, shown)


QUESTIONS = {  # what is asked about a part, and whether it asks for a determination
    "Should I uphold the {n}?": True, "Whats the right disposition of {n}": False, "What is the right disposition of {n}": True, "How many days to acknowledge {n}?": False, "is this case of {n} likely expedited": True,
    "what does the letter say on {n}": False, "tell me how to decide {n}": True, "OVERTURN THIS {n}": True,
}


@query("f20_determination_guard", f"SELECT p_partkey AS k, p_partkey % {len(QUESTIONS)} IN ({', '.join(str(i) for i, v in enumerate(QUESTIONS.values()) if v)}) AS refused FROM part")
def determination_guard(spark, d):
    ways = " ".join(f"WHEN {i} THEN concat('" + w.replace("{n}", "', p_name, '") + "')" for i, w in enumerate(QUESTIONS))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.asks_determination(F.expr(f"CASE CAST(p_partkey % {len(QUESTIONS)} AS INT) {ways} END")).alias("refused"))


# -- causal ----------------------------------------------------------------------------------

FRAME_SQL = """WITH n AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS y, CASE WHEN r > 1 THEN 1 ELSE 0 END AS x, CAST(q AS DOUBLE) AS q, CAST(n AS DOUBLE) AS k, CAST(c_acctbal AS DOUBLE) / 1000 AS b, c_nationkey AS operator,
CAST(c_nationkey % 2 AS INTEGER) AS adopter, CASE WHEN o_orderdate >= TIMESTAMP '1995-06-01' THEN 1 ELSE 0 END AS post FROM orders JOIN n ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey) """


def frame(spark, d) -> DataFrame:
    """Orders as cases: y outcome, x exposure, q, k and b covariates, nations as operators."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("k"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"))
    o = table(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("y"), F.when(F.col("r") > 1, 1).otherwise(0).alias("x"), F.col("q").cast("double").alias("q"), "k", (F.col("c_acctbal") / 1000).alias("b"),
        F.col("c_nationkey").alias("operator"), (F.col("c_nationkey") % 2).cast("int").alias("adopter"), F.when(F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz"), 1).otherwise(0).alias("post"),
    )


@query("c01_naive_effect", FRAME_SQL + "SELECT count(*) FILTER (WHERE x = 1) AS n_treated, count(*) FILTER (WHERE x = 0) AS n_control, round(avg(y) FILTER (WHERE x = 1), 6) AS mean_treated, round(avg(y) FILTER (WHERE x = 0), 6) AS mean_control, round(avg(y) FILTER (WHERE x = 1) - avg(y) FILTER (WHERE x = 0), 6) AS effect FROM f")
def naive_effect(spark, d):
    return causal.naive_effect(frame(spark, d), "y", "x").select("n_treated", "n_control", r6("mean_treated"), r6("mean_control"), r6("effect"))


SCORED_SQL = FRAME_SQL + ", s AS (SELECT *, 1 / (1 + exp(-(0.3::DOUBLE * k - 1.2::DOUBLE + 0.05::DOUBLE * b))) AS propensity FROM f) "


def scored(spark, d) -> DataFrame:
    return frame(spark, d).withColumn("propensity", 1 / (1 + F.exp(-(F.lit(0.3) * F.col("k") - 1.2 + F.lit(0.05) * F.col("b")))))


@query("c03_overlap", SCORED_SQL + """, b AS (SELECT greatest(min(propensity) FILTER (WHERE x = 1), min(propensity) FILTER (WHERE x = 0)) AS lo, least(max(propensity) FILTER (WHERE x = 1), max(propensity) FILTER (WHERE x = 0)) AS hi,
count(*) FILTER (WHERE x = 1 AND propensity > 0.8) AS nt, count(*) FILTER (WHERE x = 0 AND propensity > 0.8) AS nc FROM s)
SELECT round(lo, 6) AS support_low, round(hi, 6) AS support_high, (SELECT count(*) FROM s WHERE x = 1 AND NOT propensity BETWEEN lo AND hi) AS outside, round(CASE WHEN nt = 0 THEN 0 ELSE nt * 1.0::DOUBLE / nc END, 6) AS ratio, CASE WHEN nt = 0 THEN true ELSE nt * 1.0::DOUBLE / nc < 5 END AS ok FROM b""")
def overlap(spark, d):
    return causal.overlap(scored(spark, d), "x").select(r6("support_low"), r6("support_high"), "outside", r6("ratio"), "ok")


@query("c06_smd", FRAME_SQL + " ".join(("" if i == 0 else "UNION ALL ") + f"SELECT '{c}' AS covariate, round((avg({c}) FILTER (WHERE x = 1) - avg({c}) FILTER (WHERE x = 0)) / stddev_samp({c}) FILTER (WHERE x = 1), 6) AS smd FROM f" for i, c in enumerate("qkb")))
def smd(spark, d):
    return causal.standardised_differences(frame(spark, d), "x", ["q", "k", "b"]).select("covariate", r6("smd"))


@query("c10_did_2x2", FRAME_SQL + """SELECT count(*) AS n, round((avg(y) FILTER (WHERE adopter = 1 AND post = 1) - avg(y) FILTER (WHERE adopter = 1 AND post = 0)) - (avg(y) FILTER (WHERE adopter = 0 AND post = 1) - avg(y) FILTER (WHERE adopter = 0 AND post = 0)), 4) AS effect FROM f""")
def did_2x2(spark, d):
    r = causal.did(frame(spark, d), "y")
    return spark.createDataFrame([(r["n"], round(float(r["estimate"]), 4))], "n bigint, effect double")


@query("c07_weighted_slope", SCORED_SQL + """SELECT round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 5) AS slope FROM (SELECT *, CASE WHEN x = 1 THEN 1.0::DOUBLE ELSE propensity / (1 - propensity) END AS w FROM s),
(SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM (SELECT x, y, CASE WHEN x = 1 THEN 1.0::DOUBLE ELSE propensity / (1 - propensity) END AS w FROM s))""")
def weighted_slope(spark, d):
    w = F.when(F.col("x") == 1, 1.0).otherwise(F.col("propensity") / (1 - F.col("propensity")))
    fit = causal.least_squares(scored(spark, d), "y", {"x": F.col("x")}, w)
    return spark.createDataFrame([(round(float(fit["coef"]["x"]), 5),)], "slope double")


@query("a13_quantiles", FRAME_SQL + "SELECT round(median(y), 6) AS median, round(quantile_cont(y, 0.01), 6) AS low, round(quantile_cont(y, 0.99), 6) AS high FROM f")
def quantiles(spark, d):
    return spark.createDataFrame([tuple(round(q, 6) for q in causal.quantiles(frame(spark, d), "y", [0.5, 0.01, 0.99]))], "median double, low double, high double")


@query("a14_zscore", FRAME_SQL + "SELECT id, round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 6) + 0.0 AS z FROM f")
def zscore(spark, d):
    return causal.zscore(frame(spark, d), "q", "z").select("id", r6("z"))


@query("c15_roi", """WITH i AS (SELECT s_suppkey AS id, -s_acctbal / 1000 AS low, -s_acctbal / 1000 + s_nationkey / 4.0 AS high FROM supplier)
SELECT id, round(-high * 420 * 62 - 9000, 4) + 0.0 AS net_low, round(-low * 420 * 62 - 9000, 4) + 0.0 AS net_high, -high * 420 * 62 - 9000 < 0 AND -low * 420 * 62 - 9000 > 0 AS crosses_zero FROM i""")
def roi(spark, d):
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (-F.col("s_acctbal") / 1000).alias("low"), (-F.col("s_acctbal") / 1000 + F.col("s_nationkey") / 4.0).alias("high"))
    r = causal.roi_columns(F.col("low"), F.col("high"), 420, 62, 9000)
    return i.select("id", (F.round(r["net_low"], 4) + 0.0).alias("net_low"), (F.round(r["net_high"], 4) + 0.0).alias("net_high"), r["crosses_zero"].alias("crosses_zero"))


#: The diagram of the measurement contract.
DAG = tuple((a, "assisted") for a in ("complexity", "expedited", "backlog", "tenure", "sdoh")) + tuple((a, "hours") for a in ("complexity", "expedited", "backlog", "tenure", "sdoh", "citation")) + (("assisted", "citation"),)


@query("a21_gaps", "SELECT count(*) AS needed, count(*) FILTER (WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)) AS answered, count(*) FILTER (WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)) AS open FROM (SELECT p_partkey AS id FROM part)")
def gaps(spark, d):
    return views.gaps(table(spark, d, "part").select(F.col("p_partkey").alias("id")), table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id")))


@query("a23_retrieval_gain", V("nodes", "implements", "supersedes") + """, seed AS (SELECT 'doc:' || s_suppkey AS id, s_nationkey % 5 AS query FROM supplier WHERE s_acctbal > 5000),
one AS (SELECT DISTINCT query, target AS id FROM seed JOIN implements ON source = seed.id), f AS (SELECT query, id, 'seed' AS layer FROM seed UNION ALL SELECT query, id, 'graph' FROM one),
g AS (SELECT query, layer, n.plan_id FROM f LEFT JOIN nodes n ON n.id = f.id)
SELECT query, count(DISTINCT CASE WHEN layer = 'seed' THEN plan_id END) AS before, count(DISTINCT plan_id) AS after, count(*) FILTER (WHERE layer = 'graph') >= 40 AS capped FROM g GROUP BY 1""")
def retrieval_gain(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(X.node_id("doc", F.col("s_suppkey")).alias("id"), (F.col("s_nationkey") % 5).alias("query"))
    one = s.join(A.implements(spark, d), F.col("id") == F.col("source")).select("query", F.col("target").alias("id")).distinct()
    found = s.select("query", "id", F.lit("seed").alias("layer")).unionByName(one.select("query", "id", F.lit("graph").alias("layer")))
    return views.retrieval_gain(found, A.nodes(spark, d).select("id", "plan_id")).select("query", "before", "after", "capped")


CHAINS_SQL = """walk AS (SELECT source AS head, source AS node, 1 AS length, source AS path FROM supersedes WHERE source NOT IN (SELECT target FROM supersedes)
UNION ALL SELECT head, target, length + 1, path || '>' || target FROM walk JOIN supersedes ON source = node),
chains AS (SELECT head, length, path FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY length DESC, path) AS r FROM walk) WHERE r = 1)"""


@query("s25_graph_view", V("nodes", "implements", "supersedes", "structural", "edges", recursive=True) + ", " + CHAINS_SQL + """,
docs AS (SELECT n.plan_id, count(*) AS documents, count(i.source) AS implementing FROM nodes n LEFT JOIN (SELECT DISTINCT source FROM implements) i ON i.source = n.id WHERE kind = 'document' GROUP BY 1),
reach AS (SELECT target AS letter, count(DISTINCT plan_id) AS plans, count(*) AS documents FROM implements JOIN nodes ON id = source WHERE kind = 'document' GROUP BY 1 ORDER BY plans DESC, documents DESC, letter LIMIT 60)
SELECT 'counts' AS part, '{"name":"' || kind || '","n":' || count(*) || ',"what":"node"}' AS json FROM nodes GROUP BY kind UNION ALL SELECT 'counts', '{"name":"' || relationship_type || '","n":' || count(*) || ',"what":"edge"}' FROM edges GROUP BY relationship_type
UNION ALL SELECT 'plans', '{"plan_id":"' || plan_id || '","documents":' || documents || ',"implementing":' || implementing || '}' FROM docs
UNION ALL SELECT 'chains', '{"head":"' || head || '","length":' || length || ',"path":"' || path || '"}' FROM chains WHERE length >= 2
UNION ALL SELECT 'reach', '{"letter":"' || letter || '","plans":' || plans || ',"documents":' || documents || '}' FROM reach""")
def graph_view(spark, d):
    return views.graph_view(A.nodes(spark, d), A.edges(spark, d))


# -- streams ---------------------------------------------------------------------------------


@query("m01_stream_counts", V("ledger") + " SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM ledger GROUP BY 1, 2")
def stream_counts(spark, d):
    folder, e = staged(spark, A.ledger(spark, d))
    s = streams.counts_by_window(streams.event_stream(spark, f"{folder}/in", e.schema))
    return streams.replayed(s, folder, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def staged(spark, e: DataFrame) -> tuple[str, DataFrame]:
    """A folder whose ``in`` holds the events as files to be read as a stream."""
    import uuid

    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    e.write.parquet(f"{folder}/in")
    return folder, e


from . import queries_more, queries_sources, queries_store  # noqa: E402, F401  they add to QUERIES and SQL
