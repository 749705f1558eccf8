"""Queries of predicates, orders, text functions, graphs, ledgers and effects that queries.py has none for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import causal, graph, ledger, retrieval, views
from .plans import adapters as A
from .plans import contract, dag
from .queries import CASES_SQL, DAG, FRAME_SQL, GATE_SQL, PAIR_SQL, SCORED_SQL, SHARED, UNIT, V, _doc_graph, _gates, fields, frame, query, r6, scored
from .session import settle, table
from .sources import catalog


def position(ordered, *keys):
    """A sorted table's rows with their place in it; keys: what places count within."""
    placed = ordered.withColumn("_i", F.monotonically_increasing_id())
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_i"))).drop("_i")


# -- predicates, orders and lookups ----------------------------------------------------------


@query("p01_in_list", V("nodes", "implements") + " SELECT source AS id, plan_id, target AS letter FROM implements JOIN nodes ON id = source WHERE target = 'apl:7' AND plan_id IN ('3', '8', '15', '20') UNION ALL SELECT source, plan_id, target FROM implements JOIN nodes ON id = source WHERE target = 'apl:8'")
def in_list(spark, d):
    of = lambda letter, plans: retrieval.applicable(A.nodes(spark, d), A.implements(spark, d), letter, plans, None).select("id", "plan_id", F.lit(letter).alias("letter"))
    return of("apl:7", ["3", "8", "15", "20"]).unionByName(of("apl:8", None))


@query("p16_display", GATE_SQL + """, prior AS (SELECT user_id AS case_id, event_id AS seq FROM events WHERE event_type = 'view'), done AS (SELECT DISTINCT user_id AS case_id FROM events WHERE event_type = 'click')
SELECT 'open' AS what, case_id, gate_id AS item FROM status WHERE status <> 'met' AND gate_id <> 'CLASSIFY' UNION ALL SELECT 'prior', case_id, 'e' || seq FROM prior UNION ALL SELECT 'classified', case_id, '' FROM done""")
def display(spark, d):
    e = A.ledger(spark, d).withColumn("event_type", F.when(F.col("event_type") == "evidence.retrieved", "prior_decision.attested").when(F.col("event_type") == "assistance.requested", "operator.confirmed").otherwise(F.col("event_type")))
    e = e.withColumn("gate_id", F.lit("CLASSIFY")).withColumn("actor", F.lit("a")).withColumn("supersedes", F.lit(None).cast("string"))
    open_ = ledger.open_gates(_gates(spark, d)).select(F.lit("open").alias("what"), "case_id", F.col("gate_id").alias("item"))
    prior = ledger.prior_decisions(e).select(F.lit("prior").alias("what"), "case_id", F.col("event_id").alias("item"))
    return open_.unionByName(prior).unionByName(ledger.classified(e).select(F.lit("classified").alias("what"), "case_id", F.lit("").alias("item")))


@query("p17_sign_flags", """SELECT s_suppkey, (s_acctbal - 4000) * (s_nationkey - 12) < 0 AS signs_differ, -9 BETWEEN s_nationkey - 30 AND s_nationkey - 12 AS recovered FROM supplier""")
def sign_flags(spark, d):
    flags = causal.sign_flags(F.col("s_acctbal") - 4000, F.col("s_nationkey") - 12, F.col("s_nationkey") - 30, F.col("s_nationkey") - 12, F.lit(-9))
    return table(spark, d, "supplier").select("s_suppkey", *[c.alias(n) for n, c in flags.items()])


@query("j07_first_match", """WITH f AS (SELECT user_id, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1)
SELECT c_custkey, coalesce(event_id, -1) AS event_id FROM customer LEFT JOIN f ON user_id = c_custkey""")
def first_match(spark, d):
    bought = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), "event_id")
    return graph.first_match(table(spark, d, "customer").select("c_custkey"), bought, "c_custkey", [F.col("event_id")], ["event_id"], F.lit(-1))


@query("w01_first_rows", """SELECT url, text FROM (SELECT 'u' || p_size AS url, p_name AS text, row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_name) AS r FROM part) WHERE r = 1""")
def first_rows(spark, d):
    found = table(spark, d, "part").select(F.concat(F.lit("u"), "p_size").alias("url"), F.col("p_name").alias("text"), F.col("p_brand").alias("seed"))
    # a site's catalog has each address once; its title is the first text's
    return catalog.site_catalog(found, "p", ["policy", "formulary", "member", "manual", "notice", "form"]).select(F.col("source_url").alias("url"), F.col("title").alias("text"))


@query("o01_ordered_adoption", V("nodes", "implements") + """, a AS (SELECT p.label AS plan, CAST(coalesce(n, 0) AS BIGINT) AS documents FROM nodes p
LEFT JOIN (SELECT d.plan_id, count(*) AS n FROM (SELECT DISTINCT source FROM implements) i JOIN nodes d ON d.id = i.source WHERE d.kind = 'document' GROUP BY 1) x ON x.plan_id = p.plan_id WHERE p.kind = 'plan')
SELECT CAST(row_number() OVER (ORDER BY documents DESC, plan) AS INTEGER) AS place, plan, documents FROM a""")
def ordered_adoption(spark, d):
    return position(graph.adoption(A.nodes(spark, d), A.implements(spark, d))).select("place", "plan", "documents")


@query("o06_nearest_forty", V("implements", "supersedes", recursive=True) + """, step AS (SELECT source AS a, target AS b FROM implements UNION SELECT target, source FROM implements UNION SELECT source, target FROM supersedes UNION SELECT target, source FROM supersedes),
walk AS (SELECT 'doc:' || s_suppkey AS node, 0 AS hops FROM supplier WHERE s_suppkey = 1 UNION SELECT b, hops + 1 FROM walk JOIN step ON a = node WHERE hops < 2),
best AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)
SELECT node AS id, split_part(node, ':', 1) AS kind, hops FROM best WHERE hops > 0 ORDER BY hops, node LIMIT 40""")
def nearest_forty(spark, d):
    seeds = table(spark, d, "supplier").where("s_suppkey = 1").select(X.node_id("doc", F.col("s_suppkey")).alias("id"))
    return graph.neighbours(A.edges(spark, d), seeds, 2)


@query("o08_gate_order", GATE_SQL.rstrip() + """, due AS (SELECT case_id, gate_id, seconds IS NULL AS clockless, epoch_us(received) + coalesce(seconds, 0) * 1e6 AS due FROM cases JOIN gates g ON g.gate_id <> CASE WHEN expedited THEN 'RESOLVE_STANDARD' ELSE 'RESOLVE_EXPEDITED' END)
SELECT case_id, gate_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY clockless, due, gate_id) AS INTEGER) AS place FROM due""")
def gate_order(spark, d):
    return position(_gates(spark, d), "case_id").select("case_id", "gate_id", "place")


# -- text ------------------------------------------------------------------------------------


@query("f02_letter_keys", V("letters") + " SELECT k, CASE WHEN k % 10 = 9 THEN two ELSE one END AS letter, one AS bare FROM letters WHERE len(ids) > 0")
def letter_keys(spark, d):
    named = A.letters(spark, d).where(f"k % 10 not in ({', '.join(str(i) for i, found in enumerate(A.WAYS.values()) if not found)})")
    return named.select("k", X.letter_key(F.col("s")).alias("letter"), X.letter_key(F.concat(F.lit(" "), "one")).alias("bare"))


@query("f03_authority_keys", V("letters") + " SELECT k, CASE WHEN k % 2 = 0 THEN one ELSE one || '3' END AS authority FROM letters")
def authority_keys(spark, d):
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("APL "), "one", F.lit(", of state"))).otherwise(F.concat(F.lit("Letter ("), "one", F.lit(") § 3")))
    return A.letters(spark, d).select("k", X.authority_key(text).alias("authority"))


LISTED = {"{n} Manual": "manual", "Request for {n}": "form", "{n} Policy and Application": "form", "P&P of {n}": "policy", "{n} procedure": "policy", "About {n}": "form"}


@query("f08b_listing_kinds", f"SELECT p_partkey AS k, CASE p_partkey % {len(LISTED)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LISTED.values())) + " END AS kind FROM part")
def listing_kinds(spark, d):
    title = F.expr(f"CASE CAST(p_partkey % {len(LISTED)} AS INT) " + " ".join(f"WHEN {i} THEN replace('{w}', '{{n}}', p_name)" for i, w in enumerate(LISTED)) + " END")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.listing_kind(title).alias("kind"))


@query("f16_gate_terms", """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'expedited,72 hours,seventy-two' ELSE array_to_string(['notify'] || list_filter(list_distinct(string_split(p_name, ' ')), lambda w: length(w) > 5 AND w <> 'notify'), ',') END AS terms FROM part""")
def gate_terms(spark, d):
    gate = F.when(F.col("p_partkey") % 3 == 0, "RESOLVE_EXPEDITED").otherwise("OTHER")
    found = X.gate_terms(gate, F.concat(F.lit("Notify of "), "p_name", F.lit(", now (and notify)")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(found, ",").alias("terms"))


@query("f22_page_urls", """SELECT p_partkey AS k, CASE WHEN p_size % 9 = 0 THEN NULL ELSE '/files/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') || '.pdf?page=' || p_size || '#page=' || p_size END AS url FROM part""")
def page_urls(spark, d):
    name = F.when(F.col("p_size") % 9 > 0, F.concat("p_name", F.lit(".pdf")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.page_url(F.lit("/files"), F.col("p_brand"), name, F.col("p_size")).alias("url"))


@query("f25_subjects", V("letters") + " SELECT k, CASE k % 3 WHEN 2 THEN 'on ' || p_name ELSE p_name END AS subject FROM letters")
def subjects(spark, d):
    x = A.letters(spark, d)
    title = F.when(F.col("k") % 3 == 0, F.concat(F.lit("APL "), "one", F.lit(":  "), "p_name", F.lit(" (Supersedes APL "), "two", F.lit(")"))).when(F.col("k") % 3 == 1, F.concat(F.lit("APL "), "one", F.lit(": "), "p_name", F.lit(" superseded by APL "), "two")).otherwise(F.concat(F.lit("on "), "p_name"))
    return x.select("k", X.subject(title).alias("subject"))


@query("f29_remaining", """WITH h AS (SELECT p_partkey AS k, p_size * 3 - 60 + 0.25 AS h, p_partkey % 7 = 0 AS met, p_partkey % 5 = 0 AS clockless FROM part)
SELECT k, CASE WHEN met THEN 'answered' WHEN clockless THEN 'no clock' ELSE CASE WHEN abs(h) >= 48 THEN CAST(round(abs(h) / 24) AS INTEGER) || ' days' ELSE CAST(round(abs(h)) AS INTEGER) || ' h' END || CASE WHEN h < 0 THEN ' overdue' ELSE ' left' END END AS text FROM h""")
def remaining(spark, d):
    hours = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 3 - 60 + 0.25)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.remaining_text(hours, F.col("p_partkey") % 7 == 0).alias("text"))


# -- retrieval and questions -----------------------------------------------------------------


@query("t09_two_layers", f"""WITH RECURSIVE q AS (SELECT [1.0::DOUBLE] || list_transform(range(63), lambda i: 0.0::DOUBLE) AS q), s AS (SELECT vec_id, list_dot_product({UNIT}, q) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 8),
walk AS (SELECT vec_id AS node, 0 AS hops FROM s UNION SELECT e.vec_id, hops + 1 FROM walk JOIN embeddings e ON abs(e.vec_id - node) = 1 WHERE hops < 2), best AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)
SELECT CAST(vec_id AS VARCHAR) AS id, 'seed' AS layer, round(score, 6) AS score, 0 AS hops FROM s UNION ALL SELECT CAST(node AS VARCHAR), 'graph', NULL, hops FROM best WHERE hops > 0""")
def two_layers(spark, d):
    e = table(spark, d, "embeddings")
    ids = e.select(F.col("vec_id").alias("b"))
    line = e.select("vec_id", (F.col("vec_id") + 1).alias("b")).join(ids, "b", "left_semi").select(F.col("vec_id").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.lit("implements").alias("relationship_type"))
    return views.retrieve(e, line, [1.0] + [0.0] * 63, "vec_id").select("id", "layer", r6("score"), "hops")


ASKED = [("When must receipt of thation be acknowledged?", False), ("Should we deny the heitung?", True), ("Which zzzzzz applies?", False)]


@query("t11_ask", V("chunks") + """, c AS (SELECT CASE WHEN count(*) FILTER (WHERE contains(lower(text), 'thation') AND length(text) > 200) > 0 THEN 1 ELSE 0 END AS hit FROM chunks)
SELECT 0 AS k, false AS refused, CASE WHEN hit = 1 THEN 'assistance.requested,assistance.answered' ELSE 'assistance.requested' END AS logged, hit = 1 AS answered FROM c
UNION ALL SELECT 1, true, 'assistance.requested,assistance.refused', false UNION ALL SELECT 2, false, 'assistance.requested', false""")
def ask(spark, d):
    chunks = A.chunks(spark, d).withColumn("policy_number", F.lit("APL 31-407"))
    rows = []
    for k, (question, _) in enumerate(ASKED):
        log: list[dict] = []
        r = views.ask(question, chunks, lambda q, passages: f"APL 31-407 page {passages[0]['page']}", log.append)
        rows.append((k, r["refused"], ",".join(e["event_type"] for e in log), r["answer"] is not None and r["unverified"] == 0))
    return spark.createDataFrame(rows, "k int, refused boolean, logged string, answered boolean")


@query("t12_interpretation", """SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN 'The estimate is withheld: balance.' ELSE 'Cases: ' || (100 + n_nationkey) || '.' || chr(10) || printf('Unadjusted difference: %+.1f hours.', n_nationkey - 9.5) || chr(10)
|| printf('Adjusted effect by nearest match, caliper 0.2: %+.1f hours (%.1f to %.1f, p 0.040); the interval ', -n_nationkey / 2.0, -n_nationkey / 2.0 - 4.0, -n_nationkey / 2.0 + 4.0) || CASE WHEN n_nationkey < 8 THEN 'covers' ELSE 'excludes' END || ' zero.' || chr(10)
|| 'Matched: 80 cases, worst standardised difference 0.050; 3 exposed cases found no match.' || chr(10) || 'Adjusted for complexity, tenure, as the diagram asks.' || CASE WHEN (n_nationkey - 9.5) * -n_nationkey < 0 THEN chr(10) || 'The unadjusted difference has the other sign.' ELSE '' END END AS text FROM nation""")
def interpretation(spark, d):
    def read(r):
        if r.n_regionkey == 0:
            return views.interpretation({"withheld": True, "preconditions": contract.preconditions(0.2, 1.0)})
        e = -r.n_nationkey / 2.0
        found = {"estimate": e, "low": e - 4, "high": e + 4, "p": 0.04, "worst": 0.05, "n": 80, "n_unmatched": 3, "caliper": 0.2, "mahalanobis": False, "replacement": False, "covariates": ["complexity", "tenure"]}
        return views.interpretation({"ready": {"cases": 100 + r.n_nationkey}, "naive": r.n_nationkey - 9.5, "estimates": {"psm": found, "did": None}})

    return spark.createDataFrame([(r.n_nationkey, read(r)) for r in table(spark, d, "nation").collect()], "k int, text string")  # two dozen nations


# -- graphs ----------------------------------------------------------------------------------

CATALOG_SQL = "c AS (SELECT source AS plan_id, doc_id || '.pdf' AS filename, 'On ' || lang || ' ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS department FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


def catalog_of(spark, d):
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    return catalog.rows(docs, plan_id=F.col("source"), filename=F.concat("doc_id", F.lit(".pdf")), title=F.concat(F.lit("On "), "lang", F.lit(" "), "doc_id"), department=F.when(F.col("doc_id") % 3 != 0, F.col("lang")))


@query("g01_nodes", f"WITH {CATALOG_SQL}" + """ SELECT DISTINCT 'plan:' || plan_id AS id, 'plan' AS kind, plan_id, 'Plan ' || plan_id AS label FROM c UNION ALL SELECT 'doc:' || plan_id || '/' || filename, 'document', plan_id, title FROM c
UNION ALL SELECT DISTINCT 'dept:' || plan_id || ':' || department, 'department', plan_id, department FROM c WHERE department <> ''""")
def nodes(spark, d):
    cat = catalog_of(spark, d)
    return graph.catalog_nodes(cat, cat.select("plan_id", F.concat(F.lit("Plan "), "plan_id").alias("name")).distinct())


@query("g02_structural_edges", f"WITH {CATALOG_SQL}" + """ SELECT 'doc:' || plan_id || '/' || filename AS source, 'plan:' || plan_id AS target, 'published_by' AS relationship_type, 1.0::DOUBLE AS weight, true AS directed FROM c
UNION ALL SELECT 'doc:' || plan_id || '/' || filename, 'dept:' || plan_id || ':' || department, 'owned_by', 1.0, true FROM c WHERE department <> ''""")
def structural_edges(spark, d):
    return graph.structural_edges(catalog_of(spark, d)).drop("evidence")


ASSEMBLED = V("nodes", "implements", "supersedes", "structural", "edges") + """, rest AS (SELECT * FROM nodes WHERE kind <> 'apl'), lost AS (SELECT 'doc:' || s_suppkey AS source, 'plan:none' AS target, 1.0::DOUBLE AS weight, 'published_by' AS relationship_type FROM supplier),
all_edges AS (SELECT * FROM edges UNION ALL SELECT source, target, weight + 1, relationship_type FROM edges UNION ALL SELECT * FROM lost),
minted AS (SELECT id, 'apl' AS kind, 'state' AS plan_id, 'APL ' || substr(id, 5) AS label FROM (SELECT DISTINCT id FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id LIKE 'apl:%'))"""


def _assembled(spark, d):
    e = A.edges(spark, d)
    lost = table(spark, d, "supplier").select(X.node_id("doc", F.col("s_suppkey")).alias("source"), F.lit("plan:none").alias("target"), F.lit(1.0).alias("weight"), F.lit("published_by").alias("relationship_type"))
    every = e.unionByName(e.withColumn("weight", F.col("weight") + 1)).unionByName(lost)
    return graph.assembled(A.nodes(spark, d).where("kind <> 'apl'"), every)


@query("g21_assembled_nodes", ASSEMBLED + " SELECT * FROM rest UNION ALL SELECT * FROM minted")
def assembled_nodes(spark, d):
    return _assembled(spark, d)[0].select("id", "kind", "plan_id", "label")


@query("g21_assembled_edges", ASSEMBLED + " SELECT source, target, relationship_type, weight + 1 AS weight, (SELECT count(*) FROM lost) AS dangling FROM edges")
def assembled_edges(spark, d):
    _, edges, dangling = _assembled(spark, d)
    return edges.select("source", "target", "relationship_type", "weight", F.lit(dangling).cast("bigint").alias("dangling"))


@query("g12_rewired_degrees", V("nodes", "implements") + ", " + SHARED + """, ends AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs), deg AS (SELECT id, count(*) AS d FROM ends GROUP BY 1),
r AS (SELECT unnest(range(3)) AS replicate) SELECT replicate, d AS degree, count(*) AS nodes FROM deg, r GROUP BY 1, 2""")
def rewired_degrees(spark, d):
    # rewiring keeps every node's degree
    pairs = _doc_graph(spark, d)
    names = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    numbered = settle(names.select("x", F.row_number().over(Window.orderBy("x")).cast("bigint").alias("n")))
    rows = pairs.join(numbered.toDF("a", "i"), "a").join(numbered.toDF("b", "j"), "b").select("i", "j").collect()  # a graph that fits a worker
    made = graph.rewired(spark, [(r.i, r.j) for r in rows], 3)
    degree = made.select("replicate", F.explode(F.array("a", "b")).alias("x")).groupBy("replicate", "x").agg(F.count("*").alias("degree"))
    return degree.groupBy("replicate", "degree").agg(F.count("*").alias("nodes"))


@query("g13_ring_clustering", "SELECT n_nationkey AS degree, round(3 * (k - 2) / (4.0::DOUBLE * (k - 1)), 9) AS clustering FROM (SELECT n_nationkey, 2 * greatest(2, greatest(2, n_nationkey) // 2) AS k FROM nation)")
def ring_clustering(spark, d):
    return spark.createDataFrame([(r.n_nationkey, round(graph.ring_clustering(r.n_nationkey), 9)) for r in table(spark, d, "nation").collect()], "degree int, clustering double")


@query("g14_verdicts", """SELECT n_nationkey AS k, CASE WHEN n_nationkey < 12 THEN 'fragmented' WHEN n_nationkey % 4 = 3 THEN 'not measured' WHEN n_nationkey / 10.0 > 1.55 THEN 'small-world' WHEN n_nationkey / 10.0 > 1.0 THEN 'weakly small-world' ELSE 'not small-world' END AS verdict FROM nation""")
def verdicts(spark, d):
    rows = [(r.n_nationkey, graph.verdict(r.n_nationkey / 24, None if r.n_nationkey % 4 == 3 else r.n_nationkey / 10 - 0.05)) for r in table(spark, d, "nation").collect()]
    return spark.createDataFrame(rows, "k int, verdict string")


AUGMENT_SQL = PAIR_SQL.rstrip() + """, line AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings) AND vec_id // 8 = (vec_id + 1) // 8),
size AS (SELECT count(DISTINCT vec_id // 8) AS c, (SELECT count(*) FROM line) AS m FROM embeddings), budget AS (SELECT greatest(1, CAST(round_even(least(0.25, 1.3::DOUBLE * (c - 1) / m) * m, 0) AS BIGINT)) AS budget FROM size),
cand AS (SELECT a, b, sim, CASE WHEN a // 8 = b // 8 THEN b - a END AS hops FROM alike WHERE a // 8 <> b // 8 OR b - a >= 4),
pick AS (SELECT *, row_number() OVER (ORDER BY hops IS NOT NULL, sim DESC, CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS r FROM cand)
SELECT CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target, round(sim, 4) AS weight FROM pick WHERE r <= (SELECT budget FROM budget)"""


@query("g16_augmented", AUGMENT_SQL)
def augmented(spark, d):
    e = table(spark, d, "embeddings")
    line = e.select("vec_id", (F.col("vec_id") + 1).alias("b")).join(e.select(F.col("vec_id").alias("b")), "b", "left_semi").where("vec_id div 8 = b div 8")
    edges = line.select(F.col("vec_id").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.lit(1.0).alias("weight"), F.lit("implements").alias("relationship_type"))
    old = edges.limit(1).select(F.lit("x").alias("source"), F.lit("y").alias("target"), F.lit(1.0).alias("weight"), F.lit("shortcut").alias("relationship_type"))  # replaced
    similar = settle(retrieval.similar_pairs(e, "label", 0.25)).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "sim")
    return views.augment(edges.unionByName(old), similar, paths=False)[0].where("relationship_type = 'shortcut'").select("source", "target", "weight")


# -- causal diagrams -------------------------------------------------------------------------

EDGES_SQL = "WITH RECURSIVE e(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DAG) + "), n AS (SELECT a AS v FROM e UNION SELECT b FROM e), below AS (SELECT a AS v, b AS d FROM e UNION SELECT v, b FROM below JOIN e ON a = d), "
NODES = list(dict.fromkeys(n for e in DAG for n in e))


#: Diagrams are asked about once a part: about a variable by its number, or with one cause left out.
CAUSES = [n for n in NODES if n not in ("assisted", "hours")]
_LIST = lambda name, xs: f"{name}(i, v) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(xs)) + ")"
ASKED_SQL = _LIST("asked", NODES) + ", " + _LIST("out", CAUSES)
BY_ASKED, BY_OUT = f"part ON p_partkey % {len(NODES)} = i", f"part ON p_partkey % {len(CAUSES)} = i"


def asked(k: int) -> str:
    return NODES[k % len(NODES)]


def left(k: int) -> tuple:
    """The diagram without a part's cause."""
    return tuple(e for e in DAG if CAUSES[k % len(CAUSES)] not in e)


def per_part(spark, d, answers: Callable[[int], list[tuple]], columns: str) -> DataFrame:
    """p_partkey and the answers' columns: what a function answers for each part, in Spark's tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(f"p_partkey bigint, {columns}"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(k, *r) for k in b.column(0).to_pylist() for r in answers(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], names=kind.names)

    return table(spark, d, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, f"p_partkey bigint, {columns}")


@query("g22_descendants", EDGES_SQL + ASKED_SQL + f" SELECT p_partkey, below.v, d FROM below JOIN asked ON asked.v = below.v JOIN {BY_ASKED}")
def descendants(spark, d):
    return per_part(spark, d, lambda k: [(asked(k), x) for x in dag.descendants(DAG, asked(k))], "v string, d string")


PATHS_SQL = EDGES_SQL + ASKED_SQL + """, near AS (SELECT a AS v, b AS w FROM e UNION SELECT b, a FROM e), walk AS (SELECT ['assisted', a] AS p FROM e WHERE b = 'assisted' UNION ALL SELECT list_append(p, w) FROM walk JOIN near ON v = p[-1] WHERE NOT list_contains(p, w) AND p[-1] <> 'hours'),
paths AS (SELECT p FROM walk WHERE p[-1] = 'hours' AND len(p) > 2) """


@query("g23_backdoor_paths", PATHS_SQL + f"SELECT p_partkey, array_to_string(p, '-') AS path FROM paths JOIN out ON NOT list_contains(p, v) JOIN {BY_OUT}")
def backdoor_paths(spark, d):
    return per_part(spark, d, lambda k: [("-".join(p),) for p in dag.backdoor_paths(left(k), "assisted", "hours")], "path string")


@query("g24_blocked", PATHS_SQL.rstrip() + """, step AS (SELECT p, unnest(range(2, len(p))) AS i FROM paths), mid AS (SELECT p, p[i] AS m, EXISTS (SELECT 1 FROM e WHERE a = p[i - 1] AND b = p[i]) AND EXISTS (SELECT 1 FROM e WHERE a = p[i + 1] AND b = p[i]) AS collider FROM step),
given AS (SELECT v AS g FROM n),
judged AS (SELECT array_to_string(p, '-') AS path, g AS given, bool_or(CASE WHEN collider THEN m <> g AND NOT EXISTS (SELECT 1 FROM below WHERE below.v = m AND below.d = g) ELSE m = g END) AS blocked FROM mid, given GROUP BY 1, 2)
""" + f"SELECT p_partkey, path, given, blocked FROM judged JOIN asked ON v = given JOIN {BY_ASKED}")
def blocked(spark, d):
    paths = dag.backdoor_paths(DAG, "assisted", "hours")
    return per_part(spark, d, lambda k: [("-".join(p), asked(k), dag.blocked(DAG, p, frozenset([asked(k)]))) for p in paths], "path string, given string, blocked boolean")


@query("g25_adjustment_set", EDGES_SQL + ASKED_SQL + f" SELECT p_partkey, a.a AS variable FROM e a JOIN e b ON b.a = a.a AND b.b = 'hours' JOIN out ON a.a <> out.v JOIN {BY_OUT} WHERE a.b = 'assisted'")
def adjustment_set(spark, d):
    # every common cause, as each has a path of its own
    return per_part(spark, d, lambda k: [(v,) for v in dag.adjustment_set(left(k), "assisted", "hours")], "variable string")


@query("g26_model_checks", EDGES_SQL + ASKED_SQL + """, need AS (SELECT a.a AS v FROM e a JOIN e b ON b.a = a.a AND b.b = 'hours' WHERE a.b = 'assisted'), med AS (SELECT d AS v FROM below WHERE v = 'assisted' AND d IN (SELECT v FROM below WHERE d = 'hours')),
checked AS (SELECT n.v AS used, n.v IN (SELECT v FROM med) AS mediator, (SELECT count(*) FROM need) - CASE WHEN n.v IN (SELECT v FROM need) THEN 1 ELSE 0 END AS missing, n.v NOT IN (SELECT v FROM need) AND n.v NOT IN (SELECT v FROM med) AS extra,
CASE n.v WHEN 'assisted' THEN 'exposure' WHEN 'hours' THEN 'outcome' ELSE CASE WHEN n.v IN (SELECT v FROM need) THEN 'adjust' WHEN n.v IN (SELECT v FROM med) THEN 'mediator' ELSE 'other' END END AS role FROM n)
""" + f"SELECT p_partkey, used, mediator, missing, extra, role FROM checked JOIN asked ON v = used JOIN {BY_ASKED}")
def model_checks(spark, d):
    def check(k: int) -> list[tuple]:
        v = asked(k)
        c = dag.model_check(DAG, "assisted", "hours", [v])
        return [(v, v in c["mediators"], len(c["missing"]), v in c["extra"], dag.roles(DAG, "assisted", "hours")[v])]

    return per_part(spark, d, check, "used string, mediator boolean, missing bigint, extra boolean, role string")


# -- ledger ----------------------------------------------------------------------------------


@query("l01_violations", """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'machine actor' ELSE 'no rationale' END AS why FROM events WHERE event_type IN ('purchase', 'error') AND (event_id % 3 = 0 OR event_id % 4 = 0)""")
def violations(spark, d):
    e = A.ledger(spark, d).withColumn("actor_kind", F.when(F.col("seq") % 3 != 0, "human").otherwise(F.when(F.col("seq") % 2 == 0, "machine")))
    return ledger.violations(e.withColumn("rationale", F.when(F.col("seq") % 4 == 0, F.lit("  ")).otherwise(F.lit("for reasons")))).select("seq", "why")


QUEUE_SQL = V("ledger") + """, f AS (SELECT case_id, min(occurred_at) FILTER (WHERE event_type = 'case.created') AS o, min(occurred_at) FILTER (WHERE event_type = 'disposition.recorded') AS c FROM ledger GROUP BY 1), k AS (SELECT * FROM f WHERE o IS NOT NULL),
q AS (SELECT a.case_id, a.o, count(*) FILTER (WHERE b.o <= a.o) - count(*) FILTER (WHERE greatest(b.o, b.c) <= a.o AND b.c IS NOT NULL) AS queue FROM k a, k b GROUP BY 1, 2)"""


@query("w06_arrival_queue", QUEUE_SQL + " SELECT case_id, queue FROM q")
def arrival_queue(spark, d):
    return ledger.queue_at_arrival(A.ledger(spark, d)).select("case_id", "queue")


@query("w07_arrival_fraction", CASES_SQL + "SELECT case_id, round((epoch_us(o) - min(epoch_us(o)) OVER ()) / CAST(max(epoch_us(o)) OVER () - min(epoch_us(o)) OVER () AS DOUBLE), 9) + 0.0 AS fraction FROM cases")
def arrival_fraction(spark, d):
    return ledger.arrival_fraction(ledger.case_outcomes(A.ledger(spark, d))).select("case_id", (F.round("fraction", 9) + 0.0).alias("fraction"))


@query("l06_intake", QUEUE_SQL + """ SELECT case_id, '{"complexity":' || (case_id % 10 + 1) || ',"expedited":' || CASE WHEN case_id % 3 = 0 THEN 'true' ELSE 'false' END || ',"backlog":' || queue || ',"tenure":' || (case_id % 7) || ',"sdoh":' || (case_id % 2) || '}' AS payload FROM q""")
def intake(spark, d):
    e = A.ledger(spark, d)
    cases = ledger.case_outcomes(e).select("case_id", (F.col("case_id") % 10 + 1).alias("complexity"), (F.col("case_id") % 3 == 0).alias("expedited"), (F.col("case_id") % 7).alias("tenure"), (F.col("case_id") % 2).alias("sdoh"))
    return views.intake(cases, e).select("case_id", "payload")


@query("l11_passport", """WITH c AS (SELECT 'C-' || p_partkey AS id, p_size > 40 AND p_partkey % 50 <> 0 AS low, p_size AS n, p_partkey FROM part), ctl AS (SELECT id, 'baseline' AS o FROM c WHERE low UNION ALL SELECT id, 'addition' FROM c WHERE n = 1),
need AS (SELECT DISTINCT 'P' || p_size AS id FROM part), ans AS (SELECT DISTINCT 'P' || p_size AS id FROM part WHERE p_size % 2 = 0)
SELECT (SELECT count(*) FROM ctl) AS total, (SELECT count(*) FROM ctl WHERE o = 'baseline') AS baseline, (SELECT count(*) FROM ctl WHERE o = 'addition') AS additions, 0::BIGINT AS inherited, (SELECT count(*) FROM need) AS params_needed, (SELECT count(*) FROM ans) AS params_answered,
(SELECT count(*) FROM ctl WHERE id IN (SELECT id FROM c WHERE p_partkey % 3 = 0)) AS evidence_bound, (SELECT count(*) FROM ctl WHERE id NOT IN (SELECT id FROM c WHERE p_partkey % 3 = 0)) AS evidence_unbound, sha256('spec of ' || (SELECT count(*) FROM part)) AS spec_sha256""")
def passport(spark, d):
    p = table(spark, d, "part").withColumn("id", F.concat(F.lit("C-"), "p_partkey"))
    cat = p.select("id", F.col("p_name").alias("title"), (F.col("p_partkey") % 50 == 0).alias("withdrawn"), F.when(F.col("p_size") > 40, F.array(F.lit("low"))).otherwise(F.array(F.lit("high"))).alias("baselines"), F.col("p_size").alias("n_params"))
    chosen, _ = contract.passport_controls(cat, "low", p.where("p_size = 1").select("id", F.lit("needed").alias("reason")), p.where("p_size < 0").select("id", F.lit("host").alias("source")))
    needed = p.select(F.concat(F.lit("P"), "p_size").alias("id"))
    made = contract.passport(chosen, needed, p.where("p_size % 2 = 0").select(F.concat(F.lit("P"), "p_size").alias("id")), p.where("p_partkey % 3 = 0").select("id"), f"spec of {p.count()}")
    c = made["counts"]
    return spark.createDataFrame([(*c.values(), made["spec_sha256"])], ", ".join(f"{k} bigint" for k in c) + ", spec_sha256 string")


@query("l12_history", "WITH n AS (SELECT count(*) AS n FROM customer) SELECT t AS event_type, n AS events, true AS intact, 0::BIGINT AS refused FROM n, (VALUES ('case.created'), ('gate.answered'), ('disposition.recorded')) v(t)")
def history(spark, d):
    # as many cases as customers, through the guards and into chains, which are then verified
    e = ledger.with_iso(causal.history_events(settle(causal.simulated_history(spark, table(spark, d, "customer").count()))))
    for f in ledger.FIELDS[1:]:
        if f not in e.columns:
            e = e.withColumn(f, F.lit(None).cast("string"))
    intact = ledger.verify(ledger.chained(e, "case_id"), by=F.col("case_id")).agg(F.min(F.col("ok").cast("int"))).first()[0] == 1
    refused = ledger.violations(e).count()
    return e.where("event_type <> 'assistance.requested'").groupBy("event_type").agg(F.count("*").alias("events")).select("event_type", "events", F.lit(intact).alias("intact"), F.lit(refused).cast("bigint").alias("refused"))


# -- effects ---------------------------------------------------------------------------------


@query("c02_logistic", FRAME_SQL + ", r AS (SELECT ln(avg(x) FILTER (WHERE adopter = 0) / (1 - avg(x) FILTER (WHERE adopter = 0))) AS b0, ln(avg(x) FILTER (WHERE adopter = 1) / (1 - avg(x) FILTER (WHERE adopter = 1))) AS b1 FROM f) SELECT 'intercept' AS term, round(b0, 6) AS value FROM r UNION ALL SELECT 'adopter', round(b1 - b0, 6) FROM r")
def logistic(spark, d):
    # with one covariate of two values the likelihood is largest at the two groups' own odds
    b = causal.logistic(frame(spark, d), "x", ["adopter"])
    return spark.createDataFrame([("intercept", round(float(b[0]), 6)), ("adopter", round(float(b[1]), 6))], "term string, value double")


BOUNDS = "b AS (SELECT greatest(min(propensity) FILTER (WHERE x = 1), min(propensity) FILTER (WHERE x = 0)) AS lo, least(max(propensity) FILTER (WHERE x = 1), max(propensity) FILTER (WHERE x = 0)) AS hi FROM s)"


@query("c04_trimmed", SCORED_SQL.rstrip() + f", {BOUNDS} SELECT id FROM s, b WHERE propensity BETWEEN lo AND hi")
def trimmed(spark, d):
    return causal.trimmed(scored(spark, d), "x").select("id")


MATCH_SQL = FRAME_SQL + """, w AS (SELECT 0.1::DOUBLE * stddev_samp(y) AS w FROM f), t AS (SELECT id, y FROM f WHERE x = 1), c AS (SELECT y, min(id) AS id FROM f WHERE x = 0 GROUP BY 1),
lo AS (SELECT t.id AS t, t.y AS ty, c.id AS c, c.y AS cy FROM t ASOF JOIN c ON t.y >= c.y), hi AS (SELECT t.id AS t, t.y AS ty, c.id AS c, c.y AS cy FROM t ASOF JOIN c ON t.y <= c.y),
b AS (SELECT t, c, abs(ty - cy) AS gap FROM lo UNION ALL SELECT t, c, abs(ty - cy) FROM hi), m AS (SELECT t, min({'gap': gap, 'c': c}) AS m FROM b GROUP BY 1)"""


@query("j14_nearest_match", MATCH_SQL + " SELECT t AS treated, m.c AS control, round(m.gap, 6) + 0.0 AS gap FROM m, w WHERE m.gap <= w.w")
def nearest_match(spark, d):
    # matched on the outcome's own scale, whose numbers are the same in any engine
    return causal.matched_with_replacement(frame(spark, d), "x", "id", "y", 0.1).select("treated", "control", r6("gap"))


@query("c08_cluster_errors", FRAME_SQL + """, m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM f), b AS (SELECT *, n * sxx - sx * sx AS det FROM m), c AS (SELECT *, (sxx * sy - sx * sxy) / det AS b0, (n * sxy - sx * sy) / det AS b1 FROM b),
s AS (SELECT operator, sum(y - b0 - b1 * x) AS s0, sum(x * (y - b0 - b1 * x)) AS s1 FROM f, c GROUP BY 1), meat AS (SELECT count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM s)
SELECT round(b1, 5) AS slope, round(sqrt((sx * sx * m00 - 2.0 * n * sx * m01 + 1.0 * n * n * m11) / det / det * (g / (g - 1.0)) * ((n - 1.0) / (n - 2.0))), 5) AS se FROM c, meat""")
def cluster_errors(spark, d):
    fit = causal.least_squares(frame(spark, d), "y", {"x": F.col("x")}, cluster="operator")
    return spark.createDataFrame([(round(float(fit["coef"]["x"]), 5), round(float(fit["se"]["x"]), 5))], "slope double, se double")


MODEL_SE = """, m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM f), b AS (SELECT *, n * sxx - sx * sx AS det FROM m), c AS (SELECT *, (sxx * sy - sx * sxy) / det AS b0, (n * sxy - sx * sy) / det AS b1 FROM b),
r AS (SELECT sum((y - b0 - b1 * x) * (y - b0 - b1 * x)) AS rss FROM f, c), e AS (SELECT b1, sqrt(rss / (n - 2) * n / det) AS se FROM c, r)"""


@query("c09_error_fallback", FRAME_SQL + MODEL_SE + " SELECT round(se, 5) AS se FROM e")
def error_fallback(spark, d):
    # with one cluster there is no robust error: the model's stands in
    fit = causal.least_squares(frame(spark, d).withColumn("one", F.lit(1)), "y", {"x": F.col("x")}, cluster="one")
    return spark.createDataFrame([(round(float(fit["se"]["x"]), 5),)], "se double")


@query("c12_interval", FRAME_SQL + MODEL_SE + " SELECT round(b1 - 1.96 * se, 4) AS low, round(b1 + 1.96 * se, 4) AS high, abs(b1 / se) < 1.959963984540054 AS weak FROM e")
def interval(spark, d):
    fit = causal.least_squares(frame(spark, d), "y", {"x": F.col("x")})
    i = causal.interval(float(fit["coef"]["x"]), float(fit["se"]["x"]))
    return spark.createDataFrame([(round(i["low"], 4), round(i["high"], 4), i["p"] > 0.05)], "low double, high double, weak boolean")


@query("c11_iptw", FRAME_SQL + """, g AS (SELECT adopter AS a, avg(x) AS p FROM f GROUP BY 1), s AS (SELECT x, y, CASE WHEN x = 1 THEN 1.0::DOUBLE ELSE p / greatest(1 - p, 1e-6) END AS w FROM f JOIN g ON g.a = f.adopter), q AS (SELECT quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM s),
v AS (SELECT x, y, least(greatest(w, lo), hi) AS w FROM s, q), m AS (SELECT count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM v)
SELECT any_value(n) AS n, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 4) AS estimate FROM v, m""")
def iptw(spark, d):
    # with one covariate of two values the propensities are the groups' own shares
    r = causal.iptw(settle(frame(spark, d)), "y", "x", ["adopter"])
    return spark.createDataFrame([(r["n"], round(float(r["estimate"]), 4))], "n bigint, estimate double")


@query("c11_iptw_three")
def iptw_three(spark, d):
    r = causal.iptw(settle(frame(spark, d)), "y", "x", ["q", "k", "b"])
    return spark.createDataFrame([(r["n"], float(r["estimate"]), float(r["se"]))], "n bigint, estimate double, se double")


@query("c05_psm")
def psm(spark, d):
    # customers as cases: exposed are those who returned much
    per = frame(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("y").alias("y"), F.avg("q").alias("q"), F.first("b").alias("b"), F.count("*").cast("double").alias("n"), F.sum("x").alias("s"))
    r = causal.psm(settle(per.withColumn("x", (F.col("s") > 4).cast("int")).drop("s")), "y", "x", ["q", "n", "b"], "id")
    return spark.createDataFrame([(r["n"], float(r["estimate"]), float(r["low"]), float(r["high"]), float(r["worst"]), r["mahalanobis"], r["caliper"])], "n bigint, estimate double, low double, high double, worst double, mahalanobis boolean, caliper double")


@query("c14_preconditions", "SELECT n_nationkey AS k, n_nationkey <= 10 AND n_regionkey <= 2 AS met, CASE WHEN n_nationkey > 10 AND n_regionkey > 2 THEN 'balance,overlap' WHEN n_nationkey > 10 THEN 'balance' WHEN n_regionkey > 2 THEN 'overlap' ELSE '' END AS failed FROM nation")
def preconditions(spark, d):
    rows = []
    for r in table(spark, d, "nation").collect():
        p = contract.preconditions(r.n_nationkey / 100, r.n_regionkey * 2.4)
        rows.append((r.n_nationkey, p["met"], ",".join(p["failed"])))
    return spark.createDataFrame(rows, "k int, met boolean, failed string")


@query("c13_withheld", "SELECT true AS withheld, 'The estimate is withheld: too few cases: ' || count(*) || ' of 30.' AS text FROM nation")
def withheld(spark, d):
    cases = table(spark, d, "nation").select(F.col("n_nationkey").alias("case_id"), F.col("n_regionkey").alias("operator"), F.lit(1.0).alias("hours"), F.lit(1).alias("assisted"))
    found = contract.run_analysis(cases, DAG, "hours", "assisted", "case_id", ["case_id", "operator"], {"cases": 1, "rate": 1, "cost": 1})
    return spark.createDataFrame([(found["withheld"], views.interpretation(found))], "withheld boolean, text string")


@query("c16_simulated_cohort", "SELECT count(*) * 2 AS cases, count(*) * 2 AS of_cohort, true AS within FROM customer")
def simulated_cohort(spark, d):
    c = table(spark, d, "customer")
    cohort = c.select(F.concat(F.lit("m"), "c_custkey").alias("member_id"), (F.col("c_custkey") % 7).alias("conditions"), (F.col("c_custkey") % 5).alias("encounters"), (F.col("c_custkey") % 2).alias("sdoh_flags"), (F.col("c_custkey") % 6 == 0).cast("int").alias("urgent_condition"))
    made = causal.simulated_from_cohort(cohort, 2 * c.count())
    known = made.join(cohort.select("member_id").distinct(), "member_id", "left_semi")
    ok = F.min(((F.col("hours_to_resolution") >= 2) & F.col("complexity").between(1, 10) & F.col("assisted").isin(0, 1)).cast("int")) == 1
    return made.agg(F.count("*").alias("cases"), ok.alias("within")).select("cases", F.lit(known.count()).cast("bigint").alias("of_cohort"), "within")
