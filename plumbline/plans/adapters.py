"""The shared test tables seen as nodes, edges, chunks, ledger and case frames.

Each view has its twin in SQL (``SQL``), for queries checked against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import node_id
from ..session import table

CHUNK, STEP, PAGE = 1600, 800, 3000


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, plan_id, label: nations as plans, regions as departments, suppliers as documents, parts as letters."""
    plan = table(spark, d, "nation").select(node_id("plan", F.col("n_nationkey")).alias("id"), F.lit("plan").alias("kind"), F.col("n_nationkey").cast("string").alias("plan_id"), F.col("n_name").alias("label"))
    dept = table(spark, d, "region").select(node_id("department", F.col("r_regionkey")).alias("id"), F.lit("department").alias("kind"), F.lit("").alias("plan_id"), F.col("r_name").alias("label"))
    doc = table(spark, d, "supplier").select(node_id("doc", F.col("s_suppkey")).alias("id"), F.lit("document").alias("kind"), F.col("s_nationkey").cast("string").alias("plan_id"), F.col("s_name").alias("label"))
    apl = table(spark, d, "part").select(node_id("apl", F.col("p_partkey")).alias("id"), F.lit("apl").alias("kind"), F.lit("state").alias("plan_id"), F.col("p_name").alias("label"))
    return plan.unionByName(dept).unionByName(doc).unionByName(apl)


def implements(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    return lines.groupBy(node_id("doc", F.col("l_suppkey")).alias("source"), node_id("apl", F.col("l_partkey")).alias("target")).agg(F.count("*").cast("double").alias("weight")).withColumn("relationship_type", F.lit("implements"))


def supersedes(spark: SparkSession, d: str) -> DataFrame:
    """A part supersedes the one before it of its brand and type."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    pairs = table(spark, d, "part").select("p_partkey", F.lag("p_partkey").over(w).alias("before")).where("before is not null")
    return pairs.select(node_id("apl", F.col("p_partkey")).alias("source"), node_id("apl", F.col("before")).alias("target"), F.lit(3.0).alias("weight"), F.lit("supersedes").alias("relationship_type"))


def structural(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    by = s.select(node_id("doc", F.col("s_suppkey")).alias("source"), node_id("plan", F.col("s_nationkey")).alias("target"), F.lit(1.0).alias("weight"), F.lit("published_by").alias("relationship_type"))
    own = s.select(node_id("doc", F.col("s_suppkey")).alias("source"), node_id("department", F.col("n_regionkey")).alias("target"), F.lit(1.0).alias("weight"), F.lit("owned_by").alias("relationship_type"))
    return by.unionByName(own)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return implements(spark, d).unionByName(supersedes(spark, d)).unionByName(structural(spark, d))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, plan_id, doc_id, start, page, text: windows of 1600 characters every 800."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    cut = docs.select("doc_id", F.col("source").alias("plan_id"), "text", F.explode(F.expr(f"sequence(1, length(text), {STEP})")).alias("start"))
    page = F.expr(f"cast((start - 1) div {PAGE} as int)") + 1
    return cut.select(F.concat_ws("#", "doc_id", "start").alias("chunk_id"), "plan_id", "doc_id", "start", page.alias("page"), F.col("text").substr(F.col("start"), F.lit(CHUNK)).alias("text"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """seq, event_id, case_id, occurred_at, event_type, value, payload from events."""
    names = F.create_map(*[F.lit(x) for x in ("signup", "case.created", "view", "evidence.retrieved", "click", "assistance.requested", "purchase", "disposition.recorded", "error", "correction.recorded")])
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id")).alias("event_id"), F.col("user_id").alias("case_id"), F.col("ts").cast("timestamp").alias("occurred_at"), names[F.col("event_type")].alias("event_type"), "value", F.col("props").alias("payload"))


def letters(spark: SparkSession, d: str) -> DataFrame:
    """k, one, two, s: texts that name letters in the ways people write them, a row a part."""
    p = table(spark, d, "part")
    one = F.concat(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("p_size") * 7).cast("string"), 3, "0"))
    two = F.concat(F.lpad((F.col("p_partkey") * 3 % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("p_size") + 400).cast("string"), 3, "0"))
    x = p.select(F.col("p_partkey").alias("k"), one.alias("one"), two.alias("two"), "p_name")
    ways = [f.replace("{1}", "', one, '").replace("{2}", "', two, '").replace("{n}", "', p_name, '") for f in WAYS]
    cases = " ".join(f"WHEN {i} THEN concat('{w}')" for i, w in enumerate(ways))
    return x.withColumn("s", F.expr(f"CASE CAST(k % {len(WAYS)} AS INT) {cases} END"))


#: {1} and {2}: letter ids; {n}: a part's name. And what should be read from each.
WAYS = {
    "APL {1}": [1], "apl{1}": [1], "memo on APL  {1} (final {n})": [1], "APL {1} and APLs {2}, 31-407": [1, 2, "31-407"], "Policy 6{1} on {n}": [], "APL {1}8": [1],
    "APLs {1} & {2} and Letters 97-115": [1, 2], "the {n} of {1}": [], "{n} only": [], "APL {2}, APL {1}": [2, 1],
}


def ways_sql() -> tuple[str, str]:
    """SQL for the text of a row of letters, and for the list of ids to be read from it."""
    text = " ".join(f"WHEN {i} THEN '" + w.replace("{1}", "' || one || '").replace("{2}", "' || two || '").replace("{n}", "' || p_name || '") + "'" for i, w in enumerate(WAYS))
    name = {1: "one", 2: "two"}
    ids = " ".join(f"WHEN {i} THEN [" + ", ".join(name.get(x, f"'{x}'") for x in found) + "]::VARCHAR[]" for i, found in enumerate(WAYS.values()))
    return f"CASE k % {len(WAYS)} {text} END", f"CASE k % {len(WAYS)} {ids} END"


SQL = {
    "letters": """letters AS (SELECT *, {0} AS s, {1} AS ids FROM (SELECT p_partkey AS k, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size * 7 AS VARCHAR), 3, '0') AS one,
  lpad(CAST(p_partkey * 3 % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size + 400 AS VARCHAR), 3, '0') AS two, p_name FROM part))""".format(*ways_sql()),
    "nodes": """nodes AS (
  SELECT 'plan:' || n_nationkey AS id, 'plan' AS kind, CAST(n_nationkey AS VARCHAR) AS plan_id, n_name AS label FROM nation
  UNION ALL SELECT 'department:' || r_regionkey, 'department', '', r_name FROM region
  UNION ALL SELECT 'doc:' || s_suppkey, 'document', CAST(s_nationkey AS VARCHAR), s_name FROM supplier
  UNION ALL SELECT 'apl:' || p_partkey, 'apl', 'state', p_name FROM part)""",
    "implements": """implements AS (
  SELECT 'doc:' || l_suppkey AS source, 'apl:' || l_partkey AS target, CAST(count(*) AS DOUBLE) AS weight, 'implements' AS relationship_type
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY 1, 2)""",
    "supersedes": """supersedes AS (
  SELECT 'apl:' || p_partkey AS source, 'apl:' || before AS target, 3.0::DOUBLE AS weight, 'supersedes' AS relationship_type
  FROM (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS before FROM part) WHERE before IS NOT NULL)""",
    "structural": """structural AS (
  SELECT 'doc:' || s_suppkey AS source, 'plan:' || s_nationkey AS target, 1.0::DOUBLE AS weight, 'published_by' AS relationship_type FROM supplier
  UNION ALL SELECT 'doc:' || s_suppkey, 'department:' || n_regionkey, 1.0::DOUBLE, 'owned_by' FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "edges": "edges AS (SELECT * FROM implements UNION ALL SELECT * FROM supersedes UNION ALL SELECT * FROM structural)",
    "chunks": f"""chunks AS (
  SELECT doc_id || '#' || start AS chunk_id, plan_id, doc_id, CAST(start AS INTEGER) AS start, CAST((start - 1) // {PAGE} + 1 AS INTEGER) AS page, substr(text, start, {CHUNK}) AS text
  FROM (SELECT doc_id, source AS plan_id, text, unnest(generate_series(1, length(text), {STEP})) AS start FROM documents WHERE length(text) > 0))""",
    "ledger": """ledger AS (
  SELECT event_id AS seq, 'e' || event_id AS event_id, user_id AS case_id, ts AS occurred_at,
         CASE event_type WHEN 'signup' THEN 'case.created' WHEN 'view' THEN 'evidence.retrieved' WHEN 'click' THEN 'assistance.requested'
                         WHEN 'purchase' THEN 'disposition.recorded' WHEN 'error' THEN 'correction.recorded' END AS event_type, value, props AS payload FROM events)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH and the views' SQL, for the front of a query."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
