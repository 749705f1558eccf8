"""Queries of the versioned store and of what is built on it."""

from __future__ import annotations

import uuid

import pyarrow.dataset
import pyarrow.fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import graph
from .queries import CHAIN_SQL, SQL, UNIT, fields, query, r6
from .session import run_folder, settle, table
from .sources import catalog, chunks, documents, pages, vectors
from .sources.store import Store, ingest
from .streaming import events as streams


def place(spark) -> str:
    """A new folder of this application's."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


# -- three editions of all documents: the first, one with every third changed, one in which half of these are as at first

EDITION_SQL = "CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN text || chr(10) || 'second edition' ELSE text END"
LINES_SQL = f"SELECT doc_id, CAST(n AS INTEGER) AS n, md5(line) AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM (SELECT doc_id, {EDITION_SQL} AS t FROM documents WHERE text IS NOT NULL)) WHERE trim(line, ' ') <> ''"


def edition(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, origin, hash, text of an edition."""
    second = F.concat("text", F.lit("\nsecond edition"))
    text = {1: F.col("text"), 2: F.when(F.col("doc_id") % 3 == 0, second).otherwise(F.col("text")), 3: F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 6 != 0), second).otherwise(F.col("text"))}[k]
    return docs.where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("origin"), text.alias("text")).withColumn("hash", F.md5("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    lines = docs.select("origin", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.where("trim(line) <> ''").select("origin", (F.col("k") + 1).alias("n"), F.md5("line").alias("digest"))


DOWN = "the service is down"


def failing(at: int):
    """lines_of, but the service is down at the call of that number."""
    calls = []

    def process(part: DataFrame) -> DataFrame:
        calls.append(1)
        found = lines_of(part)
        return found.withColumn("n", F.raise_error(F.lit(DOWN)).cast("int")) if len(calls) == at else found

    return process


@query("s18_versioned_ingest", LINES_SQL)
def versioned_ingest(spark, d):
    # each edition's first run meets a failure, and the next goes on with the rest
    docs, store = table(spark, d, "documents"), Store(spark, place(spark), 16)
    each = max(1, docs.count() // 3)
    for k in (1, 2, 3):
        for process in (failing(2), lines_of):
            ingest(store, edition(docs, k), process, each if k == 1 else each // 4 + 1)
    return store.rows().select(F.col("origin").cast("bigint").alias("doc_id"), "n", "digest")


@query("s18_done", f"SELECT doc_id, md5(t) AS hash FROM (SELECT doc_id, {EDITION_SQL} AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '[^ \\n]')")
def hashes_done(spark, d):
    docs, store = table(spark, d, "documents"), Store(spark, place(spark), 16)
    for k in (1, 2, 3):
        ingest(store, edition(docs, k), lines_of)
    return store.done().select(F.col("origin").cast("bigint").alias("doc_id"), "hash")


@query("m05_stream_ingest", LINES_SQL)
def stream_ingest(spark, d):
    # three editions arrive as files; the second batch fails once, and no other failure is passed over
    at, store = place(spark), Store(spark, place(spark), 16)
    for k in (1, 2, 3):
        edition(table(spark, d, "documents"), k).write.mode("append").parquet(f"{at}/in/edition={k}")
        new = spark.readStream.schema("doc_id bigint, origin string, text string, hash string, edition int").parquet(f"{at}/in")
        for process in (failing(1), lines_of) if k == 2 else (lines_of,):
            try:
                streams.ingested(new, store, f"{at}/checkpoint", process, F.col("edition")).awaitTermination()
            except StreamingQueryException as e:
                if process is lines_of or DOWN not in str(e):
                    raise
    return store.rows(max(store.versions())).select(F.col("origin").cast("bigint").alias("doc_id"), "n", "digest")


# -- names beyond Latin-1, letters in the forms that texts have, lineages that are cycles


@query("f06_unicode_names", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, substr(regexp_replace(regexp_replace(replace(p_name, 'ee', 'ss') || ' & x-y', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 90) AS name FROM part")
def unicode_names(spark, d):
    text = F.translate(F.replace("p_name", F.lit("ee"), F.lit("ß")), "acdelnorsuz", "ąčďęłňøřśůż")
    return table(spark, d, "part").select("p_partkey", X.safe_name(F.concat(text, F.lit(" & x–y日"))).alias("name"))


FORMS = "CASE doc_id % 5 WHEN 0 THEN 'APL #26-014' WHEN 1 THEN 'apl 26 014' WHEN 2 THEN 'APL26-014' WHEN 3 THEN 'APL # 31-407, 26-014' ELSE 'Policy 600-1017' END"


@query("g04_letter_forms", f"""WITH t AS (SELECT doc_id, text || ' ' || {FORMS} || ' ' AS text FROM documents WHERE text IS NOT NULL)
SELECT 'doc:a/' || doc_id AS source, 'apl:' || unnest(CASE doc_id % 5 WHEN 4 THEN CAST([] AS VARCHAR[]) WHEN 3 THEN ['31-407', '26-014'] ELSE ['26-014'] END) AS target, 1.0::DOUBLE AS weight FROM t""")
def letter_forms(spark, d):
    chunks = table(spark, d, "documents").where("text is not null").select(F.lit("a").alias("plan_id"), F.col("doc_id").cast("string").alias("filename"), F.concat("text", F.lit(" "), F.expr(FORMS), F.lit(" ")).alias("text"))
    return graph.mined_edges(chunks).select("source", "target", F.col("weight").cast("double").alias("weight"))


CYCLE_SQL = """WITH RECURSIVE sup AS (SELECT 'apl:' || p_partkey AS letter, 'apl:' || (CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 2 ELSE p_partkey - 1 END) AS later FROM part WHERE NOT (p_partkey % 10 = 0 AND (p_partkey // 10) % 2 = 1)),
cited AS (SELECT DISTINCT 'doc:' || l_suppkey AS document, 'apl:' || l_partkey AS letter FROM lineitem WHERE l_quantity >= 25),
after(letter, later) AS (SELECT letter, later FROM sup UNION SELECT a.letter, s.later FROM after a JOIN sup s ON s.letter = a.later)
SELECT c.document, c.letter, EXISTS (SELECT 1 FROM sup s WHERE s.letter = c.letter) AS replaced,
EXISTS (SELECT 1 FROM sup s WHERE s.letter = c.letter) AND NOT EXISTS (SELECT 1 FROM after a JOIN cited o ON o.letter = a.later WHERE a.letter = c.letter AND o.document = c.document) AS old_only FROM cited c"""


@query("g19_cyclic_lineages", CYCLE_SQL)
def cyclic_lineages(spark, d):
    # of ten letters in a row each is superseded by the one before it; in every other row the first three supersede each other in a cycle
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("apl:"), c.cast("string"))
    sup = table(spark, d, "part").where("not (p_partkey % 10 = 0 and (p_partkey div 10) % 2 = 1)").select(name(F.when(key % 10 == 0, key + 2).otherwise(key - 1)).alias("source"), name(key).alias("target"), F.lit("supersedes").alias("relationship_type"))
    cited = table(spark, d, "lineitem").where("l_quantity >= 25").select(F.concat(F.lit("doc:"), "l_suppkey").alias("source"), name(F.col("l_partkey")).alias("target"), F.lit("implements").alias("relationship_type")).distinct()
    nodes = cited.select(F.col("source").alias("id"), F.lit("document").alias("kind"), F.lit("p").alias("plan_id")).distinct()
    return graph.citation_status(nodes, sup.union(cited)).drop("plan_id")


# -- searches by the vector index, here with as many probes as cells: exact


@query("s22_vector_search", f"""WITH u AS (SELECT vec_id, {UNIT} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, u.vec_id AS id, list_dot_product(q.v, u.v) AS score FROM u q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r <= 10""")
def vector_search(spark, d):
    at, e = place(spark), table(spark, d, "embeddings")
    cells = vectors.build(e, at)
    return vectors.search(spark, at, e.where("vec_id % 50 = 0"), 10, cells, itself=False).select("query_id", "rank", "id", r6("score"))


@query("o05_indexed_topk", SQL["o05_vector_topk"])
def indexed_topk(spark, d):
    at, e = place(spark), table(spark, d, "embeddings")
    cells = vectors.build(e, at)
    asked = spark.createDataFrame([(0, [1.0] + [0.0] * 63)], "vec_id bigint, embedding array<double>")
    found = vectors.search(spark, at, asked, 32, cells).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return found.groupBy("label").agg(F.min_by(F.struct("id", "score"), "rank").alias("m")).select("label", F.col("m.id").alias("vec_id"), F.round("m.score", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(8)


# -- chunks that follow headings, paragraphs and sentences (tests/test_chunks.py has them beside a plain walk)


@query("s17_structured_chunks")
def structured_chunks(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    cat = catalog.rows(docs, plan_id=F.col("source"), filename=F.concat("doc_id", F.lit(".pdf")), policy_number=F.concat(F.lit("D-"), "doc_id"), title=F.concat(F.lit("about "), "lang"))
    # every fifth line is a heading, a level deeper where the line before was one
    lines = docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("origin"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    lines = lines.withColumn("line", F.when(F.col("k") % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.col("k") / 5 % 3 + 1).cast("int")), F.lit(" "), F.substring("line", 1, 60))).otherwise(F.col("line")))
    pages = lines.groupBy("origin", (F.floor(F.col("k") / 12) + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("x")).select("origin", "page", F.array_join("x.line", "\n").alias("text"))
    return chunks.structured(cat, pages, documents.METADATA, None, 900, 0.25).select("filename", "start", "context", "text", "page", "page_count")


# -- a paged API as a source: one that serves the parts, all pages and those of one brand


def parts_service(at: str):
    """Serves items that Spark has written at a folder, in the order of their keys."""

    def page(offset: int, size: int, asked: dict) -> tuple[int, list[str]]:
        store, path = pyarrow.fs.FileSystem.from_uri(at)
        items = pyarrow.dataset.dataset(path, filesystem=store, format="parquet")
        if asked:
            of = pyarrow.dataset.field("p_brand") == asked["p_brand"]
            found = items.to_table(columns=["p_partkey", "json"], filter=of).sort_by("p_partkey")  # a brand's
            return found.num_rows, found["json"].slice(offset, size).to_pylist()
        key = pyarrow.dataset.field("p_partkey")  # 0, 1, 2 ...
        return items.count_rows(), items.to_table(columns=["p_partkey", "json"], filter=(key >= offset) & (key < offset + size)).sort_by("p_partkey")["json"].to_pylist()

    return page


@query("s30_page_source", "SELECT 'all' AS asked, p_partkey, p_name, p_brand FROM part UNION ALL SELECT 'one', p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#13' AND p_partkey > 50")
def page_source(spark, d):
    at = place(spark)
    part = table(spark, d, "part")
    part.select("p_partkey", "p_brand", F.to_json(F.struct("p_partkey", "p_name", "p_brand")).alias("json")).write.parquet(at)
    pages.register(spark, "parts_api", parts_service(at), "p_partkey bigint, p_name string, p_brand string", ("p_brand",), max(100, part.count() // 64))
    found, again = (spark.read.format("parts_api").load() for _ in range(2))  # as one of them is filtered
    one = again.where("p_brand = 'Brand#13' and p_partkey > 50")
    return found.select(F.lit("all").alias("asked"), "*").union(one.select(F.lit("one").alias("asked"), "*"))


# -- chains of a stream whose events come up to a day late, over several batches


@query("m02_ordered_chain", CHAIN_SQL + "SELECT event_id AS seq, prev_hash, hash FROM chain")
def ordered_chain(spark, d):
    at, e = place(spark), fields(spark, d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    comes = F.unix_timestamp("occurred_at") + F.pmod(F.xxhash64("seq"), F.lit(86400))
    first, last = e.agg(F.min(comes), F.max(comes)).first()
    dealt = settle(e.withColumn("part", F.floor((comes - first) * 4 / (last - first + 1))))
    for k in range(4):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    # one event that is later than all lets the watermark pass them
    e.limit(1).withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 999 days")).withColumn("case_id", F.lit("end")).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in").withWatermark("occurred_at", "26 hours")
    provider = spark.conf.get(streams.ROCKS[0])
    try:
        return streams.replayed(streams.ordered_chain(stream, none="NA"), at, "append").where("case_id <> 'end'").select("seq", "prev_hash", "hash")
    finally:
        spark.conf.set(streams.ROCKS[0], provider)
