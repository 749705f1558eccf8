"""Queries of sources and sinks: catalogs, crawls, files, chunks, indexes and records, made from the shared tables and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import graph, ledger, retrieval, views
from .plans import adapters as A
from .plans import contract
from .queries import LINK_SQL, V, case_sql, fields, links, query, r6, staged
from .session import run_folder, settle, table
from .sources import catalog, crawl, documents, records
from .sources.store import Store, ingest
from .streaming import events as streams


def place(spark) -> str:
    """A new folder of this application's."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# -- registries and catalogs -----------------------------------------------------------------

REGISTRY = "SELECT 'n' || n_nationkey AS plan_id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'site' WHEN 1 THEN 'portal' WHEN 2 THEN 'manifest' ELSE 'none' END AS fetcher FROM nation"


def registry(spark, d) -> dict[str, dict]:
    """A registry of plans as YAML text, a plan a nation, parsed again."""
    n = [r.asDict() for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # two dozen nations
    kinds = {0: "site", 1: "portal", 2: "manifest"}
    lines = [f"- {{plan_id: n{r['n_nationkey']}, name: {r['n_name']}, domain: r{r['n_regionkey']}.example, tier: 1, fetcher: {kinds.get(r['n_regionkey'], 'none')}}}" for r in n]
    return contract.parse_registry("plans:\n" + "\n".join(lines) + "\n")


@query("s01_registry", REGISTRY)
def registry_rows(spark, d):
    return spark.createDataFrame([(p["plan_id"], p["name"], p["fetcher"]) for p in registry(spark, d).values()], "plan_id string, name string, fetcher string")


@query("s02_fetchable", f"SELECT plan_id, fetcher FROM ({REGISTRY}) WHERE fetcher IN ('site', 'manifest')")
def fetchable(spark, d):
    return spark.createDataFrame([(k, p["fetcher"]) for k, p in contract.fetchable(registry(spark, d), {"site", "manifest"}).items()], "plan_id string, fetcher string")


@query("x04_dispatch", """WITH s AS (SELECT 'n' || s_nationkey AS plan_id, n_regionkey AS r, s_name AS title, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (0, 2))
SELECT plan_id, title, CASE r WHEN 0 THEN 'crawled' ELSE 'listed' END AS status FROM s WHERE n <= 3""")
def dispatched(spark, d):
    # each fetcher gives the suppliers of the plan's nation; only as many rows of a plan as asked for are kept
    def by(status):
        return lambda plan: table(spark, d, "supplier").where(F.col("s_nationkey") == int(plan["plan_id"][1:])).select(F.lit(plan["plan_id"]).alias("plan_id"), F.col("s_name").alias("title"), F.lit(status).alias("status"))

    return crawl.dispatch(registry(spark, d), {"site": by("crawled"), "manifest": by("listed")}, limit=3).select("plan_id", "title", "status")


@query("s03_catalog_repair", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS plan_id, '' AS title, '' AS status, coalesce(lang, '') AS department FROM documents")
def catalog_repair(spark, d):
    # a catalog that lacks columns and has one too many
    at = f"{place(spark)}/catalog"
    table(spark, d, "documents").select(F.col("doc_id").cast("string"), F.col("source").alias("plan_id"), F.col("lang").alias("department"), F.col("n_chars").alias("size")).write.json(at)
    return catalog.read_catalog(spark, at).select("doc_id", "plan_id", "title", "status", "department")


@query("s04_catalog_sink", """SELECT row_number() OVER (ORDER BY 'n' || s_nationkey, lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0'), s_name) AS line, s_name AS title FROM supplier""")
def catalog_sink(spark, d):
    at = f"{place(spark)}/catalog"
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("plan_id"), F.lpad((F.col("s_suppkey") % 7).cast("string"), 2, "0").alias("policy_number"), F.col("s_name").alias("title"))
    catalog.write_catalog(s, at)
    # lines in the order of the files, whose names go by number, and within them
    files = spark.read.text(at).select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    return files.select(F.row_number().over(_by("f", "b", "i")).cast("bigint").alias("line"), F.get_json_object("value", "$.title").alias("title"))


def _by(*keys):
    from pyspark.sql import Window

    return Window.orderBy(*keys)


@query("s05_catalog_rows", "SELECT 's' || s_suppkey AS doc_id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'n' || s_nationkey END AS plan_id, '' AS status FROM supplier")
def catalog_rows(spark, d):
    plan = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" n"), "s_nationkey", F.lit("\t")))
    made = catalog.rows(table(spark, d, "supplier"), doc_id=F.concat(F.lit("s"), "s_suppkey"), title=F.concat(F.lit("\n "), "s_name", F.lit(" ")), plan_id=plan)
    return made.select("doc_id", "title", "plan_id", "status")


@query("u02_merged_catalogs", """WITH old AS (SELECT 'n' || s_nationkey AS plan_id, s_name AS title, 'old' AS status FROM supplier), new AS (SELECT 'n' || c_nationkey AS plan_id, c_name AS title, 'new' AS status FROM customer WHERE c_nationkey IN (3, 4, 5))
SELECT * FROM old WHERE plan_id NOT IN ('n3', 'n4', 'n5') UNION ALL SELECT * FROM new""")
def merged_catalogs(spark, d):
    row = lambda df, n, title, status: catalog.rows(df, plan_id=F.concat(F.lit("n"), n), title=F.col(title), status=F.lit(status))
    old = row(table(spark, d, "supplier"), "s_nationkey", "s_name", "old")
    new = row(table(spark, d, "customer").where("c_nationkey in (3, 4, 5)"), "c_nationkey", "c_name", "new")
    return catalog.merged_by_plan(old, new).select("plan_id", "title", "status")


# -- pages, sitemaps and APIs ----------------------------------------------------------------

ENTITIES = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ANCHORS = """a AS (SELECT page_id, url AS seed, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS a FROM pages),
link AS (SELECT seed, CASE WHEN href LIKE 'http%' THEN href ELSE host || href END AS url, words AS text FROM (SELECT seed, host, regexp_replace(""" + ENTITIES.format("regexp_extract(a, '<a href=\"([^\"]*)\">', 1)") + """, '#.*$', '') AS href,
trim(regexp_replace(""" + ENTITIES.format("regexp_extract(a, '\">([^<]*)</a>', 1)") + """, '\\s+', ' ', 'g')) AS words FROM a))"""


@query("s06_site_links", "WITH " + ANCHORS + " SELECT url, text, seed FROM link WHERE contains(url, 'e') OR contains(url, '/d')")
def site_links(spark, d):
    return catalog.page_links(table(spark, d, "pages"), ["e", "/d"])


def sitemaps(spark, d) -> DataFrame:
    """A sitemap for each host of the pages."""
    p = table(spark, d, "pages").select("url", crawl.origin(F.col("url")).alias("host"))
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-01</lastmod></url>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.concat_ws("", F.collect_list(loc)), F.lit("</urlset>"))
    return p.groupBy("host").agg(xml.alias("xml"))


@query("s07_sitemap_urls", "SELECT url FROM pages WHERE contains(url, '/fr/') OR contains(url, '?page=')")
def sitemap_urls(spark, d):
    return catalog.sitemap_urls(sitemaps(spark, d), include=["/fr/", "?page="])


#: What the robots file of an origin says, by the length of its address.
RULES = {0: "User-agent: *\nDisallow: /fr/\n", 1: "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*.html$\n", 2: None}


def robots_stub(address: str) -> bytes | None:
    """The robots file of an origin; of some there is none, and asking for it fails."""
    at = len(address.removesuffix("/robots.txt")) % 3
    if RULES[at] is None:
        raise OSError(address)
    return RULES[at].encode()


ALLOWED = "NOT ((length(host) % 3 = 0 AND starts_with(path, '/fr/')) OR (length(host) % 3 = 1 AND ends_with(path, '.html')))"


@query("s15_robots_by_origin", f"SELECT url FROM (SELECT url, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages) WHERE {ALLOWED}")
def robots_by_origin(spark, d):
    return crawl.with_robots(table(spark, d, "pages").select("url"), robots_stub)


KIND_SQL = case_sql(X.KINDS, "'policy'", "lower(text || ' ' || url)")


@query("s12_crawl", "WITH " + ANCHORS + f""", found AS (SELECT url, text, seed FROM link WHERE contains(url, 'e') UNION ALL SELECT url, '', '' FROM pages WHERE contains(url, 'e')),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN seed = '' THEN 1 ELSE 0 END, seed, text) AS r, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_replace(url, '^https?://[^/]+', '') AS path FROM found) WHERE r = 1),
kept AS (SELECT url AS source_url, {KIND_SQL} AS doc_kind FROM one WHERE {ALLOWED}),
scoped AS (SELECT * FROM kept WHERE doc_kind IN ('policy', 'manual')), listed AS (SELECT 'http://listed.example/' || n_nationkey AS source_url, 'policy' AS doc_kind FROM nation UNION ALL SELECT source_url, 'listed again' FROM scoped)
SELECT * FROM scoped UNION ALL SELECT * FROM listed WHERE source_url NOT IN (SELECT source_url FROM scoped)""")
def crawled(spark, d):
    pages = table(spark, d, "pages").select("url", "html")
    extra = table(spark, d, "nation").select(F.concat(F.lit("http://listed.example/"), "n_nationkey").alias("source_url"), F.lit("policy").alias("doc_kind"))
    manifest = extra.unionByName(pages.select(F.col("url").alias("source_url"), F.lit("listed again").alias("doc_kind")).limit(0))
    found = crawl.crawled(pages, "p", ["policy", "manual"], ["e"], sitemaps(spark, d), robots_stub, catalog.repaired(manifest))
    return found.select("source_url", "doc_kind")


@query("p11_dropped_kinds", LINK_SQL + f", k AS (SELECT {case_sql(X.KINDS, chr(39) + 'policy' + chr(39), 'lower(txt || chr(32) || url_decode(url))')} AS doc_kind FROM p) SELECT doc_kind, count(*) AS n FROM k WHERE doc_kind NOT IN ('policy', 'manual') GROUP BY 1")
def dropped_kinds(spark, d):
    found = links(spark, d).select(X.doc_kind(F.col("url"), F.col("txt")).alias("doc_kind"))
    return crawl.dropped_kinds(found, ["policy", "manual"])


@query("o10_limited_scan", """SELECT s_name AS title FROM supplier ORDER BY s_name LIMIT 7""")
def limited_scan(spark, d):
    return crawl.head(catalog.rows(table(spark, d, "supplier"), title=F.col("s_name")), 7).select("title")


@query("s08_policies_api", """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand AS policy_number, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'Unspecified' ELSE p_type END AS department, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS date_published,
'https://files.example/' || p_partkey || '-1' AS source_url, replace(p_name, ' ', '_') || '.pdf' AS filename FROM part WHERE p_size % 4 > 0""")
def policies_api(spark, d):
    p = table(spark, d, "part").withColumn("g", F.col("p_partkey") % 10)
    file = lambda k: F.struct(F.concat(F.lit("https://files.example/"), "p_partkey", F.lit(f"-{k}")).alias("url"), F.col("p_name").alias("name"))
    files = F.slice(F.array(file(1), file(2), file(3)), 1, (F.col("p_size") % 4).cast("int"))
    item = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("number"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 > 0, F.col("p_type")).alias("department"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")).alias("published"), files.alias("files"),
    )
    body = p.groupBy("g").agg(F.to_json(F.collect_list(item)).alias("json"))  # ten answers of the API
    return catalog.policies_api(body, "p").select("doc_id", "policy_number", "title", "department", "date_published", "source_url", "filename")


@query("s09_documents_api", """SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'QX' || s_suppkey % 100 ELSE '' END AS policy_number, s_name AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'Unspecified' ELSE 'n' || s_nationkey END AS department, 'https://portal.example/' || s_suppkey AS source_url FROM supplier""")
def documents_api(spark, d):
    s = table(spark, d, "supplier")
    trail = F.array(F.struct(F.lit("home").alias("name")), F.struct(F.concat(F.lit("n"), "s_nationkey").alias("name")))
    crumbs = F.when(F.col("s_suppkey") % 5 > 0, F.array(F.struct(trail.alias("trail"))))
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" QX"), F.col("s_suppkey") % 100, F.lit("  "))).otherwise(F.lit("")), "s_name")
    item = F.struct(F.col("s_suppkey").cast("string").alias("id"), name.alias("name"), F.concat(F.lit("https://portal.example/"), "s_suppkey").alias("publicUrl"), crumbs.alias("breadcrumbs"))
    body = s.groupBy((F.col("s_suppkey") % 4).alias("g")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("json"))
    return catalog.documents_api(body, "p").select("doc_id", "policy_number", "title", "department", "source_url")


@query("s10_manifest", "SELECT 'n' || n_nationkey AS policy_number, n_name AS title, 'policy' AS doc_kind, CASE WHEN n_regionkey = 1 THEN 'west' ELSE 'Unspecified' END AS department, 'medi-cal' AS line_of_business, replace(n_name, ' ', '_') || '.pdf' AS filename FROM nation")
def manifest(spark, d):
    at = f"{place(spark)}/manifest"
    item = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("policy_number"), F.col("n_name").alias("title"), F.when(F.col("n_regionkey") == 1, "west").alias("department"))
    table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(item).alias("documents"))).alias("value")).write.text(at)
    return catalog.manifest(spark, at, "p").select("policy_number", "title", "doc_kind", "department", "line_of_business", "filename")


@query("s11_slugs", """WITH n AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'pinned' ELSE NULL END AS pin, replace(p_name, ' ', '-') AS b, 'p' || p_partkey AS id FROM part),
c AS (SELECT p_partkey, pin, id, CASE WHEN p_partkey % 2 = 0 THEN 'the-' || b || '-of-lodz' ELSE b END AS base, CASE WHEN p_partkey % 2 = 0 THEN b || '-of-lodz' ELSE b END AS second, CASE WHEN p_partkey % 2 = 0 THEN 'the-' || b || '-lodz' ELSE b END AS third FROM n)
SELECT p_partkey, CASE WHEN pin IS NOT NULL THEN pin WHEN p_partkey % 2 = 0 THEN base || '|' || second || '|' || third || '|' || id ELSE base || '|' || id END AS slugs FROM c""")
def slugs(spark, d):
    even = F.col("p_partkey") % 2 == 0
    name = F.concat(F.when(even, "The ").otherwise(""), F.regexp_replace(F.initcap("p_name"), " ", " & "), F.when(even, " of Łódź").otherwise("!"))
    found = X.slug_candidates(name, F.concat(F.lit("P"), "p_partkey"), F.when(F.col("p_size") == 7, "pinned"))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("slugs"))


def search_page(offset: int, size: int, total: int = 523) -> tuple[int, list[str]]:
    """A search API of ``total`` documents: each a number, every third without a policy number, some twice, some elsewhere."""
    out = []
    for k in range(offset, min(offset + size, total)):
        host = "files.example" if k % 11 else "elsewhere.example"
        out.append(json.dumps({"url": f"https://{host}/{k % 400}", "title": f" T{k} ", "number": [f"P{k % 400}"] if k % 3 else [], "type": [["Manual"], ["List"], ["Blog"]][k % 5 % 3], "plans": ["A", "B"][: k % 3], "revised": [f"2024-02-0{k % 9 + 1}T00:00"]}))
    return total, out


@query("s30_paged_search", """WITH k AS (SELECT unnest(range(523)) AS k), d AS (SELECT k, 'https://files.example/' || k % 400 AS source_url, CASE WHEN k % 3 > 0 THEN 'P' || k % 400 ELSE '' END AS policy_number, 'T' || k AS title, k % 5 % 3 AS t,
CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'A,B' END AS line_of_business, '2024-02-0' || (k % 9 + 1) AS date_published FROM k WHERE k % 11 > 0),
kinds AS (SELECT *, CASE WHEN policy_number <> '' THEN 'policy' WHEN t = 0 THEN 'manual' WHEN t = 1 THEN 'list' END AS doc_kind FROM d)
SELECT source_url, policy_number, title, doc_kind, line_of_business, date_published FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY CASE WHEN policy_number = '' THEN 1 ELSE 0 END, policy_number, title) AS r FROM kinds WHERE doc_kind IS NOT NULL) WHERE r = 1""")
def paged_search(spark, d):
    return crawl.search_documents(crawl.paged(spark, search_page, 50), {"Manual": "manual", "List": "list"}, "files.example").drop("department")


# -- files -----------------------------------------------------------------------------------


def file_stub(address: str) -> bytes | None:
    """A download: a PDF, a page in its place, or nothing."""
    n = int(address.rsplit("/", 1)[1])
    if n % 7 == 3:
        raise OSError(address)
    return b"%PDF-1.4 " + str(n).encode() if n % 3 else b"<html>"


@query("s14_downloads", """SELECT s_name || '.pdf' AS filename, CASE WHEN s_suppkey % 5 = 1 AND s_suppkey % 2 = 1 THEN 'present' WHEN s_suppkey % 7 = 3 THEN 'failed' WHEN s_suppkey % 3 > 0 THEN 'saved' ELSE 'not a pdf' END AS status FROM supplier""")
def downloads(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("plan_id"), F.concat("s_name", F.lit(".pdf")).alias("filename"), F.concat(F.lit("https://x.example/"), "s_suppkey").alias("source_url"), "s_suppkey")
    there = rows.where("s_suppkey % 5 = 1").select("plan_id", "filename", (F.col("s_suppkey") % 2).alias("length"))  # some are empty
    return crawl.downloads(rows, file_stub, there).select("filename", "status")


@query("s37_landed", "SELECT s_name AS title FROM supplier WHERE s_suppkey % 4 = 2")
def landed(spark, d):
    at = place(spark)
    rows = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("plan_id"), F.concat("s_suppkey", F.lit(".pdf")).alias("filename"), F.col("s_name").alias("title"), "s_suppkey")
    rows.where("s_suppkey % 4 = 2").select("plan_id", "filename").write.json(f"{at}/listing")
    return crawl.landed(rows, spark.read.schema("plan_id string, filename string").json(f"{at}/listing")).select("title")


def pdf_of(pages: list[str]) -> bytes:
    """A plain PDF of some pages of Latin-1 lines: what the reader is tried on."""
    import zlib

    out, kids = [b"%PDF-1.4\n"], []
    for k, page in enumerate(pages):
        body = b"BT /F1 12 Tf 14 TL " + b" T* ".join(b"(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1", "replace") + b") Tj" for line in page.split("\n")) + b" ET"
        packed = zlib.compress(body) if k % 2 else body
        kids.append(f"{10 + 2 * k} 0 R")
        out.append(f"{10 + 2 * k} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >> endobj\n".encode())
        out.append(f"{11 + 2 * k} 0 obj << /Length {len(packed)}{' /Filter /FlateDecode' if k % 2 else ''} >>\nstream\n".encode() + packed + b"\nendstream endobj\n")
    out.append(f"2 0 obj << /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >> endobj\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n%%EOF".encode())
    return b"".join(out)


ASCII = r"regexp_replace(text, '[^ -~\n]', '?', 'g')"


@query("s16_pdf_pages", f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS origin, unnest(string_split(t, chr(10) || chr(10))) AS text, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS page FROM (SELECT doc_id, {ASCII} AS t FROM documents WHERE length(text) > 0)),
clean AS (SELECT origin, page, trim(text, chr(10)) AS text FROM p), whole AS (SELECT * FROM clean WHERE origin IN (SELECT origin FROM clean WHERE trim(text, ' ' || chr(10) || chr(9)) <> ''))
SELECT origin, CAST(page AS INTEGER) AS page, md5(text) AS digest, CAST(1 + coalesce(sum(length(text) + 2) OVER (PARTITION BY origin ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM whole""")
def pdf_pages(spark, d):
    import pyarrow as pa

    def made(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pdf_of(t.split("\n\n")) for t in b.column(1).to_pylist()], pa.binary())], names=["origin", "content"])

    docs = table(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string"), F.regexp_replace("text", r"[^ -~\n]", "?").alias("text"))
    return documents.pdf_texts(docs.mapInArrow(made, "origin string, content binary")).select("origin", "page", F.md5("text").alias("digest"), F.col("start").cast("bigint").alias("start"))


@query("s17_document_chunks", """WITH p AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, source, lang, string_agg(text, chr(10) || chr(10) ORDER BY page) AS whole, max(page) AS page_count FROM p GROUP BY 1, 2, 3),
starts AS (SELECT doc_id, list(start ORDER BY page) AS starts FROM (SELECT doc_id, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM p) GROUP BY 1)
SELECT doc_id || '.pdf' AS filename, CAST(start AS INTEGER) AS start, CASE WHEN source = 'src1' THEN 'D-' || doc_id || ' about ' || lang ELSE 'Plan ' || source || ' · ' || 'D-' || doc_id || ' about ' || lang END AS context, md5(substr(whole, start, 900)) AS digest,
CAST(len(list_filter(starts, lambda s: s <= start)) AS INTEGER) AS page, CAST(page_count AS INTEGER) AS page_count FROM (SELECT d.*, starts, unnest(generate_series(1, length(whole), 675)) AS start FROM d JOIN starts USING (doc_id) WHERE trim(whole, ' ') <> '')""")
def document_chunks(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    cat = catalog.rows(docs, plan_id=F.col("source"), filename=F.concat("doc_id", F.lit(".pdf")), policy_number=F.concat(F.lit("D-"), "doc_id"), title=F.concat(F.lit("about "), "lang"))
    pages = docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("origin"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    names = docs.where("source <> 'src1'").select(F.col("source").alias("plan_id"), F.concat(F.lit("Plan "), "source").alias("name")).distinct()
    return documents.chunk_documents(cat, pages, names, 900, 0.25).select("filename", "start", "context", F.md5("text").alias("digest"), "page", "page_count")


@query("s19_upsert", """SELECT doc_id, 'old' AS edition FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'new' FROM documents, (VALUES (1), (2)) v(k) WHERE doc_id % 3 = 0""")
def upsert(spark, d):
    store = table(spark, d, "documents").select(F.col("doc_id").alias("origin"), F.lit("old").alias("edition"))
    new = store.where("origin % 3 = 0").select("origin", F.lit("new").alias("edition"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).drop("k")
    return catalog.upserted(store, new).select(F.col("origin").alias("doc_id"), "edition")


@query("s20_partial_ingest", """SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS done_at_last, true AS stopped_first, true AS complete_at_last, 0::BIGINT AS lost, 0::BIGINT AS twice""")
def partial_ingest(spark, d):
    # the first run meets a group that fails; the next one goes on with what isn't done
    calls, store = [], Store(spark, place(spark), 8)
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("origin"), F.md5("text").alias("hash"))

    def work(part):
        calls.append(1)
        return part.withColumn("x", F.raise_error(F.lit("the service is down")).cast("int")) if len(calls) == 4 else part.withColumn("x", F.lit(1))

    first, last = (ingest(store, docs, work, 1) for _ in range(2))
    rows = store.rows().groupBy("origin").agg(F.count("*").alias("n"))
    seen = docs.join(rows, "origin", "left").agg(F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(F.col("n") > 1).alias("twice"))
    return seen.select(F.lit(store.done().count()).alias("done_at_last"), F.lit(not first["complete"]).alias("stopped_first"), F.lit(last["complete"]).alias("complete_at_last"), "lost", "twice")


@query("s21_published", "SELECT n_nationkey, 'second' AS edition FROM nation")
def published(spark, d):
    at = place(spark)
    for edition in ("first", "second"):
        documents.publish_version(table(spark, d, "nation").select("n_nationkey", F.lit(edition).alias("edition")), at, edition)
    return documents.published(spark, at)


INDEX_SQL = V("chunks") + """, w AS (SELECT chunk_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '[a-z0-9]+')) AS term FROM chunks),
posts AS (SELECT term, chunk_id, count(*) AS n FROM w WHERE length(term) > 2 GROUP BY 1, 2)"""


@query("s22_text_index", INDEX_SQL + """, asked AS (SELECT * FROM posts WHERE term IN ('the', 'and', 'les')), df AS (SELECT term, count(*) AS df FROM asked GROUP BY 1), s AS (SELECT count(*) AS n, avg(length(text)) AS mean FROM chunks)
SELECT chunk_id, round(sum(ln(1 + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * a.n * 2.2::DOUBLE / (a.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length(text) / mean))), 6) AS score FROM asked a JOIN df USING (term) JOIN chunks USING (chunk_id), s GROUP BY 1""")
def text_index(spark, d):
    at = place(spark)
    documents.build_indexes(A.chunks(spark, d).select("chunk_id", "text"), at)
    return documents.index_scores(spark, at, "the and les").select("chunk_id", r6("score"))


def busy_service(texts: list[str]) -> list[list[float]]:
    """Three numbers a text; busy whenever it's called for the first time with a batch of odd length."""
    if len(texts) % 2 and (key := hash(tuple(texts))) not in _asked:
        _asked.add(key)
        raise documents.Busy(0.0)
    return [[float(len(t)), float(t.count("e")), float(t.count("\n"))] for t in texts]


_asked: set[int] = set()


@query("s23_embeddings", "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS length, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS es, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS DOUBLE) AS breaks FROM documents")
def embeddings(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = catalog.embedded(texts, documents.embedder("service", call=busy_service, batch=7, wait=0))
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return found.select(F.col("id").alias("doc_id"), v(0).alias("length"), v(1).alias("es"), v(2).alias("breaks"))


# -- graphs and views written and read back --------------------------------------------------


@query("s24_graph_sink", V("nodes", "implements", "supersedes", "structural", "edges") + """ SELECT 'nodes' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', relationship_type, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'nodes_csv', '', count(*) FROM nodes UNION ALL SELECT 'edges_csv', '', count(*) FROM edges""")
def graph_sink(spark, d):
    at = place(spark)
    views.write_graph(A.nodes(spark, d), A.edges(spark, d), at)
    out = None
    for what, key in (("nodes", "kind"), ("edges", "relationship_type"), ("nodes_csv", ""), ("edges_csv", "")):
        df = spark.read.csv(f"{at}/{what}", header=True) if what.endswith("csv") else spark.read.parquet(f"{at}/{what}")
        n = df.groupBy(F.col(key).cast("string").alias("name") if key else F.lit("").alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
        out = n if out is None else out.unionByName(n)
    return out


CURRENCY = """, cites AS (SELECT i.source AS document, i.target AS letter, n.plan_id FROM implements i JOIN nodes n ON n.id = i.source WHERE n.kind = 'document'),
by_ AS (SELECT target AS letter, max(source) AS by_letter FROM supersedes GROUP BY 1),
later AS (SELECT letter, by_letter AS newer FROM by_ UNION SELECT later.letter, by_letter FROM later JOIN by_ ON by_.letter = later.newer),
met AS (SELECT DISTINCT c.document, c.letter FROM cites c JOIN later l ON l.letter = c.letter JOIN cites o ON o.document = c.document AND o.letter = l.newer),
st AS (SELECT c.*, b.by_letter IS NOT NULL AS replaced, b.by_letter IS NOT NULL AND m.letter IS NULL AS old_only FROM cites c LEFT JOIN by_ b ON b.letter = c.letter LEFT JOIN met m ON m.document = c.document AND m.letter = c.letter)"""


@query("s26_currency_sink", V("nodes", "implements", "supersedes", recursive=True) + CURRENCY + """
SELECT 'plan' AS what, plan_id AS name, count(*) AS citations, count(*) FILTER (WHERE old_only) AS old_only FROM st GROUP BY 2 UNION ALL SELECT 'letter', letter, count(*), count(*) FILTER (WHERE old_only) FROM st WHERE replaced GROUP BY 2""")
def currency_sink(spark, d):
    at, nodes = place(spark), A.nodes(spark, d)
    views.write_currency(graph.citation_status(nodes, A.implements(spark, d).unionByName(A.supersedes(spark, d))), nodes, at)
    plan = spark.read.csv(f"{at}/by_plan", header=True).select(F.lit("plan").alias("what"), F.col("plan_id").alias("name"), F.col("citations").cast("bigint"), F.col("replaced_old_only").cast("bigint").alias("old_only"))
    letter = spark.read.csv(f"{at}/by_letter", header=True).select(F.lit("letter").alias("what"), F.col("letter").alias("name"), F.col("citations").cast("bigint"), F.col("old_only").cast("bigint"))
    return plan.unionByName(letter)


@query("s35_html_page", V("nodes", "implements", "supersedes", "structural", "edges") + " SELECT kind AS name, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT relationship_type, count(*) FROM edges GROUP BY 1")
def html_page(spark, d):
    # the page's own data, read out of it again
    at = f"{place(spark)}/page.html"
    counts = graph.counts(A.nodes(spark, d), A.edges(spark, d))
    views.html_page(counts.select(F.lit("counts").alias("part"), F.to_json(F.struct("what", "name", "n")).alias("json")), "Letters & <plans>", at)
    page = spark.read.text(at, wholetext=True)
    data = F.regexp_extract("value", r"<script type='application/json' id='data'>(.*?)</script>", 1)
    rows = page.select(F.explode(F.from_json(data, "struct<counts:array<struct<what:string,name:string,n:bigint>>>")["counts"]).alias("r"))
    return rows.select("r.name", "r.n")


# -- records ---------------------------------------------------------------------------------


@query("s27_cohort_csv", "SELECT 'c' || c_custkey AS member_id, CAST(c_custkey % 90 AS INTEGER) AS age, CAST(c_nationkey AS INTEGER) AS conditions FROM customer")
def cohort_csv(spark, d):
    at = f"{place(spark)}/cohort"
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("member_id"), (F.col("c_custkey") % 90).alias("age"), F.lit("f").alias("gender"), F.col("c_nationkey").alias("conditions"), *[F.lit(0).alias(x) for x in ("encounters", "claims", "medications", "sdoh_flags", "urgent_condition")])
    c.write.csv(at, header=True)
    return records.read_cohort(spark, at).select("member_id", "age", "conditions")


CONDITIONS = ["Stress (finding)", "Housing unsatisfactory", "Sprain of ankle", "Unemployed"]
BIRTH = "make_date(CAST(1930 + c_custkey % 80 AS INTEGER), CAST(c_custkey % 12 + 1 AS INTEGER), CAST(c_custkey % 28 + 1 AS INTEGER))"
COHORT_SQL = f"""WITH m AS (SELECT c_custkey, c_nationkey AS nc, c_custkey % 3 AS ne, {BIRTH} AS birth FROM customer WHERE c_custkey % 13 > 0),
cohort AS (SELECT 'c' || c_custkey AS member_id, CAST(2024 - year(birth) - CASE WHEN month(birth) * 100 + day(birth) > 615 THEN 1 ELSE 0 END AS INTEGER) AS age, CAST(nc AS INTEGER) AS conditions, CAST(ne AS INTEGER) AS encounters,
CAST((SELECT count(*) FROM range(nc) r(i) WHERE (i + c_custkey) % 4 IN (1, 3)) AS INTEGER) AS sdoh_flags, CAST(EXISTS (SELECT 1 FROM range(nc) r(i) WHERE (i + c_custkey) % 4 = 0) AS INTEGER) AS urgent_condition FROM m)"""


def bundles(spark, d) -> DataFrame:
    """Patient bundles as JSON: a customer each, with conditions and encounters; some without a date of birth, one that doesn't parse."""
    # a small file's rows are dealt over all cores, as parsing their bundles is the work
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").repartition(4 * spark.sparkContext.defaultParallelism)
    resource = "struct<resourceType:string,id:string,birthDate:string,code:struct<text:string,coding:array<struct<display:string>>>>"
    none = "cast(null as struct<text:string,coding:array<struct<display:string>>>)"
    patient = F.expr(f"named_struct('resource', cast(named_struct('resourceType', 'Patient', 'id', concat('c', c_custkey), 'birthDate', if(c_custkey % 13 > 0, cast({BIRTH.replace('INTEGER', 'INT')} as string), null), 'code', {none}) as {resource}))")
    names = "array(" + ", ".join(f"'{x}'" for x in CONDITIONS) + ")"
    # every other condition has its words in the coding
    code = f"if(i % 2 = 0, named_struct('text', element_at({names}, cast((i + c_custkey) % 4 + 1 as int)), 'coding', cast(null as array<struct<display:string>>)), named_struct('text', cast(null as string), 'coding', array(named_struct('display', element_at({names}, cast((i + c_custkey) % 4 + 1 as int))))))"
    condition = F.expr(f"transform(filter(sequence(0, greatest(c_nationkey, 1)), i -> i < c_nationkey), i -> named_struct('resource', cast(named_struct('resourceType', 'Condition', 'id', cast(null as string), 'birthDate', cast(null as string), 'code', {code}) as {resource})))")
    encounter = F.expr(f"transform(filter(sequence(0, 3), i -> i < c_custkey % 3), i -> named_struct('resource', cast(named_struct('resourceType', 'Encounter', 'id', cast(null as string), 'birthDate', cast(null as string), 'code', {none}) as {resource})))")
    body = F.to_json(F.struct(F.concat(condition, F.array(patient), encounter).alias("entry")))
    return c.select(body.alias("json")).unionByName(spark.createDataFrame([("{not json",)], "json string"))


def cohort(spark, d) -> DataFrame:
    return records.cohort(bundles(spark, d), ["unemployed", "housing"], ["stress"], "2024-06-15")


@query("s28_cohort", COHORT_SQL + " SELECT * FROM cohort")
def cohort_rows(spark, d):
    return cohort(spark, d).select("member_id", "age", "conditions", "encounters", "sdoh_flags", "urgent_condition")


@query("a25_cohort_summary", COHORT_SQL + " SELECT count(*) AS members, median(age) AS median_age, median(conditions) AS median_conditions, max(encounters) AS most_encounters, count(*) FILTER (WHERE sdoh_flags > 0) AS with_flags, count(*) FILTER (WHERE urgent_condition = 1) AS urgent FROM cohort")
def cohort_summary(spark, d):
    return records.cohort_summary(cohort(spark, d))


@query("f23_ages", """SELECT p_partkey, CAST(2021 - y - CASE WHEN m * 100 + d > 228 THEN 1 ELSE 0 END AS INTEGER) AS age FROM (SELECT p_partkey, CAST(2000 - p_size % 5 * 4 AS INTEGER) AS y, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 + p_partkey % 12 END AS m, CASE WHEN p_partkey % 2 = 0 THEN 29 ELSE 1 + p_partkey % 28 END AS d FROM part)""")
def ages(spark, d):
    # every other one was born on a 29th of February
    even = F.col("p_partkey") % 2 == 0
    birth = F.make_date(2000 - F.col("p_size") % 5 * 4, F.when(even, 2).otherwise(1 + F.col("p_partkey") % 12).cast("int"), F.when(even, 29).otherwise(1 + F.col("p_partkey") % 28).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.age_on(birth, F.to_date(F.lit("2021-02-28"))).alias("age"))


def control_catalogs(spark, d) -> DataFrame:
    """Nested control catalogs as JSON, one for every thousand numbers of parts: brands as groups, parts as controls and, below every third, an enhancement."""
    part = "named_struct('name', 'statement', 'prose', {0}, 'parts', array(named_struct('prose', concat('of ', p_type))))"
    child = "named_struct('id', concat('pt-', p_partkey, '.1'), 'title', concat(p_name, ' more'), 'params', array(named_struct('id', 'x')), 'props', cast(array() as array<struct<name:string,value:string>>), 'parts', array(" + part.format("'more'") + "))"
    control = F.expr(
        "named_struct('id', concat('pt-', p_partkey), 'title', p_name, 'params', transform(filter(sequence(0, 3), i -> i < p_size % 3), i -> named_struct('id', concat('p', i))), 'props', array(named_struct('name', 'status', 'value', if(p_size = 9, 'withdrawn', 'live'))),"
        f" 'parts', array({part.format('p_name')}, named_struct('name', 'guidance', 'prose', 'not this', 'parts', cast(array() as array<struct<prose:string>>))), 'controls', if(p_partkey % 3 = 0, array({child}), array()))"
    )
    p = table(spark, d, "part").select(F.expr("p_partkey div 1000").alias("catalog"), "p_brand", control.alias("c"))
    groups = p.groupBy("catalog", "p_brand").agg(F.collect_list("c").alias("controls")).select("catalog", F.struct(F.lower(F.replace("p_brand", F.lit("#"))).alias("id"), F.col("p_brand").alias("title"), "controls").alias("g"))
    return groups.groupBy("catalog").agg(F.to_json(F.struct(F.struct(F.collect_list("g").alias("groups")).alias("catalog"))).alias("json")).select("json")


CONTROLS_SQL = """WITH controls AS (SELECT 'PT-' || p_partkey AS id, lower(replace(p_brand, '#', '')) AS family_id, p_name AS title, NULL AS parent, p_size = 9 AS withdrawn, p_name || ' of ' || p_type AS statement, CAST(p_size % 3 AS INTEGER) AS n_params, p_size FROM part
UNION ALL SELECT 'PT-' || p_partkey || '(1)', lower(replace(p_brand, '#', '')), p_name || ' more', 'pt-' || p_partkey, false, 'more of ' || p_type, 1, p_size FROM part WHERE p_partkey % 3 = 0) """


@query("s29_controls", CONTROLS_SQL + "SELECT id, family_id, title, parent, withdrawn, statement, n_params FROM controls")
def controls(spark, d):
    return records.controls(control_catalogs(spark, d)).select("id", "family_id", "title", "parent", "withdrawn", "statement", "n_params")


@query("s38_control_catalog", "SELECT 'PT-' || p_partkey AS id, p_name AS title, CASE WHEN p_size > 25 THEN 'high,low' ELSE 'high' END AS baselines FROM part")
def control_catalog(spark, d):
    at = f"{place(spark)}/controls"
    p = table(spark, d, "part").select(F.concat(F.lit("PT-"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.array(F.lit("high"), F.lit("low"))).otherwise(F.array(F.lit("high"))).alias("baselines"))
    p.agg(F.to_json(F.struct(F.collect_list(F.struct(*p.columns)).alias("controls"))).alias("value")).write.text(at)
    return records.control_catalog(spark, at).select("id", "title", F.array_join("baselines", ",").alias("baselines"))


@query("a24_control_report", CONTROLS_SQL + "SELECT 'low' AS baseline, count(*) AS controls FROM part WHERE p_size > 25 UNION ALL SELECT 'high', count(*) FROM part UNION ALL SELECT '(no statement)', 0")
def control_report(spark, d):
    members = table(spark, d, "part").select(F.concat(F.lit("pt-"), "p_partkey").alias("control_id"), F.explode(F.when(F.col("p_size") > 25, F.array(F.lit("high"), F.lit("low"), F.lit("low"))).otherwise(F.array(F.lit("high")))).alias("baseline"))
    return records.control_report(records.with_baselines(records.controls(control_catalogs(spark, d)), members))


@query("f24_display_ids", "SELECT p_partkey, 'AC-' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '(' || p_size || ')' ELSE '' END AS id FROM part")
def display_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", X.display_id(F.concat(F.lit("ac-"), "p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("."), "p_size")).otherwise(F.lit("")))).alias("id"))


# -- specs and settings ----------------------------------------------------------------------


@query("s32_reporting_lines", "SELECT 'n' || n_nationkey AS person, 'r' || n_regionkey AS boss FROM nation WHERE n_nationkey % 6 > 0 UNION ALL SELECT 'r' || r_regionkey, 'top' FROM region")
def reporting_lines(spark, d):
    n, r = table(spark, d, "nation").collect(), table(spark, d, "region").collect()  # some thirty names
    lines = [f"  n{x.n_nationkey}: {f'r{x.n_regionkey}' if x.n_nationkey % 6 else ''}" for x in n] + [f"  r{x.r_regionkey}: top" for x in r] + ["  top:"]
    return contract.parse_reporting_lines(spark, "reports_to:\n" + "\n".join(lines) + "\n")


@query("s39_gates", "SELECT * FROM (VALUES ('ACK', 432000.0::DOUBLE, 'acknowledge,acknowledgement,receipt'), ('RESOLVE_STANDARD', 2592000.0, 'thirty,30 calendar days,resolution,resolve'), ('RESOLVE_EXPEDITED', 259200.0, 'expedited,72 hours,seventy-two'), ('CLASSIFY', NULL, 'exempt,inquiry,classif')) t(gate_id, seconds, terms)")
def gate_rows(spark, d):
    return ledger.gates(spark).select("gate_id", "seconds", F.array_join(X.gate_terms(F.col("gate_id"), F.col("obligation")), ",").alias("terms"))


@query("f32_settings", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5::DOUBLE ELSE 2.0 END AS number, p_partkey % 4 <> 1 AS flag FROM part")
def settings_rows(spark, d):
    # a part's settings: a number, a word or nothing, and a flag in one of the ways people write it
    from .config import Settings

    files = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit(".5"))).when(F.col("p_partkey") % 3 == 1, "three").alias("n"), F.element_at(F.array(*map(F.lit, ("on", " No ", "maybe", None))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("f"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [Settings({name: v for name, v in (("N", n), ("F", f)) if v is not None}) for n, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.number("N", 2.0) for s in found], pa.float64()), pa.array([s.flag("F", True) for s in found], pa.bool_())], names=["p_partkey", "number", "flag"])

    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "p_partkey bigint, number double, flag boolean")


# -- ledgers and streams ---------------------------------------------------------------------


@query("s33_durable_ledger", """WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS seq FROM nation) SELECT seq, 'c' || n_nationkey % 4 AS case_id, true AS linked FROM n""")
def durable_ledger(spark, d):
    store = ledger.Ledger(spark, place(spark))
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():  # two dozen events
        store.append({"event_type": "evidence.retrieved", "case_id": f"c{r.n_nationkey % 4}", "actor": "a", "actor_kind": "machine", "occurred_at_iso": "2024-01-01T00:00:00.000"})
    ok = ledger.verify(store.events()).first()["ok"]
    return store.events().select("seq", "case_id", F.lit(ok).alias("linked"))


CHAIN_ROWS = "e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM events)"


@query("m02_stream_chain", f"WITH {CHAIN_ROWS} SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS seq, number, true AS ok FROM e")
def stream_chain(spark, d):
    # each link is checked against the batch form
    folder, e = staged(spark, fields(spark, d))
    made = streams.replayed(streams.chain(streams.event_stream(spark, f"{folder}/in", e.schema), none="NA"), folder, "append").select("case_id", "seq", "number", "prev_hash", "hash")
    want = ledger.chained(e, "case_id").select("seq", F.col("hash").alias("h"), F.col("prev_hash").alias("p"))
    return made.join(want, "seq", "left").select("case_id", "seq", "number", F.coalesce((F.col("hash") == F.col("h")) & (F.col("prev_hash") == F.col("p")), F.lit(False)).alias("ok"))


@query("m03_stream_clocks", V("ledger") + """, f AS (SELECT case_id, min(occurred_at) FILTER (WHERE event_type = 'case.created') AS o, min(occurred_at) FILTER (WHERE event_type = 'disposition.recorded') AS c FROM ledger GROUP BY 1)
SELECT case_id, epoch_us(o) AS opened, epoch_us(c) AS disposed, coalesce((epoch_us(c) - epoch_us(o)) / 3.6e9 > 24, false) AS breached FROM f WHERE o IS NOT NULL""")
def stream_clocks(spark, d):
    folder, e = staged(spark, A.ledger(spark, d))
    out = streams.replayed(streams.case_clocks(streams.event_stream(spark, f"{folder}/in", e.schema), 24.0), folder, "update")
    return out.groupBy("case_id").agg(F.min("opened").alias("opened"), F.min("disposed").alias("disposed"), F.max("breached").alias("breached"))


@query("m04_stream_queue", V("ledger") + " SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'case.created') AS opened, count(*) FILTER (WHERE event_type = 'disposition.recorded') AS disposed FROM ledger GROUP BY 1")
def stream_queue(spark, d):
    folder, e = staged(spark, A.ledger(spark, d))
    return streams.replayed(streams.queue_changes(streams.event_stream(spark, f"{folder}/in", e.schema)), folder, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "opened", "disposed")


@query("m05_incremental_ingest", "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents")
def incremental_ingest(spark, d):
    folder, docs = staged(spark, table(spark, d, "documents").select("doc_id", "text"))
    new = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
    streams.incremental(new, f"{folder}/out", f"{folder}/checkpoint", lambda batch: batch.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "hash")


@query("s22_vector_index", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm FROM embeddings WHERE embedding IS NOT NULL")
def vector_index(spark, d):
    at = place(spark)
    e = table(spark, d, "embeddings")
    documents.build_indexes(A.chunks(spark, d).select("chunk_id", "text"), at, e.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return spark.read.parquet(f"{at}/vectors").select(F.col("chunk_id").alias("vec_id"), F.round(retrieval.dot(F.col("v"), F.col("v")), 6).alias("norm"))
