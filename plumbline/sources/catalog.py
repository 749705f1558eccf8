"""Catalogs: schema repair, merges, names, and the scans of listing pages, sitemaps and APIs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ALONE, LONGER, department, doc_kind, doc_title, safe_name, site_code, trimmed, vendor_code, vendor_title

# The catalog's columns.
COLUMNS = [
    "plan_id", "line_of_business", "doc_id", "policy_number", "title", "department", "status", "date_published", "due_date",
    "doc_kind", "source_url", "filename",
]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def repaired(df: DataFrame) -> DataFrame:
    """The twelve columns in order; missing ones and nulls are empty, extra ones are dropped."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in COLUMNS])


def rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Catalog rows from named expressions; unknown columns are an error, all values are trimmed."""
    unknown = set(columns) - set(COLUMNS)
    if unknown:
        raise ValueError(f"unknown catalog columns: {', '.join(sorted(unknown))}")
    return df.select(*[trimmed(F.coalesce(columns[c].cast("string"), F.lit(""))).alias(c) if c in columns else F.lit("").alias(c) for c in COLUMNS])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalog, one file with a list or a folder of lines; an empty typed frame where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return spark.createDataFrame([], SCHEMA)
    return repaired(spark.read.schema(SCHEMA).json(path, multiLine=not fs.getFileStatus(there).isDirectory()))


def write_catalog(catalog: DataFrame, path: str) -> None:
    repaired(catalog).orderBy("plan_id", "policy_number", "title").write.mode("overwrite").json(path)


def merged_by_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the plans that new has replaced by new's rows."""
    return old.join(new.select("plan_id").distinct(), "plan_id", "left_anti").select(old.columns).unionByName(new)


def dedupe_filenames(catalog: DataFrame) -> DataFrame:
    """Second and later equal names of a plan get _ and six letters of their doc_id; what is still equal gets _1, _2 ..."""
    stem, ext = F.regexp_replace("filename", r"\.[^.]*$", ""), F.regexp_extract("filename", r"(\.[^.]*)$", 1)
    named = lambda key: F.row_number().over(Window.partitionBy("plan_id", "filename").orderBy(*key)) - 1
    one = catalog.withColumn("_k", named(["doc_id", "source_url"]))
    mark = F.substring(F.regexp_replace("doc_id", "[^A-Za-z0-9]", ""), 1, 6)
    one = one.withColumn("filename", F.when(F.col("_k") > 0, F.concat(stem, F.lit("_"), mark, ext)).otherwise(F.col("filename")))
    two = one.withColumn("_k", named(["doc_id", "source_url"]))
    return two.withColumn("filename", F.when(F.col("_k") > 0, F.concat(stem, F.lit("_"), F.col("_k"), ext)).otherwise(F.col("filename"))).drop("_k")


# -- scans -----------------------------------------------------------------------------------


def page_links(pages: DataFrame, patterns: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """url, text, seed: links of listing pages whose address contains any pattern; without #fragments.

    Pages are parsed batch by batch on the executors; relative links are joined to the page's address.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser
        from urllib.parse import urljoin

        class Anchors(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.found, self.href, self.text = [], None, []

            def handle_starttag(self, tag, attrs):
                if tag == "a" and dict(attrs).get("href"):
                    self.href, self.text = dict(attrs)["href"], []

            def handle_data(self, data):
                if self.href is not None:
                    self.text.append(data)

            def handle_endtag(self, tag):
                if tag == "a" and self.href is not None:
                    self.found.append((self.href, " ".join("".join(self.text).split())))
                    self.href = None

        for b in batches:
            out = {"url": [], "text": [], "seed": []}
            for base, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if base is None or body is None:
                    continue
                p = Anchors()
                p.feed(body)
                for href, text in p.found:
                    try:
                        full = urljoin(base, href).split("#")[0]
                    except ValueError:
                        continue
                    if any(x in full for x in patterns):
                        out["url"].append(full)
                        out["text"].append(text)
                        out["seed"].append(base)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("url", pa.string()), ("text", pa.string()), ("seed", pa.string())]))

    return pages.select(url, html).mapInArrow(run, "url string, text string, seed string")


def simple_links(pages: DataFrame) -> DataFrame:
    """page_id, href, text: plain double-quoted anchors, JVM-side; enough for well-formed listings."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    each = pages.select("page_id", F.explode(found).alias("a"))
    return each.select("page_id", F.regexp_extract("a", r'<a href="([^"]*)">', 1).alias("href"), F.regexp_extract("a", r'">([^<]*)</a>', 1).alias("text"))


def sitemap_urls(maps: DataFrame, xml: str = "xml", include: list[str] | None = None) -> DataFrame:
    """url: all loc elements whatever their namespace; only those with any of ``include``."""
    urls = maps.select(F.explode(F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))).alias("url"))
    return urls if not include else urls.where(reduce(lambda a, b: a | b, [F.col("url").contains(p) for p in include]))


def policies_api(body: DataFrame, plan_id: str, json: str = "json") -> DataFrame:
    """Catalog rows of a policies API: each policy's first file; policies without one are dropped."""
    schema = "array<struct<id:string,number:string,title:string,department:string,status:string,published:string,due:string,files:array<struct<url:string,name:string>>>>"
    p = body.select(F.explode(F.from_json(F.col(json), schema)).alias("p")).where("size(p.files) > 0")
    day = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 10)
    return rows(
        p, plan_id=F.lit(plan_id), doc_id=F.col("p.id"), policy_number=F.col("p.number"), title=F.col("p.title"), department=F.coalesce("p.department", F.lit("Unspecified")),
        status=F.coalesce("p.status", F.lit("Unknown")), date_published=day("p.published"), due_date=day("p.due"), doc_kind=F.lit("policy"), source_url=F.element_at("p.files", 1)["url"],
        filename=F.concat(safe_name(F.element_at("p.files", 1)["name"]), F.lit(".pdf")),
    )


def documents_api(body: DataFrame, plan_id: str, json: str = "json") -> DataFrame:
    """Catalog rows of a document portal; an error if the first document lacks id, name or publicUrl."""
    schema = "struct<data:array<struct<id:string,name:string,publicUrl:string,breadcrumbs:array<struct<trail:array<struct<name:string>>>>>>>"
    parsed = body.select(F.from_json(F.col(json), schema)["data"].alias("data"))
    first = F.get(F.col("data"), 0)
    checked = parsed.select(F.when(first["id"].isNotNull() & first["name"].isNotNull() & first["publicUrl"].isNotNull(), F.col("data")).otherwise(F.raise_error(F.lit("the portal's schema has changed"))).alias("data"))
    d = checked.select(F.explode("data").alias("d"))
    return rows(
        d, plan_id=F.lit(plan_id), doc_id=F.col("d.id"), policy_number=vendor_code(F.col("d.name")), title=vendor_title(F.col("d.name")),
        department=F.coalesce(F.get(F.get(F.col("d.breadcrumbs"), 0)["trail"], 1)["name"], F.lit("Unspecified")), doc_kind=F.lit("policy"), source_url=F.col("d.publicUrl"), filename=F.concat(safe_name(F.col("d.name")), F.lit(".pdf")),
    )


def manifest(spark: SparkSession, path: str, plan_id: str) -> DataFrame:
    fields = "policy_number string, title string, source_url string, doc_kind string, department string, line_of_business string"
    m = spark.read.schema(f"documents array<struct<{fields.replace(' string', ':string')}>>").json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    return rows(
        m, plan_id=F.lit(plan_id), policy_number=F.col("policy_number"), title=F.col("title"), source_url=F.col("source_url"), doc_kind=F.coalesce("doc_kind", F.lit("policy")),
        department=F.coalesce("department", F.lit("Unspecified")), line_of_business=F.coalesce("line_of_business", F.lit("medi-cal")), filename=F.concat(safe_name(F.col("title")), F.lit(".pdf")),
    )


def site_catalog(links: DataFrame, plan_id: str, scope: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Catalog rows of crawled links (url, text, seed): first of each address, classified, in scope; then manifest rows not met."""
    one = links.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("seed", "text"))).where("_r = 1")
    title = doc_title(F.col("text"), F.col("url"))
    found = rows(
        one, plan_id=F.lit(plan_id), doc_id=F.substring(F.md5("url"), 1, 12), policy_number=site_code(title), title=title, department=department(F.col("url"), F.col("seed")),
        doc_kind=doc_kind(F.col("url"), F.col("text")), source_url=F.col("url"), filename=F.concat(safe_name(title), F.lit(".pdf")),
    )
    found = dedupe_filenames(found).where(F.col("doc_kind").isin(scope))
    return found if extra is None else found.unionByName(extra.join(found.select("source_url").distinct(), "source_url", "left_anti").select(COLUMNS))


def slugs(name: str, pinned: str | None = None, plan_id: str = "") -> list[str]:
    """Candidate host names of an organisation, as slug_candidates gives; a pinned one is the only one."""
    import re
    import unicodedata

    flat = "".join(LONGER.get(c, ALONE.get(c, c)) for c in name)
    base = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", flat).encode("ascii", "ignore").decode().lower()).strip("-")
    found = [base, re.sub("^the-", "", base), base.replace("-of-", "-"), plan_id.lower()]
    return [pinned] if pinned else list(dict.fromkeys(f for f in found if f))


# -- documents -------------------------------------------------------------------------------


def changed(files: DataFrame, done: DataFrame) -> DataFrame:
    """files (origin, content or hash) whose hash isn't among those done (origin, hash)."""
    f = files if "hash" in files.columns else files.withColumn("hash", F.md5("content"))
    return f.join(done.select("origin", "hash"), ["origin", "hash"], "left_anti")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of files that begin with %PDF."""
    return spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "length")


def page_starts(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """start: where each page begins in its document's text, pages joined by two characters."""
    before = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)) + 1)


def chunked(docs: DataFrame, size: int = 1600, overlap: float = 0.5, text: str = "text") -> DataFrame:
    """Overlapping windows of a text: chunk, start and text. The last one may be shorter."""
    step = max(1, int(size * (1 - overlap)))
    out = docs.where(F.length(text) > 0).withColumn("start", F.explode(F.sequence(F.lit(1), F.length(text), F.lit(step))))
    return out.withColumn("chunk", F.col(text).substr(F.col("start"), F.lit(size)))


def page_of(starts: Column, at: Column) -> Column:
    """The page that a place is on: how many pages start at or before it."""
    return F.size(F.filter(starts, lambda s: s <= at))


def upserted(store: DataFrame, new: DataFrame, key: str = "origin") -> DataFrame:
    """store with all rows of new's keys replaced."""
    return store.join(new.select(key).distinct(), key, "left_anti").select(store.columns).unionByName(new)


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Written aside, then renamed over the live table, so readers see the old or the new one."""
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    building, old = f"{path}.building", f"{path}.old"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(building)
    if fs.exists(Path(path)):
        fs.delete(Path(old), True)
        fs.rename(Path(path), Path(old))
    fs.rename(Path(building), Path(path))
    fs.delete(Path(old), True)


def hashing_embedder(dim: int = 64):
    """A deterministic stand-in for an embedding service: hashed word counts, unit length. For mapInArrow over (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for b in batches:
            x = np.zeros((b.num_rows, dim), np.float32)
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    x[i, h % dim] += 1 if h & 0x80000000 else -1
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))], names=["id", "embedding"])

    return run


def embedded(texts: DataFrame, embed=None) -> DataFrame:
    """texts (id, text) with embeddings, batch by batch on the executors; ``embed`` is the service, a stub by default."""
    return texts.select("id", "text").mapInArrow(embed or hashing_embedder(), T.StructType([texts.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))]))
