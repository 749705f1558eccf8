"""Documents: text of PDF files, chunks with their context, embeddings by batches with retries, ingest that keeps what is done, and the indexes."""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators.retrieval import unit
from ..session import settle
from .catalog import page_of, page_starts

# -- pdf -------------------------------------------------------------------------------------

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj(.*?)endobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|[-+.\d]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_pages(content: bytes) -> list[str] | None:
    """The text of each page of a PDF with a plain text layer; None if it isn't one or has none.

    Reads objects, Flate streams, and the text operators of pages' contents in the Latin-1
    encoding; fonts with maps of their own, encryption and object streams aren't read.
    """
    if not content.startswith(b"%PDF"):
        return None
    objects = {int(k): body for k, body in OBJECT.findall(content)}
    pages = [objects[k] for k in _page_order(objects)]
    out = [_page_text(p, objects) for p in pages]
    return out if any(x.strip() for x in out) else None


def _page_order(objects: dict[int, bytes]) -> list[int]:
    """Pages in the order of the page tree."""
    kids = {k: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] for k, b in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", b, re.S))}
    below = {x for v in kids.values() for x in v}
    out: list[int] = []
    stack = sorted((k for k in kids if k not in below), reverse=True)
    seen: set[int] = set()
    while stack:
        k = stack.pop()
        if k in seen or k not in objects:
            continue
        seen.add(k)
        if k in kids:
            stack += kids[k][::-1]
        elif re.search(rb"/Type\s*/Page\b", objects[k]):
            out.append(k)
    return out


def _page_text(page: bytes, objects: dict[int, bytes]) -> str:
    m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
    out: list[bytes] = []
    for k in re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else []:
        body = objects.get(int(k), b"")
        s = STREAM.search(body)
        if not s:
            continue
        try:
            data = zlib.decompress(s[1]) if b"/FlateDecode" in body else s[1]
        except zlib.error:
            continue
        held: list[bytes] = []
        for token in TOKEN.findall(data):
            if token[:1] == b"(":
                held.append(ESCAPE.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else NAMED.get(e[1], e[1]), token[1:-1]))
            elif token[:1] == b"<":
                held.append(bytes.fromhex(token[1:-1].decode().ljust(len(token) - 2 + len(token) % 2, "0")))
            elif token in (b"Tj", b"TJ"):
                out += held
                held = []
            elif token in (b"'", b'"'):
                out += [b"\n", *held]
                held = []
            elif token in (b"T*", b"Td", b"TD", b"ET") and out and out[-1] != b"\n":
                out.append(b"\n")
    return b"".join(out).decode("latin-1").strip("\n")


def pdf_texts(files: DataFrame) -> DataFrame:
    """origin, page, text, start of each page of files (origin, content), pages joined by two characters; files without text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(o, k, t) for o, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, t in enumerate((pdf_pages(c) if c else None) or [], 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["origin", "page", "text"])

    return page_starts(files.select("origin", "content").mapInArrow(run, "origin string, page int, text string"), "origin")


# -- chunks ----------------------------------------------------------------------------------

METADATA = ["plan_id", "line_of_business", "policy_number", "title", "department", "status", "date_published", "doc_kind", "filename"]


def chunk_documents(catalog: DataFrame, pages: DataFrame, names: DataFrame | None = None, size: int = 1600, overlap: float = 0.5) -> DataFrame:
    """origin, start, context, text, page, page_count and the catalog's columns: overlapping windows of each document.

    catalog: METADATA columns; pages: origin (plan_id/filename), page, text; names (plan_id, name): plans are named in the context.
    The context ("name · number title") stands before the text where it is embedded or scored, so that a chunk says whose it is.
    """
    starts = page_starts(pages, "origin")
    docs = starts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("page", "text", "start"))).alias("p"))  # a document's own pages
    docs = docs.select("origin", F.array_join("p.text", "\n\n").alias("whole"), F.col("p.start").alias("starts"), F.size("p").alias("page_count")).where(F.trim("whole") != "")
    head = F.trim(F.concat_ws(" ", "policy_number", "title"))
    meta = catalog.select(F.concat_ws("/", "plan_id", "filename").alias("origin"), *METADATA)
    if names is not None:
        meta = meta.join(names.select("plan_id", F.col("name").alias("_name")), "plan_id", "left")
        head = F.trim(F.when(F.col("_name").isNull(), head).otherwise(F.concat("_name", F.lit(" · "), head)))
    step = max(1, int(size * (1 - overlap)))
    cut = docs.join(meta, "origin").withColumn("start", F.explode(F.sequence(F.lit(1), F.length("whole"), F.lit(step))))
    return cut.select("origin", "start", head.alias("context"), F.col("whole").substr(F.col("start"), F.lit(size)).alias("text"), page_of(F.col("starts"), F.col("start")).alias("page"), "page_count", *METADATA)


# -- embeddings ------------------------------------------------------------------------------


class Busy(Exception):
    """A service that asks to be called again; ``after`` seconds, if it says when."""

    def __init__(self, after: float | None = None):
        super().__init__("busy")
        self.after = after


def connector(call: Callable[[list[str]], list[list[float]]], batch: int = 64, tries: int = 8, wait: float = 0.5, most: float = 60.0):
    """For mapInArrow over (id, text): embeddings from a service, ``batch`` texts a call. A busy service is called again after the time it asks for, or twice as long each time."""

    def embed(texts: list[str]) -> list[list[float]]:
        for k in range(tries):
            try:
                found = call(texts)
            except Busy as e:
                if k + 1 == tries:
                    raise
                time.sleep(min(most, e.after if e.after is not None else wait * 2**k))
                continue
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} embeddings of {len(texts)} texts")
            return found
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float32()))], names=["id", "embedding"])

    return run


PROVIDERS: dict[str, Callable[..., object]] = {}


def provider(name: str):
    """Registers what makes a connector from settings, under the name that the settings give."""

    def add(make):
        PROVIDERS[name] = make
        return make

    return add


@provider("local")
def _local(**settings):
    from .catalog import hashing_embedder

    return hashing_embedder(int(settings.get("dim", 64)))


@provider("service")
def _service(call, **settings):
    return connector(call, int(settings.get("batch", 64)), int(settings.get("tries", 8)), float(settings.get("wait", 0.5)))


def embedder(name: str, **settings):
    """The connector of a provider; an unknown name is an error."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**settings)


# -- publishing ------------------------------------------------------------------------------


def publish_version(df: DataFrame, path: str, version: str) -> None:
    """Writes a version of a table beside the others, then names it the live one by renaming one small file over another, so readers always find a whole table."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    new, live = Path(f"{path}/live.building"), Path(f"{path}/live")
    fs = new.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(live), rename)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The live version; an error where none is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/live")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/live').first()[0]}")


# -- indexes ---------------------------------------------------------------------------------


WORD = re.compile("[a-z0-9]{3,}")
COUNTED = 256  # chunks whose words are counted in a batch


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, chunk_id, n of each chunk by itself, so no shuffle has a row for a word's every occurrence."""
    for b in batches:
        for i in range(0, b.num_rows, COUNTED):
            part = b.slice(i, COUNTED)
            found = [Counter(WORD.findall(t.lower())) if t else {} for t in part.column(1).to_pylist()]
            at = pa.array([k for k, c in enumerate(found) for _ in c], pa.int32())
            term, n = pa.array([w for c in found for w in c], pa.string()), pa.array([x for c in found for x in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([term, part.column(0).take(at), n], names=["term", "chunk_id", "n"])


def build_indexes(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Postings (term, chunk_id, n) in the order of the terms, chunks' lengths, and unit vectors. chunks: chunk_id, text.

    The ranges of terms are as many as the session's shuffles have, and a frequent term stands in several of them.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    dealt = chunks.select("chunk_id", "text").repartition("chunk_id")  # over all cores, whatever files the texts come from
    posts = settle(dealt.mapInArrow(_counted, f"term string, chunk_id {kind}, n bigint"), "postings")  # as ranges are found by a pass of its own
    posts = posts.repartitionByRange("term", "chunk_id")
    chunks.select("chunk_id", F.length("text").alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")
    if not chunks.sparkSession.read.parquet(f"{path}/lengths").groupBy("chunk_id").count().where("count > 1").isEmpty():  # chunks that share an id
        posts = posts.groupBy("term", "chunk_id").agg(F.sum("n").alias("n"))
    posts.sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    if vectors is not None:
        vectors.where("embedding is not null").select("chunk_id", unit(F.col("embedding")).alias("v")).write.mode("overwrite").parquet(f"{path}/vectors")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """term, chunk_id, n of some terms; files and row groups whose range has none of them aren't read."""
    return spark.read.parquet(f"{path}/postings").where(F.col("term").isin(words))


def index_scores(spark: SparkSession, path: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """chunk_id, score by BM25 over whole words from the index alone."""
    words = spark.createDataFrame([(query,)], "q string").select(terms(F.col("q"), 2)).first()[0]
    lengths = spark.read.parquet(f"{path}/lengths")
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    met = postings(spark, path, words)
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    joined = met.join(F.broadcast(df), "term").join(lengths, "chunk_id")  # a row for each word of the query
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / (mean or 1.0)))
    return joined.groupBy("chunk_id").agg(F.sum(part).alias("score"))


