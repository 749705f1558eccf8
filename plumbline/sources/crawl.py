"""Crawling as a flow of tables: robots rules by origin, guarded downloads, paged APIs, and one site's catalog.

The network is a callable that the caller gives (``fetch``: address -> bytes or None); it runs on
the executors, batch by batch. Everything else is declared.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import robots_allowed, robots_rules
from ..session import settle
from . import catalog

Fetch = Callable[[str], bytes | None]


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/]+)", 1)


def fetched(urls: DataFrame, fetch: Fetch, pause: float = 0.0) -> DataFrame:
    """url, content: what fetch gives for each address (null if it fails or gives none); ``pause`` seconds between two calls of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u in b.column(0).to_pylist():
                try:
                    out.append(fetch(u))
                except Exception:  # noqa: BLE001  a page that can't be had is a finding, not an end
                    out.append(None)
                if pause:
                    time.sleep(pause)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["url", "content"])

    return urls.select("url").mapInArrow(run, "url string, content binary")


def with_robots(links: DataFrame, fetch: Fetch) -> DataFrame:
    """links (url and others) that the robots rules of their origin allow. Each origin's rules are fetched once; an origin without rules allows all."""
    origins = links.select(origin(F.col("url")).alias("_o")).distinct()
    texts = settle(fetched(origins.select(F.concat("_o", F.lit("/robots.txt")).alias("url")), fetch), "robots")
    rules = texts.select(F.regexp_replace("url", "/robots.txt$", "").alias("_o"), robots_rules(F.coalesce(F.decode("content", "UTF-8"), F.lit(""))).alias("_rules"))
    return links.withColumn("_o", origin(F.col("url"))).join(rules, "_o").where(robots_allowed(F.col("url"), F.col("_rules"))).drop("_o", "_rules")


def crawled(
    pages: DataFrame, plan_id: str, scope: list[str], patterns: list[str], sitemaps: DataFrame | None = None, fetch: Fetch | None = None, manifest: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """The catalog of one site: links of seed pages and of sitemaps, each address once, as far as robots rules allow; classified,
    names told apart, in scope; then manifest rows whose address wasn't crawled. limit: so many rows, by policy number and address.

    pages: url, html; sitemaps: xml; manifest: catalog rows. fetch: gives robots.txt; without it all is allowed.
    """
    links = catalog.page_links(pages, patterns)
    if sitemaps is not None:
        links = links.unionByName(catalog.sitemap_urls(sitemaps, include=patterns).select("url", F.lit("").alias("text"), F.lit("").alias("seed")))
    # a page's own words win over a sitemap's bare address
    first = Window.partitionBy("url").orderBy(F.col("seed") == "", "seed", "text")
    one = links.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    found = catalog.site_catalog(one if fetch is None else with_robots(one, fetch), plan_id, scope, manifest)
    return head(found, limit)


def head(found: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by policy number, title and address, or all."""
    return found if limit is None else found.orderBy("policy_number", "title", "source_url").limit(limit)


def dropped_kinds(links: DataFrame, scope: list[str]) -> DataFrame:
    """doc_kind, n of what the scope leaves out."""
    return links.where(~F.col("doc_kind").isin(scope)).groupBy("doc_kind").agg(F.count("*").alias("n"))


def downloads(rows: DataFrame, fetch: Fetch, present: DataFrame, pause: float = 0.0) -> DataFrame:
    """plan_id, filename, source_url, status, content: what to do with each catalog row's file.

    present: plan_id, filename, length of files at hand. status: "present" (at hand and not empty, not fetched again),
    "saved" (begins with %PDF), "not a pdf", "failed".
    """
    have = present.where("length > 0").select("plan_id", "filename").distinct().withColumn("_have", F.lit(True))
    marked = settle(rows.select("plan_id", "filename", "source_url").join(have, ["plan_id", "filename"], "left"), "rows")
    # each address is asked for once
    got = settle(fetched(marked.where("_have is null").select(F.col("source_url").alias("url")).distinct(), fetch, pause), "files")
    status = F.when(F.col("_have"), "present").when(F.col("content").isNull(), "failed").when(F.substring("content", 1, 4) == F.lit(b"%PDF"), "saved").otherwise("not a pdf")
    met = marked.join(got, F.col("source_url") == F.col("url"), "left").withColumn("status", status)
    return met.select("plan_id", "filename", "source_url", "status", F.when(F.col("status") == "saved", F.col("content")).alias("content"))


def landed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows whose file is there; files: plan_id, filename."""
    return rows.join(files.select("plan_id", "filename").distinct(), ["plan_id", "filename"], "left_semi").select(rows.columns)


def paged(spark: SparkSession, page: Callable[[int, int], tuple[int, list[str]]], size: int = 100) -> DataFrame:
    """json: the items of a paged API. page(offset, size) -> (total, items as JSON); the first page says how many there are, all others are asked for on the executors."""
    total, _ = page(0, size)
    offsets = spark.range(0, max(total, 1), size, max(1, min(200, -(-total // size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(page(at, size)[1], pa.string())], names=["json"])

    return offsets.mapInArrow(run, "json string")


ITEM = "struct<url:string,title:string,name:string,number:array<string>,type:array<string>,plans:array<string>,owner:array<string>,revised:array<string>>"


def search_documents(items: DataFrame, kinds: dict[str, str], host: str, json: str = "json") -> DataFrame:
    """Catalog columns of a search API's items: those of a host that have a policy number or a type in ``kinds``; one row for each address, numbered ones first."""
    d = items.select(F.from_json(json, ITEM).alias("d")).select("d.*").where(F.contains(F.coalesce("url", F.lit("")), F.lit(host)))
    first = lambda c: F.coalesce(F.get(F.col(c), 0), F.lit(""))
    named = F.lit(None).cast("string")
    for kind, as_ in kinds.items():
        named = F.when(first("type") == kind, as_).otherwise(named)
    rows = d.withColumn("policy_number", first("number")).withColumn("doc_kind", F.when(F.col("policy_number") != "", "policy").otherwise(named)).where("doc_kind is not null")
    title = F.trim(F.coalesce(F.nullif("title", F.lit("")), "name", F.lit("")))
    order = Window.partitionBy("source_url").orderBy(F.col("policy_number") == "", "policy_number", "title")
    out = rows.select(
        "policy_number", title.alias("title"), F.col("url").alias("source_url"), "doc_kind", F.coalesce(F.get("owner", F.lit(0)), F.lit("Unspecified")).alias("department"),
        F.coalesce(F.array_join("plans", ","), F.lit("")).alias("line_of_business"), F.substring(first("revised"), 1, 10).alias("date_published"),
    )
    return out.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dispatch(registry: dict[str, dict], fetchers: dict[str, Callable[[dict], DataFrame]], plans: list[str] | None = None, limit: int | None = None) -> DataFrame | None:
    """The catalogs of the plans asked for, each by the fetcher that the registry names for it, at most ``limit`` rows of each."""
    from ..plans.contract import fetchable

    out = None
    for plan in fetchable(registry, set(fetchers), plans).values():
        rows = head(catalog.repaired(fetchers[plan["fetcher"]](plan)), limit)
        out = rows if out is None else out.unionByName(rows)
    return out
