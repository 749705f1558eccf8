"""Chunks that follow a text's structure, with the headings that they stand under.

A chunk may begin and end at a border: where a heading line begins (rank 3), where a paragraph begins (2: an empty line is before it),
where a line or sentence begins (1), or where a word begins (0). From its start a chunk goes on to the last border of the highest rank in the
second half of ``size`` characters that lies behind the end of the chunk before; if that half has none above words, to the last border above words in the
first half, else to the last word; a word that is longer than the size is not cut. The next chunk begins at the
first border above words within the last ``overlap`` of this one, else where it ends. Ends are without white space.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import page_starts

HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t#]*$", re.M)
GAP = re.compile(r"\n\s*(?=\S)|(?<=[.!?])[\"')\]]*[ \t]+(?=\S)")  # before a line or a sentence
SPACE = re.compile(r"\s+(?=\S)")


def borders(text: str) -> tuple[list[int], list[int]]:
    """Places above words where a chunk may begin, and their ranks."""
    heads = {m.start() for m in HEADING.finditer(text)}
    at, rank = [], []
    for m in GAP.finditer(text):
        at.append(m.end())
        rank.append(3 if m.end() in heads else 2 if m[0].count("\n") > 1 else 1)
    return at, rank


def cut(text: str, size: int, overlap: float) -> list[tuple[int, int]]:
    """Where each chunk begins and ends."""
    at, rank = borders(text)
    n, end, out = len(text.rstrip()), 0, []
    start = len(text) - len(text.lstrip())
    while end < n:
        limit, floor = start + size, max(end, start)
        if limit >= n:
            out.append((start, n))
            break
        lo, mid, hi = (bisect_right(at, x) for x in (floor, max(floor, start + size // 2), limit))
        if mid < hi:
            stop = at[max(range(mid, hi), key=lambda k: (rank[k], at[k]))]
        elif lo < hi:
            stop = at[hi - 1]
        else:
            words = [m.end() for m in SPACE.finditer(text, floor, limit + 1) if floor < m.end() <= limit]
            if words:
                stop = words[-1]
            else:
                m = SPACE.search(text, limit)
                stop = m.end() if m else n
        out.append((start, start + len(text[start:stop].rstrip())))
        end = stop
        k = bisect_left(at, max(stop - int(size * overlap), start + 1))
        start = at[k] if k < len(at) and at[k] < stop else stop
    return out


def contexts(text: str, starts: list[int]) -> list[str]:
    """The headings that each place stands under, outermost first, a line each."""
    heads, open_, out = [(m.start(), len(m[1]), m[2]) for m in HEADING.finditer(text)], [], []
    k = 0
    for s in starts:
        while k < len(heads) and heads[k][0] < s:
            open_ = [*[h for h in open_ if h[0] < heads[k][1]], heads[k][1:]]
            k += 1
        out.append("\n".join(title for _, title in open_))
    return out


def chunker(size: int, overlap: float):
    """For mapInArrow over (origin, whole, starts): a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, text, pages in zip(*(b.column(k).to_pylist() for k in range(3))):
                spans = cut(text, size, overlap)
                starts = [a for a, _ in spans]
                columns = [[origin] * len(spans), [a + 1 for a in starts], contexts(text, starts), [text[a:z] for a, z in spans], [bisect_right(pages, a + 1) for a in starts], [len(pages)] * len(spans)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()])], names=["origin", "start", "headings", "text", "page", "page_count"])

    return run


def structured(catalog: DataFrame, pages: DataFrame, columns: list[str], names: DataFrame | None = None, size: int = 1600, overlap: float = 0.5) -> DataFrame:
    """origin, start (from 1), context, text, page, page_count and the catalog's columns of each chunk.

    catalog: ``columns``, of them plan_id, filename, policy_number, title; pages: origin (plan_id/filename), page, text; names (plan_id, name): plans are named in the
    context, which is "name · number title" and below it the headings. A document that the catalog doesn't have keeps its headings alone, and nulls. One without text has no chunk; null pages are as empty ones.
    """
    starts = page_starts(pages.withColumn("text", F.coalesce("text", F.lit(""))), "origin")
    docs = starts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("page", "text", "start"))).alias("p"))  # a document's own pages
    docs = docs.select("origin", F.array_join("p.text", "\n\n").alias("whole"), F.col("p.start").cast("array<bigint>").alias("starts"))
    found = docs.mapInArrow(chunker(size, overlap), "origin string, start int, headings string, text string, page int, page_count int")
    head = F.trim(F.concat_ws(" ", "policy_number", "title"))
    meta = catalog.select(F.concat_ws("/", "plan_id", "filename").alias("origin"), *columns)
    if names is not None:
        meta = meta.join(names.select("plan_id", F.col("name").alias("_name")), "plan_id", "left")
        head = F.trim(F.when(F.col("_name").isNull(), head).otherwise(F.concat("_name", F.lit(" · "), head)))
    meta = meta.select("origin", head.alias("_head"), *columns)
    context = F.array_join(F.filter(F.array("_head", "headings"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    return found.join(meta, "origin", "left").select("origin", "start", context.alias("context"), "text", "page", "page_count", *columns)
