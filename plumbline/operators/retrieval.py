"""Text retrieval over chunks: scopes, BM25, rarity scores, facets, pages, citations, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
ROWS = 128  # of a block's vectors that are multiplied at a time
BLOCK = 4096  # vectors of a side that are multiplied together


def times(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring, in lower case. Counted in bytes, whose number a string knows."""
    t = F.lower(text)
    return ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(word), F.lit("")))) / len(word.encode())).cast("int")


def question_stems(query: str, longer_than: int = 2, stem: int = 7, stop: tuple[str, ...] = ()) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()
    return list(dict.fromkeys(w[:stem] for w in dict.fromkeys(words) if len(w) > longer_than and w not in stop))


def density_scope(chunks: DataFrame, key: str, pattern: str, least_hits: int = 3, least_share: float = 0.15) -> DataFrame:
    """key, hits, total, density of the groups that speak of the pattern often enough; one pass."""
    out = chunks.groupBy(key).agg(F.count_if(F.lower("text").rlike(pattern)).alias("hits"), F.count("*").alias("total"))
    out = out.withColumn("density", F.col("hits").cast("double") / F.col("total"))
    return out.where((F.col("hits") >= least_hits) & (F.col("density") >= least_share))


def bm25(chunks: DataFrame, query: str, top: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """chunks with score > 0, best first (ties by chunk_id).

    All statistics are of the chunks given, i.e. after filters. Lengths are characters, counts
    are of substrings. The few stems are columns, so one aggregate and one projection do it all.
    """
    stems = question_stems(query)
    tf = chunks.select("*", F.length("text").alias("_len"), *[times(F.col("text"), s).alias(f"_tf{i}") for i, s in enumerate(stems)])
    stats = tf.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(stems))])
    tf = tf.crossJoin(F.broadcast(stats))  # one row
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_len") / F.col("_avg"))
    part = lambda i: F.when(F.col(f"_df{i}") > 0, F.ln(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + norm)).otherwise(0.0)
    scored = tf.withColumn("score", reduce(lambda x, y: x + y, [part(i) for i in range(len(stems))], F.lit(0.0))).where("score > 0").select(*chunks.columns, "score")
    return scored.orderBy(F.desc("score"), "chunk_id").limit(top) if top else scored


def rarity(chunks: DataFrame, query: str, top: int | None = 6, least_length: int = 200, stop: tuple[str, ...] = ()) -> DataFrame:
    """chunks by the sum of 1 / log1p(df) (four decimals) over the stems they have; df counts all chunks, short ones aren't scored."""
    stems = question_stems(query, 3, 7, stop)
    has = chunks.select("*", *[F.lower("text").contains(s).cast("int").alias(f"_h{i}") for i, s in enumerate(stems)])
    stats = has.agg(*[F.greatest(F.sum(f"_h{i}"), F.lit(1)).alias(f"_df{i}") for i in range(len(stems))])
    has = has.where(F.length("text") > least_length).crossJoin(F.broadcast(stats))  # one row
    hits = reduce(lambda x, y: x + y, [F.round(1 / F.log1p(F.col(f"_df{i}")), 4) * F.col(f"_h{i}") for i in range(len(stems))], F.lit(0.0))
    scored = has.withColumn("hits", hits).where("hits > 0").select(*chunks.columns, "hits")
    return scored.orderBy(F.desc("hits"), "page", "chunk_id").limit(top) if top else scored


def facets(hits: DataFrame, columns: list[str]) -> DataFrame:
    """facet, name, n for each column, in one pass by grouping sets."""
    each = hits.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("name")) for c in columns])).alias("x"))
    return each.groupBy(F.col("x.facet").alias("facet"), F.col("x.name").alias("name")).agg(F.count("*").alias("n"))


def first_page(chunks: DataFrame, stems: list[str]) -> DataFrame:
    """doc_id, page: the first page with any of the stems."""
    return chunks.where(F.lower("text").rlike("|".join(stems))).groupBy("doc_id").agg(F.min("page").alias("page"))


def authority_passage(chunks: DataFrame, stems: list[str], least_length: int = 300) -> DataFrame:
    """One chunk for each document: the first with a stem, else its first one; long ones only."""
    c = chunks.where(F.length("text") > least_length).withColumn("fallback", (~F.lower("text").rlike("|".join(stems))).cast("int"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("fallback", "page", "start"))).where("r = 1").drop("r")


def applicable(nodes: DataFrame, edges: DataFrame, letter: str, plans: list[str] | None = None, top: int | None = 12) -> DataFrame:
    """Documents that implement a letter, most mentions first."""
    docs = nodes.where("kind = 'document'").select(F.col("id").alias("source"), "plan_id", "label")
    out = edges.where((F.col("relationship_type") == "implements") & (F.col("target") == letter)).join(docs, "source").select(F.col("source").alias("id"), "plan_id", "label", F.col("weight").alias("mentions"))
    out = out.where(F.col("plan_id").isin(plans)) if plans is not None else out
    return out.orderBy(F.desc("mentions"), "id").limit(top) if top else out


def citation_tokens(answers: DataFrame) -> DataFrame:
    """id, pos, letter, page: each page named in a text (id, answer) with the letter named last before it."""
    found = answers.select("id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"(?i)(APL\s*[0-9]{2}-[0-9]{3}|page\s+[0-9]+)"), F.lit(1))).alias("pos", "tok"))
    w = Window.partitionBy("id").orderBy("pos")
    letter = F.when(F.col("tok").rlike("(?i)^APL"), F.concat(F.lit("APL "), F.regexp_extract("tok", r"([0-9]{2}-[0-9]{3})", 1)))
    out = found.withColumn("letter", F.last(letter, ignorenulls=True).over(w)).where(~F.col("tok").rlike("(?i)^APL"))
    return out.select("id", "pos", "letter", F.regexp_extract("tok", "([0-9]+)", 1).cast("int").alias("page"))


def verified_citations(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """id, cited, unverified, uncited: shown (policy_number, page) are the passages that answers may cite."""
    cited = citation_tokens(answers).where("letter is not null").select("id", F.concat_ws("#", "letter", "page").alias("c")).distinct()
    have = shown.select(F.concat_ws("#", "policy_number", "page").alias("c")).distinct().withColumn("ok", F.lit(True))
    some = not shown.isEmpty()
    counted = cited.join(have, "c", "left").groupBy("id").agg(F.count("*").alias("cited"), F.count_if(F.col("ok").isNull()).alias("unverified"))
    zero = F.lit(0).cast("bigint")
    return answers.select("id").join(counted, "id", "left").select("id", F.coalesce("cited", zero).alias("cited"), F.coalesce("unverified", zero).alias("unverified"), (F.col("cited").isNull() & F.lit(some)).alias("uncited"))


# -- vectors ---------------------------------------------------------------------------------


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding", least: int = 1) -> DataFrame:
    """key, pos, value: means of distinct vectors by group, scaled to length one."""
    distinct = vectors.where(finite(F.col(vector))).select(key, F.col(vector).cast("array<double>").alias("v")).distinct()
    enough = distinct.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    mean = distinct.join(enough, key).select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return mean.withColumn("value", F.col("m") / F.nullif(norm, F.lit(0.0))).where("value is not null").select(key, "pos", "value")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    d = v.cast("array<double>")
    with_norm = F.array(F.struct(d.alias("v"), F.sqrt(dot(d, d)).alias("n")))  # the norm is made once, not for each component
    return F.element_at(F.transform(with_norm, lambda r: F.transform(r["v"], lambda x: x / r["n"])), 1)


def vector_top(vectors: DataFrame, query: list[float], key: str, top: int = 8, wide: int = 4, vector: str = "embedding") -> DataFrame:
    """key, score: best top * wide vectors by cosine, the best of each key, head top. TakeOrdered, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(finite(F.col(vector))).select(key, "vec_id", dot(unit(F.col(vector)), unit(q)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(top * wide)
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))).where("r = 1")
    return best.orderBy(F.desc("score"), "vec_id").limit(top).select(key, "vec_id", "score")


def similar_pairs(vectors: DataFrame, plan: str, least: float = 0.55, per_doc: int = 3, vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """a, b, sim: for each vector its best ``per_doc`` later ones of other plans with cosine >= least, by sim to nine digits, then by b.

    All pairs are asked for, so they are formed block by block: block x meets block y >= x in one group of two times
    BLOCK vectors at most about, whatever the input's size, and is multiplied there as matrices. The work grows with the square of the vectors.
    """
    blocks = blocks or max(1, -(-vectors.count() // BLOCK))
    good = vectors.where(finite(F.col(vector))).select(F.col("vec_id").alias("id"), F.col(plan).alias("plan"), unit(F.col(vector)).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("k"))
    left = good.withColumn("x", F.col("k")).withColumn("y", F.explode(F.sequence(F.col("k"), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = good.withColumn("y", F.col("k")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("side", F.lit(1))

    def run(key, frame):
        import numpy as np
        import pandas as pd

        a, b = frame[frame.side == 0], frame[frame.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        va, vb = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy())
        held = pd.DataFrame({"a": a.id.iloc[:0], "b": a.id.iloc[:0], "sim": np.zeros(0)})  # the best of the rows so far, not all pairs
        for i in range(0, len(a), ROWS):
            s = va[i : i + ROWS] @ vb.T
            ia, ib = a.id.to_numpy()[i : i + ROWS, None], b.id.to_numpy()[None, :]
            ok = (s >= least - 1e-12) & (a.plan.to_numpy()[i : i + ROWS, None] != b.plan.to_numpy()[None, :]) & (ia != ib)
            r, c = np.nonzero(ok)
            x, y = a.id.to_numpy()[i + r], b.id.to_numpy()[c]
            keep = (x < y) if key[0] == key[1] else np.ones(len(x), bool)
            held = pd.concat([held, pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "sim": s[r, c][keep]})])
            held = held.assign(r=held.sim.round(9)).sort_values(["a", "r", "b"], ascending=[True, False, True]).drop(columns="r").groupby("a").head(per_doc)
        return held

    found = left.unionByName(right).groupBy("x", "y").applyInPandas(run, "a bigint, b bigint, sim double")
    rank = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b")
    return found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_doc).drop("r")
