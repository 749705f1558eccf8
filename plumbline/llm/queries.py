"""The operators of this package bound to the shared tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import alignment, ann, codebooks, langid, line_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, warc
from .common import run_folder, settle, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), *site())
    return found.select("doc_id", F.round("p_good", 9).alias("p_good"), F.round("evidence", 9).alias("evidence"), F.round("prior_odds", 9).alias("prior_odds"), "kept")


def site() -> tuple[Column, Column]:
    """Host and path of a document: its source, and the part of it in its language."""
    return F.col("source"), F.col("lang")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id is as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_scoring.score(docs, remainder("doc_id", 10) != 0, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, remainder("doc_id", 3) != 1)
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


WEIGHTS = [
    *[("domain", f"d{k}", float(k + 1)) for k in range(4)],
    ("language", "en", 4.0), ("language", "de", 2.0), ("language", "fr", 2.0), ("language", "es", 1.0),
]


def tree(docs: DataFrame) -> DataFrame:
    """Sizes of documents and their place: four domains of sources, by a digest of the source."""
    digit = F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1)
    domain = F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")
    return mixing.sizes_of(docs, domain, F.col("lang"), F.col("source"))


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "level string, name string, weight double")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = settle(tree(table(spark, sf_dir, "documents")), "sizes")
    leaves = mixing.plan(mixing.leaves_of(sizes), F.col("all_tokens"), weights(spark))
    return mixing.mixed(sizes, leaves).drop("row")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), f"{run_folder(spark)}/{uuid.uuid4().hex}/warc")
    return warc.report(warc.read(archives))


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_quality_rules, op3_attention_lm, op4_collision_ann, op5_language_spans, op6_line_dedup, op7_best_fit_packing, op8_simhash, op9_substring_dedup, op10_mixing, op11_token_alignment, op12_warc, op13_codebooks]
    return {f.__name__: _shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINES_SQL, "op9_substring_dedup": WORDS_SQL, "op10_mixing": MIX_SQL, "op12_warc": WARC_SQL, "op13_codebooks": codes_sql()}


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
windows AS (
  SELECT doc_id, n, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
later AS (
  SELECT doc_id, n FROM (
    SELECT doc_id, n, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, n) AS occurrence FROM windows WHERE third IS NOT NULL)
  WHERE occurrence > 1),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, (VALUES (0), (1), (2)) t(k)),
kept AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n),
sums AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
                string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT removed) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.text, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""

WORDS_SQL = """
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS n, ws FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL)),
windows AS (SELECT doc_id, n, array_to_string(list_slice(ws, n, n + 19), ' ') AS w FROM words WHERE n + 19 <= len(ws)),
later AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY w ORDER BY doc_id, n) AS occurrence FROM windows) WHERE occurrence > 1),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, (SELECT unnest(range(20)) AS k)),
sums AS (SELECT w.doc_id, count(*) AS n_words, count(g.n) AS n_removed, string_agg(w.word, ' ' ORDER BY w.n) FILTER (WHERE g.n IS NULL) AS text
         FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.n = w.n GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""

#: A level of the tree: the budgets b of nodes by ``keys``, divided from those by ``parent``.
_LEVEL = """
{name}_n AS (SELECT {keys}, sum(capacity) AS capacity, first({up}.b) AS budget, first(coalesce(w.weight, 1.0)) AS weight
  FROM leaf JOIN {up} USING ({parent}) LEFT JOIN weights w ON w.level = '{level}' AND w.name = leaf.{level} GROUP BY {keys}),
{name}_w AS (SELECT *, sum(capacity) OVER o AS used, sum(weight) OVER f - sum(weight) OVER o AS rest_weight FROM {name}_n
  WINDOW o AS (PARTITION BY {parent} ORDER BY capacity / weight, {level}), f AS (PARTITION BY {parent})),
{name}_f AS (SELECT *, used + capacity / weight * rest_weight <= budget AS full_ FROM {name}_w),
{name} AS (SELECT {keys}, greatest(0, CASE WHEN full_ THEN capacity ELSE least(capacity, (budget - coalesce(sum(capacity) FILTER (WHERE full_) OVER p, 0)) * weight / sum(weight) FILTER (WHERE NOT full_) OVER p) END) AS b
  FROM {name}_f WINDOW p AS (PARTITION BY {parent}))"""

MIX_SQL = (
    """
WITH weights(level, name, weight) AS (VALUES """
    + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in WEIGHTS)
    + f"""),
sizes AS (SELECT doc_id, md5(coalesce(text, '')) AS row_, 0 AS root, lang AS language, source,
  CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '4' THEN 'd0' WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'd1' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'c' THEN 'd2' ELSE 'd3' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT root, domain, language, source, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE * 4 AS capacity FROM sizes WHERE tokens > 0 GROUP BY 1, 2, 3, 4),
top AS (SELECT 0 AS root, sum(tokens) AS b FROM leaf),"""
    + _LEVEL.format(name="one", level="domain", up="top", parent="root", keys="root, domain")
    + ","
    + _LEVEL.format(name="two", level="language", up="one", parent="root, domain", keys="root, domain, language")
    + ","
    + _LEVEL.format(name="three", level="source", up="two", parent="root, domain, language", keys="root, domain, language, source")
    + f""",
plan AS (SELECT leaf.*, CAST(floor(b) AS BIGINT) AS share, CAST(floor(b) AS BIGINT) // CAST(tokens AS BIGINT) AS whole, CAST(floor(b) AS BIGINT) % CAST(tokens AS BIGINT) AS part FROM leaf JOIN three USING (root, domain, language, source)),
docs AS (SELECT s.doc_id, s.row_, s.domain, s.language, s.source, s.tokens, whole, part FROM sizes s JOIN plan USING (root, domain, language, source) WHERE s.tokens > 0),
last AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY md5('{mixing.SEED}:' || whole || ':' || doc_id || ':' || row_), doc_id, row_ ROWS UNBOUNDED PRECEDING) - tokens AS before FROM docs WHERE part > 0)
SELECT doc_id, domain, language, source, CAST(epoch AS INTEGER) AS epoch, tokens, tokens AS tokens_taken FROM (SELECT *, unnest(range(whole)) AS epoch FROM docs WHERE whole > 0)
UNION ALL SELECT doc_id, domain, language, source, CAST(whole AS INTEGER), tokens, CAST(least(tokens, part - before) AS BIGINT) FROM last WHERE before < part
"""
)

_DIGIT = "('0x' || substr(h, {at}, 5))::INTEGER"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_DIGIT.format(at=1 + 5 * g)} >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0))

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def codes_sql() -> str:
    """Rounds of assignment and update, one after the other."""
    start = f"""
WITH good AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS (SELECT vec_id, label, list_transform(v, lambda x: floor({codebooks.SCALE} * x::DOUBLE)) AS v FROM good),
parts AS (SELECT vec_id, label, part, v[part * len(v) // {codebooks.PARTS} + 1:(part + 1) * len(v) // {codebooks.PARTS}] AS x FROM ints, (SELECT unnest(range({codebooks.PARTS})) AS part)),
book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM ints ORDER BY vec_id LIMIT {codebooks.ENTRIES}))"""
    near = """,
near{r} AS (SELECT vec_id, label, p.part, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 65536 + k) AS best
  FROM parts p JOIN book{r} b ON b.part = p.part GROUP BY ALL)"""
    update = """,
sums{r} AS (SELECT part, k, pos, sum(CAST(val AS BIGINT))::BIGINT AS s, count(*) AS n FROM (
  SELECT p.part, n.best % 65536 AS k, unnest(p.x) AS val, generate_subscripts(p.x, 1) AS pos FROM parts p JOIN near{r} n ON n.vec_id = p.vec_id AND n.part = p.part) GROUP BY ALL),
new{r} AS (SELECT part, k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM sums{r} GROUP BY ALL),
book{s} AS (SELECT b.part, b.k, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN new{r} n ON n.part = b.part AND n.k = b.k)"""
    rounds = "".join(near.format(r=r) + update.format(r=r, s=r + 1) for r in range(codebooks.ROUNDS)) + near.format(r=codebooks.ROUNDS)
    end = f""",
found AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best % 65536)), '' ORDER BY part) AS code, sum(best // 65536)::BIGINT AS error FROM near{codebooks.ROUNDS} GROUP BY ALL),
entries AS (SELECT part, k, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM book{codebooks.ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(CAST(x AS BIGINT)::VARCHAR, ',' ORDER BY part, k, pos)) FROM entries) AS codebooks_sha256
FROM found"""
    return start + rounds + end
