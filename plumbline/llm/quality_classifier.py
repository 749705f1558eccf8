"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Three levels, each a grouped aggregation over labelled documents:

* evidence: a document's shape (share of capitals, of symbols, of bars, of distinct words,
  of repeated neighbours, length of words) falls into bins; each bin of each feature has a
  log likelihood ratio of good to bad, from smoothed counts of all labelled documents;
* host: a host's share of good documents, shrunk towards the global share with the strength
  that the spread of the hosts' shares shows (method of moments);
* path: the same, shrunk towards its host.

A document's log odds are its path's (for paths without labels its host's, then the global
one) plus its evidence. As the features overlap, the evidence is tempered by TEMPER. Kept at
a probability of KEEP or more (ties are kept). A labelled document's own label is taken out of
all counts that judge it, so its verdict is as if it had none.

Without a word (null and empty texts) a document is rejected. Null hosts and paths are groups
of their own. Labels that repeat a doc_id are averaged, a half counts as good; null ones are
left out. Rows that share a doc_id are judged one by one, each with that label. Without labels
all documents with a word are kept at even odds; an empty table gives an empty result. Long
texts take memory in proportion to the longest. Other columns, whatever their names, pass through kept_documents().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_hash, settle
from .kernel import Texts, blocks, per_text
from .quality_rules import CONTINUED, labelled, repeats_in_text

KEEP, TEMPER = 0.5, 0.7
FEW = 100_000  # hosts or paths that are broadcast, some ten MB
FEATURES = ["capitals", "symbols", "bars", "distinct", "repeated", "length"]
EDGES = {
    "capitals": [0.02, 0.06, 0.12, 0.3, 0.6],
    "symbols": [0.002, 0.01, 0.03, 0.08],
    "bars": [0.002, 0.01, 0.03, 0.08],
    "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeated": [0.01, 0.05, 0.2, 0.5],
    "length": [3.0, 4.0, 5.0, 6.0, 8.0, 12.0],
}
CAPITAL, MARKS, BAR = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[65:91], MARKS[list(b"#*$%&<>!@^~{}[]\\")], BAR[ord("|")] = True, True, True


def shape(texts: Texts) -> np.ndarray:
    """A row of FEATURES for each text, NaN where it has no word."""
    words, at = texts.hashes(0), texts.offsets
    doc = texts.text_of()
    n = texts.counts
    chars = per_text(~(texts.space | CONTINUED[texts.data]), at)
    _, later = repeats_in_text(words, doc)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    # in long texts words repeat by nature: distinct words are judged against a square root's growth beyond 400 words
    natural = np.where(n > 400, np.sqrt(400 / np.maximum(n, 1)), 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.stack([
            per_text(CAPITAL[texts.data], at) / chars,
            per_text(MARKS[texts.data], at) / chars,
            per_text(BAR[texts.data], at) / chars,
            np.minimum(1, (n - per_text(later, texts.ptr)) / n / natural),
            per_text(same, texts.ptr) / n,
            chars / n,
        ])
    return np.where(n > 0, out, np.nan)


def evidence(known: DataFrame) -> DataFrame:
    """feature, bin, good, bad from rows of (bins, y); at most a row for each bin of each feature."""
    each = known.where("bins is not null").select("y", F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy("feature", "bin").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))


def strength(mean: Column) -> Column:
    """Prior weight of a group's parent, in documents: mean (1 - mean) over the spread of the groups' shares beyond chance, less one; from 1 to 1000."""
    between = F.var_pop("share") - F.avg(mean * (1 - mean) / F.col("n"))
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.avg(mean * (1 - mean)) / F.greatest(between, F.lit(1e-6)) - 1))


def held(p: Column) -> Column:
    return F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), p))


@dataclass
class Priors:
    """Counts of good and all labelled documents, by host and by (host, path), and how strongly each level is shrunk to the one above."""

    good: int
    n: int
    hosts: DataFrame  # host, good, n
    paths: DataFrame  # host, path, good, n
    host_weight: float
    path_weight: float

    @property
    def mean(self) -> float:
        return (self.good + 1) / (self.n + 2)


def priors(known: DataFrame) -> Priors:
    """known: host, path, y."""
    paths = settle(known.groupBy("host", "path").agg(F.sum("y").alias("good"), F.count("*").alias("n")), "paths")
    hosts = settle(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    top = hosts.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    found = Priors(top["g"] or 0, top["n"] or 0, hosts, paths, 1.0, 1.0)
    share = (F.col("good") / F.col("n")).alias("share")
    found.host_weight = hosts.where("n > 1").select("n", share).agg(strength(F.lit(found.mean)).alias("m")).first()["m"] or 1.0
    p_host = held((F.col("good") + found.host_weight * found.mean) / (F.col("n") + found.host_weight)).alias("p_host")
    under = paths.select("host", "n", share).join(hosts.select(F.col("host").alias("h"), p_host), F.col("host").eqNullSafe(F.col("h")))
    found.path_weight = under.where("n > 1").agg(strength(F.col("p_host")).alias("m")).first()["m"] or 1.0
    return found


def shapes(docs: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, host, path and bins (a number for each feature, null without words) of each document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_hash(F.col(text)).alias("row"), host.alias("host"), path.alias("path"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 4):
            x = shape(Texts(b.column(4)))
            bins = np.stack([np.digitize(np.nan_to_num(x[k]), EDGES[f]) for k, f in enumerate(FEATURES)], axis=1).astype(np.int32)
            some = ~np.isnan(x[0])
            offsets = pa.array(np.append(0, np.cumsum(some) * len(FEATURES)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(bins[some].reshape(-1)), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], names=["doc_id", "row", "host", "path", "bins"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:4], T.StructField("bins", T.ArrayType(T.IntegerType()))]))


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast, if it has no more than FEW rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df


@dataclass
class Model:
    priors: Priors
    bins: list[list[tuple[int, int]]]  # good and bad labelled documents by feature and bin

    def score(self, rows: DataFrame, keep: float = KEEP) -> DataFrame:
        """rows (_host, _path, _y, bins and others) with evidence, prior_odds, p_good, kept. _y: the row's own label, null without one."""
        p = self.priors
        hosts = _small(p.hosts.select(F.col("host").alias("_h"), F.col("good").alias("_hg"), F.col("n").alias("_hn")))
        paths = _small(p.paths.select(F.col("host").alias("_ph"), F.col("path").alias("_pp"), F.col("good").alias("_pg"), F.col("n").alias("_pn")))
        rows = rows.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left")
        rows = rows.join(paths, F.col("_host").eqNullSafe(F.col("_ph")) & F.col("_path").eqNullSafe(F.col("_pp")), "left")
        own, one = F.coalesce(F.col("_y"), F.lit(0)), F.when(F.col("_y").isNotNull(), 1).otherwise(0)
        mean = (p.good + 1 - own) / (p.n + 2 - one)
        p_host = F.when(F.col("_hn").isNull(), mean).otherwise((F.col("_hg") - own + p.host_weight * mean) / (F.col("_hn") - one + p.host_weight))
        rows = rows.withColumn("_p", held(p_host))
        p_path = F.when(F.col("_pn").isNull(), F.col("_p")).otherwise((F.col("_pg") - own + p.path_weight * F.col("_p")) / (F.col("_pn") - one + p.path_weight))
        rows = rows.withColumn("_p", held(p_path)).withColumn("prior_odds", F.log(F.col("_p") / (1 - F.col("_p"))))
        rows = rows.withColumn("evidence", F.when(F.col("bins").isNotNull(), self.ratios(own, one) * TEMPER))
        good = F.when(F.col("bins").isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.col("prior_odds") + F.col("evidence")))))
        rows = rows.drop("_h", "_hg", "_hn", "_ph", "_pp", "_pg", "_pn", "_p")
        return rows.withColumn("p_good", good).withColumn("kept", F.col("p_good") >= keep)

    def ratios(self, own: Column, one: Column) -> Column:
        """Sum over the features of the log likelihood ratios of a row's bins; a bin that no other labelled document has says nothing."""
        total = F.lit(0.0)
        for k, bins in enumerate(self.bins):
            at = F.get("bins", F.lit(k))
            good = F.get(F.array(*[F.lit(g) for g, _ in bins]), at) - own
            bad = F.get(F.array(*[F.lit(b) for _, b in bins]), at) - (one - own)
            some = sum(g + b > 0 for g, b in bins)
            all_good, all_bad = sum(g for g, _ in bins) - own, sum(b for _, b in bins) - (one - own)
            ratio = F.log(((good + 1) / (all_good + some + 1)) / ((bad + 1) / (all_bad + some + 1)))
            total = total + F.when(good + bad > 0, ratio).otherwise(F.lit(0.0))
        return total


def fit(found: DataFrame) -> Model:
    """found: host, path, bins, y (null without a label)."""
    known = found.where("y is not null").select("y", "host", "path", "bins")
    counts = {(r["feature"], r["bin"]): (r["good"], r["bad"]) for r in evidence(known).collect()}  # a few dozen rows
    return Model(priors(known), [[counts.get((k, b), (0, 0)) for b in range(len(EDGES[f]) + 1)] for k, f in enumerate(FEATURES)])


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str, text: str, keep: float) -> DataFrame:
    """doc_id, row, _host, _path, evidence, prior_odds, p_good, kept: a row for each of docs; texts are read once, and only small rows joined."""
    found = settle(shapes(docs, host, path, doc_id, text).join(labelled(labels), "doc_id", "left"), "judged")
    rows = found.select("doc_id", "row", F.col("host").alias("_host"), F.col("path").alias("_path"), "bins", F.col("y").alias("_y"))
    return fit(found).score(rows, keep)


def report(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, prior_odds, p_good, kept: a row for each of docs. host, path: expressions over docs' columns."""
    return judged(docs, labels, host, path, doc_id, text, keep).select("doc_id", "evidence", "prior_odds", "p_good", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs that the classifier keeps, unchanged."""
    # equal keys have equal texts, hosts, paths and labels, and so one verdict
    verdicts = judged(docs, labels, host, path, doc_id, text, keep).where("kept").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(("doc_id", "row", "_host", "_path"))]).distinct()
    rows = docs.select(F.struct("*").alias("_d"), F.col(doc_id).alias("_i"), row_hash(F.col(text)).alias("_r"), host.alias("_h"), path.alias("_p"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(("_i", "_r", "_h", "_p"))]
    return rows.join(verdicts, same, "left_semi").select("_d.*")
