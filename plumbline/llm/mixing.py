"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A total budget of tokens goes down the tree. At each node the children's weights divide its
budget, but none gets more than its subtree holds (its tokens times MAX_EPOCHS). What a child
can't use goes to its siblings by weight first; only what the whole family can't use is left
to the parent's siblings, as a parent never gets more than its subtree holds. This water-filling
is exact in one pass a level: children in order of capacity over weight are full as long as
all before them full, and the rest at that level, fit the budget.

A leaf's tokens come in epochs. An epoch orders the leaf's documents by a hash of (seed, epoch,
document); whole epochs are taken as long as they fit, of the last one a prefix of tokens: the
document at the border is taken in part (``tokens_taken`` says how much). The prefix is found
by sums over hash ranges first, so that rows are ordered only within the range of the border
and no leaf is ever in one task.

All is DataFrame operations. Nulls in domain, language or source are groups of their own;
null and empty texts have no tokens and are never taken. Rows that share a doc_id are told
apart by a hash of their text; of fully equal rows as many are taken as the prefix has room
for. A node without a weight has weight 1; weights of zero or
less get nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

LEVELS = ["domain", "language", "source"]
DIGITS = 3  # hexadecimal digits that name a hash range: 4096 ranges a leaf
SEED = 20_240_601


def words(text: Column) -> Column:
    """Tokens as words: runs of other than \\x20\\x09-\\x0D."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("bigint")


def divided(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """nodes (budget of their parent, capacity, weight) with ``share``: what each gets of it."""
    ratio = F.col("capacity") / F.col("weight")
    w = Window.partitionBy(*parent).orderBy(ratio, *order)
    family = Window.partitionBy(*parent)
    nodes = nodes.withColumn("_used", F.sum("capacity").over(w)).withColumn("_left", F.sum("weight").over(family) - F.sum("weight").over(w))
    full = F.col("_used") + ratio * F.col("_left") <= F.col("budget")
    nodes = nodes.withColumn("_full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(family), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family)
    share = F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), rest * F.col("weight") / open_weight))
    return nodes.withColumn("share", F.greatest(share, F.lit(0.0))).drop("_used", "_left", "_full", "budget")


def plan(leaves: DataFrame, budget: Column | float, weights: DataFrame | None = None, max_epochs: int = 4) -> DataFrame:
    """domain, language, source, tokens, share from leaves (domain, language, source, tokens).

    budget: tokens in all, or an expression over ``all_tokens``. weights: (level, name, weight),
    for the nodes of a level by name. Windows run over nodes, never over documents.
    """
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    leaves = leaves.withColumn("all_tokens", F.lit(leaves.agg(F.sum("tokens")).first()[0] or 0).cast("bigint"))
    keys: list[str] = []
    out = leaves.withColumn("budget", F.least(budget if isinstance(budget, Column) else F.lit(float(budget)), F.col("all_tokens") * F.lit(float(max_epochs))).cast("double"))
    for level in LEVELS:
        parent, keys = list(keys), [*keys, level]
        node = out.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("budget"))
        if weights is None:
            node = node.withColumn("weight", F.lit(1.0))
        else:
            own = weights.where(F.col("level") == level).select(F.col("name").alias("_name"), F.col("weight").cast("double"))
            node = node.join(own, node[level].eqNullSafe(F.col("_name")), "left").drop("_name").fillna(1.0, ["weight"]).where("weight > 0")
        node = divided(node, parent or [F.lit(0)], [level]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("share").alias("budget"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # a level's budgets are written down: else every level would plan all levels above it twice over
        out = settle(out.drop("budget").join(node, same).drop(*[f"_{k}" for k in keys]), level)
    return out.select(*LEVELS, "tokens", F.floor("budget").cast("bigint").alias("share"))


def order_hash(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("row")))


def mixed(sizes: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, row, domain, language, source, epoch, tokens, tokens_taken of what is taken.

    sizes: doc_id, row, domain, language, source, tokens of the documents; leaves: as plan() gives.
    """
    leaf = leaves.where("share > 0").select(
        *[F.col(k).alias(f"_{k}") for k in LEVELS],
        F.expr("cast(share div tokens as int)").alias("whole"), F.expr("share % tokens").alias("part"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS]
    docs = sizes.where("tokens > 0").join(leaf, same).drop(*[f"_{k}" for k in LEVELS])
    whole = docs.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("tokens_taken", F.col("tokens"))
    last = docs.where("part > 0").withColumn("epoch", F.col("whole")).withColumn("h", order_hash(seed, F.col("epoch"))).withColumn("at", F.substring("h", 1, DIGITS))
    sums = settle(last.groupBy(*LEVELS, "part", "at").agg(F.sum("tokens").alias("n")), "sums")
    # a leaf's ranges are summed up within sixteen groups of them, and the groups among themselves
    group = F.substring("at", 1, 1)
    groups = sums.groupBy(*LEVELS, group.alias("_g")).agg(F.sum("n").alias("_n")).withColumn("_base", F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_g")) - F.col("_n"))
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "_g", "_base")
    within = F.sum("n").over(Window.partitionBy(*LEVELS, group).orderBy("at")) - F.col("n")
    before = sums.withColumn("_w", within).join(groups, [*same, group == F.col("_g")]).withColumn("before", F.col("_w") + F.col("_base")).where("before < part").drop("_w", "_g", "_base", *[f"_{k}" for k in LEVELS])
    ranges = before.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.col("at").alias("_at"), "before", (F.col("before") + F.col("n") <= F.col("part")).alias("inside"))
    met = last.join(ranges, [*same, F.col("at") == F.col("_at")]).drop(*[f"_{k}" for k in LEVELS], "_at")
    inside = met.where("inside").withColumn("tokens_taken", F.col("tokens"))
    run = Window.partitionBy(*LEVELS, "at").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = met.where("not inside").withColumn("to", F.col("before") + F.sum("tokens").over(run)).withColumn("from", F.col("to") - F.col("tokens"))
    border = border.where("from < part").withColumn("tokens_taken", F.least(F.col("tokens"), F.col("part") - F.col("from")))
    names = ["doc_id", "row", *LEVELS, "epoch", "tokens", "tokens_taken"]
    return whole.select(names).unionByName(inside.select(names)).unionByName(border.select(names))


def sizes_of(docs: DataFrame, domain: Column, language: Column, source: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("row"), domain.alias("domain"), language.alias("language"), source.alias("source"), words(F.col(text)).alias("tokens"))


def leaves_of(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))


def chosen(docs: DataFrame, taken: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that mixed() took from, once for each epoch that took them; texts and columns unchanged.

    Of equal rows as many stay as were taken.
    """
    times = taken.groupBy("doc_id", "row").agg(F.count("*").alias("_n")).select(F.col("doc_id").alias("_i"), F.col("row").alias("_r"), "_n")
    marked = docs.select(F.struct("*").alias("_d"), F.col(doc_id).alias("_i"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_r"))
    # equal rows meet in one group and are given out anew, each row once for every time it was taken
    one = marked.where(F.col("_i").isNotNull()).join(times, ["_i", "_r"]).groupBy("_i", "_r").agg(F.first("_d").alias("_d"), F.first("_n").alias("_n"))
    nameless = marked.where(F.col("_i").isNull()).join(times.where("_i is null").select("_r", "_n"), "_r").groupBy("_r").agg(F.first("_d").alias("_d"), F.first("_n").alias("_n"))
    both = one.select("_d", "_n").union(nameless.select("_d", "_n"))
    return both.withColumn("_e", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_d.*")
