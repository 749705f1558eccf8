"""Typed graphs: edge builders, relational queries, lineage, traversal and topology."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import TITLE_STOP, letter_ids, node_id, terms
from ..session import settle, small

WORDS = 8  # masks of 64 starts in a row of a search from many nodes
LEVELS = 32  # after so many levels of a walk what it has is written: plans stay short
SEMANTIC = ["implements", "supersedes", "similar_topic", "shortcut"]


# -- builders --------------------------------------------------------------------------------


def edge_rows(df: DataFrame, source: Column, target: Column, kind: str, weight: Column | float = 1.0, directed: bool = True, evidence: str | None = None) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("relationship_type"), w.cast("double").alias("weight"), F.lit(directed).alias("directed"), F.lit(evidence).cast("string").alias("evidence"))


def document_key(plan: Column, filename: Column) -> Column:
    return node_id("doc", F.concat_ws("/", plan, filename))


def catalog_nodes(catalog: DataFrame, plans: DataFrame) -> DataFrame:
    """id, kind, plan_id, label from a catalog and plans (plan_id, name)."""
    p = plans.select(node_id("plan", F.col("plan_id")).alias("id"), F.lit("plan").alias("kind"), "plan_id", F.col("name").alias("label"))
    d = catalog.select(document_key(F.col("plan_id"), F.col("filename")).alias("id"), F.lit("document").alias("kind"), "plan_id", F.col("title").alias("label"))
    w = catalog.where("department <> ''").select(F.concat_ws(":", F.lit("dept"), "plan_id", "department").alias("id"), F.lit("department").alias("kind"), "plan_id", F.col("department").alias("label")).distinct()
    return p.unionByName(d).unionByName(w)


def structural_edges(catalog: DataFrame) -> DataFrame:
    doc = document_key(F.col("plan_id"), F.col("filename"))
    by = edge_rows(catalog, doc, node_id("plan", F.col("plan_id")), "published_by")
    return by.unionByName(edge_rows(catalog.where("department <> ''"), doc, F.concat_ws(":", F.lit("dept"), "plan_id", "department"), "owned_by"))


def supersede_edges(catalog: DataFrame) -> DataFrame:
    """From letters' titles, newer to older: ids after "supersedes", and this one under those after "superseded by"."""
    letters = catalog.where("doc_kind = 'apl'").withColumn("self", F.coalesce(F.get(letter_ids(F.col("policy_number")), 0), F.get(letter_ids(F.col("title")), 0))).where("self is not null")
    place = lambda p: F.coalesce(F.regexp_instr("title", F.lit(p)), F.lit(0))
    t = letters.withColumn("by", place(r"(?i)supersede[ds]?\s+by")).withColumn("of", place(r"(?i)supersedes"))
    tail = F.col("title").substr(F.col("by"), F.length("title"))
    older = F.col("title").substr(F.col("of"), F.when(F.col("by") > F.col("of"), F.col("by") - F.col("of")).otherwise(F.length("title")))
    newer_by = t.where("by > 0").select("self", F.explode(letter_ids(tail)).alias("other")).where("other <> self")
    newer_of = t.where("of > 0 and of <> by").select("self", F.explode(letter_ids(older)).alias("other")).where("other <> self")
    make = lambda df, a, b: edge_rows(df, node_id("apl", F.col(a)), node_id("apl", F.col(b)), "supersedes", 3.0, True, "title")
    return make(newer_by, "other", "self").unionByName(make(newer_of, "self", "other"))


def mined_edges(chunks: DataFrame, state_plan: str = "state", prefilter: str | None = None) -> DataFrame:
    """Documents to the letters their chunks name; weight: how many chunks do. chunks: plan_id, filename, text."""
    from ..functions.text import PREFILTER

    hits = chunks.where((F.col("plan_id") != state_plan) & F.col("text").rlike(prefilter or PREFILTER))
    named = hits.select(document_key(F.col("plan_id"), F.col("filename")).alias("source"), F.explode(letter_ids(F.col("text"))).alias("letter"))
    counts = named.groupBy("source", node_id("apl", F.col("letter")).alias("target")).agg(F.count("*").alias("n"))
    return edge_rows(counts, F.col("source"), F.col("target"), "implements", F.col("n"), True, "text")


def shared_terms(docs: DataFrame, least: int = 2, band: tuple[int, int] = (2, 60), stop: list[str] | None = None) -> DataFrame:
    """a, b, shared: pairs of different plans that share terms; docs: id, plan_id, title.

    Terms in too few or too many documents are left out, which also bounds what each can join.
    """
    has = docs.select("id", "plan_id", F.explode(terms(F.col("title"), 3, TITLE_STOP if stop is None else stop)).alias("term"))
    kept = has.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(*band)).select("term")
    has = has.join(kept, "term")
    a, b = has.alias("a"), has.alias("b")
    pairs = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.plan_id") != F.col("b.plan_id")))
    return pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def capped(pairs: DataFrame, cap: int = 6, weight: str = "shared") -> DataFrame:
    """Greedy choice of pairs (a, b) by weight, at most ``cap`` at each end.

    Rounds take every pair that is within the free places of both its ends, in the order
    (weight desc, a, b), until none is left; under a total order this equals the sequential
    greedy choice. Each round is two windows over the ends' pairs.
    """
    left, taken = settle(pairs.select("a", "b", weight)), None
    while True:
        used = None
        if taken is not None:
            used = taken.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("u"))
        ends = left.select("a", "b", weight, F.explode(F.array("a", "b")).alias("n"))
        ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc(weight), "a", "b")))
        if used is not None:
            ranked = ranked.join(used, "n", "left").withColumn("free", cap - F.coalesce("u", F.lit(0)))
        else:
            ranked = ranked.withColumn("free", F.lit(cap))
        status = ranked.groupBy("a", "b", weight).agg(F.min((F.col("r") <= F.col("free")).cast("int")).alias("ok"), F.min("free").alias("free"))
        status = settle(status.where("free > 0"))
        new = status.where("ok = 1").select("a", "b", weight)
        taken = settle(new if taken is None else taken.unionByName(new))
        left = status.where("ok = 0").select("a", "b", weight)
        if left.isEmpty():
            return taken


def assembled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes once each with every referenced letter minted, edges once each between known nodes, and how many edges dangled."""
    minted = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id like 'apl:%'").distinct().select("id", F.lit("apl").alias("kind"), F.lit("state").alias("plan_id"), F.regexp_replace("id", "^apl:", "APL ").alias("label"))
    first = Window.partitionBy("id").orderBy("from", "label")
    all_nodes = nodes.withColumn("from", F.lit(0)).unionByName(minted.withColumn("from", F.lit(1))).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "from")
    known = all_nodes.select("id")
    whole = edges.join(known, edges["source"] == known["id"], "left_semi").join(known, edges["target"] == known["id"], "left_semi")
    dangling = edges.count() - whole.count()
    once = Window.partitionBy("source", "target", "relationship_type").orderBy(F.desc("weight"))
    return all_nodes, whole.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r"), dangling


# -- relational queries ----------------------------------------------------------------------


def adoption(nodes: DataFrame, edges: DataFrame, letter: str | None = None) -> DataFrame:
    """plan, documents: how many documents of each plan implement the letter (any, if none is named); plans without one are the finding."""
    impl = edges.where("relationship_type = 'implements'")
    if letter is not None:
        impl = impl.where(F.col("target") == letter)
    docs = nodes.where("kind = 'document'").select("id", "plan_id")
    n = impl.select("source").distinct().join(docs, F.col("source") == F.col("id")).groupBy("plan_id").agg(F.count("*").alias("n"))
    plans = nodes.where("kind = 'plan'").select("plan_id", F.col("label").alias("plan"))
    return plans.join(n, "plan_id", "left").select("plan", F.coalesce("n", F.lit(0)).alias("documents")).orderBy(F.desc("documents"), "plan")


def reach(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> DataFrame:
    """letter, plans, documents: how widely each letter is implemented, widest first."""
    docs = nodes.where("kind = 'document'").select(F.col("id").alias("source"), "plan_id")
    out = edges.where("relationship_type = 'implements'").join(docs, "source").groupBy(F.col("target").alias("letter")).agg(F.countDistinct("plan_id").alias("plans"), F.count("*").alias("documents"))
    return out.orderBy(F.desc("plans"), F.desc("documents"), "letter").limit(top) if top else out


def stale_citations(edges: DataFrame, nodes: DataFrame | None = None, plans: list[str] | None = None) -> DataFrame:
    """document, cited, superseded_by: a row for each superseder of a cited letter."""
    impl = edges.where("relationship_type = 'implements'").select(F.col("source").alias("document"), F.col("target").alias("cited"))
    sup = edges.where("relationship_type = 'supersedes'").select(F.col("target").alias("cited"), F.col("source").alias("superseded_by"))
    out = impl.join(sup, "cited")
    if plans is not None:
        out = out.join(nodes.where(F.col("plan_id").isin(plans)).select(F.col("id").alias("document")), "document", "left_semi")
    return out.select("document", "cited", "superseded_by")


def cross_plan(pairs: DataFrame, nodes: DataFrame, text: str | None = None, top: int | None = None) -> DataFrame:
    """Pairs (a, b, shared) with both labels, of different plans; text: a substring of either label, % and _ are wildcards."""
    n = nodes.select("id", "plan_id", "label")
    out = pairs.join(n.toDF("a", "plan_a", "label_a"), "a").join(n.toDF("b", "plan_b", "label_b"), "b").where("plan_a <> plan_b")
    if text:
        pattern = f"%{text.lower()}%"
        out = out.where(F.lower("label_a").like(pattern) | F.lower("label_b").like(pattern))
    return out.orderBy(F.desc("shared"), "a", "b").limit(top) if top else out


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    return a.unionByName(edges.groupBy(F.col("relationship_type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge")))


def plan_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, documents, implementing: documents of each plan and those that implement any letter."""
    has = edges.where("relationship_type = 'implements'").select(F.col("source").alias("id")).distinct().withColumn("has", F.lit(1))
    return nodes.where("kind = 'document'").join(has, "id", "left").groupBy("plan_id").agg(F.count("*").alias("documents"), F.count("has").alias("implementing"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, top: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(top)


def first_match(left: DataFrame, right: DataFrame, key: str, order: list, columns: list[str], default: Column | None = None) -> DataFrame:
    """left with columns of the first of right's rows (by ``order``) that has its key; without one they are null, or ``default``."""
    pick = right.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_m"))
    value = lambda c: F.col(f"_m.{c}") if default is None else F.coalesce(F.col(f"_m.{c}"), default)
    return left.join(pick, key, "left").select(*left.columns, *[value(c).alias(c) for c in columns])


# -- lineage ---------------------------------------------------------------------------------


def lineage(supersedes: DataFrame, seeds: DataFrame, depth: int = 12, down: bool = True) -> DataFrame:
    """start, node, depth: letters reached from each seed (id), each at every depth it is reached at; down: to older ones."""
    a, b = ("source", "target") if down else ("target", "source")
    step = supersedes.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    level = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        level = level.join(step, "node").select("start", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        if k % 4 == 0 and k < depth:  # lineage is cut every fourth level, and the walk ends where a level is empty
            level = settle(level)
            if level.isEmpty():
                break
        out = out.unionByName(level)
    return out


def longest_chains(supersedes: DataFrame) -> DataFrame:
    """head, length, path: from each letter that none supersedes its longest way to older ones, the smallest path of equals.

    Runs of letters without a fork or a meeting are put together first, so levels are counted in runs: of the ways of one more
    run each run keeps the longest, the smallest of equals, which is made of that of a run below it. So a level has a row a run at most. In
    a cycle a way ends where it would meet itself.
    """
    step = settle(supersedes.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    heads = step.select("node").distinct().join(step.select(F.col("next").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("head"))
    level, over = _runs(step)
    of_heads = lambda: level.join(heads, F.col("run") == F.col("head"), "left_semi").select(F.col("run").alias("head"), "path")
    best, several = of_heads(), not over.isEmpty()
    for k in count(1) if several else ():
        below, own = level.select(F.col("run").alias("next"), F.col("path").alias("rest")), level if k == 1 else own
        grown = over.join(below, "next").where(~F.array_contains("rest", F.col("run"))).join(own, "run").select("run", F.concat("path", "rest").alias("path"))
        level = settle(grown.groupBy("run").agg(F.min(F.struct((-F.size("path")).alias("n"), F.array_join("path", ">").alias("s"), "path")).alias("m")).select("run", "m.path"))
        if level.isEmpty():
            break
        best = best.unionByName(of_heads())
        if k % LEVELS == 0:
            best = settle(_longest(best))
    return (_longest(best) if several else best).select("head", F.size("path").alias("length"), F.array_join("path", ">").alias("path"))


def _runs(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """run, path: letters in a row without a fork or a meeting, by the first of them; and the steps (run, next) from run to run. step: node, next.

    Each letter looks 1, 2, 4 ... letters up until it sees the first of its run. A round in which none gets there leaves those of
    runs without a first, cycles that nothing leads to, which no way from a head enters.
    """
    ways = step.where("node <> next")
    down = ways.groupBy("node").agg(F.count("*").alias("n"), F.min("next").alias("next")).where("n = 1").select("node", "next")
    up = ways.groupBy("next").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("node", "next")
    inner = settle(down.join(up, ["node", "next"]))
    first = ways.select(F.explode(F.array("node", "next")).alias("letter")).distinct().join(inner.select(F.col("next").alias("letter")), "letter", "left_anti")
    there = [settle(first.select("letter", F.col("letter").alias("up"), F.lit(0).cast("bigint").alias("far")))]
    open_, left = inner.select(F.col("next").alias("letter"), F.col("node").alias("up"), F.lit(1).cast("bigint").alias("far")), -1
    while True:
        seen = reduce(DataFrame.unionByName, there).withColumn("done", F.lit(True)).unionByName(open_.withColumn("done", F.lit(False)))
        further = seen.select(F.col("letter").alias("up"), F.col("up").alias("above"), F.col("far").alias("more"), "done")
        met = settle(open_.join(further, "up").select("letter", F.col("above").alias("up"), (F.col("far") + F.col("more")).alias("far"), "done"))
        there.append(met.where("done").drop("done"))
        open_ = met.where("not done").drop("done")
        now = open_.count()
        if now in (0, left):
            break
        left = now
    place = reduce(DataFrame.unionByName, there)
    path = F.transform(F.array_sort(F.collect_list(F.struct("far", "letter"))), lambda x: x["letter"])
    over = ways.join(inner, ["node", "next"], "left_anti").join(place.select(F.col("letter").alias("node"), F.col("up").alias("run")), "node").select("run", "next")
    return settle(place.groupBy(F.col("up").alias("run")).agg(path.alias("path"))), settle(over)


def _longest(paths: DataFrame) -> DataFrame:
    order = Window.partitionBy("head").orderBy(F.desc(F.size("path")), F.array_join("path", ">"))
    return paths.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def latest_superseder(supersedes: DataFrame) -> DataFrame:
    """letter, by: one superseder of each letter, the largest name of several."""
    return supersedes.groupBy(F.col("target").alias("letter")).agg(F.max("source").alias("by"))


def _jumps(sup: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables (letter, to) of 1, 2, 4 ... superseders further, and whether some lineages have no end.

    A jump that as many letters have as the one before it is had by letters on the way to a cycle alone: of a
    lineage with an end, some letter ends between the two. If the letters that it leads to are as many as before too, they are those on cycles.
    """
    jumps, had, reached = [sup.select("letter", F.col("by").alias("to"))], -1, -1
    while True:
        more = settle(jumps[-1].alias("a").join(jumps[-1].alias("b"), F.col("a.to") == F.col("b.letter")).select(F.col("a.letter").alias("letter"), F.col("b.to").alias("to")))
        have = more.count()
        if not have:
            return jumps, False
        jumps.append(more)
        if have == had:
            to = more.select("to").distinct().count()
            if to == reached:
                return jumps, True
            reached = to
        had = have


def _cycles(sup: DataFrame, far: DataFrame) -> DataFrame:
    """letter, root: the letters on cycles, which are what ``far`` leads to, and the smallest of each one's cycle."""
    on = settle(far.select(F.col("to").alias("letter")).distinct())
    jump = settle(on.join(sup, "letter").select("letter", F.col("by").alias("to"), F.least("letter", "by").alias("root")))
    while True:
        b = jump.select(F.col("letter").alias("to"), F.col("to").alias("further"), F.col("root").alias("least"))
        more = settle(jump.join(b, "to").select("letter", F.col("further").alias("to"), F.least("root", "least").alias("root"), (F.col("least") < F.col("root")).alias("new")))
        if not more.agg(F.max("new")).first()[0]:
            return more.select("letter", "root")
        jump = more.drop("new")


def _lifted(batches):
    """letter, to, far: how far each letter gets over the links (letter, by) in its partition, up to a million of them at a time. No cycles."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    def lifted(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(part).combine_chunks()
        letter, by = (pa.concat_arrays(rows.column(c).chunks) for c in (0, 1))
        own = np.arange(len(letter))
        up = pa.compute.index_in(by, value_set=letter).fill_null(-1).to_numpy().astype(np.int64)
        far, up = (up >= 0).astype(np.int64), np.where(up < 0, own, up)
        while True:
            further = up[up]
            if np.array_equal(further, up):
                break
            far, up = far + far[up], further
        return pa.RecordBatch.from_arrays([letter, by.take(pa.array(up)), pa.array(far + 1)], names=["letter", "to", "far"])

    part, n = [], 0
    for b in batches:
        part.append(b)
        n += b.num_rows
        if n >= 1_000_000:
            yield lifted(part)
            part, n = [], 0
    if n:
        yield lifted(part)


def _to_the_end(links: DataFrame) -> DataFrame:
    """letter, far: how many links (letter, by; no cycles) lead from each letter to its last superseder. Quick where a lineage's links lie together."""
    lifted = settle(links.select("letter", "by").mapInArrow(_lifted, "letter string, to string, far bigint"))
    hubs = settle(lifted.join(lifted.select(F.col("to").alias("letter")).distinct(), "letter", "left_semi"))  # where a partition's links end and others go on
    moved = not hubs.isEmpty()
    while moved:
        further = hubs.select(F.col("letter").alias("to"), F.col("to").alias("further"), F.col("far").alias("more"))
        met = settle(hubs.join(further, "to", "left").select("letter", F.coalesce("further", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("further").isNotNull().alias("moved")))
        hubs, moved = met.drop("moved"), not met.where("moved").isEmpty()
    return lifted.join(hubs.select(F.col("letter").alias("to"), F.col("far").alias("more")), "to", "left").select("letter", (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))


def citation_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """document, plan_id, letter, replaced, old_only: old_only if the document cites nothing later in the letter's lineage.

    Each letter has one superseder at most here. Most lineages are lines, in which a later letter is one nearer to the end: of a document's
    citations of a line those nearest to it are old_only, but for the end itself. All others go to ``_among_branches``.
    """
    links = edges.where("relationship_type = 'supersedes'")
    impl = edges.where("relationship_type = 'implements'").select(F.col("source").alias("document"), F.col("target").alias("letter"))
    impl = impl.join(nodes.where("kind = 'document'").select(F.col("id").alias("document"), "plan_id"), "document")
    of = settle(components(undirected(links, once=False)).withColumnRenamed("id", "letter"))
    line = F.coalesce("component", "letter").alias("line")  # a letter of no pair stands alone
    latest = links.where("source is not null and target is not null").groupBy(F.col("target").alias("letter")).agg(F.max("source").alias("by"), (F.min("source") < F.max("source")).alias("several"))
    sup = settle(latest.join(of, "letter", "left").select("letter", "by", "several", line).orderBy("line", "letter"))
    forks = sup.groupBy("by").agg(F.count("*").alias("n"), F.first("line").alias("line")).where("n > 1").select("line")
    ends = sup.select(F.col("by").alias("letter"), "line").join(sup.select("letter"), "letter", "left_anti").select("line")
    odd = settle(sup.where("several").select("line").union(forks).union(sup.select("line").join(ends, "line", "left_anti")).distinct())
    cited = settle(impl.join(of, "letter", "left").select("document", "plan_id", "letter", line))
    place = _to_the_end(sup.join(odd, "line", "left_anti"))
    far = F.min(F.coalesce("far", F.lit(0))).over(Window.partitionBy("document", "line"))
    plain = cited.join(odd, "line", "left_anti").join(place, "letter", "left").withColumn("old_only", F.col("far").isNotNull() & (F.coalesce("far", F.lit(0)) == far))
    found = plain.select("document", "plan_id", "letter", F.col("far").isNotNull().alias("replaced"), "old_only")
    if odd.isEmpty():
        return found
    others = (df.join(odd, "line", "left_semi").drop("line", "several") for df in (cited, sup))
    return found.unionByName(_among_branches(*map(settle, others)))


def _among_branches(impl: DataFrame, sup: DataFrame) -> DataFrame:
    """citation_status() of impl (document, plan_id, letter) where lineages (sup: letter, by; settled) may meet or be cycles.

    Lineages are trees towards their latest letters, or towards a cycle, whose letters are all later than each other and themselves: a cycle
    stands for one letter in the trees, and its letters are never old_only. Tables of jumps over 1, 2, 4 ... superseders, a row a letter each, give every
    letter's last one and its distance; whether one citation of a document is later than another
    is then tested for those pairs alone, by as many jumps as their distances differ by.
    """
    jumps, endless = _jumps(sup)
    impl = impl.withColumn("root", F.lit(None).cast("string"))
    if endless:
        on = settle(_cycles(sup, jumps[-1]))
        impl = impl.drop("root").join(on, "letter", "left")
        tree = sup.join(on.select("letter"), "letter", "left_anti").join(on.select(F.col("letter").alias("by"), "root"), "by", "left")
        jumps, _ = _jumps(settle(tree.select("letter", F.coalesce("root", "by").alias("by"))))
    impl = settle(impl.withColumn("node", F.coalesce("root", "letter")))
    place = impl.select("node").distinct().withColumn("last", F.col("node")).withColumn("far", F.lit(0).cast("bigint"))
    for k in reversed(range(len(jumps))):
        j = jumps[k].select(F.col("letter").alias("last"), "to")
        place = place.join(j, "last", "left").select("node", F.coalesce("to", "last").alias("last"), (F.col("far") + F.when(F.col("to").isNotNull(), 2**k).otherwise(0)).alias("far"))
    cited = settle(impl.join(place, "node").join(sup, "letter", "left"))
    a, b = cited.select("document", "letter", "last", "far", "node"), cited.select("document", "last", F.col("node").alias("newer"), F.col("far").alias("nearer")).distinct()
    pairs = a.join(b, ["document", "last"]).where("nearer < far").select("document", "letter", "newer", (F.col("far") - F.col("nearer")).alias("steps"), F.col("node").alias("at"))
    for k, jump in enumerate(jumps):
        j = jump.select(F.col("letter").alias("at"), "to")
        pairs = pairs.join(j, "at", "left").withColumn("at", F.when(F.col("steps").bitwiseAND(2**k) > 0, F.col("to")).otherwise(F.col("at"))).drop("to")
    met = pairs.where("at = newer").select("document", "letter").distinct().withColumn("met", F.lit(True))
    old = F.col("by").isNotNull() & F.col("met").isNull() & F.col("root").isNull()
    return cited.join(met, ["document", "letter"], "left").select("document", "plan_id", "letter", F.col("by").isNotNull().alias("replaced"), old.alias("old_only"))


# -- traversal and topology ------------------------------------------------------------------


def undirected(edges: DataFrame, types: list[str] | None = None, once: bool = True) -> DataFrame:
    """a < b, without loops. once: each once, else as often as it comes and where it comes, unshuffled."""
    e = edges if types is None else edges.where(F.col("relationship_type").isin(types))
    e = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b")
    return e.distinct() if once else e


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def distances(pairs: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """start, id, hops: of all nodes within ``hops`` of each start, or all it reaches. seeds: start, id."""
    step = settle(both_ways(pairs))
    seen = seeds.select("start", "id", F.lit(0).alias("hops"))
    front = seen
    for k in count(1) if hops is None else range(1, hops + 1):
        new = front.join(step, front["id"] == step["a"]).select("start", F.col("b").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = settle(new.withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % LEVELS == 0:
            seen = settle(seen)
    return seen


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2, types: list[str] | None = None, most: int | None = 40) -> DataFrame:
    """id, kind, hops of nodes around any of the seeds (id); kinds by the id's prefix."""
    found = distances(undirected(edges, types or SEMANTIC), seeds.select(F.lit(0).alias("start"), "id").distinct(), hops).where("hops > 0")
    out = found.select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("kind"), "hops")
    return out.orderBy("hops", "id").limit(most) if most else out


def _forest(batches):
    """Within each partition, up to a million links at a time: a link from every node to the smallest it reaches there."""
    import numpy as np
    import pyarrow as pa

    def thinned(u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
        names = pa.chunked_array([*u.chunks, *v.chunks]).unique().sort()  # numbers in the order of the names
        at = lambda x: pa.compute.index_in(x.combine_chunks(), value_set=names).to_numpy()
        a, b, label = at(u), at(v), np.arange(len(names))
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if np.array_equal(before, label):
                break
        far = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(far)), names.take(pa.array(label[far]))], names=["u", "v"])

    import pyarrow.compute  # noqa: F401

    u, v, n = [], [], 0
    for b in batches:
        u.append(b.column(0))
        v.append(b.column(1))
        n += b.num_rows
        if n >= 1_000_000:
            star = thinned(pa.chunked_array(u), pa.chunked_array(v))
            u, v, n = [star.column(0)], [star.column(1)], star.num_rows
            if n >= 500_000:
                yield star
                u, v, n = [], [], 0
    if n:
        yield thinned(pa.chunked_array(u), pa.chunked_array(v))


def components(pairs: DataFrame) -> DataFrame:
    """id, component: the smallest id each node reaches. Alternating large and small stars until all are stars.

    What lies together in a partition is put together there first, so pairs are best given as they come, repeated or not.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    links = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    links = settle(links.mapInArrow(_forest, f"u {kind}, v {kind}").distinct())
    while not _are_stars(links):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether each node of links (u, v, once each, u > v) has one smaller node, or larger ones only."""
    one, none = F.lit(1), F.lit(0)
    ends = links.select(F.col("u").alias("id"), one.alias("up"), none.alias("down")).union(links.select("v", none, one))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def reachable_share(found: DataFrame) -> DataFrame:
    """components, largest, reach: share of ordered pairs of nodes that reach each other."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p"), F.sum("n").alias("all"))
    return total.select("components", "largest", (F.col("p").cast("double") / (F.col("all") * (F.col("all") - 1))).alias("reach"))


def clustering(pairs: DataFrame) -> DataFrame:
    """triangles, triples, clustering = 3 triangles / triples.

    Pairs point from the end of lower degree to the higher, so that no node, however hot, has
    more than the square root of twice the pairs to look among.
    """
    d = both_ways(pairs).groupBy("a").agg(F.count("*").alias("d"))
    rank = pairs.join(d.select(F.col("a"), F.col("d").alias("da")), "a").join(d.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    lower = F.struct("da", "a") < F.struct("db", "b")
    out = settle(rank.select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = out.alias("p").join(out.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    tri = wedge.join(pairs, ["a", "b"]).agg(F.count("*").alias("triangles"))
    triples = d.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("bigint").alias("triples"))
    return tri.crossJoin(triples).select("triangles", "triples", (3.0 * F.col("triangles") / F.nullif("triples", F.lit(0))).alias("clustering"))


def reached(pairs: DataFrame, starts: DataFrame, hops: int | None = None) -> Iterator[tuple[int, DataFrame, int]]:
    """For 1, 2, 3 ... hops the nodes that starts (start, chunk, word, bit) reach first there, and how many pairs these are. pairs: a settled table.

    64 starts are one bit mask and WORDS masks a row (id, chunk, f0, f1, ...), so that a search from all n nodes of a component keeps n * n / 64
    words; a level is one shuffle, in which masks that meet at a node are joined by OR before they travel.
    """
    step = both_ways(pairs)
    names = [(f"s{w}", f"f{w}") for w in range(WORDS)]
    none = F.lit(0).cast("bigint")
    own = lambda w: F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(none))
    state = starts.groupBy(F.col("start").alias("id"), "chunk").agg(*[own(w).alias(f) for w, (_, f) in enumerate(names)])
    state = state.select("id", "chunk", *[F.col(f).alias(n) for pair in names for f, n in ((pair[1], pair[0]), (pair[1], pair[1]))])
    for k in count(1) if hops is None else range(1, hops + 1):
        front = state.where(reduce(lambda x, y: x | y, [F.col(f) != 0 for _, f in names]))
        sent = front.join(step, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "chunk", *[x for s, f in names for x in (none.alias(s), F.col(f))])
        known = state.select("id", "chunk", *[x for s, f in names for x in (F.col(s), none.alias(f))])
        met = known.unionByName(sent).groupBy("id", "chunk").agg(*[F.bit_or(c).alias(c) for pair in names for c in pair])
        new = [F.col(f).bitwiseAND(F.bitwise_not(F.col(s))) for s, f in names]
        met = met.select("id", "chunk", *[x for (s, f), n in zip(names, new) for x in (F.col(s).bitwiseOR(F.col(f)).alias(s), n.alias(f))])
        seen = Observation()
        state = settle(met.observe(seen, F.sum(reduce(lambda x, y: x + y, [F.bit_count(f) for _, f in names])).alias("n")))
        n = seen.get["n"] or 0
        if not n:
            return
        yield k, state.select("id", "chunk", *[f for _, f in names]), n


def numbered(starts: DataFrame, pairs: DataFrame) -> DataFrame:
    """start (id, once each) with its place in the masks: chunk, word, bit.

    Starts of one component of pairs follow each other, so that a chunk meets few components and a node only the chunks of its own.
    """
    of = components(pairs).withColumnRenamed("id", "start")
    at = settle(starts.select(F.col("id").alias("start")).distinct().join(of, "start", "left").orderBy("component", "start"))
    at = at.withColumn("n", F.monotonically_increasing_id())  # dense within a partition
    word = (F.floor(F.col("n") / 64) % WORDS).cast("int")
    return settle(at.select("start", F.floor(F.col("n") / (64 * WORDS)).alias("chunk"), word.alias("word"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("bit")))


HELD = 8_000_000  # pairs of a component that a worker holds, some 80 bytes each
SHARE = 4_000_000_000  # starts times pairs of a component that are one task's, and in how many tasks a component's starts are at most
SHARES = 32
TOGETHER = 500_000  # pairs of small components that are one task's


def mean_path(pairs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """pairs, mean_path: over ordered pairs of nodes that reach each other, from all nodes or the given sources (id).

    A component of HELD pairs at most is searched within tasks, each of which has all its pairs and a share of its starts: what is seen
    stays in the task, so that only pairs are shuffled. A larger component goes through reached().
    """
    pairs = settle(pairs.select("a", "b"))
    of = components(pairs).select("id", F.xxhash64("component").alias("g"))  # two components of one number would only share a task
    if sources is None:
        nodes = of.withColumn("s", F.lit(True))
    else:
        nodes = of.join(sources.select("id").distinct().withColumn("s", F.lit(True)), "id", "left").withColumn("s", F.coalesce("s", F.lit(False)))
    nodes = settle(nodes.withColumn("n", F.monotonically_increasing_id()))
    ends = [nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"), *(["g"] if x == "a" else [])) for x in "ab"]
    links = settle(pairs.where("a <> b").join(ends[0], "a").join(ends[1], "b"))
    size = links.groupBy("g").agg(F.count("*").alias("m")).join(nodes.groupBy("g").agg(F.count_if("s").alias("k")), "g")
    size = settle(size.select("g", "m", F.least(F.ceil(F.col("m").cast("double") * F.col("k") / SHARE), F.lit(SHARES)).cast("int").alias("parts")).where("parts > 0"))
    few, most = size.agg(F.sum("m"), F.max("m")).first()
    groups = max(64, -(-(few or 0) // TOGETHER))
    held = links.join(small(size.where(F.col("m") <= HELD)), "g")
    held = held.select("g", "na", "nb", "sa", "sb", "parts", F.when(F.col("parts") > 1, F.col("g")).otherwise(F.pmod("g", F.lit(groups))).alias("h"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    n, total = held.groupBy("h", "parts", "part").applyInArrow(_hops, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    n, total = n or 0, total or 0
    if (most or 0) > HELD:
        large = size.where(F.col("m") > HELD).select("g")
        rest = settle(links.join(small(large), "g", "left_semi").select("a", "b"))
        starts = nodes.where("s").join(small(large), "g", "left_semi").select("id")
        for k, _, new in reached(rest, numbered(starts, rest)):
            n, total = n + new, total + k * new
    return pairs.sparkSession.createDataFrame([(n, total / n if n else None)], "pairs bigint, mean_path double")


def _hops(table):
    """How many pairs of a start and another node are connected, and the sum of their hops. table: g, na, nb, sa, sb, parts, part of whole components."""
    import numpy as np
    import pyarrow as pa

    column = lambda c: table.column(c).to_numpy()
    parts, part, m = table.column("parts")[0].as_py(), table.column("part")[0].as_py(), table.num_rows
    ids, first = np.unique(np.concatenate([column("na"), column("nb")]), return_index=True)
    own = column("g")[first % m]
    order = np.argsort(own, kind="stable")  # a component's nodes side by side
    own, rank = own[order], np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    a, b = (rank[np.searchsorted(ids, column(c))] for c in ("na", "nb"))
    is_start = np.zeros(len(ids), bool)
    is_start[a], is_start[b] = column("sa"), column("sb")
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.argsort(u, kind="stable")
    v, at = v[by], np.append(0, np.cumsum(np.bincount(u, minlength=len(ids))))  # neighbours of node i: v[at[i]:at[i + 1]]
    del table, a, b, u, by, ids, first, order, rank
    starts, n, total = np.flatnonzero(is_start)[part::parts], 0, 0
    for i in range(0, len(starts), 64):
        some = starts[i : i + 64]
        low, high = np.searchsorted(own, own[some[0]], "left"), np.searchsorted(own, own[some[-1]], "right")
        to, edge = v[at[low] : at[high]] - low, at[low:high] - at[low]
        seen = np.zeros(high - low, np.uint64)
        seen[some - low] = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
        front = seen.copy()
        for k in count(1):
            front = np.bitwise_or.reduceat(front[to], edge) & ~seen
            new = int(np.bitwise_count(front).sum())
            if not new:
                break
            seen |= front
            n, total = n + new, total + k * new
    return pa.table({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})


def hops_between(candidates: DataFrame, pairs: DataFrame, hops: int | None = None) -> DataFrame:
    """candidates (a, b and others) with ``hops`` between their ends, null where a doesn't reach b within ``hops``."""
    candidates, pairs = settle(candidates), settle(pairs)
    starts = numbered(candidates.select(F.col("a").alias("id")), pairs)
    levels = [new.withColumn("hops", F.lit(k)) for k, new, _ in reached(pairs, starts, hops)]
    if not levels:
        return candidates.withColumn("hops", F.when(F.col("a") == F.col("b"), 0))
    ends = settle(candidates.select("a", "b").distinct().join(starts, F.col("a") == F.col("start")).select("a", "b", "chunk", "word", "bit"))
    found = ends.join(reduce(DataFrame.unionByName, levels).withColumnsRenamed({"id": "b"}), ["b", "chunk"])
    mask = F.get(F.array(*[f"f{w}" for w in range(WORDS)]), F.col("word"))
    found = found.where(mask.bitwiseAND(F.col("bit")) != 0).select("a", "b", "hops")
    return candidates.join(found, ["a", "b"], "left").withColumn("hops", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("hops")))


def shortcut_candidates(similar: DataFrame, pairs: DataFrame, least_hops: int = 4) -> DataFrame:
    """similar (a, b, sim) whose ends are at least ``least_hops`` apart or don't reach each other."""
    return hops_between(similar, pairs, least_hops - 1).where("hops is null").drop("hops")


def with_hops(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """candidates (a, b, sim) with ``hops`` between their ends, null where they don't reach each other."""
    return hops_between(candidates, pairs)


def bridging(metrics: dict, edges: int, p: float | None = None) -> tuple[float, float, int]:
    """Bridging cost, the share of edges aimed at, and the budget of shortcuts."""
    cost = (metrics["components"] - 1) / max(edges, 1)
    share = min(0.25, 1.3 * cost) if p is None else p
    return cost, share, max(1, round(share * edges))


def augmented(edges: DataFrame, candidates: DataFrame, budget: int) -> DataFrame:
    """edges with all shortcuts replaced by the best candidates: unreachable pairs first, then the most similar.

    Where edges have them, ``directed`` is false and ``evidence`` tells how far apart the ends were.
    """
    order = [F.col("hops").isNotNull()] if "hops" in candidates.columns else []
    best = candidates.orderBy(*order, F.desc("sim"), "a", "b").limit(budget)
    was = F.when(F.col("hops").isNull(), "was unreachable").otherwise(F.concat(F.lit("was "), F.col("hops").cast("string"), F.lit(" hops"))) if order else F.lit(None).cast("string")
    more = {c: x for c, x in {"directed": F.lit(False), "evidence": was}.items() if c in edges.columns}
    new = best.select(F.col("a").alias("source"), F.col("b").alias("target"), F.round("sim", 4).alias("weight"), F.lit("shortcut").alias("relationship_type"), *[x.alias(c) for c, x in more.items()])
    return edges.select("source", "target", "weight", "relationship_type", *more).where("relationship_type <> 'shortcut'").unionByName(new)


def ring_clustering(mean_degree: float) -> float:
    """Clustering of the ring lattice of like degree, in closed form."""
    k = 2 * max(2, int(max(2, round(mean_degree)) / 2))
    return 3 * (k - 2) / (4 * (k - 1))


def verdict(reach: float, sigma: float | None) -> str:
    """sigma: None where there is none, as without random twins or where these have no triangles."""
    if reach < 0.5:
        return "fragmented"
    if sigma is None:
        return "not measured"
    return "small-world" if sigma > 1.5 else "weakly small-world" if sigma > 1 else "not small-world"


SWAPS = 10_000  # that are numbers of Python's at a time


def swapped(pairs, rng):
    """pairs (an array of two columns) after 10 swaps a pair that keep all degrees. A pair is one number, and swaps are drawn into arrays."""
    import numpy as np

    names, at = np.unique(pairs, return_inverse=True)
    at, n = np.sort(at.reshape(-1, 2), axis=1).astype(np.int64), max(1, len(names))
    e = (at[:, 0] * n + at[:, 1]).tolist()
    have = set(e)
    drawn, flips = rng.integers(0, len(e), (2, 10 * len(e))).astype(np.int32), rng.random(10 * len(e)) < 0.5
    for k in range(0, 10 * len(e), SWAPS):
        for i, j, flip in zip(*drawn[:, k : k + SWAPS].tolist(), flips[k : k + SWAPS].tolist()):
            a, b = divmod(e[i], n)
            c, d = divmod(e[j], n)
            if flip:
                c, d = d, c
            if len({a, b, c, d}) < 4:
                continue
            x, y = min(a, d) * n + max(a, d), min(c, b) * n + max(c, b)
            if x in have or y in have:
                continue
            have -= {e[i], e[j]}
            have |= {x, y}
            e[i], e[j] = x, y
    made = np.array(e, np.int64)
    return np.stack([names[made // n], names[made % n]], axis=1)


def rewired(spark, pairs: list[tuple[int, int]], replicates: int = 5, seed: int = 42, metrics: bool = False) -> DataFrame:
    """replicate, a, b of degree-preserving rewirings (10 swaps a pair), one task for each replicate; or replicate, clustering, mean_path.

    Swaps depend on one another, so a replicate is made in one place: for graphs that fit a
    worker, as the measure of topology here is meant for.
    """
    import numpy as np

    shared = spark.sparkContext.broadcast(np.array(pairs, np.int64).reshape(-1, 2))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.column(0).to_pylist():
                made = swapped(shared.value, np.random.default_rng(seed + r))
                if metrics:
                    c, length = small_metrics(made.tolist())
                    yield pa.RecordBatch.from_pydict({"replicate": [r], "clustering": [c], "mean_path": [length]})
                else:
                    for i in range(0, len(made), SWAPS):
                        some = made[i : i + SWAPS]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r)), pa.array(some[:, 0]), pa.array(some[:, 1])], names=["replicate", "a", "b"])

    return spark.range(replicates).repartition(replicates, "id").mapInArrow(run, "replicate bigint, clustering double, mean_path double" if metrics else "replicate bigint, a bigint, b bigint")


def null_model(spark, pairs: list[tuple[int, int]], replicates: int = 5, seed: int = 42) -> DataFrame:
    """replicate, clustering, mean_path of degree-preserving rewirings."""
    return rewired(spark, pairs, replicates, seed, metrics=True)


def small_metrics(pairs: list) -> tuple[float, float]:
    """Clustering and mean path of a graph in memory."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    triples = sum(len(n) * (len(n) - 1) // 2 for n in near.values())
    triangles = sum(len(near[a] & near[b]) for a, b in pairs)
    total = n = 0
    for s in near:
        dist, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near[x] if y not in dist and not dist.update({y: dist[x] + 1})]
        total += sum(dist.values())
        n += len(dist) - 1
    return (triangles / triples if triples else 0.0), (total / n if n else float("nan"))
