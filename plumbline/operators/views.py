"""Views made of several operators: hybrid retrieval, small-world reports, exports, question workflows, intake records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFUSED, letter_year, subject
from ..session import settle
from . import graph, ledger, retrieval


def retrieve(vectors: DataFrame, edges: DataFrame, query: list[float], key: str, top: int = 8, hops: int = 2, most: int = 40) -> DataFrame:
    """id, layer, score, hops: documents nearest to the query, then what is around them in the graph and isn't a seed."""
    seeds = retrieval.vector_top(vectors, query, key, top).select(F.col(key).cast("string").alias("id"), "score")
    around = graph.neighbours(edges, seeds.select("id"), hops, most=most).join(seeds.select("id"), "id", "left_anti")
    return seeds.select("id", F.lit("seed").alias("layer"), "score", F.lit(0).alias("hops")).unionByName(around.select("id", F.lit("graph").alias("layer"), F.lit(None).cast("double").alias("score"), "hops"))


def retrieval_gain(found: DataFrame, plans: DataFrame, most: int = 40) -> DataFrame:
    """query, before, after, capped: plans that seeds cover, and seeds with what was found around them. found: query, id, layer; plans: id, plan_id."""
    f = found.join(plans, "id", "left")
    g = f.groupBy("query").agg(
        F.countDistinct(F.when(F.col("layer") == "seed", F.col("plan_id"))).alias("before"), F.countDistinct("plan_id").alias("after"), (F.count_if(F.col("layer") == "graph") >= most).alias("capped"),
    )
    return g.withColumn("gain", F.col("after") - F.col("before"))


def small_world(pairs: DataFrame, spark, replicates: int = 5, seed: int = 42, most_pairs: int = 2_000_000) -> dict:
    """Clustering, mean path, reach, sigma, omega and the verdict. Random twins are made in workers' memory, so for at most ``most_pairs`` pairs; beyond them the verdict of a connected graph is 'not measured'."""
    c = graph.clustering(pairs).first()
    length, reach = graph.mean_path(pairs).first(), graph.reachable_share(graph.components(pairs)).first()
    n = pairs.count()
    out = {"clustering": c["clustering"], "mean_path": length["mean_path"], "components": reach["components"], "largest": reach["largest"], "reach": reach["reach"], "edges": n, "sigma": None, "omega": None}
    if 0 < n <= most_pairs:
        rows = [(r["a"], r["b"]) for r in pairs.toLocalIterator()]
        names = {x: i for i, x in enumerate(sorted({y for p in rows for y in p}))}
        twin = graph.null_model(spark, [(names[a], names[b]) for a, b in rows], replicates, seed).agg(F.avg("clustering").alias("c"), F.avg("mean_path").alias("l")).first()
        ring = graph.ring_clustering(2 * n / len(names))
        if twin["c"] and twin["l"] and c["clustering"] is not None:
            out["sigma"] = (c["clustering"] / twin["c"]) / (length["mean_path"] / twin["l"])
        if ring and twin["l"]:
            out["omega"] = twin["l"] / length["mean_path"] - c["clustering"] / ring
    out["verdict"] = graph.verdict(out["reach"] or 0.0, out["sigma"])
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by kind and edges by type, so that queries of one type read one folder; and both as CSV."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relationship_type").parquet(f"{path}/edges")
    nodes.write.mode("overwrite").csv(f"{path}/nodes_csv", header=True)
    edges.write.mode("overwrite").csv(f"{path}/edges_csv", header=True)


def graph_view(nodes: DataFrame, edges: DataFrame, most_pairs: int = 60, least_chain: int = 2) -> DataFrame:
    """part, json: totals, plans, chains, pairs of documents and widest letters, each row as JSON."""
    parts = {
        "counts": graph.counts(nodes, edges), "plans": graph.plan_profile(nodes, edges), "chains": graph.longest_chains(edges.where("relationship_type = 'supersedes'")).where(F.col("length") >= least_chain),
        "pairs": edges.where("relationship_type = 'similar_topic'").orderBy(F.desc("weight"), "source", "target").limit(most_pairs), "reach": graph.reach(nodes, edges, most_pairs),
    }
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def chains_of(chains: DataFrame, key: Column, first: int, last: int, least: int = 2) -> DataFrame:
    """Chains of some length whose head's year is within a span."""
    return chains.where((F.col("length") >= least) & letter_year(key).between(first, last))


def write_currency(status: DataFrame, nodes: DataFrame, path: str) -> None:
    """Currency by plan and by replaced letter, as CSV in order; a letter's files may be several."""
    status = settle(status)
    plan = status.groupBy("plan_id").agg(F.count("*").alias("citations"), F.count_if("replaced").alias("replaced"), F.count_if("old_only").alias("replaced_old_only"))
    letter = status.where("replaced").groupBy("letter").agg(F.count("*").alias("citations"), F.count_if("old_only").alias("old_only"), F.countDistinct("plan_id").alias("plans"))
    letter = letter.join(nodes.select(F.col("id").alias("letter"), subject(F.col("label")).alias("subject")), "letter", "left")
    plan.orderBy("plan_id").coalesce(1).write.mode("overwrite").csv(f"{path}/by_plan", header=True)
    letter.orderBy("letter").write.mode("overwrite").csv(f"{path}/by_letter", header=True)


def ask(question: str, chunks: DataFrame, model: Callable[[str, list[dict]], str], log: Callable[[dict], None], top: int = 6) -> dict:
    """A question to passages: logged, refused if it asks for a determination, else answered by the model and its citations checked.

    chunks: policy_number, page, text and chunk_id. The model is any callable of question and passages.
    """
    import re

    log({"event_type": "assistance.requested", "payload": {"question": question}})
    if re.search("|".join(REFUSED), question, re.IGNORECASE):
        log({"event_type": "assistance.refused", "payload": {"question": question}})
        return {"refused": True, "answer": None}
    passages = retrieval.rarity(chunks, question, top)
    rows = [r.asDict() for r in passages.collect()]  # at most ``top``
    if not rows:
        return {"refused": False, "answer": None, "passages": []}
    answer = model(question, rows)
    spark = chunks.sparkSession
    check = retrieval.verified_citations(spark.createDataFrame([(1, answer)], "id int, answer string"), spark.createDataFrame([(r["policy_number"], r["page"]) for r in rows], "policy_number string, page int")).first()
    log({"event_type": "assistance.answered", "payload": {"cited": check["cited"], "unverified": check["unverified"]}})
    return {"refused": False, "answer": answer, "passages": rows, "unverified": check["unverified"], "uncited": check["uncited"]}


def interpretation(found: dict, outcome: str = "hours", true_effect: float | None = None) -> str:
    """A reading of run_analysis() by a fixed text: what was compared, the unadjusted difference, each adjusted effect with its interval, and what it rests on."""
    if found.get("withheld"):
        why = found.get("preconditions", {}).get("failed") or [found["ready"]["message"]]
        return f"The estimate is withheld: {', '.join(why)}."
    m, did = found["estimates"]["psm"], found["estimates"].get("did")
    span = lambda e: f"{e['estimate']:+.1f} {outcome} ({e['low']:.1f} to {e['high']:.1f}, p {e['p']:.3f})"
    lines = [f"Cases: {found['ready']['cases']}.", f"Unadjusted difference: {found['naive']:+.1f} {outcome}."]
    how = f"nearest match{' with replacement' if m['replacement'] else ''}, caliper {m['caliper']:g}{', Mahalanobis within it' if m['mahalanobis'] else ''}"
    lines.append(f"Adjusted effect by {how}: {span(m)}; the interval {'covers' if m['low'] < 0 < m['high'] else 'excludes'} zero.")
    lines.append(f"Matched: {m['n']} cases, worst standardised difference {m['worst']:.3f}; {m['n_unmatched']} exposed cases found no match.")
    lines.append(f"Adjusted for {', '.join(m['covariates'])}, as the diagram asks.")
    if did is not None:
        lines.append(f"Difference in differences: {span(did)}.")
    flag = flags(found, true_effect)
    if flag["signs_differ"]:
        lines.append("The unadjusted difference has the other sign.")
    if true_effect is not None:
        lines.append(f"The true effect of {true_effect:+.1f} is {'within' if flag['recovered'] else 'outside'} the interval.")
    return "\n".join(lines)


def flags(found: dict, true_effect: float | None = None) -> dict:
    """signs_differ: unadjusted and adjusted effect point apart; recovered: the interval holds the true effect (null without one)."""
    m = found["estimates"]["psm"]
    return {"signs_differ": found["naive"] * m["estimate"] < 0, "recovered": None if true_effect is None else m["low"] <= true_effect <= m["high"]}


def intake(cases: DataFrame, events: DataFrame) -> DataFrame:
    """cases (case_id, complexity, expedited, tenure, sdoh) with their opening payload: the queue that each met on arrival, and its own fields."""
    met = cases.join(ledger.queue_at_arrival(events).select("case_id", "queue"), "case_id", "left")
    body = F.struct("complexity", "expedited", F.coalesce("queue", F.lit(0)).alias("backlog"), "tenure", "sdoh")
    return met.select(*cases.columns, F.to_json(body).alias("payload"))


def augment(edges: DataFrame, similar: DataFrame, least_hops: int = 4, share: float | None = None, paths: bool = True) -> tuple[DataFrame, dict]:
    """edges with shortcuts anew, and what it did: bridging cost, budget, and the topology before and after. paths: measure mean paths too, a walk from every node."""
    pairs = settle(graph.undirected(edges.where("relationship_type <> 'shortcut'"), graph.SEMANTIC))
    before = topology(pairs, paths)
    cost, p, budget = graph.bridging(before, before["edges"], share)
    found = graph.with_hops(settle(graph.shortcut_candidates(similar, pairs, least_hops)), pairs)
    out = settle(graph.augmented(edges, found, budget))
    return out, {"cost": cost, "share": p, "budget": budget, "before": before, "after": topology(graph.undirected(out, graph.SEMANTIC), paths)}


def topology(pairs: DataFrame, paths: bool = True) -> dict:
    """edges, clustering, mean_path (null unless asked for), components, largest, reach."""
    c, r = graph.clustering(pairs).first(), graph.reachable_share(graph.components(pairs)).first()
    return {"edges": pairs.count(), "clustering": c["clustering"], "mean_path": graph.mean_path(pairs).first()["mean_path"] if paths else None, "components": r["components"], "largest": r["largest"], "reach": r["reach"]}


def html_page(view: DataFrame, title: str, path: str, least: int = 2, first: int = 1990, last: int = 2030) -> None:
    """A page that holds the rows of graph_view() as data and shows chains of some length whose head is within years; one file without outside parts."""
    import json
    from html import escape

    parts: dict[str, list] = {}
    for r in view.collect():  # a view's lists are for display: pairs and reach have a top, chains are a row a head
        parts.setdefault(r["part"], []).append(json.loads(r["json"]))
    data = json.dumps(parts, sort_keys=True).replace("<", "\\u003c")
    script = (
        "const view=JSON.parse(document.getElementById('data').textContent);const span=[%d,%d];"
        "const year=k=>{const m=/(\\d\\d)-\\d\\d\\d/.exec(k);return m?(+m[1]>=90?1900:2000)+ +m[1]:null};"
        "const list=document.getElementById('chains');"
        "for(const c of view.chains||[]){const y=year(c.head);if(c.length>=%d&&(y===null||y>=span[0]&&y<=span[1])){const li=document.createElement('li');li.textContent=c.path;list.append(li)}}"
    ) % (first, last, least)
    body = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ol id='chains'></ol><script type='application/json' id='data'>{data}</script><script>{script}</script></body></html>"
    spark = view.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, True)
    out.write(bytearray(body.encode()))
    out.close()


def gaps(needed: DataFrame, answered: DataFrame, key: str = "id") -> DataFrame:
    """needed, answered, open: sizes of what is asked for, what of it is answered, and what isn't."""
    n, a = needed.select(key).distinct(), answered.select(key).distinct().withColumn("_a", F.lit(True))
    return n.join(a, key, "left").agg(F.count("*").alias("needed"), F.count("_a").alias("answered"), F.count_if(F.col("_a").isNull()).alias("open"))
