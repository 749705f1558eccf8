"""Measurement contracts and registries: loading with checks, preconditions, the run of an analysis."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causal
from ..operators.ledger import readiness
from .dag import adjustment_set

SECTIONS = ["contract", "intervention", "outcome", "dag", "required_fields", "estimators", "preconditions", "roi"]
REGISTRY_KEYS = ["plan_id", "name", "domain", "tier", "fetcher"]


def load_contract(path: str) -> dict:
    return parse_contract(Path(path).read_text())


def parse_contract(text: str) -> dict:
    """A contract whose sections are all there and whose diagram has edges."""
    spec = yaml.safe_load(text)
    missing = [s for s in SECTIONS if s not in spec]
    if missing:
        raise ValueError(f"contract lacks {', '.join(missing)}")
    if not spec["dag"].get("edges"):
        raise ValueError("contract has an empty dag")
    return spec


def diagram(spec: dict) -> tuple[tuple[str, str], ...]:
    return tuple((e["from"], e["to"]) for e in spec["dag"]["edges"])


def load_registry(path: str) -> dict[str, dict]:
    return parse_registry(Path(path).read_text())


def parse_registry(text: str) -> dict[str, dict]:
    """Entries by plan_id; a missing key or a plan_id met twice is an error."""
    plans = yaml.safe_load(text)["plans"]
    out: dict[str, dict] = {}
    for p in plans:
        missing = [k for k in REGISTRY_KEYS if k not in p]
        if missing:
            raise ValueError(f"registry entry {p.get('plan_id', '?')} lacks {', '.join(missing)}")
        if p["plan_id"] in out:
            raise ValueError(f"duplicate plan_id {p['plan_id']}")
        out[p["plan_id"]] = p
    return out


def fetchable(registry: dict[str, dict], fetchers: set[str], plans: list[str] | None = None) -> dict[str, dict]:
    """The plans asked for; unknown or unimplemented ones are an error if named, left out if not."""
    if plans is None:
        return {k: p for k, p in registry.items() if p["fetcher"] in fetchers}
    for k in plans:
        if k not in registry:
            raise ValueError(f"unknown plan {k}")
        if registry[k]["fetcher"] not in fetchers:
            raise ValueError(f"{k}: fetcher {registry[k]['fetcher']} isn't implemented")
    return {k: registry[k] for k in plans}


def reporting_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_reporting_lines(spark, Path(path).read_text())


def parse_reporting_lines(spark: SparkSession, text: str) -> DataFrame:
    """person, boss from a chart; people without a boss have no row."""
    chart = yaml.safe_load(text)["reports_to"]
    return spark.createDataFrame([(k, v) for k, v in chart.items() if v], "person string, boss string")


def preconditions(balance: float | None, ratio: float, most_balance: float = 0.1, most_ratio: float = 5.0) -> dict:
    failed = []
    if balance is None or balance > most_balance:
        failed.append("balance")
    if not ratio <= most_ratio:
        failed.append("overlap")
    return {"met": not failed, "failed": failed}


def run_analysis(cases: DataFrame, edges: tuple, outcome: str, exposure: str, key: str, required: list[str], costs: dict, true_effect: float | None = None, limits: list[str] = (), calipers: tuple[float, ...] = causal.CALIPERS) -> dict:
    """Readiness, then all estimators on the diagram's adjustment set, then preconditions; the effect is withheld if they fail."""
    ready = readiness(cases, required, limits)
    if not ready["satisfiable"]:
        return {"ready": ready, "withheld": True}
    covariates = [c for c in adjustment_set(edges, exposure, outcome) if c in cases.columns]
    scored = causal.with_propensity(cases, exposure, covariates)
    lap = causal.overlap(scored, exposure).first()
    found = {"psm": causal.psm(cases, outcome, exposure, covariates, key, calipers), "iptw": causal.iptw(cases, outcome, exposure, covariates), "did": causal.did(cases, outcome, covariates)}
    met = preconditions(found["psm"]["worst"], lap["ratio"])
    out = {"ready": ready, "covariates": covariates, "preconditions": met, "withheld": not met["met"], "naive": causal.naive_effect(cases, outcome, exposure).first()["effect"]}
    if met["met"]:
        out |= {"estimates": found, "roi": causal.roi(found["psm"]["low"], found["psm"]["high"], **costs)}
        if true_effect is not None:
            out["recovered"] = found["psm"]["low"] <= true_effect <= found["psm"]["high"]
    return out


def passport_controls(catalog: DataFrame, baseline: str, additions: DataFrame, inherited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controls with where they come from (id, title, origin, reason, n_params), and warnings (id, warning).

    catalog: id, title, withdrawn, baselines, n_params; additions: id, reason; inherited: id, source.
    A control both in the baseline and inherited stays twice.
    """
    base = catalog.where(F.array_contains("baselines", baseline) & ~F.coalesce("withdrawn", F.lit(False))).select("id", "title", F.lit(f"baseline:{baseline}").alias("origin"), F.lit("").alias("reason"), "n_params")
    add = additions.join(catalog.select("id", "title", "n_params", F.array_contains("baselines", baseline).alias("_in"), F.lit(True).alias("_known")), "id", "left")
    warnings = add.select("id", F.when(F.col("_known").isNull(), "unknown control").when(F.col("_in"), "already in the baseline").alias("warning")).where("warning is not null")
    new = add.where(F.col("_known") & ~F.coalesce("_in", F.lit(False))).select("id", "title", F.lit("addition").alias("origin"), F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), r"\s+", " ")).alias("reason"), "n_params")
    own = inherited.join(catalog, "id").select("id", "title", F.lit("inherited").alias("origin"), F.concat(F.lit("from: "), F.coalesce("source", F.lit("?"))).alias("reason"), "n_params")
    return base.unionByName(new).unionByName(own), warnings


def passport_summary(controls: DataFrame) -> DataFrame:
    return controls.groupBy("origin").agg(F.count("*").alias("controls"), F.sum("n_params").alias("params"))


def passport(controls: DataFrame, needed: DataFrame, answered: DataFrame, bound: DataFrame, spec: str, artifact: bytes | None = None) -> dict:
    """counts, open parameters, unbound controls and hashes of an instrument's passport.

    controls: as passport_controls() gives; needed, answered: id of parameters; bound: id of controls with evidence;
    spec: the text it was made from; artifact: what it describes.
    """
    import hashlib

    by = {r["origin"].split(":")[0]: r["controls"] for r in passport_summary(controls).collect()}  # three origins
    ids = controls.select("id").distinct()
    n, a = needed.select("id").distinct(), answered.select("id").distinct()
    total = sum(by.values())
    with_evidence = ids.join(bound.select("id").distinct(), "id", "left_semi").count()
    counts = {
        "total": total, "baseline": by.get("baseline", 0), "additions": by.get("addition", 0), "inherited": by.get("inherited", 0),
        "params_needed": n.count(), "params_answered": n.join(a, "id", "left_semi").count(), "evidence_bound": with_evidence, "evidence_unbound": total - with_evidence,
    }
    return {
        "counts": counts, "open_parameters": n.join(a, "id", "left_anti"), "unbound_controls": ids.join(bound.select("id"), "id", "left_anti"),
        "spec_sha256": hashlib.sha256(spec.encode()).hexdigest(), "artifact_sha256": hashlib.sha256(artifact).hexdigest() if artifact is not None else None,
    }


def passport_text(found: dict, name: str, version: str, baseline: str) -> str:
    """A passport to read."""
    c = found["counts"]
    lines = [
        f"Passport of {name} {version}, baseline {baseline}",
        f"spec {found['spec_sha256'][:16]}, artifact {found['artifact_sha256'][:16] if found['artifact_sha256'] else 'not bound'}",
        f"{c['total']} controls: {c['baseline']} of the baseline, {c['additions']} added, {c['inherited']} inherited",
        f"{c['params_answered']} of {c['params_needed']} parameters answered",
        f"{c['evidence_bound']} controls with evidence, {c['evidence_unbound']} without",
    ]
    return "\n".join(lines)
