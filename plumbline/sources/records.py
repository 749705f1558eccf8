"""Nested records: patient bundles and control catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import age_on
from ..operators.causal import quantiles
from ..session import bound_batches, settle

BUNDLE = (
    "struct<entry:array<struct<resource:struct<resourceType:string,id:string,birthDate:string,gender:string,code:struct<text:string,coding:array<struct<display:string>>>,clinicalStatus:struct<coding:array<struct<code:string>>>>>>>"
)


def cohort(bundles: DataFrame, social: list[str], urgent: list[str], on: str, json: str = "json") -> DataFrame:
    """One row a bundle: member_id, age, gender, counts of resources, social flags, urgent_condition.

    Bundles without a patient of known birth date, or that don't parse, are left out. All by
    higher-order functions on the parsed bundle, without exploding it.
    """
    b = bundles.select(F.transform(F.from_json(F.col(json), BUNDLE)["entry"], lambda e: e["resource"]).alias("r"))
    patient = F.get(F.filter("r", lambda x: (x["resourceType"] == "Patient") & x["birthDate"].isNotNull()), 0)
    n = lambda kind: F.size(F.filter("r", lambda x: x["resourceType"] == kind))
    shown = F.transform(F.filter("r", lambda x: x["resourceType"] == "Condition"), lambda x: F.lower(F.coalesce(x["code"]["text"], F.get(x["code"]["coding"], 0)["display"], F.lit(""))))
    any_of = lambda words, s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))
    age = age_on(F.to_date("p.birthDate"), F.to_date(F.lit(on)))
    return b.withColumn("p", patient).where("p is not null").select(
        F.col("p.id").alias("member_id"), age.alias("age"), F.col("p.gender").alias("gender"), n("Condition").alias("conditions"), n("Encounter").alias("encounters"), n("Claim").alias("claims"),
        n("MedicationRequest").alias("medications"), F.size(F.filter(shown, lambda s: any_of(social, s))).alias("sdoh_flags"), F.exists(shown, lambda s: any_of(urgent, s)).cast("int").alias("urgent_condition"),
    )


CONTROLS = "id string, control_id string, family_id string, family string, title string, parent string, withdrawn boolean, statement string, n_params int"


def controls(catalogs: DataFrame, json: str = "json") -> DataFrame:
    """Controls and enhancements of nested control catalogs (groups, controls, controls within); prose is flattened in order.

    A Python worker has one catalog's controls at a time, in batches of catalogs bounded by bytes.
    """
    bound_batches(catalogs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json as js

        def prose(part: dict) -> str:
            return " ".join(x for x in [part.get("prose", ""), *[prose(p) for p in part.get("parts") or []]] if x).strip()

        def walk(c: dict, group: dict, parent: str | None) -> Iterator[dict]:
            props = {p["name"]: p.get("value") for p in c.get("props") or []}
            statement = " ".join(prose(p) for p in c.get("parts") or [] if p.get("name") == "statement")
            yield {"id": c["id"], "control_id": c["id"], "family_id": group["id"], "family": group["title"], "title": c["title"], "parent": parent, "withdrawn": props.get("status") == "withdrawn", "statement": statement, "n_params": len(c.get("params") or [])}
            for child in c.get("controls") or []:
                yield from walk(child, group, c["id"])

        schema = pa.schema([("id", pa.string()), ("control_id", pa.string()), ("family_id", pa.string()), ("family", pa.string()), ("title", pa.string()), ("parent", pa.string()), ("withdrawn", pa.bool_()), ("statement", pa.string()), ("n_params", pa.int32())])
        for b in batches:
            for t in b.column(0):
                if text := t.as_py():
                    rows = [r for g in js.loads(text)["catalog"]["groups"] for c in g.get("controls") or [] for r in walk(c, g, None)]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from ..functions.text import display_id

    return catalogs.select(json).mapInArrow(run, CONTROLS).withColumn("id", display_id(F.col("control_id")))


def with_baselines(found: DataFrame, members: DataFrame) -> DataFrame:
    """found with the baselines (control_id, baseline) that each control is in."""
    by = members.groupBy("control_id").agg(F.array_sort(F.collect_set("baseline")).alias("baselines"))  # a few baselines each
    return found.join(by, "control_id", "left").withColumn("baselines", F.coalesce("baselines", F.array().cast("array<string>")))


COHORT = "member_id string, age int, gender string, conditions int, encounters int, claims int, medications int, sdoh_flags int, urgent_condition int"


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """A cohort kept as CSV with a header."""
    return spark.read.schema(COHORT).csv(path, header=True)


def cohort_summary(members: DataFrame) -> DataFrame:
    """members, median_age, median_conditions, most_encounters, with_flags, urgent: one row. The members are made once, for all of these."""
    members = settle(members.select("age", "conditions", "encounters", "sdoh_flags", "urgent_condition"), "members")
    middle = lambda c: F.lit(quantiles(members, c, [0.5])[0]).cast("double").alias(f"median_{c}")
    return members.agg(
        F.count("*").alias("members"), middle("age"), middle("conditions"), F.max("encounters").alias("most_encounters"),
        F.count_if(F.col("sdoh_flags") > 0).alias("with_flags"), F.count_if(F.col("urgent_condition") == 1).alias("urgent"),
    )


def control_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A control catalog kept as JSON with a list ``controls``, keyed by id; an error where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        raise FileNotFoundError(f"no control catalog at {path}")
    kind = "struct<id:string,title:string,withdrawn:boolean,baselines:array<string>,statement:string,n_params:int>"
    return spark.read.schema(f"controls array<{kind}>").json(path, multiLine=True).select(F.explode("controls").alias("c")).select("c.*")


def control_report(found: DataFrame) -> DataFrame:
    """baseline, controls: how many controls each baseline has; and how many have no statement."""
    by = found.select(F.explode("baselines").alias("baseline")).groupBy("baseline").agg(F.count("*").alias("controls"))
    return by.unionByName(found.agg(F.lit("(no statement)").alias("baseline"), F.count_if(F.coalesce("statement", F.lit("")) == "").alias("controls")))
