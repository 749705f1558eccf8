"""Paged APIs as a source of Spark."""

import json
from pathlib import Path

import pytest

from plumbline.sources import pages

ITEMS = [{"id": k, "plan": f"p{k % 3}", "title": f"t{k}"} for k in range(57)]
SCHEMA = "id bigint, plan string, title string, more string"


def service(log):
    """Serves ITEMS, and notes what it was asked for in a file."""

    def page(offset, size, asked):
        with open(log, "a") as f:
            f.write(json.dumps([offset, size, asked]) + "\n")
        found = [x for x in ITEMS if all(x[k] == v for k, v in asked.items())]
        return len(found), [json.dumps(x) for x in found[offset : offset + size]]

    return page


def asked(log):
    return [json.loads(x) for x in Path(log).read_text().splitlines()]


@pytest.mark.parametrize("size", [10, 57, 100])
def test_all_pages(spark, tmp_path, size):
    pages.register(spark, "api_all", service(str(tmp_path / "log")), SCHEMA, ("plan",), size)
    df = spark.read.format("api_all").load()
    assert sorted((r.id, r.plan, r.title, r.more) for r in df.collect()) == [(x["id"], x["plan"], x["title"], None) for x in ITEMS]
    assert df.rdd.getNumPartitions() == -(-57 // size)


def test_parameters_and_limits_are_asked_of_the_api(spark, tmp_path):
    log = str(tmp_path / "log")
    pages.register(spark, "api_some", service(log), SCHEMA, ("plan",), 7)
    got = spark.read.format("api_some").load().where("plan = 'p1' and id > 20").collect()
    assert sorted(r.id for r in got) == [x["id"] for x in ITEMS if x["plan"] == "p1" and x["id"] > 20]
    assert all(a == {"plan": "p1"} for _, size, a in asked(log) if size > 1) and sum(size > 1 for _, size, _ in asked(log)) == 3
    assert spark.read.format("api_some").option("limit", 9).load().count() == 9
    assert spark.read.format("api_some").load().where("plan = 'none'").count() == 0


def test_a_stream_reads_on(spark, tmp_path):
    pages.register(spark, "api_stream", service(str(tmp_path / "log")), SCHEMA, (), 10)

    def run():
        out = spark.readStream.format("api_stream").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        out.trigger(once=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(57)) == run()
