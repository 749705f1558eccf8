import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval
from plumbline.plans import contract
from plumbline.sources import catalog, crawl, documents, records
from plumbline.streaming import events as streams


def test_rows_and_repair(spark, tmp_path):
    df = spark.createDataFrame([(" a ", None)], "p string, t string")
    r = catalog.rows(df, plan_id=F.col("p"), title=F.col("t")).first()
    assert r.plan_id == "a" and r.title == "" and len(r) == 12
    with pytest.raises(ValueError, match="unknown"):
        catalog.rows(df, nope=F.col("p"))
    assert catalog.read_catalog(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps([{"plan_id": "a", "extra": 1}]))
    assert catalog.read_catalog(spark, str(tmp_path / "c.json")).first().status == ""
    catalog.write_catalog(catalog.read_catalog(spark, str(tmp_path / "c.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_names_and_merges(spark):
    df = spark.createDataFrame([("a", "rides.pdf", "k1l2m3", ""), ("a", "rides.pdf", "n4o5p6", ""), ("b", "rides.pdf", "x", "")], "plan_id string, filename string, doc_id string, source_url string")
    assert {(r.plan_id, r.filename) for r in catalog.dedupe_filenames(df).collect()} == {("a", "rides.pdf"), ("a", "rides_n4o5p6.pdf"), ("b", "rides.pdf")}
    new = spark.createDataFrame([("a", "new.pdf", "n", "")], df.schema)
    assert {r.filename for r in catalog.merged_by_plan(df, new).collect()} == {"new.pdf", "rides.pdf"}
    assert catalog.slugs("Night & Day Rides", "pinned")[0] == "pinned" and "night-day-rides" in catalog.slugs("Night & Day Rides")


def test_pages_and_sitemaps(spark):
    html = '<a href="/docs/AB12.pdf#p2">AB12  <b>Intake</b></a><a href="http://[bad">x</a><a href="other.html">no</a>'
    pages = spark.createDataFrame([("https://x.org/list/", html), (None, html), ("https://x.org/", None)], "url string, html string")
    assert [tuple(r) for r in catalog.page_links(pages, [".pdf"]).collect()] == [("https://x.org/docs/AB12.pdf", "AB12 Intake", "https://x.org/list/")]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.org/a.pdf</loc></url><url><loc>https://x.org/b.html</loc></url></urlset>'
    assert [r.url for r in catalog.sitemap_urls(spark.createDataFrame([(xml,)], "xml string"), include=[".pdf"]).collect()] == ["https://x.org/a.pdf"]
    found = catalog.site_catalog(catalog.page_links(pages, [".pdf"]), "p", ["policy"])
    r = found.first()
    assert (r.policy_number, r.doc_kind, r.filename) == ("AB12", "policy", "AB12_Intake.pdf")


def test_apis(spark):
    body = [{"id": "1", "number": "AB12", "title": "Intake", "published": "2024-01-02T00:00", "files": [{"url": "u", "name": "n"}]}, {"id": "2", "files": []}]
    r = catalog.policies_api(spark.createDataFrame([(json.dumps(body),)], "json string"), "p").collect()
    assert len(r) == 1 and (r[0].department, r[0].status, r[0].date_published) == ("Unspecified", "Unknown", "2024-01-02")
    portal = {"data": [{"id": "7", "name": "QX7 Rides", "publicUrl": "u", "breadcrumbs": [{"trail": [{"name": "x"}, {"name": "Nights"}]}]}]}
    r = catalog.documents_api(spark.createDataFrame([(json.dumps(portal),)], "json string"), "p").first()
    assert (r.policy_number, r.title, r.department) == ("QX7", "Rides", "Nights")
    with pytest.raises(Exception, match="schema has changed"):
        catalog.documents_api(spark.createDataFrame([('{"data": [{"x": 1}]}',)], "json string"), "p").collect()


def test_files_and_publishing(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "f" / "b.pdf").write_bytes(b"<html>")
    assert [r.path.rsplit("/", 1)[1] for r in catalog.pdf_files(spark, str(tmp_path / "f")).collect()] == ["a.pdf"]
    for n in (1, 2):
        catalog.publish(spark.range(n), str(tmp_path / "live"))
        assert spark.read.parquet(str(tmp_path / "live")).count() == n
    store = spark.createDataFrame([("a", 1), ("b", 1)], "origin string, v int")
    assert {tuple(r) for r in catalog.upserted(store, spark.createDataFrame([("a", 2)], store.schema)).collect()} == {("a", 2), ("b", 1)}
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, text string")
    assert [len(r.embedding) for r in catalog.embedded(texts).collect()] == [64, 64]
    assert [(r.start, r.chunk) for r in catalog.chunked(spark.createDataFrame([("abcdef",)], "text string"), 4, 0.5).collect()] == [(1, "abcd"), (3, "cdef"), (5, "ef")]


def test_records(spark):
    bundle = {"entry": [{"resource": {"resourceType": "Patient", "id": "p", "birthDate": "1990-06-15", "gender": "f"}}, {"resource": {"resourceType": "Condition", "code": {"text": "Homeless (finding)"}}}, {"resource": {"resourceType": "Claim"}}]}
    df = spark.createDataFrame([(json.dumps(bundle),), ("not json",), ('{"entry": []}',)], "json string")
    r = records.cohort(df, ["homeless"], ["stroke"], "2024-06-14").collect()
    assert [(x.member_id, x.age, x.conditions, x.claims, x.sdoh_flags, x.urgent_condition) for x in r] == [("p", 33, 1, 1, 1, 0)]
    oscal = {"catalog": {"groups": [{"id": "ac", "title": "Access", "controls": [{"id": "ac-2", "title": "Accounts", "params": [{"id": "x"}], "parts": [{"name": "statement", "prose": "A", "parts": [{"name": "item", "prose": "B"}]}], "controls": [{"id": "ac-2.1", "title": "Auto", "props": [{"name": "status", "value": "withdrawn"}]}]}]}]}}
    found = {r.id: r for r in records.controls(spark.createDataFrame([(json.dumps(oscal),)], "json string")).collect()}
    assert set(found) == {"AC-2", "AC-2(1)"} and found["AC-2"].statement == "A B" and found["AC-2(1)"].parent == "ac-2" and found["AC-2(1)"].withdrawn
    cat = spark.createDataFrame([("A", "t", False, ["low"], 1), ("B", "t", False, ["high"], 2), ("C", "t", True, ["low"], 0)], "id string, title string, withdrawn boolean, baselines array<string>, n_params int")
    out, warned = contract.passport_controls(cat, "low", spark.createDataFrame([("A", "x"), ("B", " y  z "), ("Q", "")], "id string, reason string"), spark.createDataFrame([("A", "host")], "id string, source string"))
    assert {(r.id, r.origin, r.reason) for r in out.collect()} == {("A", "baseline:low", ""), ("B", "addition", "y z"), ("A", "inherited", "from: host")}
    assert {r.id for r in warned.collect()} == {"A", "Q"}
    assert {r.origin: r.params for r in contract.passport_summary(out).collect()} == {"baseline:low": 1, "addition": 2, "inherited": 1}


def test_citations(spark):
    shown = spark.createDataFrame([("APL 31-407", 6)], "policy_number string, page int")
    answers = spark.createDataFrame([(1, "APL 31-407 page 6"), (2, "APL 61-204 page 6"), (3, "page 6"), (4, None)], "id int, answer string")
    got = {r.id: (r.cited, r.unverified, r.uncited) for r in retrieval.verified_citations(answers, shown).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (0, 0, True), 4: (0, 0, True)}


def test_bm25_statistics_follow_the_filter(spark):
    rows = [(str(i), "timetable " + "x " * i) for i in range(5)] + [("5", "other text")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = retrieval.bm25(df, "timetable").collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and len(got) == 5
    narrow = {r.chunk_id: r.score for r in retrieval.bm25(df.where("chunk_id in ('0', '5')"), "timetable").collect()}
    assert narrow["0"] != {r.chunk_id: r.score for r in got}["0"]


def test_streams_equal_batches(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "case.created", t), (1, "disposition.recorded", t + dt.timedelta(hours=800)), (2, "case.created", t + dt.timedelta(days=1)), (2, "disposition.recorded", t + dt.timedelta(days=2)), (3, "case.created", t)]
    df = spark.createDataFrame(rows, "case_id bigint, event_type string, occurred_at timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = streams.event_stream(spark, str(tmp_path / "in"), df.schema)
    streams.case_clocks(s).writeStream.outputMode("update").format("memory").queryName("clocks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.case_id, r.breached) for r in spark.table("clocks").collect()} == {(1, True), (2, False), (3, False)}
    streams.incremental(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck2"), lambda b: b).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_pdf_text():
    from plumbline.queries_sources import pdf_of

    pages = ["One (two) \\three\nfour", "fünf\n\nsechs", ""]
    assert documents.pdf_pages(pdf_of(pages)) == ["One (two) \\three\nfour", "fünf\n\nsechs", ""]
    assert documents.pdf_pages(b"<html>") is None and documents.pdf_pages(pdf_of([" "])) is None and documents.pdf_pages(b"%PDF-1.4 broken") is None


def test_connector_batches_and_retries():
    import pyarrow as pa

    calls = []

    def service(texts):
        calls.append(len(texts))
        if len(calls) in (1, 3):
            raise documents.Busy(0.0)
        return [[float(len(t))] for t in texts]

    batch = pa.RecordBatch.from_pydict({"id": list(range(5)), "text": ["a", None, "ccc", "dd", "e"]})
    out = pa.Table.from_batches(documents.connector(service, batch=2, wait=0)([batch])).to_pydict()
    assert [v[0] for v in out["embedding"]] == [1, 0, 3, 2, 1] and calls == [2, 2, 2, 2, 1]
    with pytest.raises(documents.Busy):
        list(documents.connector(lambda t: (_ for _ in ()).throw(documents.Busy(0.0)), tries=2, wait=0)([batch]))
    with pytest.raises(ValueError, match="embeddings of"):
        list(documents.connector(lambda t: [], batch=9)([batch]))
    with pytest.raises(ValueError, match="unknown provider"):
        documents.embedder("none")


def test_missing_stores(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.published(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        records.control_catalog(spark, str(tmp_path / "none"))


def test_robots_that_fail_allow_all(spark):
    links = spark.createDataFrame([("https://a.example/x",), ("https://a.example/y",), ("https://b.example/x",)], "url string")

    def fetch(u):
        if "b.example" in u:
            raise OSError
        return b"User-agent: *\nDisallow: /x"

    assert {r.url for r in crawl.with_robots(links, fetch).collect()} == {"https://a.example/y", "https://b.example/x"}
    assert crawl.with_robots(links.limit(0), fetch).count() == 0


def test_paged_of_nothing(spark):
    assert crawl.paged(spark, lambda offset, size: (0, [])).count() == 0


def test_control_catalogs_are_bounded(spark, tmp_path):
    from plumbline import queries_sources

    spark.range(2500).selectExpr("id p_partkey", "concat('n', id) p_name", "'Brand#1' p_brand", "'t' p_type", "cast(id % 50 as int) p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = [r.json.count('"name":"status"') for r in queries_sources.control_catalogs(spark, str(tmp_path)).collect()]
    assert len(found) == 3 and sum(found) == 2500 and max(found) <= 1000


def test_cohort_summary_makes_members_once(spark):
    from plumbline.sources import records

    made = spark.sparkContext.accumulator(0)

    def age(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    m = spark.range(40).selectExpr("cast(id as int) age", "1 conditions", "2 encounters", "0 sdoh_flags", "1 urgent_condition")
    found = records.cohort_summary(m.mapInArrow(age, m.schema)).first()
    assert (found.members, found.median_age, found.urgent) == (40, 19.5, 40) and made.value == 40


@pytest.mark.parametrize("name", ["f32_settings", "g22_descendants", "g23_backdoor_paths", "g24_blocked", "g25_adjustment_set", "g26_model_checks"])
def test_settings_and_diagrams_are_asked_about_every_part(spark, sf, name):
    from plumbline import queries

    assert "part.parquet" in str(queries.QUERIES[name](spark, sf).inputFiles())


def test_index_counts_words_chunk_by_chunk(spark, tmp_path):
    texts = [(1, "The cat's the Hat, THE\nCAT a\tbb ccc-ccc"), (2, None), (3, ""), (4, "\u212aelvin \u0130stan na\u00efve \u03a3ABC x9y 2024"), (5, "one"), (5, "one two")]
    df = spark.createDataFrame(texts, "chunk_id int, text string")
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", " "), " +")
    want = df.select("chunk_id", F.explode(F.filter(words, lambda w: F.length(w) > 2)).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("n"))
    documents.build_indexes(df, str(tmp_path))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/postings").collect())) == sorted(map(tuple, want.collect()))
    (one,) = documents._counted([pa.RecordBatch.from_pydict({"chunk_id": [7], "text": ["a row a word, not a row an occurrence: word row"]})])
    assert one.num_rows == len(set(one["term"].to_pylist())) == 4 and sum(one["n"].to_pylist()) == 7


def test_unit_makes_its_norm_once(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([],), (None,), ([0.0, 1.0],)], "v array<double>")
    assert [r[0] for r in v.select(retrieval.unit(F.col("v"))).collect()] == [[0.6, 0.8], [], None, [0.0, 1.0]]
    plan = v.select(retrieval.unit(F.col("v")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("SQRT") == 1 and "array(struct(" in plan  # beside the components, not within each
