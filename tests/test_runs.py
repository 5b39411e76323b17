import functools
import json
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagemill.operators import dedupe, guarded, incremental, records, rows, summary
from pagemill.operators import pages as whole
from pagemill.plans import registry
from pagemill.sources import readers, sink, writers
from pagemill.streaming import live

HTML = """<html lang="en"><head><title>é "q", x</title></head><body><h1>H</h1><div><p class="i"><a href="/a">Title one</a> £5</p>
<p class="i"><a href="/b">Title two</a> £6</p><p class="i"><a href="/c"></a> some other</p></div>
<table><tr><th>a<th></tr><tr><td>1<td>2</table><img src=x></body></html>"""


@pytest.fixture
def run(spark, page, tmp_path):
    return writers.save_extracted(whole.extract_pages(page(HTML)), str(tmp_path / "run"))


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text(HTML, encoding="utf-8")
    pages = readers.read_html_files(spark, str(tmp_path / "*.html"))
    row = pages.first()
    assert row.url == (tmp_path / "a.html").as_uri() and row.method == "local-file" and row.html == HTML
    assert rows.page_header(pages).first().title == 'é "q", x'


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":\n1}')
    (tmp_path / "b.json").write_text("{broken")
    payloads = readers.read_json_payloads(spark, str(tmp_path))
    assert payloads.count() == 2
    assert readers.parsed_payloads(payloads).count() == 1


def test_payloads_as_files_of_their_own(spark, tmp_path, monkeypatch):
    """Folders don't grow with the files one by one, and every row has its file: repeated and missing keys too."""
    monkeypatch.setattr(writers, "FOLDER_FILES", 50)
    rows = [(n % 290, f'{{"n":\n{n}}}') for n in range(300)] + [(None, '{"é": 1}'), (-7, None), (5, "")]
    table = spark.createDataFrame(rows, "id long, body string").repartition(3)
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        sources = writers.write_payload_files(table, folder, "id")
        written = [p for p in (tmp_path / folder[-1]).rglob("*") if not p.name.endswith(".crc")]
        assert sum(p.is_file() for p in written) == sources.distinct().count() == len(rows)
        assert sum(p.is_dir() for p in written) <= 3 + 9
        back = readers.read_payload_files(sources)
        found = [(int(k) if (k := r.source.rpartition("-id=")[2].removesuffix(".json")) else None, r.body) for r in back.collect()]
        assert sorted(found, key=repr) == sorted(((k, b or "") for k, b in rows), key=repr)
    names = spark.createDataFrame([("a/../b %2F é", "1")], "k string, body string")
    assert readers.read_payload_files(writers.write_payload_files(names, f"file://{tmp_path}/c", "k")).first().body == "1"


def test_pages_as_files_of_their_own(spark, tmp_path, monkeypatch):
    """Folders don't grow with the pages, texts of one page are one file, and pages without an id come back without one."""
    monkeypatch.setattr(writers, "FOLDER_FILES", 50)
    html = "<html lang=en><title>{}</title>é"
    rows = [(n, html.format(n)) for n in range(300)] + [(-7, html.format("below")), (400, None), (401, ""), (402, html)]
    more = [(5, html.format(5)), (6, html.format("a 6"))] + [(None, html.format(c)) for c in "ab"]
    headers = [(n, str(n), "en") for n in range(300)] + [(-7, "below", "en"), (400, "", ""), (401, "", ""), (402, "{}", "en")]
    for n, (table, expected) in enumerate([(rows, headers), (rows + more, headers + [(None, c, "en") for c in "ab"])]):
        found, out = f"{tmp_path}/{n}", tmp_path / f"out {n}"
        pages = [(page_id, f"https://a.example/{page_id}", text) for page_id, text in table]
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{found}/pages.parquet")
        monkeypatch.setattr(registry, "new_folder", lambda spark, name, out=out: str(out))
        result = [tuple(r) for r in entry.queries()["html_files"](spark, found).collect()]
        assert sorted(result, key=repr) == sorted(expected, key=repr)
        written = [p for p in out.rglob("*") if not p.name.endswith(".crc")]
        assert sum(p.is_file() for p in written) == len(expected)
        assert sum(p.is_dir() for p in written) <= 5 * 4 + 300 / 50
    names = [("a/../b %2F é", "1"), ("x", "2\r\n"), ("x", "<p>"), ("(q)", None), (None, html), (None, html)]
    named = writers.write_html_files(spark.createDataFrame(names, "k string, html string"), f"{tmp_path}/b %20c", "k")
    back = readers.read_html_files(spark, named).collect()
    assert sorted(r.html for r in back) == sorted(["1\n", "2\r\n\n<p>\n", "\n", html + "\n", html + "\n"])
    by_path = readers.read_html_files(spark, f"{tmp_path}/b %20c/*/*/*.html").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, by_path))


def test_exports(spark, run, tmp_path):
    meta = summary.run_meta(run, preset="none")
    out = str(tmp_path / "out")
    written = writers.export_all(run, out, {"csv", "json", "jsonl", "tables"}, meta)
    assert len(written) == 6 + 5 + 1 + 6
    items = readers.read_report_csv(spark, out + "/items.csv", "page_id bigint, `index` int, title string, price string")
    assert [tuple(r) for r in items.orderBy("index").collect()] == [(1, 1, "Title one", "£5"), (1, 2, "Title two", "£6"), (1, 3, "", "")]
    document = json.loads(spark.read.json(out + "/run.json").first().document)
    assert document["meta"]["title"] == 'é "q", x' and len(document["items"]) == 3
    assert document["tables"][0]["rows"] == [["1", "2"]]
    saved = spark.read.parquet(out + "/data/qa_issues")
    assert {"page", "check_name", "where_clause"} <= set(saved.columns)
    assert spark.read.parquet(out + "/data/run_meta").first().preset == "none"
    cells = spark.read.csv(out + "/tables.csv", header=True)
    assert cells.where("col_name = 'col_2'").first().cell == "2"
    files = writers.manifest_files(spark, out)
    found = writers.manifest(meta, summary.run_counts(run), files).first()
    assert found.counts["items"] == 3 and found.schema_version == "2.0" and found.files.n == files.count() > 10
    assert all((Path(out) / f.file).is_file() for f in files.collect())
    with pytest.raises(ValueError, match="Unknown format"):
        writers.export_all(run, out, {"xml"})


def test_saved_tables(spark, run):
    spark.sql("create database if not exists pm_test")
    try:
        for _ in range(2):
            writers.save_tables(run, database="pm_test")
        assert spark.table("pm_test.items").count() == 3
        assert "idx" in spark.table("pm_test.items").columns
    finally:
        spark.sql("drop database pm_test cascade")


def test_missing_report(spark, tmp_path):
    assert readers.read_report_csv(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    (tmp_path / "bom.csv").write_text("a,b\n1,x\n,\"two\nlines\"\n", encoding="utf-8-sig")
    got = readers.read_report_csv(spark, str(tmp_path / "bom.csv"), "a int, b string, c string").collect()
    assert [tuple(r) for r in got] == [(1, "x", ""), (None, "two\nlines", "")]


def test_sink(spark, run, tmp_path):
    items, path = whole.family(run, "items"), str(tmp_path / "sink")
    assert writers.push(items.where("false"), path) == 0
    assert [writers.push(items, path, m) for m in ("replace", "append", "append", "replace", "append")] == [3] * 5
    back = writers.pushed(spark, path)
    assert sorted(back.columns) == sorted( ["page", "index", "title", "price", "link", "image", "text", "fingerprint"])
    assert back.count() == 6
    with pytest.raises(ValueError):
        writers.push(items, path, "other")
    failing = items.withColumn("title", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        writers.push(failing, path, "replace")
    assert writers.pushed(spark, path).count() == 6


def test_rows_of_lost_attempts_do_not_count(spark, tmp_path):
    """A task that fails after it has written, and is run again, leaves no rows twice."""
    path = str(tmp_path / "sink")
    writer = sink.RowWriter(["a", "b"], path, "p1", overwrite=False)
    lost = writer.write(iter([("1", "x"), ("2", None)]))
    again = writer.write(iter([("1", "x"), ("2", None)]))
    empty = writer.write(iter([]))
    writer.commit([again, empty, None])
    assert len(list((tmp_path / "sink/data").iterdir())) == 2 and lost.files != again.files
    assert sorted(map(tuple, sink.read_rows(spark, path).collect()), key=repr) == [("1", "x"), ("2", None)]
    failed = sink.RowWriter(["a", "b"], path, "p2", overwrite=True)
    failed.abort([failed.write(iter([("9", "9")])), None])
    assert sink.read_rows(spark, path).count() == 2 and not list((tmp_path / "sink/commits").glob("p2*"))
    second = sink.RowWriter(["a", "b"], path, "p3", overwrite=True)
    second.commit([second.write(iter([("3", "é")]))])
    assert [tuple(r) for r in sink.read_rows(spark, path).collect()] == [("3", "é")]
    assert sink.read_commits(spark, path).first().push == "p3"


def test_manifest_of_odd_files(spark, tmp_path):
    names = {"empty.txt": 0, "b c.txt": 3, "_m.txt": 1, "sub/.hidden": 2, "sub/deep/é#?.json": 5}
    for name, size in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    for at_once in (2, 5, 100):
        got = writers.manifest_files(spark, f"file://{tmp_path}", at_once)
        assert {r.file: r.bytes for r in got.collect()} == names
    (tmp_path / "nothing").mkdir()
    assert writers.manifest_files(spark, str(tmp_path / "nothing")).count() == 0


def test_manifest_has_empty_families(spark, run, tmp_path):
    out = str(tmp_path / "out")
    writers.export_all(run.where("false"), out, {"csv", "jsonl"})
    folders = {f.file.split("/")[0] for f in writers.manifest_files(spark, out).collect()}
    assert len(folders) == 11


def test_summaries(spark, run):
    counts = {r.what: r.n for r in summary.run_counts(run, checked_links=4).collect()}
    assert counts["items"] == 3 and counts["tables"] == 1 and counts["checked_links"] == 4
    assert summary.page_metrics(run).first().n_images == 1
    columns = "title string, price string, link string, image string, fingerprint string"
    items = spark.createDataFrame([("a", "1", "l", "i", "f"), (" ", "", "l", "", "f"), ("b", "2", "", "i", "")], columns)
    issues = spark.createDataFrame([("High",), ("high",), ("Low",)], "severity string")
    done = summary.completeness(items, issues)
    assert done.first().asDict() == {
        "total": 3, "missing_title": 1, "missing_price": 1, "missing_link": 1, "missing_image": 1,
        "duplicate_fingerprints": 1, "qa_issues_total": 3, "qa_issues_high": 2,
    }
    text = summary.quality_summary(done).first().summary
    assert text == "1 missing titles; 1 missing prices; 1 duplicates; 2 HIGH-severity issues"
    good = summary.completeness(items.where("title = 'a'"), issues.where("false"))
    assert summary.quality_summary(good).first().summary.startswith("clean")
    cells = spark.createDataFrame([("£10",), ("£9.5",), ("none",), ("$1,000",)], "price string")
    assert [r.price for r in summary.report_sort(cells, "price").collect()] == ["£9.5", "£10", "$1,000", "none"]
    assert summary.preview(cells.withColumn("page_id", F.lit(1)), "links").count() == 4


def test_incremental(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", ""), (2, "u2", "u3"), (3, "u3", "")], "page_id bigint, url string, next_url string")
    path = str(tmp_path / "done")
    incremental.mark_done(pages.where("page_id = 2"), path)
    incremental.mark_done(pages.where("page_id = 2"), path)  # a run that was repeated
    done = incremental.done_pages(spark, path)
    assert done.count() == 1 and done.first().asDict() == {"page_id": 2, "url": "u2", "next_url": "u3", "finished": False}
    left = incremental.pending_pages(pages, done)
    assert {r.url for r in left.collect()} == {"u1", "u3"}
    incremental.mark_done(left, path, finished=True)
    assert incremental.done_pages(spark, path).count() == 3
    bits = incremental.done_bits(spark, path)
    assert incremental.pending_pages(pages, incremental.done_pages(spark, path), bits=bits).count() == 0
    jobs = spark.createDataFrame([("a", 1), ("b", 1)], "name string, t int")
    changes = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "name string, t int")
    merged = incremental.upsert(jobs, changes, "name", ["t"])
    assert {tuple(r) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 2)}
    assert incremental.remove(jobs, changes, "name").count() == 1


def test_only_urls_that_may_be_done_are_compared(spark):
    done = spark.range(3000).selectExpr("concat('http://h/', id) as url")
    pages = spark.range(2000, 12000).selectExpr("id as page_id", "concat('http://h/', id) as url").union(spark.sql("select -1L, cast(null as string)"))
    bits = incremental.url_bits(done)
    flagged = incremental.maybe_seen(pages, bits)
    compared = flagged.where("maybe")
    assert 1000 <= compared.count() < 1100 and flagged.count() == 10_001
    assert compared.join(done, "url", "left_semi").count() == 1000
    left = incremental.pending_pages(pages, done, bits=bits)
    assert left.columns == pages.columns and left.count() == 9001
    full = spark.range(incremental.RANGES).selectExpr("cast(id as int) as range", f"explode(sequence(0, {incremental.WORDS - 1})) as word", "-1L as bits")
    assert incremental.maybe_seen(pages, full).where("not maybe").count() == 0
    assert incremental.pending_pages(pages, done, bits=full).count() == 9001
    assert incremental.pending_pages(pages, done.limit(0)).count() == 10_001


def test_first_rows_by_address(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, -3, 0, 2**62, -(2**63)]), rng.choice([None, 1, -7]), rng.choice("xyz")) for _ in range(400)]
    table = spark.createDataFrame(rows, "k string, n bigint, m int, s string")
    place = lambda r: tuple((v is not None, v or 0) for v in r[1:3])
    for order, last in ((["n", "m"], False), (["n", "m"], True)):
        got = dedupe.first_rows(table, ["k"], order, last).collect()
        want = {k: (max if last else min)(place(r) for r in rows if r[0] == k) for k in (None, "a", "b", "c")}
        assert {r.k: place(r) for r in got} == want
        assert all(tuple(r) in rows for r in got)
    by_text = dedupe.first_rows(table, ["k"], ["s", "n"]).collect()
    assert all(r.s == "x" for r in by_text) and {r.k for r in by_text} == {None, "a", "b", "c"}
    unique = table.distinct()
    assert dedupe.first_rows(unique, ["k", "s"], ["n", "m"]).count() >= 12
    plan = dedupe.first_rows(table, ["k"], ["n", "m"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    stamped = table.selectExpr("k", "timestamp_micros(coalesce(n, 0) div 1000000) as t", "cast(date_from_unix_date(coalesce(m, 0)) as date) as d", "m")
    latest = dedupe.first_rows(stamped, ["k"], ["t", "d"], last=True)
    assert {r.t for r in latest.collect()} == {stamped.agg(F.max("t")).first()[0]}


def test_report_order_is_natural(spark):
    rng = random.Random(8)
    cells = ["£10", "£9.5", "$1,000", "none", "item 10", "Item 9", "item 010", "item 2b", "alpha", "Beta", "beta 2", "beta 10", "", "7", "-3", "a1b22", "a1b3"]
    cells += [f"page {rng.randrange(300)} of {rng.randrange(30)}" for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(cells)), "pos int, price string").repartition(3)

    def number(text):
        found = re.fullmatch(r"\s*[^\d\-\s]{0,4}\s?(-?\d[\d,]*(?:\.\d+)?)\s?[^\d\s]{0,4}\s*", text)
        return float(found[1].replace(",", "")) if found else None

    def compare(a, b):
        x, y = number(cells[a]), number(cells[b])
        if (x is None) != (y is None):
            return -1 if y is None else 1
        if x is None:
            x, y = ([(0, int(p)) if p.isdigit() else (1, p) for p in re.findall("[0-9]+|[^0-9]+", cells[n].lower())] for n in (a, b))
        return (x > y) - (x < y) or a - b

    want = sorted(range(len(cells)), key=functools.cmp_to_key(compare))
    placed = summary.with_place(summary.report_sort(table, "price"))
    assert [r.pos for r in placed.orderBy("place").collect()] == want
    assert [r.place for r in placed.orderBy("place").collect()] == list(range(1, len(cells) + 1))
    falling = [cells[r.pos] for r in summary.report_sort(table, "price", ascending=False).collect()]
    assert [number(c) is None for c in falling] == sorted((number(c) is None for c in cells), reverse=True)


def test_limits_of_previews(spark):
    rows = spark.range(1200).selectExpr("id div 7 as page_id", "cast(id % 7 as int) as pos", "id")
    for kind, n in summary.PREVIEW_ROWS.items():
        shown = [r.id for r in summary.preview(rows.repartition(5), kind).collect()]
        assert shown == list(range(min(n, 1200)))


def test_only_families_asked_for_are_worked_out(spark, page):
    def plan(**families):
        spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
        return whole.extract_pages(page(HTML), **families)._jdf.queryExecution().optimizedPlan().toString()

    least, links, full = plan(families=()), plan(families=["links"]), plan()
    named = lambda text: {f for f in whole.FAMILIES if re.search(rf"\b{f}\b", text)}
    assert named(least) <= {"items"} and named(links) - {"items"} == {"links"} and named(full) == set(whole.FAMILIES)
    assert len(least) < len(links) < len(full)
    whole_row = whole.extract_pages(page(HTML)).first().asDict()
    for families in ((), ["links"], ["items", "issues"], ["tables"]):
        some = whole.extract_pages(page(HTML), families=families).first().asDict()
        assert {f for f in whole.FAMILIES if f in some} == set(families) and all(whole_row[c] == v for c, v in some.items())
    with pytest.raises(KeyError, match="Unknown families"):
        plan(families=["none"])


def test_stream_keeps_the_first_by_place(spark, tmp_path):
    """Equal to the batch on shuffled arrival; state goes when the delay is over."""
    rng = random.Random(3)
    rows = [(rng.randrange(30), n // 10, n % 10, f"2024-01-01 00:{rng.randrange(60):02}:00") for n in range(300)]
    table = spark.createDataFrame(rows, "k int, page_id bigint, `index` int, ts string")
    columns = ["page_id", "index", "cast(ts as timestamp) as ts", "concat('http://h/', k) as link", *[f"'' as {c}" for c in ("image", "title", "price", "text")]]
    items = table.selectExpr(*["`index`" if c == "index" else c for c in columns])
    late = items.limit(1).selectExpr("99L as page_id", "`index`", "cast('2024-01-09' as timestamp) as ts", "'http://h/new' as link", "image", "title", "price", "text")
    incoming, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def step(batch):
        batch.coalesce(1).write.mode("append").parquet(incoming)
        stream = live.stream_files(spark, incoming, items.schema)
        return live.drain(live.stream_dedupe(stream, "ts", "2 hours"), "dedupe", out, mark)

    for n in range(3):
        found = step(items.where(F.pmod(F.hash("page_id", "index"), F.lit(3)) == n))
    want = dedupe.dedupe_items(items.drop("ts"))
    got = live.settled(found).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    step(late)
    states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in live.progress(spark)]
    assert max(states) >= 30 and states[-1] < 5


def test_errors_do_not_stop_a_run(spark):
    def f(row):
        return str(10 // row["id"])

    mapped = guarded.map_with_errors(spark.range(3), f)
    got = {r.id: (r.result, (r.error or "").split(":")[0]) for r in mapped.collect()}
    assert got == {0: (None, "ZeroDivisionError"), 1: ("10", ""), 2: ("5", "")}
    assert guarded.skip_bad_rows(mapped).count() == 2


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    incoming = str(tmp_path / "in")
    pages.where("page_id < 20").write.parquet(incoming)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def step():
        stream = live.stream_extract(live.stream_pages(spark, incoming), records.extract_items)
        return live.drain(stream, "items", out, mark)

    first = step().count()
    assert first == records.extract_items(pages.where("page_id < 20")).count()
    assert step().count() == first
    pages.where("page_id >= 20").write.mode("append").parquet(incoming)
    assert sorted(map(tuple, step().collect())) == sorted(map(tuple, records.extract_items(pages).collect()))
    with pytest.raises(ValueError):
        live.stream_extract(pages, rows.page_header)


# ---------------------------------------------------------------- registered queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


# Queries that SQL can't express, and the tests that hold them against brute force or a library.
BY_TEST = {
    "item_groups": "test_extract.py",
    "op1_quality": "test_llm_scores.py",
    "op4_bpe": "test_llm_tokens.py",
    "op5_token_counts": "test_llm_tokens.py",
    "op6_simhash": "test_llm_copies.py",
    "op7_token_files": "test_llm_tokens.py",
    "op8_repeats": "test_llm_copies.py",
    "op9_toxicity": "test_llm_scores.py",
    "pipeline": "test_llm_scores.py",
}


def test_every_query_has_its_sql_or_a_test_of_its_own():
    queries, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= queries and queries - sql <= set(BY_TEST) and not sql & set(BY_TEST)


def rounded(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize(
    "name",
    [
        "page_header", "extract_links", "links_by_host", "html_nodes", "nav_groups", "qa_header", "price_parse", "url_join",
        "catalog_items", "preset_items", "table_cells", "qa_rows", "qa_elements", "qa_issues", "dedupe_items", "json_items",
        "reply_items", "check_links", "robots_filter", "page_signals", "stream_dedupe", "upsert_users",
    ],
)
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    got = sorted(repr(rounded(r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(repr(rounded(r)) for r in expected.select(names).fetchall())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"host", "type", "n_links"}


def test_workers_do_not_need_the_package(tmp_path):
    """The queries with Python in them run where the package is not on the workers' path."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("html_nodes", "map_with_errors", "skip_bad_rows"):
    assert entry.queries()[name](spark, {SF!r}).count() > 0
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "done" in ran.stdout, ran.stderr[-2000:]
