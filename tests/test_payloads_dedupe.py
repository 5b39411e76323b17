import hashlib
import json

from pyspark.sql import functions as F

from pagemill.operators import dedupe, payloads


def frame(spark, bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")


def reference_path(data, path):
    """Plain reading of the path rules, for comparison."""
    if not data:
        return []
    if not path:
        return data if isinstance(data, list) else [data]
    steps = []
    for p in path.split("."):
        name = p.replace("[*]", "")
        steps += [name] if name or "[*]" not in p else []
        steps += ["*"] if "[*]" in p else []
    here = data
    for s in steps:
        if s == "*":
            return list(here) if isinstance(here, list) else []
        if isinstance(here, dict):
            here = here.get(s)
            if here is None:
                return []
        elif isinstance(here, list):
            return [e[s] for e in here if isinstance(e, dict) and e.get(s) is not None]
        else:
            return []
    return here if isinstance(here, list) else [here]


def test_json_path(spark):
    datas = [
        [{"a": 1}, {"a": 2}], {"products": [{"a": 1}, 5, None]}, {"data": {"items": [{"x": {"y": 1}}, {"x": None}]}},
        {"data": {"items": {"x": 3}}}, {"data": None}, {"data": "text"}, 7, "s", {"it's": [1]},
    ]
    paths = ["", "a", "products[*]", "products", "data.items", "data.items[*].x", "data.items.x", "data.items.x.y", "[*]", "none", "it's"]
    df = frame(spark, [json.dumps(d) for d in datas])
    value = payloads.try_json(F.col("body"))
    columns = [F.transform(payloads.json_path(value, p), lambda v: F.to_json(v)).alias(f"p{n}") for n, p in enumerate(paths)]
    for row in df.select("id", *columns).collect():
        for n, p in enumerate(paths):
            got = [json.loads(v) for v in row[f"p{n}"]]
            assert got == reference_path(datas[row.id], p), (datas[row.id], p)


def items(df):
    return [tuple(r) for r in df.orderBy("id", "index").select("id", "index", "title", "price", "link", "image", "text").collect()]


def test_items_guess_the_fields(spark):
    bodies = [
        json.dumps([{"Name": "A", "cost": "$1", "url": "u", "IMG": "i", "description": "d"}, "x", 4, {"Name": "B"}]),
        json.dumps({"title": "T" * 300, "price": 5, "value": 6}),
        "{}", "[]", '""', "not json", "", "null", "0", "7", '"text"',
    ]
    assert items(payloads.items_from_json(frame(spark, bodies))) == [
        (0, 1, "A", "$1", "u", "i", "d"), (0, 2, "B", "", "", "", ""), (1, 1, "T" * 300, "5", "", "", ""),
    ]


def test_items_with_a_map(spark):
    body = json.dumps({"data": {"products": [{"n": {"en": "N"}, "p": None, "t": [1]}, {"n": "flat"}]}})
    names = {"title": "n.en", "price": "p", "text": "t"}
    got = items(payloads.items_from_json(frame(spark, [body]), "data.products[*]", names))
    assert got == [(0, 1, "N", "", "", "", "[1]"), (0, 2, "", "", "", "", "")]
    many = json.dumps([{"name": f"Item {i}"} for i in range(100)])
    assert payloads.items_from_json(frame(spark, [many]), max_items=10).count() == 10
    one = frame(spark, ['[{"HEADLINE":1,"amount":2}]'])
    fields = {r.field: r.key for r in payloads.json_field_map(one).collect()}
    assert fields == {"title": "HEADLINE", "price": "amount", "link": "", "image": "", "text": ""}


def test_replies(spark):
    replies = [
        '```json\n[{"title": "A", "price": 1}]\n```', '{"items": [{"title": "B"}]}', '{"items": [], "data": [{"title": "C"}]}',
        "42", "sorry", '{"other": 1}', "```\n[]\n```",
    ]
    df = frame(spark, replies).withColumnRenamed("body", "text")
    got = [(r.id, r.title, r.price) for r in payloads.items_from_reply(df).orderBy("id").collect()]
    assert got == [(0, "A", "1"), (1, "B", ""), (2, "C", "")]


COLUMNS = "page_id bigint, `index` int, title string, price string, link string, image string, text string"


def test_dedupe(spark):
    rows = [
        (2, 1, "later", "", "https://x/1?id=2", "", ""), (1, 2, "first", "", "http://x/1;v#f", "", ""),
        (1, 1, "P", "1", "", "i.jpg", ""), (3, 1, "P", "2", "", "i.jpg", ""), (3, 2, "Q", "1", "", "", ""),
        (3, 3, "", "", "", "", "t" * 300), (3, 4, "", "", "", "z", "t" * 200 + "other"),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.page_id, r["index"]): r.fingerprint for r in dedupe.dedupe_items(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 2), (3, 3), (3, 4)}
    for at, key in [((1, 2), "x/1"), ((1, 1), "i.jpg|P"), ((3, 2), "Q|1"), ((3, 3), "t" * 300), ((3, 4), "t" * 200 + "other")]:
        assert got[at] == hashlib.sha1(key.encode()).hexdigest()[:16]
    assert dedupe.dedupe_stats(df).first().asDict() == {"items": 7, "unique": 5, "removed": 2}
    again = dedupe.dedupe_items(dedupe.dedupe_items(df).drop("fingerprint"))
    assert {(r.page_id, r["index"]) for r in again.collect()} == set(got)


def test_one_fingerprint_in_most_rows(spark):
    hot = spark.range(20000).select(
        F.col("id").alias("page_id"), F.lit(1).alias("index"), F.lit("t").alias("title"), F.lit("").alias("price"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://h/"), F.col("id"))).otherwise("http://h/same").alias("link"),
        F.lit("").alias("image"), F.lit("").alias("text"),
    )
    kept = dedupe.dedupe_items(hot)
    assert kept.count() == 1 + 6667
    assert kept.where("link = 'http://h/same'").first().page_id == 1


def test_urls(spark):
    df = spark.createDataFrame([("http://a/b/",), ("http://a/b#x",), ("http://a/b",), ("http://a/b?q=1",)], "url string")
    assert {r.norm_url for r in dedupe.dedupe_urls(df).collect()} == {"http://a/b", "http://a/b?q=1"}


def test_nothing_is_cut(spark):
    items = [{"title": "t" * 900, "url": "https://h/" + "u" * 900, "description": f"{n} " + "d" * 900} for n in range(1500)]
    payload = spark.createDataFrame([(1, json.dumps(items))], "id int, body string")
    got = payloads.items_from_json(payload)
    assert got.count() == 1500 and payloads.items_from_json(payload, max_items=7).count() == 7
    row = got.first()
    assert len(row.title) == 900 and len(row.link) == 910 and len(row.text) == 902
    text = "same " * 60
    rows_ = spark.createDataFrame([(1, n, "", "", "", "", text + str(n)) for n in range(2)], "page_id long, index int, title string, price string, link string, image string, text string")
    assert dedupe.dedupe_items(rows_).count() == 2


def test_unread_payloads_are_rows(spark):
    bodies = ['{"a": 1}', '{"a": 1, "a": 2}', "no json", "{}", None, "[1]"]
    table = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    assert sorted(r.id for r in payloads.rejected_payloads(table).collect()) == [1, 2, 4]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert sorted(r.id for r in payloads.rejected_payloads(table).collect()) == [2, 4]
        twice = spark.createDataFrame([(1, '[{"title": "a", "title": "b"}]')], "id int, body string")
        assert payloads.items_from_json(twice).first().title == "b"
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
