from pyspark.sql import functions as F

from siftmesh.functions import charsets as B
from siftmesh.functions import http as H
from siftmesh.operators import storage as K
from siftmesh.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "urls").write_text("# list\nhttp://a/\n\nb.test/x\nhttp://a/\n")
    assert sorted(r[0] for r in files.url_list(spark, str(tmp_path / "urls")).collect()) == ["http://a/", "http://b.test/x"]
    (tmp_path / "stop").write_text("The # article\nof\n" + "x" * 17 + "\n#none\n")
    assert sorted(tuple(r) for r in files.stopword_list(spark, str(tmp_path / "stop"), "en").collect()) == [("en", "of"), ("en", "the")]


def test_robots_groups(spark):
    body = "User-agent: evil\nDisallow: /\n\nUser-agent: SIFT\nUser-agent: more\nDisallow: /a # x\nDisallow: /b c\n\nUser-agent: *\nDisallow:\n"
    rows = spark.createDataFrame([(1, body), (2, None), (3, "nonsense")], "site_id long, body string")
    assert sorted(tuple(r) for r in files.robots_rules(rows, "siftmesh").collect()) == [(1, "/a"), (1, "/b")]


def test_headers(spark):
    text = "HTTP/1.1 200 OK\r\nX-A: 1\r\nx-a: 2\r\nContent-Type: Text/HTML; Charset=\"UTF-8\"\r\n broken\r\n"
    row = spark.range(1).select(H.headers(F.lit(text)).alias("h")).first()["h"]
    assert row == {"x-a": "2", "content-type": 'Text/HTML; Charset="UTF-8"'}
    out = spark.range(1).select(H.content_type(F.lit(row["content-type"])), H.charset(F.lit(row["content-type"])), H.content_type(F.lit("")), H.next_visit(F.lit(0), 10, F.lit("Thu, 01 Jan 1970 00:01:00 GMT")), H.next_visit(F.lit(0), 10, F.lit("-1"))).first()
    assert tuple(out) == ("text/html", "utf-8", None, 60, 10)
    assert [r[0] for r in spark.createDataFrame([(200,), (302,), (404,), (503,), (304,), (777,), (None,)], "s int").select(H.status_class(F.col("s"))).collect()] == ["ok", "redirect", "delete", "retry", "unchanged", "unknown", "unknown"]


def test_charset_guess():
    texts = {"fr": "façade élève où déjà très garçon", "de": "über schön größer müssen straße"}
    profiles = {f"{k}-{c}": B.profile([t.encode(c)]) for k, t in texts.items() for c in ("utf-8", "latin-1")}
    assert B.guess("déjà une façade".encode("latin-1"), profiles) == "fr-latin-1"
    assert B.guess("größer und schön".encode(), profiles) == "de-utf-8"
    assert B.guess(b"", profiles) is None and B.guess(None, profiles) is None and B.guess(b"12345", profiles) is None


def test_segments():
    assert B.segments("私は東京大学AbC1へ", frozenset(["東京", "東京大学", "大学"])) == ["私", "は", "東京大学", "abc1", "へ"]
    assert B.segments("", frozenset()) == []


def test_snapshots_and_logs(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    K.publish(spark.range(3), folder)
    old = K.current(spark, folder)
    K.publish(spark.range(5), folder)
    assert old.count() == 3 and K.current(spark, folder).count() == 5
    for i in range(2):
        K.log_query(spark, f"file://{tmp_path}/log", f"q{i}", "1.2.3.4", 1, 2, 0.5, 0.75)
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == 2 and log.schema["start"].dataType.simpleString() == "decimal(15,3)"
    assert K.result_key("a", 1) == K.result_key("a", 1) != K.result_key("a", 2)


def test_saved_spaces_and_masks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (3, "d")], "k long, v string")
    assert sorted(tuple(r) for r in K.saved(old, new, "k").collect()) == [(1, "a"), (2, None), (3, "d")]
    urls = spark.createDataFrame([("http://a/x", 1), ("http://b/", 2), (None, 1)], "url string, tag int")
    assert [r["url"] for r in K.cleared(urls, {"url": ["http://a/%"], "tag": [1, 5]}).collect()] == ["http://b/", None]
    assert K.cleared(urls, {}).count() == 0
    subsets = spark.createDataFrame([(1, "http://%"), (2, "%/x"), (2, "http://a%"), (3, None)], "subset_id int, mask string")
    rows = K.subset_urls(urls.withColumnRenamed("tag", "url_id"), subsets)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_results_are_kept_until_they_are_too_many_or_old(spark):
    from siftmesh.session import Scratch

    cache, runs = K.ResultCache(Scratch(spark, "cache"), most=2), []

    def search(n):
        runs.append(n)
        return spark.range(n)

    ask = lambda n: cache.get(K.result_key("query", n), lambda: search(n)).count()
    assert [ask(n) for n in (1, 2, 1, 3, 1, 2)] == [1, 2, 1, 3, 1, 2] and runs == [1, 2, 3, 2]
    cache.clear()
    assert ask(2) == 2 and runs == [1, 2, 3, 2, 2]


def test_a_part_of_the_log_is_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (101, "b"), (2, "c"), (None, "d")], "word_id long, v string")
    K.append_changes(rows, f"{tmp_path}/log")
    K.append_changes(rows.limit(1), f"{tmp_path}/log")
    assert sorted(r["v"] for r in K.logged_changes(spark, f"{tmp_path}/log", 1).collect())[-1] == "b"
    assert K.logged_changes(spark, f"{tmp_path}/log").count() == 5 and {p.name for p in (tmp_path / "log").glob("part=*")} == {"part=1", "part=2", "part=__HIVE_DEFAULT_PARTITION__"}
