import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftmesh.operators import crawl as C
from siftmesh.operators import orphans as orphan_module
from siftmesh.operators.orphans import _compressed, _decoded, _merge, _packed, _unpacked, orphans
from siftmesh.operators.skewed_keys import numbered, per_key
from siftmesh.session import Scratch


def test_per_key_with_a_key_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k if k else None, int(o), int(v)) for k, o, v in zip(np.where(rng.random(6000) < 0.35, "hot", rng.integers(0, 300, 6000).astype(str)), rng.integers(0, 4000, 6000), rng.integers(0, 9, 6000))]
    rows = [(k, o, o % 7) for k, o, _ in rows] + [(None, 1, 1), ("x", None, 1)] + [("hot", 1, 1)] * 50
    got = {r["k"]: (r["n"], r["total"]) for r in per_key(spark.createDataFrame(rows, "k string, o long, v long"), "k", "o", {"total": "sum:v"}, tasks=16).collect()}
    want: dict = {}
    for k, o, v in set(rows):
        if k is not None and o is not None:
            n, t = want.get(k, (0, 0))
            want[k] = (n + 1, t + v)
    assert got == want


def test_heavy_keys_are_split(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("o"))
    sizes = rows.repartitionByRange(12, "k", "o").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 9000 / 12 * 2


def test_numbered_is_row_number(spark):
    rows = spark.range(2000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.hash("id").alias("o"), "id")
    got = numbered(rows, "k", ["o", "id"], Scratch(spark, "n"), tasks=9)
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    assert got.join(want, "id").where("place <> want").count() == 0 and got.count() == 2000


def test_a_hot_key_is_split_in_a_join(spark):
    from siftmesh.operators.skewed_keys import split_join

    left = spark.createDataFrame([(i % 3 if i % 3 < 2 else i, i) for i in range(90)] + [(None, 900)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (None, "d")], "k long, w string")
    for how in ("left", "inner"):
        plain, split = (sorted(map(str, split_join(left, right, "k", how, limit=limit).collect())) for limit in (10**6, 7))
        assert plain == split


def test_containers_keep_few_and_many_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 100, 60_000):
        low = np.sort(rng.choice(65536, n, replace=False))
        assert (_decoded(_compressed(low)) == low).all()
    for keys in ([5], [-(2**63), 2**63 - 1], [0, 1, 2, 300, 70_000, 2**40], list(range(-9, 9_000, 3))):
        assert _unpacked(_packed(np.array(keys, np.int64))).tolist() == keys


def test_orphans_of_far_apart_keys_and_one_key_with_most_references(spark, monkeypatch):
    """Against brute force: keys anywhere among 64 bits, a third of all references to one missing and to one living key, small ranges, parts and merges."""
    monkeypatch.setattr(orphan_module, "RANGE", 64)
    monkeypatch.setattr(orphan_module, "HOT_ROWS", 50)
    monkeypatch.setattr(orphan_module, "MERGED", 2)
    rng = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 4))
    keys = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    parents = [(s, k, rng.choice([0, 0, 1, None]), rng.choice([day(), day(), None]), True) for s in (0, 1) for k in keys[: 250 - 100 * s]]
    hot = [keys[0], keys[299]]
    refs = [(rng.choice([0, 1]), rng.choice([0, 1]), i, rng.choice([hot[0], hot[1], rng.choice(keys)]), rng.choice([day(), day(), None])) for i in range(3_000)]
    r = spark.createDataFrame(refs, "space long, field long, source_id long, target_id long, at timestamp").repartition(7)
    p = spark.createDataFrame(parents, "space long, key long, deleted int, first_seen timestamp, found boolean")
    got = sorted((x["field"], x["source_id"], x["target_id"], x["kind"]) for x in orphans(r, p, Scratch(spark, "o")).collect())
    known = {(s, k): (d, t) for s, k, d, t, _ in parents}
    want = []
    for s, f, i, k, at in refs:
        d, t = known.get((s, k), (None, None))
        kind = "missing" if (s, k) not in known else "deleted" if d == 1 else "late" if t and at and t > at else None
        if kind:
            want.append((f, i, k, kind))
    assert got == sorted(want)


def test_containers_of_many_tasks_become_one(spark):
    rows = pd.DataFrame({"space": 1, "range": 0, "field": 0, "period": np.repeat([3, 4], 50), "lane": 0, "data": [_packed(np.array([i, i + 1, 900])) for i in range(100)]})
    out = pd.concat(_merge(iter([rows[:30], rows[30:]])))
    assert sum(len(d) for d in map(_unpacked, out["data"])) == 2 * 52 and out["period"].tolist() == [3, 4]


def test_orphan_kinds_by_time(spark):
    t = lambda h: dt.datetime(2025, 3, 1, h)
    refs = [(0, 0, i, target, at) for i, (target, at) in enumerate([(1, t(5)), (1, t(2)), (1, t(3)), (2, t(9)), (99, t(9)), (70000, t(9)), (-5, t(9)), (1, None), (99, None)])]
    parents = [(0, 1, 0, t(3), True), (0, 2, 1, t(1), True), (0, 70000, 0, dt.datetime(2024, 1, 1), True)]
    r = spark.createDataFrame(refs, "space long, field long, source_id long, target_id long, at timestamp_ntz")
    p = spark.createDataFrame(parents, "space long, key long, deleted int, first_seen timestamp_ntz, found boolean")
    got = {x["source_id"]: x["kind"] for x in orphans(r, p, Scratch(spark, "o")).collect()}
    assert got == {1: "late", 3: "deleted", 4: "missing", 6: "missing", 8: "missing"}


def test_upsert_revives_and_appends(spark):
    urls = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "url_id long, url string, deleted int")
    found = spark.createDataFrame([("a",), ("d",), ("c",), ("c",), (None,)], "url string")
    assert sorted(tuple(r) for r in C.upserted(urls, found, 10, Scratch(spark, "u")).collect()) == [(1, "a", 0), (2, "b", 1), (10, "c", 0), (11, "d", 0)]


def test_rules_first_match_wins(spark):
    rules = [("Allow", "/keep/", False), ("Disallow", r"\.exe$", False), ("CheckOnly", "^http://", True)]
    rows = spark.createDataFrame([("http://x/keep/a.exe",), ("http://x/a.EXE",), ("ftp://x/",), ("http://x/",)], "u string")
    assert [r[0] for r in rows.select(C.first_rule(F.col("u"), rules)).collect()] == ["Allow", "Disallow", "CheckOnly", "Allow"]


def test_longest_prefix(spark):
    urls = spark.createDataFrame([(1, "http://h/a/b/c.html"), (2, "http://h/ax"), (3, "http://o/")], "url_id long, url string")
    configs = spark.createDataFrame([("http://h/", 1), ("http://h/a/", 2), ("http://h/a/b/", 3)], "prefix string, v int")
    assert {r["url_id"]: r["v"] for r in C.server_config(urls, configs).collect()} == {1: 3, 2: 1, 3: None}


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, digest string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "z")], "k long, digest string")
    assert {r["k"]: r["state"] for r in C.changes(a, b, "k").collect()} == {1: "same", 2: "changed", 3: "removed", 4: "added"}


def test_link_rank_keeps_pages_without_links(spark):
    from siftmesh.operators.links import link_rank, link_rank_incremental, resolved_redirects

    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "from_id long, to_id long")
    full = {r["url_id"]: round(r["rank"], 4) for r in link_rank(links, Scratch(spark, "r"), 2).collect()}
    assert full == {1: 1.0, 2: 0.575, 3: round(0.85 * (0.5 + 0.575) + 0.15, 4)}
    inc = {r["url_id"]: round(r["rank"], 4) for r in link_rank_incremental(links, spark.range(1, 5).withColumnRenamed("id", "url_id"), Scratch(spark, "r"), 1).collect()}
    assert inc == {1: 0.15, 2: 0.575, 3: 1.425, 4: 0.15}
    hops = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 5), (6, 7), (7, 6), (8, 6)], "from_id long, to_id long")
    assert {r["from_id"]: r["to_id"] for r in resolved_redirects(hops, Scratch(spark, "r")).collect()} == {1: 4, 2: 4, 3: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_ranges_and_blocks(spark):
    from siftmesh.operators import geo as G

    lines = spark.createDataFrame([("1.0.0.0-1.0.2.255 AA",), ("1.0.1.0 - 1.0.1.255 BB",), ("nonsense",)], "value string")
    ranges = G.read_ranges(lines)
    rows = spark.createDataFrame([(1, 1 << 24), (2, (1 << 24) + 300), (3, (1 << 24) + 700), (4, 5)], "id long, ip long")
    assert {r["id"]: r["country"] for r in G.lookup(rows, ranges).collect()} == {1: "AA", 2: "BB", 3: "AA", 4: None}
    blocks = sorted(tuple(r) for r in G.blocks(ranges.where("country = 'AA'")).collect())
    assert blocks == [(1 << 24, 23, "AA"), ((1 << 24) + 512, 24, "AA")]


def test_changes_merge_in_order(spark):
    from siftmesh.streaming.deltas import merge

    base = spark.createDataFrame([("a", [1]), ("b", [2]), ("c", [3])], "k string, v array<int>")
    delta = spark.createDataFrame([(1, "a", [9]), (2, "a", []), (2, "b", [7]), (1, "b", []), (3, "d", [4]), (1, "c", None)], "seq long, k string, v array<int>")
    assert sorted((r["k"], r["v"]) for r in merge(base, delta, ["k"], "v").collect()) == [("b", [7]), ("d", [4])]


def test_changes_fold_into_the_buckets_they_name(spark):
    from siftmesh.streaming.deltas import FoldedIndex, merge

    base = spark.createDataFrame([(f"k{i}", [i]) for i in range(40)] + [(None, [5])], "k string, v array<int>")
    scratch = Scratch(spark, "f")
    index = FoldedIndex(base, ["k"], "v", scratch, buckets=8)
    before = dict(index.places)
    first = spark.createDataFrame([(5, "k3", [33]), (4, "k3", []), (6, "k4", None), (7, None, [6])], "seq long, k string, v array<int>")
    index.fold(first)
    moved = {b for b in before if index.places[b] != before[b]}
    assert 1 <= len(moved) <= 3
    # Late and repeated changes lose to later ones.
    index.fold(spark.createDataFrame([(2, "k3", [0]), (1, "k4", [9]), (8, "new", [1])], "seq long, k string, v array<int>"))
    index.fold(first)
    index.fold(first.limit(0))
    got = sorted((str(r["k"]), r["v"]) for r in index.rows().collect())
    every = first.unionByName(spark.createDataFrame([(8, "new", [1])], "seq long, k string, v array<int>"))
    assert got == sorted((str(r["k"]), r["v"]) for r in merge(base, every, ["k"], "v").collect()) and len(got) == 41


def test_recent_versions_hide_and_replace_documents(spark):
    from siftmesh.streaming.deltas import FoldedIndex, RecentStore

    shape = "seq long, doc long, word string, at array<int>"
    base = spark.createDataFrame([(1, "a", [1]), (1, "b", [2]), (2, "a", [3]), (3, "c", [4])], "doc long, word string, at array<int>")
    store = RecentStore(FoldedIndex(base, ["doc", "word"], "at", Scratch(spark, "r"), 4), "doc", most=3)
    rows = lambda: sorted((r["doc"], r["word"], r["at"]) for r in store.rows().collect())
    store.put(spark.createDataFrame([(1, 1, "a", [9]), (1, 1, "x", [8]), (2, 2, "", [])], shape))
    want = [(1, "a", [9]), (1, "x", [8]), (3, "c", [4])]
    assert rows() == want and store.recent is not None
    store.fold()
    assert rows() == want and store.recent is None
    store.put(spark.createDataFrame([(3, 1, "z", [1]), (4, 7, "n", [2]), (5, 8, "n", [2])], shape))
    assert store.recent is None and rows() == [(1, "z", [1]), (3, "c", [4]), (7, "n", [2]), (8, "n", [2])]


def test_stopped_positions_stay_free(spark):
    from siftmesh.functions.text import indexable, tokens

    docs = spark.createDataFrame([(1, "The cat of x"), (2, None), (3, ""), (4, "y" * 40)], "id long, t string")
    got = [(r["id"], r["word"], r["pos"]) for r in indexable(tokens(docs, ["id"], {0: "t"}), ["the", "of"]).collect()]
    assert got == [(1, "cat", 1), (1, "x", 3)]




def test_windows_over_a_stream_drop_late_events(spark, tmp_path):
    from siftmesh.streaming.deltas import tumbling

    schema = "ts timestamp, key string"
    for i, hours in enumerate([[0, 1, 5], [9, 0], [20, 21]]):
        rows = [(dt.datetime(2025, 1, 1) + dt.timedelta(hours=h, minutes=i), "k") for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tumbling(events, "ts", "key", "1 hour", late="2 hours").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r["starts"].hour: r["n"] for r in spark.table("windows").collect()}
    assert got[1] == 1 and got[5] == 1 and sum(got.values()) <= 7


def test_results_cover_their_parts(spark):
    """OR is the union of its terms, AND their intersection, NOT the rest, a pattern the union of its words."""
    from siftmesh.plans.compile import Store, evaluate
    from siftmesh.plans.query_language import parse

    rng = np.random.default_rng(8)
    words = ["walking", "walkers", "runner", "jumping"]
    rows = [(words[w], int(u) % 3, int(u), int(s), int(s) << 14 | int(p)) for w, u, s, p in zip(rng.integers(0, 4, 300), rng.integers(0, 60, 300), rng.integers(0, 4, 300), rng.integers(0, 50, 300))]
    store = Store(spark.createDataFrame(rows, "word string, site_id long, url_id long, section int, pos int"))
    ids = lambda q: {r["url_id"] for r in evaluate(parse(q).tree, store).collect()}
    a, b, c = ids("walking"), ids("walkers"), ids("runner")
    assert ids("walking walkers") == a & b and ids("walking OR runner") == a | c and ids("walking -runner") == a - c
    assert ids("walking (walkers OR runner)") == a & (b | c) and ids("walkin* OR walker?") == a | b
    assert ids('"walking walkers"') <= a & b and ids("title:walking") <= a
