import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmesh.operators import results as R
from siftmesh.plans.compile import Store, evaluate
from siftmesh.plans.query_language import parse


def word_weight(pos, form=0x8000):
    best = max(pos) & 0xC000
    if best == 0:
        return form
    return form | best >> 1 | ~min(p for p in pos if p & 0xC000 == best) & 0x1FFF


def and_weight(lists, gaps):
    """Brute force: every way to pick the end of a run and walk back."""
    longest = []
    for i, own in enumerate(lists):
        best = 1
        for p in own:
            n, q, j = 1, p, i
            while j > 0 and q - gaps[j] in lists[j - 1] and (q - gaps[j]) & 0xC000 == q & 0xC000:
                q, j, n = q - gaps[j], j - 1, n + 1
            best = max(best, n)
        longest.append(best)
    smallest = min(max(own) for own in lists)
    ends = sum(x >= 2 for x in longest)
    near = 0x1800 if max(longest) == len(lists) else 0x1000 if ends > 1 else ends << 11
    return 0x8000 | (smallest & 0xC000) >> 1 | near | ~smallest & 0x7FF


@pytest.fixture(scope="module")
def random_postings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for url in range(60):
        for word in ("aa", "bb", "cc"):
            for section in rng.choice(4, rng.integers(1, 3), replace=False):
                for p in set(rng.integers(0, 9, rng.integers(1, 5)).tolist()):
                    rows.append((word, url % 5, url, int(section), int(section) << 14 | p))
    df = spark.createDataFrame(rows, "word string, site_id long, url_id long, section int, pos int").cache()
    lists = {}
    for w, _, u, _, p in rows:
        lists.setdefault(u, {}).setdefault(w, []).append(p)
    return df, {u: {w: sorted(ps) for w, ps in ws.items()} for u, ws in lists.items()}


def got(df, text):
    return {r["url_id"]: r["wp"] for r in evaluate(parse(text).tree, Store(df)).collect()}


def test_single_words(random_postings):
    df, lists = random_postings
    assert got(df, "aa") == {u: word_weight(ws["aa"]) for u, ws in lists.items()}


@pytest.mark.parametrize("words", [("aa", "bb"), ("aa", "bb", "cc"), ("cc", "aa", "bb")])
def test_and_by_runs(random_postings, words):
    df, lists = random_postings
    assert got(df, " ".join(words)) == {u: and_weight([ws[w] for w in words], [1] * len(words)) for u, ws in lists.items()}


def test_or_not_and_properties(random_postings):
    df, lists = random_postings
    either = got(df, "aa OR bb")
    assert either == {u: max(word_weight(ws["aa"]) & 0x7FFF, word_weight(ws["bb"]) & 0x7FFF) | 0x8000 for u, ws in lists.items()}
    few = df.where(~((F.col("word") == "bb") & (F.col("url_id") % 2 == 0)))
    assert set(got(few, "aa -bb")) == {u for u in lists if u % 2 == 0}
    assert set(got(few, "aa bb")) == {u for u in lists if u % 2 == 1}
    assert not set(got(few, "aa -bb")) & set(got(few, "bb"))
    assert set(got(df, '"aa bb"')) <= set(got(df, "aa bb"))


def test_phrase_takes_the_last_start(random_postings):
    df, lists = random_postings
    want = {}
    for u, ws in lists.items():
        starts = [p for p in ws["aa"] if p + 1 in ws["bb"] and p & 0xC000 == p + 1 & 0xC000]
        if starts:
            want[u] = max(starts) ^ 0x3FFF if max(starts) & 0xC000 else 0x3000
    assert got(df, '"aa bb"') == want and want


def test_phrase_does_not_cross_sections(spark):
    rows = [("aa", 1, 1, 0, 0x3FFF), ("bb", 1, 1, 1, 0x4000)]
    assert got(spark.createDataFrame(rows, "word string, site_id long, url_id long, section int, pos int"), '"aa bb"') == {}


def test_section_filter_drops_the_form_bit(random_postings):
    df, lists = random_postings
    want = {u: word_weight([p for p in ws["aa"] if p >> 14 == 3], 0) for u, ws in lists.items() if any(p >> 14 == 3 for p in ws["aa"])}
    assert got(df, "title:aa") == want


def test_final_weight_and_rank(spark):
    rows = spark.createDataFrame([(0x8000, 0.0), (0xBFFF, 1.5), (0x8800, 0.15), (0xE123, 1e9)], "wp int, rank double")
    out = rows.select(R.quantized_rank(F.col("rank")).alias("q"), "wp").select("q", R.final_weight(F.col("wp"), F.col("q")).alias("w")).collect()
    assert [r["q"] for r in out] == [0, 5416, 810, 46051]
    assert [r["w"] for r in out] == [0x80000000, 0xBFFF0000 + 5416, 0x88000000 + (810 << 11), 0xE1230000 + 46051]


def test_order_breaks_ties_by_url(spark):
    rows = spark.createDataFrame([(u, 1, 5, 5, u % 2) for u in range(9)], "url_id long, site_id long, weight long, within long, site_weight long")
    assert [r["url_id"] for r in R.top(rows, 9).collect()] == [1, 3, 5, 7, 0, 2, 4, 6, 8]
    best = R.by_site(rows).collect()[0]
    assert (best["url_id"], best["second_url"], best["n_urls"]) == (0, 1, 9)


def test_search_ungroups_a_single_site(spark):
    from siftmesh.search import Parameters, search

    rows = [("aa", 7, u, 0, 1) for u in range(5)]
    df = spark.createDataFrame(rows, "word string, site_id long, url_id long, section int, pos int")
    assert search(Store(df), "aa").rows.count() == 5
    more = df.union(spark.createDataFrame([("aa", 8, 9, 0, 1)], df.schema))
    assert search(Store(more), "aa").rows.count() == 2
    assert search(Store(more), "aa", Parameters(site=7)).rows.count() == 5
    assert [r["place"] for r in search(Store(more), "aa", Parameters(group=False, number=1, size=4)).rows.collect()] == [5, 6]
