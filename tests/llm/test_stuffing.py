import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siftmesh.llm import stuffing
from siftmesh.llm.stuffing import Chunk, judged, stuffed_pages, tokens
from siftmesh.session import Scratch

SPAM = [
    "cheap pills, Cheap Pills, cheap pills, CHEAP PILLS, cheap pills, pills", "casino | casino | Casino | CASINO | casino | casino", "gold coins car insurance gold coins car insurance gold coins car insurance",
    "buy pills, best pills, pills shop, pills online, pills 2025, top pills", "tewe, tewe-1, teweshop, tewe-sale, tewe2, tewez, teweers", "stobroste4u stobrostez stobrosteers stobrostez stobroste2 stobrosteer",
    "Buy lamps. All lamps! The lamps shop. Best lamps here. lamps online.", "See a.example. See www.b-c.test. See d.e.invalid.", "[url=a.test]x[/url] [url=b.test]y[/url] [url=c.test]z", "<a href=http://a.test> <a href=http://b.test>",
    "http://a.test http://b.test http://c.test/x", "camera partner >> riri links >> www mirror >> www links >> lantern partner >> www mirror >>", "#cheaptaps #ringtone #ringtone #cheaptaps #ringtone #ringtone",
    "size S / 268.85 EUR / [lamp] / size X / blue / -41% / SKU-1234 / [lamp]", "cheap pills " * 20_000,
]
FINE = [
    "", "   ", "!!!", "A", "Guide to guide: a narrow guide", "Home > Garden > Tools > rake", "Home >> Garden >> Tools >> rakes >> steel", "Model X-1009 (59 x 59 mm)",
    "garden, tree, lawn, hedge, flower, pond, path, fence, gate, wall, roof, door", "garden, garden tools, garden fence, garden pond, garden path, hedge, lawn, tree",
    "The steady dealer sells the kettle beside the sto", "Read more on http://a.test/ about how a kettle is made.", "This rural kettle costs 64.50 EUR and comes with a lid.",
    "Open from 10.00 to 16.55 on weekdays; call 485 2371 for groups of 39.", "We keep a kettle here; the kettle of the year brings another lid.", "Kettle - www.shop.test",
    "bright lamp, old chair, new table, red door, blue wall, tall tree, small pond", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 5 % 26)}q{i % 7}" for i in range(3_000)),
]
NOUNS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "vo", "si", "du") for c in ("l", "t", "rk", "sh", "m")]
SHAPES = ["The {0} sells the {1} beside the {2} in the town.", "How a {0} finds the {1} and what it has to do with the {2}.", "All about the {0}, the {1} and the {2} with pictures of each.", "We keep the {0} here and bring a {1} to the {2}."]


def prose(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return [r.choice(SHAPES).format(*r.sample(NOUNS, 3)) for _ in range(n)]


def scored(texts: list[str], informed: bool = True) -> list[tuple[float, float, bool]]:
    """The texts as the whole corpus, in one chunk, by an independent count of words and pairs."""
    each = [tokens(t) for t in texts]
    code, words = pd.factorize(np.array([w for t, _ in each for w in t], object))
    own = Chunk(np.array([len(t) for t, _ in each]), code)
    single, pair, alone = Counter(), Counter(), Counter()
    for t, _ in each:
        single.update(t)
        pair.update(zip(t, t[1:]))
        for w in set(t):
            at = [i for i, x in enumerate(t) if x == w]
            alone[w] += sum(b - a <= stuffing.WORD_SPAN for a, b in zip(at, at[1:]))
    n = own.words
    count = np.array([single[w] for w in words] + [alone[words[c]] for c in own.selves] + [pair[(words[p // n], words[p % n])] for p in own.pairs], float)
    assert (own.keys(np.arange(n) + 2)[2] == count).all()
    if not informed:
        count[n:] = 0
    kinds = np.array([w if w[0] == "<" else "" for w in words], object)
    return list(zip(*own.scores(count, sum(single.values()), sum(pair.values()), np.array([c for _, s in each for c in s], bool), kinds)))


BACKGROUND = prose(400) + [f"{a}, {b}, {c}" for a, b, c in zip(NOUNS, NOUNS[7:], NOUNS[31:])]


@pytest.mark.parametrize("text", SPAM)
def test_repeated(text):
    assert scored([text, *BACKGROUND])[0][1] >= stuffing.COVERED


@pytest.mark.parametrize("text", FINE)
def test_not_stuffed(text):
    _, repeated, salad = scored([text, *BACKGROUND])[0]
    assert repeated < stuffing.COVERED and not salad


def test_verdicts_need_the_information():
    """Without what the corpus says of pairs, no field is repeated and all prose is salad."""
    with_it, without = scored(SPAM[:-1] + BACKGROUND), scored(SPAM[:-1] + BACKGROUND, informed=False)
    assert all(r[1] >= stuffing.COVERED for r in with_it[: len(SPAM) - 1]) and not any(r[1] >= stuffing.COVERED for r in without)
    assert sum(r[2] for r in with_it[len(SPAM) - 1 :]) <= 4 and sum(r[2] for r in without[len(SPAM) - 1 :]) > 150


@pytest.fixture(scope="module")
def corpus():
    rows = pq.read_table("/root/testdata/sf0.01/urlwords.parquet", columns=["title", "description"]).to_pylist()
    return [t for r in rows for t in r.values() if t]


@pytest.mark.parametrize("length", [8, 14, 20, 40])
@pytest.mark.parametrize("by_use", [True, False])
def test_salad(corpus, length, by_use):
    r = random.Random(length)
    words = [w for t in corpus for w in tokens(t)[0] if w[0] != "<"]
    words = words if by_use else sorted(set(words))
    salad = [" ".join(r.choice(words) for _ in range(length)) for _ in range(200)]
    out = scored(salad + corpus)
    assert sum(x[2] for x in out[:200]) >= 180
    assert sum(x[2] for x in out[200:]) <= 0.01 * len(corpus)


def test_mean_information_by_hand():
    """Neighbours' information is what the other fields say: log((seen + 1) / (expected + 1)), not below zero."""
    texts = ["red lamp"] * 4 + ["red lamp", "old door"] * 3
    seen, outside = 6, 6 * 6
    want = np.log((seen + 1) / (outside / 10 + 1))
    assert scored(texts)[0][0] == pytest.approx(want)
    assert np.isnan(scored(["lamp", "door door"])[0][0])


def test_roots_and_kinds():
    assert tokens("tewe, tewe-1 teweshop") == (["tewe", "tewe", "<number>", "tewe"], [False, True, False, False])
    assert set(tokens("size S / 268.85 EUR / [lamp] / -41% / SKU-1234 #tag")[0]) == {"<mark>"}
    assert tokens("stobrostez, stobroster stobroste2")[0] == ["stobr"] * 3


def test_many_chunks_give_what_one_does(spark, monkeypatch):
    rows = [(i, "title", t) for i, t in enumerate(SPAM[:-1] + FINE[:-1] + prose(300))] + [(5_000, "keywords", "kanal lovosh minat tudurk resim kavol")] * 2
    frame = spark.createDataFrame(rows, "id long, field string, text string").where("text <> ''")
    key = lambda r: (r["id"], r["field"], r["kind"], round(r["repeated"], 9), None if r["pmi"] is None else round(r["pmi"], 9))
    whole = sorted(map(key, judged(frame.coalesce(1), Scratch(spark, "one")).collect()), key=str)
    parts = sorted(map(key, judged(frame.repartition(5), Scratch(spark, "five")).collect()), key=str)
    assert whole == parts and len(whole) == len([r for r in rows if r[2]])
    assert all(r[2] is None for r in whole if r[0] == 5_000)


def test_query(spark, folder):
    schema = pa.schema([("url_id", pa.int64()), ("title", pa.string()), ("keywords", pa.string()), ("description", pa.string())])
    rows = [{"url_id": i, "title": t, "keywords": None, "description": ""} for i, t in enumerate(SPAM[:8])]
    rows += [{"url_id": 100 + i, "title": None, "keywords": t, "description": t} for i, t in enumerate(FINE)] + [rows[0]] + [{"url_id": None, "title": SPAM[0], "keywords": None, "description": None}]
    rows += [{"url_id": 1_000 + i, "title": None, "keywords": None, "description": t} for i, t in enumerate(prose(200))]
    rows.append({"url_id": 9_000, "title": "kanal sells tudurk beside resim minat the of lovosh bring duk a kavol", "keywords": None, "description": None})
    found = {r[0] for r in stuffed_pages(spark, folder(urlwords=(rows, schema))).collect()}
    assert set(range(8)) <= found and not any(100 <= i < 200 for i in found)
