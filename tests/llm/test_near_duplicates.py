import random

import numpy as np
import pyarrow as pa
import pytest

from siftmesh.llm import near_duplicates as N
from siftmesh.session import Scratch

SCHEMA = pa.schema([("url_id", pa.int64()), ("txt", pa.string())])


def brute(rows, similarity=0.6):
    sets = [(u, s) for u, s in {(u, frozenset(words(t))) for u, t in rows} if s]
    out = set()
    for a, s in sets:
        for b, t in sets:
            if a < b and len(s & t) >= similarity * len(s | t):
                out.add((a, b))
    return out


def words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for u in range(n):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rng.shuffle(text)
        else:
            text = ["the", "a", *rng.sample(vocab, 28)]
        rows.append((u, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_all_pairs(spark, folder, seed):
    rows = corpus(seed) + [(500, None), (501, ""), (502, " .,! "), (503, "one"), (504, "ONE!"), (505, "one two"), (3, corpus(seed)[3][1])]
    d = folder(urlwords=([{"url_id": u, "txt": t} for u, t in rows], SCHEMA))
    got = [tuple(r) for r in N.page_pairs(spark, d).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.02 * len(want)


def test_groups_cover_every_page_with_words(spark, folder):
    rows = corpus(5, 60) + [(500, None)]
    d = folder(urlwords=([{"url_id": u, "txt": t} for u, t in rows], SCHEMA))
    got = {r["url_id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in N.page_groups(spark, d).collect()}
    assert set(got) == set(range(60))
    assert all(g <= c <= u for u, (c, g, _) in got.items())


def test_a_text_held_by_a_third_of_all_pages(spark, folder):
    rows = [(u, "same words in every page of this third") for u in range(40)] + [(100 + u, f"page{u} has{u} its{u} own{u} words{u}") for u in range(80)]
    d = folder(urlwords=([{"url_id": u, "txt": t} for u, t in rows], SCHEMA))
    assert {tuple(r) for r in N.page_pairs(spark, d).collect()} == brute(rows)


def test_a_template_held_by_a_third_of_all_pages(spark, folder):
    """Template pages with 0 to 40 % other words, some of which two pages share; their other words alone don't make them meet."""
    rng = random.Random(6)
    template, rows = [f"tpl{i}" for i in range(26)], []
    for u in range(0, 100, 2):
        own = [f"own{u}x{i}" for i in range(rng.randint(0, 17))]
        rows += [(u, " ".join(template + own)), (u + 1, " ".join(template + own[: rng.randint(0, len(own))]))]
    rows += [(200 + u, " ".join(f"far{u}x{i}" for i in range(30))) for u in range(200)]
    d = folder(urlwords=([{"url_id": u, "txt": t} for u, t in rows], SCHEMA))
    got, want = {tuple(r) for r in N.page_pairs(spark, d).collect()}, brute(rows)
    assert got <= want
    assert len(want - got) <= 0.02 * len(want)


def test_members_of_a_large_class_meet_in_blocks(spark):
    members = spark.createDataFrame([(i, 1) for i in range(50)] + [(90, 2)], "id long, rep long")
    got = [tuple(r) for r in N._within(members, block=7).collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2


def _met(packed, monkeypatch):
    rows = sorted((r for b in packed for r in b.to_pylist()), key=lambda r: r["bucket"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    units = list(N._units(iter([pa.RecordBatch.from_pylist(rows)])))
    names = [u for b in units for u in b.column(0).to_pylist()]
    assert len(names) == len(set(names))
    outs = list(N._pairs(iter(units)))
    return {(a, b) for out in outs for a, b in zip(*(c.to_pylist() for c in out.columns))}, [b.slice(i, 1) for b in units for i in range(b.num_rows)]


@pytest.mark.parametrize("blocks", [0, 3, 5])
@pytest.mark.parametrize("block", [7, 2_048])
def test_a_value_in_half_of_the_texts_meets_in_blocks(monkeypatch, blocks, block):
    """Whatever share a value has, no unit has more pairs than two blocks make, no pair is lost, and salted entries stay apart."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "UNIT_PAIRS", 100)
    n = 60
    words = ["alpha beta gamma delta epsilon"] * n + [f"own{i} text{i}" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), pa.array(words)], names=["rep", "words"])
    value = N._band_values(pa.array([words[0].split()]), pa.array([], pa.string()))[1]
    packed = list(N._entries([], {int(v): blocks for v in value} if blocks else {}, 5)(iter([batch])))
    got, units = _met(packed, monkeypatch)
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n)}
    if block == 7:
        assert all(sum(out.num_rows for out in N._pairs(iter([u]))) <= 200 for u in units)
    if blocks:
        keys = [k for b in packed for r in b.to_pylist() for k in N._unplanes(r["keys"]).tolist()]
        assert max(np.unique(keys, return_counts=True)[1]) < n


def test_unrelated_texts_end_where_they_meet(monkeypatch):
    """Texts that share a fifth of their words have band values in common, but hardly any such pair leaves the task; similar ones all do."""
    rng = random.Random(8)
    texts = [[f"all{i}" for i in range(10)] + [f"own{u}x{i}" for i in range(20)] for u in range(400)]
    for u in range(0, 80, 2):
        texts[u + 1] = texts[u][:]
        texts[u + 1][rng.randrange(10, 30)] = "other"
    words = [" ".join(sorted(t)) for t in texts]
    text, value = N._band_values(pa.array([t.split() for t in words]), pa.array([], pa.string()))
    by_value: dict = {}
    for t, v in zip(text.tolist(), value.tolist()):
        by_value.setdefault(v, []).append(t)
    meet = {(a, b) for own in by_value.values() for a in own for b in own if a < b}
    similar = {(u, u + 1) for u in range(0, 80, 2)}
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), pa.array(words)], names=["rep", "words"])
    got, _ = _met(list(N._entries([], {}, 5)(iter([batch]))), monkeypatch)
    assert similar <= meet and len(meet - similar) > 100
    assert similar <= got and len(got - similar) < 0.1 * len(meet - similar)


def test_rounds_have_all_bands_and_leave_no_files(spark, folder, monkeypatch):
    """Rounds of a bounded number of bands find the pairs, and what is left in the shared folder are the tables that are still read."""
    import os

    rows, seen, entries = corpus(9), [], N._entries
    monkeypatch.setattr(N, "TASK_ENTRIES", 1_000)
    monkeypatch.setattr(N, "_entries", lambda bands, *more: (seen.append(bands), entries(bands, *more))[1])
    scratch = Scratch(spark, "rounds")
    near = N.NearDuplicates(spark.createDataFrame(rows, "id long, text string"), scratch)
    got, want = {tuple(sorted(r)) for r in near.pairs().collect()}, brute(rows)
    rep = {r["id"]: r["rep"] for r in near.members().collect()}
    want = {tuple(sorted((rep[a], rep[b]))) for a, b in want if rep[a] != rep[b]}
    assert got <= want and len(want - got) <= 0.02 * len(want)
    assert [b for bands in seen for b in bands] == list(range(N.BANDS)) and len(seen) > 3 and max(map(len, seen)) <= N.ROUND
    left = [name for name in os.listdir(scratch.base.removeprefix("file:").replace("//", "/")) if "candidates" in name]
    assert not left


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(4)
    chance = N._chance(N._SIZES)
    lists, want = [], []
    for _ in range(60):
        a = rng.choice(5000, 40, replace=False)
        b = np.concatenate([a[: rng.integers(0, 41)], rng.choice(5000, 40) + 5000])[:40]
        lists += [[f"w{x}" for x in a], [f"w{x}" for x in b]]
        want.append(len(set(a) & set(b)) / len(set(a) | set(b)))
    regs, size = N.registers(pa.array(lists), 256, 7)
    got = N.estimate(regs[::2], regs[1::2], size[::2], size[1::2], chance)
    assert np.abs(got - want).max() < 0.13 and np.abs(got - want).mean() < 0.03


def test_registers_of_no_words():
    regs, size = N.registers(pa.array([[], ["a"], None, ["a", "b"]], pa.list_(pa.string())), 8)
    assert size.tolist() == [0, 1, 0, 2] and not regs[0].any() and (regs[3] >= regs[1]).all()


def test_very_long_texts(spark, folder):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " one more"), (3, " ".join(f"u{i}" for i in range(30_000)))]
    d = folder(urlwords=([{"url_id": u, "txt": t} for u, t in rows], SCHEMA))
    assert {tuple(r) for r in N.page_pairs(spark, d).collect()} == {(1, 2)}


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert N.NearDuplicates(empty, Scratch(spark, "n")).pairs().count() == 0
