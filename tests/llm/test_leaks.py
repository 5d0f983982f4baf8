import random

import pyarrow as pa
import pytest

from siftmesh.llm import leaks as leaks_module
from siftmesh.llm.leaks import Automaton, cleaned, leaked_items, words


def brute(items, text, least):
    out = set()
    for item, ws in items:
        grams = {tuple(ws[i : i + least]) for i in range(len(ws) - least + 1)}
        if any(tuple(text[i : i + least]) in grams for i in range(len(text) - least + 1)):
            out.add(item)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_automaton_against_all_passages(seed):
    rng = random.Random(seed)
    letters = "abc" if seed % 2 else "abcdefgh"
    items = [(i, [rng.choice(letters) for _ in range(rng.randint(0, 30))]) for i in range(12)]
    items += [(20, items[3][1]), (21, items[4][1][5:] + ["x"])]
    for least in (2, 4, 6):
        automaton = Automaton(items, least)
        texts = [[rng.choice(letters + "z") for _ in range(rng.randint(0, 60))] + items[rng.randrange(12)][1][: rng.randint(0, 20)] for _ in range(8)]
        got = [set() for _ in texts]
        for t, first, last, found in automaton.scan(texts):
            got[t] |= set(found)
            assert last - first + 1 >= least
        assert got == [brute(items, t, least) for t in texts]


def test_words():
    assert words("Ein Öl-Tank, 5x_7 ²") == ["ein", "öl", "tank", "5x", "7", "²"]
    assert words(None) == words("") == words(" .,") == []


DOC = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
ITEM = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def test_leaks_and_cleaning(spark, folder):
    passage = " ".join(f"w{i}" for i in range(20))
    part = " ".join(f"w{i}" for i in range(5, 18))
    docs = [(1, f"Before, {passage.upper()}! After and much more text that stays here, as it is no passage of any item at all, so most of it is kept in the end."),
            (2, part), (3, part.rsplit(" ", 1)[0]), (4, None), (5, ""), (6, "x " * 50_000 + passage.replace(" ", "\n- ")), (2, part)]
    d = folder(documents=([{"doc_id": i, "text": t} for i, t in docs], DOC), eval_items=([{"item_id": 7, "text": passage}, {"item_id": 8, "text": part}, {"item_id": 9, "text": "short one"}, {"item_id": 10, "text": None}], ITEM))
    assert sorted(tuple(r) for r in leaked_items(spark, d).collect()) == [(1, 7), (1, 8), (2, 7), (2, 8), (6, 7), (6, 8)]
    out = {r["doc_id"]: r for r in cleaned(spark, d).collect()}
    assert out[1]["action"] == "cut" and out[1]["clean"].startswith("Before, ! After") and out[1]["n_leaked"] == 20
    assert out[2]["action"] == "drop" and out[2]["clean"] is None
    assert out[6]["n_words"] == 50_020 and out[6]["clean"].strip().startswith("x x")


def test_blocks_of_items(spark, folder):
    from siftmesh.llm.leaks import leaks
    from siftmesh.sources.tables import read

    texts = {i: " ".join(f"v{i}x{k}" for k in range(15)) for i in range(6)}
    d = folder(documents=([{"doc_id": i, "text": t} for i, t in texts.items()], DOC), eval_items=([{"item_id": i, "text": t} for i, t in texts.items()], ITEM))
    parts = [p for p, _ in leaks(read(spark, d, "documents"), read(spark, d, "eval_items"), block_words=30)]
    assert len(parts) == 3
    assert sorted(tuple(r) for p in parts for r in p.collect()) == [(i, i) for i in range(6)]


def test_matches_become_stretches():
    assert list(leaks_module.stretches(iter([(0, 3, 15, ()), (0, 4, 16, ()), (0, 17, 30, ()), (0, 40, 53, ()), (2, 0, 12, ())]))) == [(0, 3, 30), (0, 40, 53), (2, 0, 12)]
    assert list(leaks_module.stretches(iter([]))) == []
