import random
from collections import defaultdict

import pytest

from siftmesh.llm.term_frequency import LEVELS, assignment, frequencies, plan


def brute(rows):
    seen, entries = set(), defaultdict(list)
    for term, block, records in rows:
        if term is not None and block is not None:
            entries[term] += []
            if block not in seen:
                seen.add(block)
                entries[term] += [r for r in records or [] if r is not None]
    return {t: (len(e), len(set(e))) for t, e in entries.items()}


@pytest.mark.parametrize("limit", [10**6, 200, 40])
def test_against_brute_force_with_splits(spark, limit):
    rng = random.Random(limit)
    rows = []
    for block in range(900):
        term = "hot" if rng.random() < 0.35 else f"t{rng.randrange(120)}"
        rows.append((term, block, [rng.randrange(300) for _ in range(rng.randrange(4))]))
    rows += [rows[5], rows[6], (None, 5000, [1]), ("t1", None, [1]), ("only", 5001, None), ("empty", 5002, []), ("gap", 5003, [None, 4, 4])]
    got = {r["term"]: (r["total"], r["records"]) for r in frequencies(spark.createDataFrame(rows, "term string, block long, records array<long>"), limit).collect()}
    assert got == brute(rows)


def test_plan_splits_only_what_is_too_large():
    cells = {0x1234: 50, 0x1235: 60, 0x1FFF: 5, 0xA000: 500}
    split, by_record = plan(cells, 100)
    assert split == ["", "1", "a", "12", "a0", "123", "a00"]
    assert by_record == {"a000": 8}
    assert all(len(p) < LEVELS for p in split)
    assert sorted(assignment(cells, 100)) == [(0x1234, "1234", 1), (0x1235, "1235", 1), (0x1FFF, "1f", 1), (0xA000, "a000", 8)]
    assert plan({}, 10) == ([""], {}) or plan({}, 10)[1] == {}
