import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmesh.llm.bpe import TOKENIZERS, Bpe, encode

tokenizers = pytest.importorskip("tokenizers")
BPE = Bpe(f"{TOKENIZERS}/byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
LIBRARY.encode_special_tokens = True


def ids(*texts):
    flat, ends = BPE.encode(list(texts))
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def wanted(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n'ab1é.-"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_same_as_the_library(texts):
    assert ids(*texts) == [wanted(t) for t in texts]


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaa", " lead", "trail ", "a  b", "a \n b", "it's we'll I'D", "<|endoftext|> x", "x\x1c y\x85z", "½ Ⅳ x²", "日本語 🙂🙂", "�​́", "x" * 5000])
def test_edges(text):
    assert ids(text) == [wanted(text)]


def test_round_trip():
    text = "Überall 12.5 % – naïve façade\n\n\tcode(); 🙂"
    assert LIBRARY.decode(ids(text)[0]) == text


def test_empty_null_and_very_long(spark):
    long = "The quick brown fox 123. " * 40_000
    rows = spark.createDataFrame([(1, "", 5), (2, None, 5), (3, " ", 5), (4, long, 5), (5, "a b", 5)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in encode(rows).collect()}
    assert got[1] == got[2] == [] and got[3] == [220] and got[4] == wanted(long) and got[5] == wanted("a b")


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("siftmesh.llm.bpe.REMEMBERED", 3)
    small = Bpe(f"{TOKENIZERS}/byte_bpe_50k.json")
    for text in ["one two three four", "five one six", "", "one two"]:
        flat, _ = small.encode([text, "two"])
        assert flat.tolist() == wanted(text) + wanted("two")
