import pytest

from siftmesh.plans.query_language import Empty, QueryError, Vocabulary, normal, parse

V = Vocabulary(stop={"the", "of"}, forms={"pump": ("pumps",)})


@pytest.mark.parametrize("text, tree", [
    ("water valve", "(water & valve)"), ("Water AND VALVE", "(water & valve)"), ("water OR valve", "(valve | water)"), ("water | water", "water"),
    ("water -valve", "(water -valve)"), ("water-valve", "(water & valve)"), ("water - valve", "(water & valve)"), ('"water of valve"', '"water@0 valve@2"'),
    ('"water (valve | tap)"', '"water@0 (tap | valve)@1"'), ("title:water", "8:water"), ("title:desc:(water valve)", "10:(water & valve)"), ("body:desc:keywords:title:water", "water"),
    ("water site:a.b", "(water site:a.b)"), ("water -site:a.b", "(water -site:a.b)"), ("link: www.x.y/z", "link:www.x.y/z"), ("water the valve", "(water & * valve)"), ("water site:a.b valve", "(water & * valve site:a.b)"),
    ("valves*", "valves*"), ("pump", "{pump|pumps}"), ("a (b | c) -d", "(a & (b | c) -d)"), ("the water", "water"), ("water OR the", "water"),
])
def test_trees(text, tree):
    assert normal(parse(text, V).tree) == tree


@pytest.mark.parametrize("text, code", [
    ("the", "stopwords"), ("*", "stopwords"), ("site:a.b", "stopwords"), ("-water", "emptyquery"), ("", "emptyquery"), ('"water', "noquoted"), ("(water", "noparenthesis"),
    ("water)", "noparenthesis"), ("abcde*", "tooshort"), ("w?ter", "tooshort"), ("a \x01 b", "extrasymbol"),
])
def test_errors(text, code):
    with pytest.raises(QueryError) as e:
        parse(text, V)
    assert e.value.code == code


def test_unknown_words_fold():
    v = Vocabulary(known={"water"})
    assert parse("water nowhere", v).tree == Empty()
    assert normal(parse("water OR nowhere", v).tree) == "water"
    assert parse('"water nowhere"', v).tree == Empty()


def test_long_words_are_empty_and_complexity_counts_operators():
    assert parse("a" * 33, V).tree == Empty()
    assert parse("water valve", V).complexity == 0
    assert parse("water OR valve", V).complexity == 2
    assert parse('"a (b | c)"', V).complexity == 1
