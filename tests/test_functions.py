from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siftmesh.functions import cgi, dates, forms, html, urls
from siftmesh.operators import excerpts
from siftmesh.plans.query_language import parse


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_durations(spark):
    assert one(spark, dates.duration, "4h30m", "1h-60M+1s", "3600", "5x", "1y6m-15d", "", None, "90M") == [16200 - 30 * 60 + 30 * 2592000, 1, 3600, None, 31536000 + 6 * 2592000 - 15 * 86400, None, None, 5400]


def test_dates(spark):
    same = 784111777
    got = one(spark, dates.http_date, "Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "-1", "", None, "Sun, 06 Foo 1994 08:49:37 GMT", "Sunday, 06-Nov-05 00:00:00 GMT", "Sun, 31 Feb 2020 00:00:00 GMT")
    assert got == [same, same, same, None, None, None, None, 1131235200, None]
    assert one(spark, dates.day_first, "01/02/2024", "31/02/2024", "1-2-3") == [1706745600, None, None]
    assert one(spark, dates.compact, "19941106084937", "1994") == [same, None]


def test_hours(spark):
    origin = dates.hour_origin(1_700_000_000)
    f = lambda c: dates.last_change_hour(c.cast("long"), origin, 1_700_000_000)
    assert one(spark, f, None, "0", "1700000000", str(1_700_000_000 + 10**7)) == [0, 1, 65534, 65535]


BASES = ["http://h.test/a/b/c.html?q=1", "http://h.test/", "https://u:p@h.test:8080/x/y"]
LINKS = ["d.html", "../d", "../../../../d", "./", "..", "/r/./s/../t", "//o.test/z", "http://k.test/", "?n=2", "", "d/e/../f/", "#x", "a b#c"]


@pytest.mark.parametrize("base", BASES)
def test_links_resolve_like_the_standard(spark, base):
    got = one(spark, lambda c: urls.resolve(F.lit(base), c), *LINKS)
    want = [urljoin(base, x.split("#")[0]) for x in LINKS]
    assert got == want


def test_url_parts(spark):
    p = spark.range(1).select(urls.decompose(F.lit("HTTP://u:p@Host.Test:81/a/b.php?x=1#f")).alias("p")).first()["p"]
    assert tuple(p) == ("http", "u", "p", "host.test", "81", "/a/", "b.php", "?x=1")
    assert spark.range(1).select(urls.decompose(F.lit("http://h'x/"))).first()[0] is None
    assert one(spark, urls.like_of, "a*b?c%d_e\\") == ["a%b_c\\%d\\_e\\\\"]
    assert one(spark, urls.escaped, "a b/ü~*") == ["a%20b%2F%C3%BC~%2A"]
    assert one(spark, urls.unescaped, "a+b%2F%C3%BC", "%zz") == ["a b/ü", None]
    assert spark.range(1).select(urls.prefixes(F.lit("http://h/a/b/c?d"))).first()[0] == ["http://h/", "http://h/a/", "http://h/a/b/"]


PAGE = """<HTML><head><title>A &amp; B&copy</title><meta name=keywords content='k1, k2'><META content="desc" NAME="description">
<base href="/dir/"><script>if (1 < 2) document.write("<b>no</b>")</script><style>x {}</style></head>
<body bgcolor=red>It's <b>bold</b>text <!-- a comment --><!--noindex-->hidden<!--/noindex--> &#65;&#x42; <a href=x.html#top>link</a><a href='../y'>y</a>
<img src="i.png"><!--UdmComment-->gone<!--/UdmComment--> <a href="x.html">again</a> end"""


def test_html():
    p = html.parse(PAGE, "http://h.test/p/q.html")
    assert (p["title"], p["keywords"], p["description"]) == ("A & B©", "k1, k2", "desc")
    assert p["body"] == "It`s bold text AB link y again end"
    assert p["links"] == ["http://h.test/dir/x.html", "http://h.test/y", "http://h.test/dir/i.png"]


def test_font_sizes():
    p = html.parse("<body>a <h1>b <i>c</i></h1> d <font size=+2>e <small>f <small>g</small></small></font> h <big>i</big> <font size=2>j</font> <h5>k</h5> <font size=x>l")
    assert p["large"] == "b c e f i"
    assert html.parse("<basefont size=6><h2>a</h2><h1>b</h1><font size=7>c</font>")["large"] == "c"


def test_converters(spark):
    rows = spark.createDataFrame([(1, "a/b", b"x"), (2, "c/d", b"y"), (3, "a/b", None), (4, None, b"z")], "url_id long, content_type string, data binary")
    assert {r["url_id"]: r["text"] for r in html.converted(rows, {"a/b": lambda d: d.decode().upper()}).collect()} == {1: "X", 2: None, 3: None, 4: None}


def test_html_robots_and_broken_pages():
    p = html.parse("<body>words<meta name=robots content='noindex,nofollow'><a href=x>y</a>", "http://h/")
    assert (p["body"], p["links"], p["index"], p["follow"]) == ("", [], False, False)
    assert html.parse("<meta name=robots content=ALL><p>a")["index"]
    assert html.parse(None)["body"] == html.parse("")["body"] == ""
    assert html.parse("<title>open")["title"] == "open"
    assert html.parse('<a href="unclosed>x</a> y <b')["body"].endswith("y")
    assert html.parse("<script>never ends")["body"] == ""
    assert html.parse("<meta http-equiv=refresh content='0; url=/n'>", "http://h/")["links"] == ["http://h/n"]
    assert html.entities("&nosuch; &lt &#0; &eacute;") == "&nosuch; <  é"


def test_forms(spark):
    rules = forms.read_suffixes("prefixes\nflag *A:\n. > RE\nsuffixes\nflag *S:\n [^Y] > S\n Y > -Y,IES\n Z > 'S\nflag D:\n E > D\n")
    assert [(r.flag, r.condition, r.strip, r.add) for r in rules] == [("S", "[^y]", "", "s"), ("S", "y", "y", "ies"), ("D", "e", "", "d")]
    words = spark.createDataFrame(forms.read_dictionary("city/S\nbake/SD\nred\n"), "word string, flags string")
    out = forms.expand(words, rules)
    assert sorted(r["form"] for r in out.collect()) == ["bake", "baked", "bakes", "cities", "city", "red"]
    assert forms.forms_of(out, ["bakes", "nothing"]) == {"bakes": ("bake", "baked", "bakes"), "nothing": ()}


@pytest.mark.parametrize("text, query", [
    ("q=water", "water"), ("q=x&iq=water+pump&im=p", '"water pump"'), ("q=water&xq=a+b", "water -a -b"), ("q=water&xq=a+b&xm=p", 'water -"a b"'), ("q=water&is=a.b", "water site:a.b"),
    ("q=water&is=a.b+c.d&xs=e.f", "water (site:a.b | site:c.d) -site:e.f"), ("q=water&tl=on&ds=on", "desc:title:(water)"), ("q=water&r=old+words&in=on", "(old words) (water)"), ("q=water&ln=www.x.y", "link: www.x.y"),
])
def test_form_rewriting(text, query):
    r = cgi.request(text, 0, 0)
    assert r.query == query
    parse(r.query)


def test_form_settings():
    r = cgi.request("q=a&s=date&gr=off&np=2&ps=500&sp3=on&sp1=on&ul=http://a/%25+b%25&dt=back&dp=2h", 7_200_000, 0)
    p = r.parameters
    assert (p.sort, p.group, p.number, p.size, p.spaces, r.masks, p.since, p.until) == ("date", False, 2, 100, (1, 3), ("http://a/%", "b%"), 1998, None)
    assert cgi.window({"dt": "er", "dd": "1", "dm": "0", "dy": "2024", "dx": "1"}, 0) == (1704067200, None)
    assert cgi.window({"dt": "range", "db": "01/01/2024", "de": "bad"}, 0) == (1704067200, None)


def test_excerpts_and_highlights():
    wanted = excerpts.matcher(parse('garden OR "big tree" OR describe* -house').tree)
    text = "The garden & the big tree. " + "x " * 100 + "Gardens don't count, but it described a garden. A house."
    assert excerpts.highlighted(text[:27], wanted) == "The <B>garden</B> &amp; the <B>big</B> <B>tree</B>. "
    out = excerpts.excerpts(text, wanted, most=2, length=60)
    assert len(out) == 2 and "garden" in out[0] and "described" in out[1]
    assert excerpts.excerpts(None, wanted) == [] and excerpts.highlighted(None, wanted) == ""
    assert excerpts.colored("<b garden>garden</b>", parse("garden").tree, ["red"]) == '<b garden><span style="background:red">garden</span></b>'


def test_a_phrase_is_marked_as_a_phrase_only():
    wanted = excerpts.matcher(parse('"big tree" garden').tree)
    text = "A tree, big. The big tree in a garden."
    assert excerpts.highlighted(text, wanted) == "A tree, big. The <B>big</B> <B>tree</B> in a <B>garden</B>."
    assert excerpts.colored("big <i>tree</i> tree", parse('"big tree"').tree, ["red"]) == '<span style="background:red">big</span> <i><span style="background:red">tree</span></i> tree'
    # The last excerpt is the one with all terms.
    far = "garden " + "x " * 100 + "garden " + "y " * 100 + "big tree garden"
    assert excerpts.excerpts(far, wanted, most=1, length=40)[0].endswith("big tree garden")


def test_a_form_is_answered(spark):
    from siftmesh.plans.compile import Store
    from siftmesh.search import Side

    rows = [("pump", 1, 10, 3, 3 << 14), ("pumps", 2, 20, 0, 5), ("pumpe", 1, 11, 0, 1), ("valve", 1, 10, 0, 4), ("pump", 2, 21, 3, (3 << 14) + 9)]
    store = Store(spark.createDataFrame(rows, "word string, site_id long, url_id long, section int, pos int"))
    side = Side(
        sites=spark.createDataFrame([(1, "http://a.test/"), (2, "http://b.test/")], "site_id long, site string"), subsets=spark.createDataFrame([(7, "http://s/%"), (8, "http://t/%")], "subset_id int, mask string"),
        subset_urls=spark.createDataFrame([(7, 21), (8, 10)], "subset_id int, url_id long"), copies=spark.createDataFrame([(10, "<p>pump</p>"), (11, None)], "url_id long, page string"),
    )
    forms = {"en": {"pump": ("pumps",)}, "de": {"pump": ("pumpe",)}}
    ask = lambda form: cgi.answer(form, store, side, 0, 0, set(), forms)
    ids = lambda form: sorted(r["url_id"] for r in ask(form + "&gr=off").rows.collect())
    assert ids("q=pump") == [10, 21]
    assert ids("q=pump&fm=en") == [10, 20, 21] and ids("q=pump&fm=en+de") == [10, 11, 20, 21]
    assert ids("q=pump&ul=http://a%25") == [10] and ids("q=pump&ul=http://z%25") == []
    assert ids("q=pump&ul=http://s/%25") == [21] and ids("q=pump&ul=site/%238") == [10] and ids("q=pump&ul=site/%239") == []
    near, off = ({r["url_id"]: r["weight"] for r in ask(f"q=pump&gr=off&ad={x}").rows.collect()} for x in ("yes", "no"))
    assert near[10] > near[21] and off[10] == off[21] == near[10]
    assert [tuple(r) for r in ask("q=pump&ch=10").collect()] == [(10, '<p><span style="background:#ffff66">pump</span></p>')]
    assert [tuple(r) for r in ask("q=pump&ch=11").collect()] == [(11, None)] and ask("q=pump&ch=99").collect() == []


def test_extensions_come_before_rules(spark):
    from siftmesh.operators import crawl

    rules = [("Disallow", r"/private/", False)]
    got = one(spark, lambda c: crawl.first_rule(c, rules, extensions={"gif": "Disallow", "html": "Allow"}), "http://a/x.GIF", "http://a/private/y.html?q", "http://a/private/z", "http://a.gif/", "http://a/b.gif/c")
    assert got == ["Disallow", "Allow", "Disallow", "Allow", "Allow"]
    assert one(spark, lambda c: crawl.mime_type(c, [("text/plain", r"\.txt$"), ("image/x", r"\.im")]), "http://a/b.TXT", "http://a/b.img", "http://a/", None) == ["text/plain", "image/x", None, None]


def test_profiles_tell_languages_and_charsets_apart(spark):
    """Profiles learned from half of the documents on the other half."""
    from siftmesh.functions import charsets
    from siftmesh.plans import storage_catalog

    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(lang.isin("fr", "de") & (F.length("text") > 300)).select("doc_id", lang.alias("lang"), "text")
    each = [F.struct(F.concat_ws(" ", "lang", F.lit(c)).alias("name"), storage_catalog.coded("text", c).alias("data")) for c in storage_catalog.CHARSETS]
    coded = docs.select("doc_id", F.explode(F.array(*each)).alias("r")).select("doc_id", "r.*")
    profiles = charsets.learned(coded.where("doc_id % 2 = 0"))
    assert len(profiles) == 6 and all(0 < len(p) <= charsets.PROFILE for p in profiles.values())
    rows = [(r["name"], charsets.guess(bytes(r["data"]), profiles)) for r in coded.where("doc_id % 2 = 1").collect()]
    assert len(rows) > 30 and sum(a == b for a, b in rows) >= 0.9 * len(rows)
