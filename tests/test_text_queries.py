"""Query texts, cover ranks of any query, thesaurus and synonyms."""

import math
import random

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.functions import arrays, headlines, labelpath, stemmers
from tablewright.functions import textsearch as ts
from tablewright.operators import search


@pytest.mark.parametrize("text, shown", [
    ("a | b & c", "'a' | 'b' & 'c'"), ("(a | b) & c", "( 'a' | 'b' ) & 'c'"), ("!a & b", "!'a' & 'b'"), ("!(a & b)", "!( 'a' & 'b' )"), ("!!a", "!( !'a' )"),
    ("a <-> b", "'a' <-> 'b'"), ("a <2> b <-> c", "'a' <2> 'b' <-> 'c'"), ("a & b <-> c | d", "'a' & 'b' <-> 'c' | 'd'"), ("a <-> (b | c)", "'a' <-> 'b' | 'a' <-> 'c'"),
    ("(a & b) <-> c", "'a' <-> 'c' & 'b' <-> 'c'"), ("a <-> !b", "'a' & !( 'a' <-> 'b' )"), ("!a <-> b", "!( 'a' <-> 'b' ) & 'b'"), ("!a <-> !b", "!'a' & !'b'"),
    ("'it''s'", "'it' & 's'"), ("'New York':*AB", "'new':*AB & 'york':*AB"), ("fo:b*a", "'fo':*AB"), ("a&b|c", "'a' & 'b' | 'c'"), ("((a))", "'a'"),
])
def test_query_texts(text, shown):
    assert repr(ts.to_query(text)) == shown


@pytest.mark.parametrize("text", ["a b", "a &", "& a", "(a", "a)", "a <-> ", "<-> a", "a <x> b", "'open", "!", "a & | b", ""])
def test_query_texts_with_faults(text):
    with pytest.raises(ValueError):
        ts.to_query(text)


def test_stop_words_in_query_texts(spark):
    english = lambda q: repr(ts.to_query(q, "english"))
    assert english("the & cats") == "'cat'" and english("cats <-> of <-> dogs") == "'cat' <2> 'dog'" and english("the <-> cats") == "'cat'"
    assert ts.to_query("the & !of | (a)", "english") is None
    with pytest.raises(ValueError):
        arrays.matches_query(F.array(F.lit(1)), "1 <-> 2")


def test_expressions_over_arrays_and_labels(spark):
    df = spark.createDataFrame([([1, 2, 5], "Top.Science.Astronomy"), ([3], "Top.Hobbies")], "a array<int>, p string")
    got = df.select(arrays.matches_query(F.col("a"), "1&(2|3)&!4").alias("x"), arrays.matches_query(F.col("a"), "!(1|2)").alias("y")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True)]
    assert [r.x for r in df.select(labelpath.matches_words(F.col("p"), "Astro* & !Hobbies").alias("x")).collect()] == [True, False]


def vector(words):
    return F.array(*[F.struct(F.lit(w).alias("term"), F.lit(p).alias("pos"), F.lit(k).alias("w")) for w, p, k in words])


def matches(q, inside):
    """Does a stretch of (word, position) match?"""
    if isinstance(q, ts.And):
        return all(matches(p, inside) for p in q.parts)
    if isinstance(q, ts.Or):
        return any(matches(p, inside) for p in q.parts)
    if isinstance(q, ts.Not):
        return not matches(q.parts[0], inside)
    return bool(ends(q, inside))


def ends(q, inside):
    if isinstance(q, ts.Term):
        return {p for w, p in inside if (w.startswith(q.word) if q.prefix else w == q.word)}
    return {b for a in ends(q.parts[0], inside) for b in ends(q.parts[1], inside) if b == a + q.distance}


@pytest.mark.parametrize("text", ["a", "a & b", "a | b", "a & (b | c)", "a <-> b", "a & b & c", "(a | b) & (c | d)", "a <2> b | c", "a & !b", "(a & c) & !b", "a <-> b & c", "(a | b <-> c) & !(d & a)", "a* & b".replace("a*", "'a':*")])
def test_extents_are_the_shortest_matches(text):
    q, rng = ts.to_query(text), random.Random(text)
    for _ in range(60):
        doc = [(rng.choice("abcde") + rng.choice(["", "", "x"]) * (rng.random() < 0.2), p) for p in sorted(rng.sample(range(1, 40), rng.randint(0, 14)))]
        at = {t: sorted(ends(t, doc)) for t in q.leaves()}
        places = [p for _, p in doc]
        inside = lambda i, j: [x for x in doc if i <= x[1] <= j]
        positive = ts.And(*[p for p in q.parts if not isinstance(p, ts.Not)]) if isinstance(q, ts.And) else q
        hit = [(i, j) for i in places for j in places if i <= j and matches(positive, inside(i, j))]
        shortest = [e for e in hit if not any(o != e and e[0] <= o[0] and o[1] <= e[1] for o in hit)]
        assert q.extents(at) == sorted(e for e in shortest if matches(q, inside(*e)))


def test_cover_rank_values(spark):
    words = [("with", 3, "D"), ("was", 5, "D"), ("were", 6, "A"), ("with", 9, "D"), ("x", 20, "D")]
    df = spark.range(1).select("id", vector(words).alias("v"))
    one = lambda q, **k: search.cover_rank(df, "id", F.col("v"), ts.to_query(q), **k).select("rank", "covers").first()
    assert one("with & (was | were)") == (pytest.approx(0.1 / 2 + (2 / 11) / 3), 2)
    r = one("with & (was | were)", norm=4)
    # middles 4 and 7.5
    assert r.rank == pytest.approx((0.1 / 2 + (2 / 11) / 3) / (2 / (1 / 3.5)))
    assert one("with & was", norm=1).rank == pytest.approx(one("with & was").rank / math.log(6))
    assert one("were").rank == pytest.approx(1.0) and one("with").covers == 2
    assert one("with & nothing") is None and one("with & !was").covers == 2 and one("(with & was) & !were").covers == 1
    assert one("with & was", norm=32).rank == pytest.approx(one("with & was").rank / (one("with & was").rank + 1))
    empty = spark.range(1).select("id", F.lit(None).cast("array<struct<term:string,pos:int,w:string>>").alias("v"))
    assert search.cover_rank(empty, "id", F.col("v"), ts.to_query("a")).count() == 0


@pytest.mark.parametrize("text, expect", [
    ("a of of b", "a from from b"), ("by the of", "bythe from"), ("x of the y", "x ofthe y"), ("of by the", "from bythe"), ("by by the", "by bythe"),
    ("one of these two here", "12 here"), ("one two here", "one two here"), ("by", "by"), ("", ""), ("big bang theory x", "cosmology x"), ("big bang x", "bang2 x"), ("big x", "big x"),
])
def test_thesaurus(spark, text, expect):
    phrases = {"of": "from", "by the": "bythe", "of the": "ofthe", "one ? ? two": "12", "big bang theory": "cosmology", "big bang": "bang2"}
    got = spark.range(1).select(search.thesaurus(ts.words(F.lit(text)), phrases, stop=["of", "these"]).alias("w")).first().w
    assert " ".join(got) == expect


def test_thesaurus_does_not_read_what_it_wrote(spark):
    got = spark.range(1).select(search.thesaurus(ts.words(F.lit("of the b")), {"of": "by", "by the": "never"}).alias("w"), search.thesaurus(F.lit(None).cast("array<string>"), {"a": "b"}).alias("n")).first()
    assert got.w == ["by", "the", "b"] and got.n is None


@pytest.mark.parametrize("how, expect", [
    ({}, {"supernova": ["supernova", "sn", "sne", "1987a"], "sn": ["sn"], "grb": ["grb"]}),
    ({"keep_word": False}, {"supernova": ["sn", "sne", "1987a"], "sn": ["sn"], "grb": ["grb"]}),
    ({"match_synonyms": True}, {"supernova": ["supernova", "sn", "sne", "1987a"], "sn": ["supernova", "sn", "sne", "1987a"], "grb": ["grb"]}),
    ({"keep_word": False, "match_synonyms": True}, {"supernova": ["sn", "sne", "1987a"], "sn": ["sn", "sne", "1987a"], "grb": ["grb"]}),
    ({"match_word": False, "keep_synonyms": False, "match_synonyms": True}, {"supernova": ["supernova"], "sn": ["supernova"], "grb": ["grb"]}),
    ({"keep_word": False, "match_word": False, "keep_synonyms": False}, {"supernova": ["supernova"], "sn": ["sn"], "grb": ["grb"]}),
    ({"keep_word": False, "keep_synonyms": False, "match_synonyms": True}, {"supernova": [], "sn": [], "grb": ["grb"]}),
])
def test_extended_synonyms(spark, how, expect):
    tokens = spark.createDataFrame([(w, w) for w in ("supernova", "sn", "grb")], "at string, term string")
    rules = spark.createDataFrame([("supernova", ["sn", "sne", "1987A"])], "word string, others array<string>")
    got = {w: [] for w in expect}
    for r in search.extended_synonyms(tokens, "term", rules, "word", "others", **how).collect():
        got[r["at"]].append(r.term)
    assert got == expect


POEM = """
Day after day, day after day,
  We stuck, nor breath nor motion,
As idle as a painted Ship
  Upon a painted Ocean.
Water, water, every where
  And all the boards did shrink;
Water, water, every where,
  Nor any drop to drink.
S. T. Coleridge (1772-1834)
"""


def shown(spark, text, query, options, config="english"):
    q = ts.to_query(query, config)
    return spark.range(1).select(headlines.headline(F.lit(text), q, options, config).alias("h")).head().h


# known results
@pytest.mark.parametrize("query, options, want", [
    ("paint & water", "", "<b>painted</b> Ocean.\n<b>Water</b>, <b>water</b>, every where\n  And all the boards did shrink;\n<b>Water</b>, <b>water</b>, every"),
    ("breath & motion & water", "", "<b>breath</b> nor <b>motion</b>,\nAs idle as a painted Ship\n  Upon a painted Ocean.\n<b>Water</b>, <b>water</b>"),
    ("ocean", "", "<b>Ocean</b>.\nWater, water, every where\n  And all the boards did shrink;\nWater, water, every where"),
    ("day & drink", "", "<b>day</b>,\n  We stuck, nor breath nor motion,\nAs idle as a painted Ship\n  Upon a painted Ocean.\nWater, water, every where\n"
     "  And all the boards did shrink;\nWater, water, every where,\n  Nor any drop"),
    ("ocean", "MaxFragments=1", "after day,\n  We stuck, nor breath nor motion,\nAs idle as a painted Ship\n  Upon a painted <b>Ocean</b>.\nWater, water, every where\n"
     "  And all the boards did shrink;\nWater, water, every where,\n  Nor any drop"),
    ("Coleridge & stuck", "MaxFragments=2", "after day, day after day,\n  We <b>stuck</b>, nor breath nor motion,\nAs idle as a painted Ship\n  Upon a painted Ocean.\n"
     "Water, water, every where\n  And all the boards did shrink;\nWater, water, every where ... drop to drink.\nS. T. <b>Coleridge</b>"),
    ("ocean & seahorse", "MaxFragments=1", "\nDay after day, day after day,\n  We stuck, nor breath nor motion,\nAs idle as"),
])
def test_headlines(spark, query, options, want):
    assert shown(spark, POEM, query, options) == want


def test_headline_options(spark):
    for query, options, want in [
        ("1 <-> 3", "MaxWords=2, MinWords=1", "<b>1</b> <b>3</b>"), ("1 & 3", "MaxWords=4, MinWords=1", "<b>1</b> 2 <b>3</b>"),
        ("1 <-> 3", "MaxWords=4, MinWords=1", "<b>1</b> <b>3</b>"),
    ]:
        assert shown(spark, "1 2 3 1 3", query, options, "simple") == want
    both = "MaxFragments=2,FragmentDelimiter=***"
    assert shown(spark, POEM, "Coleridge & stuck", both) == shown(spark, POEM, "Coleridge & stuck", "MaxFragments=2").replace(" ... ", "***")
    page = "<body>\n<b>Sea</b> view <u>foo bar</u>\n</body>"
    assert shown(spark, page, "sea & foo", "HighlightAll=true, StartSel=[, StopSel=]") == "<body>\n<b>[Sea]</b> view <u>[foo] bar</u>\n</body>"
    assert shown(spark, page, "sea & foo", "StartSel=[, StopSel=], MinWords=1") == "[Sea]  view  [foo]"
    assert shown(spark, "a b", "b & !c", "MinWords=1, MaxWords=2", "simple") == "<b>b</b>"
    assert shown(spark, "thread three by", "thr:*", "MinWords=2, MaxWords=3", "simple") == "<b>thread</b> <b>three</b>"
    for wrong, message in [("MinWords=9, MaxWords=9", "less"), ("MinWords=0", "positive"), ("ShortWord=-1", "negative"), ("Words=3", "unrecognized")]:
        with pytest.raises(ValueError, match=message):
            headlines.Options.of(wrong)


def test_headline_inputs(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "x"), (5, "the " * 200_000), (6, "w " * 300_000 + "the end")], "id int, text string")
    for options, long in (("", 15), ("MaxFragments=2", 35)):
        got = {r.id: r.h for r in rows.select("id", headlines.headline(F.col("text"), ts.to_query("the"), options).alias("h")).collect()}
        assert (got[1], got[2], got[3], got[4]) == (None, "", "", "x")
        assert got[5].count("<b>the</b>") == (long if long == 15 else 70) and "<b>the</b>" in got[6]
    assert rows.limit(0).select(headlines.headline(F.col("text"), None)).count() == 0
    assert spark.range(1).select(headlines.headline(F.lit("a b"), None).alias("h")).head().h == "a b"


def test_fragments_do_not_overlap_and_show_most(spark):
    rnd = random.Random(3)
    for _ in range(30):
        words = [rnd.choice("xyzabcdefgh") * rnd.randint(1, 6) for _ in range(rnd.randint(1, 120))]
        text = " ".join(f"{w}{i}" if w[0] not in "xyz" else w[0] for i, w in enumerate(words))
        q = ts.to_query("x & (y | z)")
        o = headlines.Options(max_words=9, min_words=4, max_fragments=3)
        t = headlines._Text(text, q, o, "simple", {})
        parts = t._fragments()
        assert len(parts) <= 3 and all(b < c for (_, b), (c, _) in zip(parts, parts[1:])) and all(b - a < 9 for a, b in parts)
        if parts:
            assert max(t._count(a, b) for a, b in parts) >= max(t._count(a, b) for a, b in t._pieces())


# known stems
STEMS = {
    "german": (
        "aufeinander:aufeinand aufeinanderbiss:aufeinanderbiss aufeinanderfolge:aufeinanderfolg aufeinanderfolgen:aufeinanderfolg "
        "aufeinanderfolgend:aufeinanderfolg aufeinanderfolgende:aufeinanderfolg aufeinanderfolgenden:aufeinanderfolg "
        "aufeinanderfolgt:aufeinanderfolgt aufeinanderschlügen:aufeinanderschlug auferlegen:auferleg auferlegt:auferlegt "
        "aufenthalt:aufenthalt auffällig:auffall auffälliges:auffall auffällt:auffallt kategorie:kategori kategorien:kategori "
        "kategorischen:kategor kater:kat katers:kat kathedrale:kathedral kathinka:kathinka katholik:kathol katholischen:kathol "
        "katholizismus:katholizismus kätzchen:katzch kätzchens:katzch kauen:kau kauern:kau kauf:kauf kaufen:kauf käufer:kauf"
    ),
    "spanish": (
        "cheque:chequ cheques:chequ cheyene:cheyen chi:chi chía:chi chiapaneca:chiapanec chic:chic chica:chic chicago:chicag "
        "chicas:chic chicharrones:chicharron chicos:chic chico:chic chihuahua:chihuahu chihuahuense:chihuahuens chiítas:chiit torá:tor "
        "tórax:torax torcer:torc toreado:tor toreados:tor toreándolo:tor torear:tor toreara:tor torearlo:tor toreó:tore torero:torer "
        "toreros:torer torio:tori tormenta:torment tormentas:torment tornado:torn tornados:torn tornar:torn tornen:torn torneo:torne "
        "torneos:torne tornillo:tornill"
    ),
    "french": (
        "continu:continu continua:continu continuait:continu continuant:continu continuation:continu continue:continu continué:continu "
        "continuel:continuel continuelle:continuel continuellement:continuel main:main mains:main maintenaient:mainten "
        "maintenait:mainten maintenant:mainten maintenir:mainten maintenue:maintenu maintien:maintien majestueuse:majestu "
        "majestueusement:majestu majestueux:majestu majeur:majeur majeure:majeur majordome:majordom majorité:major malade:malad "
        "maladie:malad maladies:malad maladroit:maladroit"
    ),
}


@pytest.mark.parametrize("language", sorted(STEMS))
def test_stems_of_languages(spark, language):
    pairs = [p.split(":") for p in STEMS[language].split()]
    assert [stemmers.STEMMERS[language](w) for w, _ in pairs] == [s for _, s in pairs]
    rows = spark.createDataFrame([(w, language) for w, _ in pairs] + [(None, language), ("worte", None), ("worte", "other")], "w string, c string")
    got = [r.s for r in rows.select(ts.stem_by(F.col("w"), F.col("c")).alias("s")).collect()]
    assert got == [s for _, s in pairs] + [None, "worte", "worte"]
    assert [f("") for f in stemmers.STEMMERS.values()] == ["", "", "", ""] and all(isinstance(f(c), str) for f in stemmers.STEMMERS.values() for c in "asyé")


def test_language_vectors_meet_queries(spark):
    text = spark.range(1).select(F.lit("Die Kategorien der Katholiken").alias("t"))
    v = ts.to_vector(F.col("t"), "german", stop=["die", "der"])
    row = text.select(F.transform(v, lambda o: F.concat_ws(":", o["term"], o["pos"])).alias("v"), ts.match(v, ts.to_query("kategorie & katholik", "german")).alias("m")).head()
    assert row.v == ["kategori:2", "kathol:4"] and row.m
    h = text.select(headlines.headline(F.col("t"), ts.to_query("kategorie", "german"), "MinWords=1, MaxWords=3", "german").alias("h")).head().h
    assert h == "<b>Kategorien</b>"


def test_lexize_and_debug(spark):
    words = spark.createDataFrame([("Stars",), ("the",), (None,)], "w string")
    assert [r.x for r in words.select(ts.lexize(F.col("w"), "english").alias("x")).collect()] == [["star"], [], None]
    text = F.lit("The stars: 3.5 a@b.org well-known")
    got = [tuple(r) for r in spark.range(1).select(F.explode(ts.debug(text, "english")).alias("d")).select("d.*").collect() if r.alias != "blank"]
    assert got == [
        ("asciiword", "The", "english_stem", []), ("asciiword", "stars", "english_stem", ["star"]), ("float", "3.5", "simple", ["3.5"]),
        ("email", "a@b.org", "simple", ["a@b.org"]), ("asciihword", "well-known", "english_stem", ["well-known"]),
    ]
    assert spark.range(1).select(ts.debug(F.lit(None).cast("string")).alias("d")).head().d is None
    assert spark.range(1).select(F.size(ts.debug(F.lit(""))).alias("n")).head().n == 0


def test_tokens_and_types_equal_the_plain_list_of_patterns(spark):
    odd = ["a.b@c.de, x", "see http://x.y/z?q=1 now", "http: //x", "www.site.org.", "3.14 2a a2 22", "well-known-fact - end-", "a_b+c", "++a@b.cd", "naïve Straße x²", "Ab\u0301c",
           "\n\ttab\u0085 end.", "https://", "a:b", "--- ... ___", "x@y", "-", "", "été.fr", "z-9-y", "日本語 test", "a.b.c", "a.bc1"]
    plain = "(" + "|".join(p for _, _, p in ts.TOKEN_TYPES) + ")"

    def typed(token):
        kind = F.lit(12)
        for number, _, pattern in reversed(ts.TOKEN_TYPES[:-1]):
            kind = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(number)).otherwise(kind)
        return kind

    df = spark.createDataFrame([(t,) for t in odd] + [(None,)], "t string")
    found = F.regexp_extract_all("t", F.lit(plain), F.lit(1))
    for row in df.select("t", ts.tokens(F.col("t")).alias("got"), found.alias("want"), F.transform(found, ts.token_type).alias("k"), F.transform(found, typed).alias("types")).collect():
        assert row.got == row.want and row.k == row.types, row.t


def test_list_words_are_handled_once_a_batch():
    seen = []

    def rule(words):
        seen.extend(words)
        return [w and w.upper() for w in words]

    lists = pa.array([["a", "b", "a"], None, [], ["b", None, "a"]] * 50, pa.list_(pa.string()))
    assert ts.over_distinct(lists, rule).to_pylist() == [["A", "B", "A"], None, [], ["B", None, "A"]] * 50
    assert ts.over_distinct(lists.slice(1, 3), rule).to_pylist() == [None, [], ["B", None, "A"]]
    assert len([w for w in seen if w]) == 4


def test_headlines_ask_few_words_whether_they_may_end(monkeypatch):
    asked = []
    plain = headlines._Text._ends
    monkeypatch.setattr(headlines._Text, "_ends", lambda self, i: asked.append(i) or plain(self, i))
    text = "word " * 3000 + "hit " + "tail " * 3000
    shown = headlines._Text(text, ts.to_query("hit"), headlines.Options(), "simple", {}).headline()
    assert "<b>hit</b>" in shown and len(asked) < 100
