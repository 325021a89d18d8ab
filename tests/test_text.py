"""English stems against the published sample, and look-ups in the inverted index against plain code."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions.text import stems
from waymark.operators import catalog

# Words of the published sample vocabulary and of its description, each with its stem.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent
consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console
consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy
conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables
constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves
knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit
knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp
knopp knot knot knots knot skies sky dying die generate generat general general generically generic communism communism ties tie cries cri
gas gas this this kiwis kiwi hopping hop hoped hope hoping hope luxuriated luxuri by by say say cry cri boy boy happy happi relational relat
conditional condit rational ration digitizer digit sensibilities sensibl geology geolog formative format falling fall bled bled bee bee
agreed agre feed feed proceed proceed inning inning plates plate trails trail hiking hike mountains mountain ponies poni caresses caress
abilities abil yellow yellow toy toy youth youth adjustable adjust replacement replac adoption adopt controll control rate rate rolled roll
ridges ridg valley valley lakes lake
"""


def test_stems_of_the_published_sample(spark):
    words = SAMPLE.split()
    given, want = words[::2], words[1::2]
    got = spark.createDataFrame([(given,)], "w array<string>").select(stems(F.col("w"))).first()[0]
    assert [(w, a, b) for w, a, b in zip(given, got, want) if a != b] == [] and len(given) > 100


def test_odd_words(spark):
    got = spark.createDataFrame([(["", "a", "y", "42", "x9s"],), ([],), (None,)], "w array<string>").select(stems(F.col("w"))).collect()
    assert [r[0] for r in got] == [["", "a", "y", "42", "x9s"], [], None]


PLAIN = {
    "a & b": lambda w: "a" in w and "b" in w,
    "a | b & !c": lambda w: "a" in w or "b" in w and "c" not in w,
    "!a": lambda w: "a" not in w,
    "!a & !b": lambda w: "a" not in w and "b" not in w,
    "!a | b": lambda w: "a" not in w or "b" in w,
    "!(a | b) | c": lambda w: not ("a" in w or "b" in w) or "c" in w,
    "!!a": lambda w: "a" in w,
    "a <-> b": lambda w: ("a", "b") in zip(w, w[1:]),
    "a <-> b <-> c": lambda w: ("a", "b", "c") in zip(w, w[1:], w[2:]),
    "(a <-> b | c) & !d": lambda w: (("a", "b") in zip(w, w[1:]) or "c" in w) and "d" not in w,
    "d1:*": lambda w: any(x.startswith("d1") for x in w),
    "zz | zy": lambda w: False,
}


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(7)
    # letters that are no stop words, doubled so that a is a word of its own
    rows = [(i, [rng.choice(["a", "b", "c", "d", "d1", "d12"]) for _ in range(rng.randrange(5))]) for i in range(200)]
    df = spark.createDataFrame([(i, " ".join("q" + x for x in w) if i % 17 else None) for i, w in rows], "line_id long, name string")
    return {i: (w if i % 17 else []) for i, w in rows}, df, catalog.text_index(df)


@pytest.mark.parametrize("query", PLAIN)
def test_queries_equal_plain_code(names, query):
    own, df, index = names
    asked = re.sub(r"(?<![a-z0-9])([a-z])", r"q\1", query)
    got = {r.line_id for r in catalog.search(df, asked, walk_only=False, index=index).collect()}
    assert got == {i for i, w in own.items() if PLAIN[query](w)}


def test_two_levels(spark):
    rows = [(1, "x", "path", "s"), (2, "x", "track", "s"), (3, "x", "path", None), (4, None, "path", "s")]
    got = {r["name"]: r for r in catalog.by_name_and_kind(spark.createDataFrame(rows, "line_id long, name string, highway string, surface string"), ["line_id", "surface"]).collect()}
    assert [(k.kind, k.lines, [m.line_id for m in k.members]) for k in got["x"].kinds] == [("path", 2, [1, 3]), ("track", 1, [2])]
    assert got["x"].lines == 3 and got[None].lines == 1


def test_a_search_without_an_index_stems_each_name_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "text_index", lambda *a, real=catalog.text_index: made.append(real(*a)) or made[-1])
    names = ["red plate", "small gears", None, ""]
    lines = spark.range(400).select(F.col("id").alias("line_id"), F.array(*(F.lit(n) for n in names))[(F.col("id") % 4).cast("int")].alias("name"))
    got = {q: {r.line_id % 4 for r in catalog.search(lines, q, walk_only=False).collect()} for q in ("red | gears", "!gear")}
    assert got == {"red | gears": {0, 1}, "!gear": {0, 2, 3}}
    assert [m.count() for m in made] == [4, 4]
