"""What the methods promise beyond small inputs: long texts, hot keys, clashing ids and
names, penalties that act; and each registered query against plain code."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import decontaminate, fingerprint, jaccard, langid, quality, registry, secrets, substrings, toxicity
from waymark.llm._common import Words, materialise, table
from waymark.llm.linear import ftrl

from .test_operators import base, deduped, entropy, hits, linked, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_word_hashes_do_not_depend_on_their_place():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bc", "é", "x" * 300, "y" * 200_000]) for _ in range(rng.randrange(6))).encode() for _ in range(40)]
    w, seen = Words(texts), {}
    for t, a, b in zip(texts, w.bounds, w.bounds[1:]):
        assert len(t.split()) == b - a
        for word, h in zip(t.split(), w.hashes[a:b].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_anchors_are_the_same_in_any_slice():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 2_500_000, np.uint64)
    whole = substrings._least(values, 13)
    assert len(whole) == len(values) - 12
    for a in (0, 1_048_500, 2_097_100, 2_400_000):
        part = substrings._least(values[a : a + 5000], 13)
        assert (part + a == whole[a : a + len(part)]).all()


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substrings_of_one_id_over_two_texts(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(12)
    shared, other = " ".join(words(rng, 25)), " ".join(words(rng, 40))
    rows = [(5, f"{other} {shared}"), (5, "tail"), (2, f"a b {shared} c"), (9, f"{shared} {other}"), (None, f"z {other}"), (7, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_words): r for r in substrings.deduplicate(got, shard_words=100).collect()}
    assert found[2, 28].n_removed == 0  # the first occurrence stays
    assert found[5, 65].n_removed == 65 and found[9, 65].n_removed == 65 and found[None, 41].n_removed == 0 and found[5, 1].n_removed == 0
    many = [(i, t) for i, t in enumerate([f"{shared} w{i} {other}" for i in range(30)])]
    want = deduped(many)
    for r in substrings.deduplicate(spark.createDataFrame(many, "doc_id long, text string"), shard_words=100).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_jaccard_of_one_id_with_different_texts(spark):
    rng = random.Random(13)
    a, b = (words(rng, 60, 10_000) for _ in range(2))
    near = [*a[:-1], "x"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), (None, " ".join(b)), (None, " ".join(words(rng, 60, 10_000)))]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]


def test_secrets_of_long_runs(spark):
    rng = random.Random(14)
    text = {"base64": "".join(rng.choice(secrets.BASE64) for _ in range(300_000)), "letters": "ab" * 300_000, "keys": " ".join(f"{rng.getrandbits(128):032x}" for _ in range(3000))}
    df = spark.createDataFrame(list(text.items()), "k string, text string")
    began = time.time()
    got = {r.k: r for r in secrets.scan(df).collect()}
    assert time.time() - began < 60
    assert [(s["start"], s["end"]) for s in got["base64"].entropy if s["kind"] == "entropy_base64"] == [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{24,}", text["base64"])]
    assert not got["letters"].entropy and len(got["keys"].hex) == 3000
    assert all(text["keys"][s["start"] : s["end"]].isalnum() for s in got["keys"].hex)


def added(text):
    """The spans that the method adds, by plain code."""
    out = []
    for kind, pattern, alphabet, window, bits in secrets.CLASSES:
        for m in re.finditer(pattern, text):
            s = m[0]
            value = re.search(f"[^=/]{{{window},}}$", s)
            if re.search("[0-9]", s) and re.search("[A-Za-z]", s) and not re.search(secrets.ALLOW, value[0] if value else s):
                if entropy(s.lower() if alphabet == secrets.HEX else s, window) >= bits:
                    out.append((m.start(), m.end(), kind))
    return sorted(out)


def test_added_spans_are_those_of_plain_code(spark, documents):
    rng = random.Random(15)
    key = lambda n: "".join(rng.choice(secrets.BASE64[:62]) for _ in range(n))
    texts = [f"/latest/{key(30)} contest_id={key(40)} TEST_KEY={key(26)} sample_{key(30)} {key(24)}", f"x={key(23)} {'0123456789' * 4}", "a/b/c/d/" * 8, *(t or "" for _, t in documents)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in secrets.scan(got).collect():
        assert sorted((s["start"], s["end"], s["kind"]) for s in r.entropy) == added(r.text)
    assert len(added(texts[0])) >= 3


def test_fingerprints_of_many_lines(spark):
    lines = [f"line {i} of it" for i in range(20_000)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join([*lines[:15_000], "new", *lines[15_001:]])), ("a\nb", "c")], "a string, b string")
    sets = df.select(*(fingerprint.paragraphs(F.col(c)).alias(c) for c in "ab"))
    cells = sets.withColumns({f"c{c}": fingerprint.sketch(F.col(c), fingerprint.CELLS) for c in "ab"})
    began = time.time()
    got = [r.near for r in cells.select(fingerprint.likeness(*(F.col(c) for c in ("a", "b", "ca", "cb"))).alias("near")).collect()]
    assert got == [pytest.approx(2 * 19_999 / 40_000), 0.0] and time.time() - began < 60
    wide = spark.range(1).select(fingerprint.as_text(F.array(F.struct(F.lit(0x12345).alias("c"), F.lit(1).alias("k"), F.lit(2).cast("long").alias("h")))).alias("t"))
    assert wide.first().t == "00012345" + "0" * 15 + "1" + "00000002"


def test_edited_texts(spark):
    rows = [(1, "abcdefg"), (2, "xy"), (3, ""), (4, "é😀ü")]
    nexts = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.e for r in nexts.select("doc_id", fingerprint.edited(F.col("text"), F.col("next_text")).alias("e")).collect()}
    assert got == {1: "abcdxy", 2: "x", 3: "", 4: "é😀a"}


def test_the_counterfactual_penalty_acts_on_the_corpus(spark):
    """Where the corpus names one group in its toxic rows and another in the rest."""
    sf = "/root/testdata/sf0.01"
    rows = quality.labelled(table(spark, sf, "documents"), table(spark, sf, "labels"), "toxic", ~toxicity.held_out(), 2000)
    pairs = toxicity.learn(rows)["pairs"]
    named = rows.withColumn("text", F.concat("text", F.when(F.col("y") > 0, F.lit(". All women.")).otherwise(F.lit(". All men."))))
    gap = {}
    for penalty in (0.0, 4.0):
        model = toxicity.learn(named, penalty=penalty)
        women, men = (sum(model["weights"].get(int(h), 0.0) for h in toxicity._hashed(set(toxicity.forms(t)))) for t in (b"women", b"men"))
        gap[penalty] = abs(women - men)
    assert pairs > 100 and model["pairs"] > pairs and gap[4.0] < 0.3 * gap[0.0]


def test_naive_bayes_against_plain_counts(spark):
    rng = random.Random(16)
    say = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    rows = [(say("abcd ", 200), "x") for _ in range(20)] + [(say("bcde ", 200), "y") for _ in range(12)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    probes = [say("abcde ", 12) + "a" for _ in range(40)]

    def plain(text):
        logs = []
        for lang in ("x", "y"):
            own = [t for t, k in rows if k == lang]
            total = math.log((len(own) + 1) / (len(rows) + 2))
            for n in langid.GRAMS:
                bucket = lambda t: langid._buckets(np.array([ord(c) for c in t], np.uint32), n).tolist()  # noqa: E731, B023
                seen = [b for t in own for b in bucket(t)]
                total += sum(math.log((seen.count(b) + 0.5) / (len(seen) + 0.5 * langid.BUCKETS)) for b in bucket(text))
            logs.append(total)
        return 1 / (1 + math.exp(min(logs) - max(logs))), "xy"[logs.index(max(logs))]

    for text, lang, p in zip(probes, *langid.score(probes, model)):
        assert (p, lang) == (pytest.approx(plain(text)[0], abs=0.02), plain(text)[1])


def test_ftrl_against_plain_updates():
    rng = random.Random(17)
    rows = [(np.array(sorted(rng.sample(range(12), 3))), np.array([rng.random() for _ in range(3)]), rng.randrange(2)) for _ in range(30)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.5
    w, b = ftrl(rows, 12, alpha, beta, l1, l2, epochs=2, updates=0, seed=7)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        if i == 12:
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            x = {int(i): float(v) for i, v in zip(*rows[r][:2])} | {12: 1.0}
            own = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(own[i] * x[i] for i in x))) - rows[r][2]
            for i, v in x.items():
                z[i] += g * v - (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / alpha * own[i]
                n[i] += (g * v) ** 2
    assert w == pytest.approx([weight(i) for i in range(12)], abs=1e-5) and b == pytest.approx(weight(12), abs=1e-6)


# the registered queries by name


def rows_of(spark, name):
    return {r.doc_id: r for r in registry.queries()[name](spark, SF).collect()}


def test_op1(spark, documents):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = rows_of(spark, "op1_decontaminate")
    assert len(got) == len(documents)
    grams = {}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for item, t in items:
        w = split(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    for i, t in documents:
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in grams:
                    hit.update(range(p, p + k))
                    found |= grams[tuple(w[p : p + k])]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_op3_and_op10(spark, documents):
    want, got = deduped(documents), rows_of(spark, "op3_substring_dedup")
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert {i: (r.n_shingles, r.component_id) for i, r in rows_of(spark, "op10_ngram_jaccard").items()} == linked(documents)


def test_op7(spark, documents):
    got = rows_of(spark, "op7_secrets")
    for i, t in documents:
        own = base(t)
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in own)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for _, _, kind, _ in own) for k in ("assign", "access", "hex"))
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_op8(spark, documents):
    got, order = rows_of(spark, "op8_fingerprints"), sorted(documents)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + following[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[i].edited_fingerprint) >= (t == edit)


@pytest.mark.parametrize(("name", "cut"), [("op6_toxicity", 0.5), ("op9_quality", 0.7)])
def test_op6_and_op9(spark, documents, name, cut):
    got = rows_of(spark, name)
    assert len(got) == len(documents)
    assert all(r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in got.values())
    assert {r.held_out for r in got.values()} == {True, False}


def test_op5(spark, documents):
    got = rows_of(spark, "op5_language_id")
    langs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r for i, r in got.items() if r.held_out and langs[i] and r.lang_pred != "und"]
    assert len(got) == len(documents) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


# the pipeline


def test_stages_on_odd_rows(spark):
    rng = random.Random(18)
    docs = table(spark, SF, "documents")
    text = " ".join(words(rng, 50))
    odd = [(900_001, None), (900_002, ""), (None, text), (None, text), (900_003, text), (900_003, text), (900_004, "x" * 50_000)]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    clash = docs.unionByName(more).withColumns({"score": F.lit("kept"), "items": F.lit(1), "spans": F.lit(None).cast("string"), "n_words": F.lit("w"), "a.b": F.lit(2), "node": F.lit(3)})
    schema = clash.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        clash = materialise(stage(spark, clash, SF), f"odd-{name}")
        assert [(f.name, f.dataType) for f in clash.schema] == [(f.name, f.dataType) for f in schema], name
        assert clash.where("score != 'kept' or items != 1 or spans is not null or n_words != 'w' or node != 3").count() == 0
    left = [r.doc_id for r in clash.collect()]
    assert not {900_001, 900_002} & set(left) and left.count(900_003) + left.count(None) <= 2
    assert corpus_pipeline.STAGES[-1][1](spark, clash, SF).select("doc_id").distinct().count() == len(set(left))


def test_near_duplicate_and_contaminated_documents_go(spark):
    docs = table(spark, SF, "documents")
    want = linked([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").limit(5).collect()]
    planted = spark.createDataFrame([(1, items[0][1], "en", "s", 0), (2, "nothing of the kind", "en", "s", 0)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, planted, SF).collect()] == [2]
    assert hits(items[0][1], items)[1] > 0 and decontaminate.WINDOW == 13
