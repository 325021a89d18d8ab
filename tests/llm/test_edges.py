"""Cases that tables of plain prose do not hold: odd characters, stuck sketches, fits against plain ones."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import fingerprint, langid, packing, registry, search
from waymark.llm._common import table
from waymark.llm.linear import counterfactual, sigmoid

SF = "/root/testdata/sf0.001"


def test_tokens_of_odd_characters_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.WordTokens(path)
    rng = random.Random(6)
    odd = [chr(c) for c in (*range(33), 0x7F, 0x85, 0xA0, 0x130, 0x131, 0x17F, 0x1C5, 0x301, 0x307, 0x345, 0x374, 0x3A3, 0x3C2, 0x340, 0x344, 0x530, 0x5D0, 0x958, 0x95F, 0x9DC, 0xAC00, 0x1100, 0x1161, 0x1E9E, 0x2003, 0x2028, 0x212A, 0x2160, 0xFB01, 0xFEFF, 0x1D400, 0x1F600, 0x2F800)]
    plain = list("abZéñœł09.,;:!?-_(){}[]<>|'\"#/\\ \n\t")
    texts = ["end}\x7f", "a\x00.", "\x1b[0m", "Beyoğlu İ.", "xक़.", "é\x00.", "ﬁ.", "é.", "1́,", "don't\x07", "<|endoftext|>\x00"]
    texts += ["".join(rng.choice(odd if rng.random() < 0.3 else plain) for _ in range(rng.randrange(1, 25))) for _ in range(8000)]
    texts += [f"{a}{chr(c)}{b}" for c in range(0x700) for a in ("", "a") for b in ("", ".", ".b")]
    texts += [f"{chr(c)}." for c in range(0x700, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 3000):
        part = texts[i : i + 3000]
        got = [np.frombuffer(x, own.dtype).tolist() for x in own(part)]
        want = [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        assert [(t, a) for t, a, b in zip(part, got, want) if a != b] == []


@pytest.mark.parametrize(("text", "letters"), [("²½①Ⅷ", False), ("٣ 12_", False), ("", False), ("ª", True), ("²a", True), ("漢", True)])
def test_letters_are_those_of_the_letter_categories(text, letters):
    assert langid.has_letter(text) is letters


def test_language_of_digits_is_unknown(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "el gato")], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("es"))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["²½ ①", "Ⅷ", None, "12"])], "doc_id long, text string")
    got = langid.identify(odd, langid.learn(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_a_part_that_never_peels_is_compared(spark, monkeypatch):
    """Sketches of one cell a table are stuck with any two digests: the count must still be right."""
    monkeypatch.setattr(fingerprint, "PART_CELLS", (3,))
    rng = random.Random(2)
    sets = [(sorted(rng.sample(range(1, 400), n)), sorted(rng.sample(range(1, 400), m))) for n, m in ((0, 0), (1, 0), (30, 30), (5, 60), (200, 190))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sets)], "i int, a array<long>, b array<long>")
    cells = df.withColumns({f"c{x}": fingerprint.sketch(F.col(x), fingerprint.CELLS) for x in "ab"})
    got = cells.select("i", fingerprint.difference(F.col("a"), F.col("b"), F.col("ca"), F.col("cb")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: len(set(a) ^ set(b)) for i, (a, b) in enumerate(sets)}


def test_op8_likeness_is_that_of_the_sets(spark):
    """Likeness of the query from plain sets of digests, whatever sketches recovered."""
    got = {r.doc_id: r for r in registry.queries()["op8_fingerprints"](spark, SF).collect()}
    rows = fingerprint.with_next(table(spark, SF, "documents").select("doc_id", "text")).withColumn("edit", fingerprint.edited(F.col("text"), F.col("next_text")))
    sets = rows.select("doc_id", *(fingerprint.paragraphs(F.col(c)).alias(c) for c in ("text", "edit", "next_text"))).collect()
    like = lambda a, b: 1.0 if a == b else 2 * len(a & b) / (len(a) + len(b))
    for r in sets:
        a, e, n = (set(x) for x in (r.text, r.edit, r.next_text))
        assert got[r.doc_id].near_edited == pytest.approx(like(a, e)) and got[r.doc_id].near_next == pytest.approx(like(a, n))
    assert len({r.near_edited for r in got.values()}) > 10


@pytest.mark.parametrize("penalty", [0.0, 4.0])
def test_counterfactual_fit_against_plain_steps(penalty):
    """The vectorised fit makes the steps that loops over rows, pairs and features make."""
    rng = random.Random(12)
    size, steps, l1, l2, rate = 9, 25, 5e-4, 1e-5, 0.5
    rows = [sorted(rng.sample(range(size), rng.randrange(1, 5))) for _ in range(20)]
    labels = np.array([float(rng.random() < 0.4) for _ in rows])
    swaps = [(np.array([rng.randrange(4)]), np.array([4 + rng.randrange(4)])) for _ in range(7)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w, b = counterfactual(bounds, np.concatenate(rows), labels, swaps, size, penalty, l1, l2, rate, steps)
    v, c, hist, hist_b = [0.0] * size, 0.0, [1e-8] * size, 1e-8
    share = sum(labels) / len(labels)
    for _ in range(steps):
        grad, gb = [2 * l2 * x for x in v], 0.0
        for r, y in zip(rows, labels):
            e = (sigmoid(sum(v[i] for i in r) + c) - y) * (0.5 / share if y else 0.5 / (1 - share)) / len(rows)
            gb += e
            for i in r:
                grad[i] += e
        for come, go in swaps:
            change = v[come[0]] - v[go[0]]
            grad[come[0]] += 2 * penalty / len(swaps) * change
            grad[go[0]] -= 2 * penalty / len(swaps) * change
        for i in range(size):
            hist[i] += grad[i] ** 2
            step = rate / hist[i] ** 0.5
            v[i] -= step * grad[i]
            v[i] = (1 if v[i] > 0 else -1) * max(abs(v[i]) - step * l1, 0.0)
        hist_b += gb**2
        c -= rate * gb / hist_b**0.5
    assert w == pytest.approx(v, abs=1e-9) and b == pytest.approx(c, abs=1e-9)


def test_an_index_serves_several_searches(spark):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)} w{i}") for i in range(60)], "doc_id long, text string")
    found = search.index(docs, shard_terms=50)
    one = search.search(found, spark.createDataFrame([(1, "beta w7")], "item_id long, text string"), k=3).collect()
    two = search.search(found, spark.createDataFrame([(1, "beta w7"), (2, "w8")], "item_id long, text string"), k=3).collect()
    assert one[0].doc_id == 7 and [r for r in two if r.item_id == 1] == one and [r.doc_id for r in two if r.item_id == 2] == [8]
