"""Lexical search, spelling variants and chat formatting against plain code, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import chat, registry, search, spelling
from waymark.llm._common import materialise

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_spelling_variants", "op13_chat_formatting"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got


# 11: ranked lexical search


def ranking(docs, items, k):
    get = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    own = [(i, Counter(get(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    nd, nt = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(get(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in own:
            m = 10 + (90 * n * nd) // nt
            s = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is not None, i if i is not None else 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, ""), (2002, " .,;! "), (2003, " ".join(words)), (None, rows[9][1]), (None, None), (11, "Été à Wörld W1"), rows[12], rows[12]]
    return rows


ITEMS = [(i, f"W{i} w{i + 3} w1 w2 zebra, ÉTÉ") for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "zebra"), (3, "w77 W5"), (None, "w4")]


@pytest.mark.parametrize("shard_terms,block_bytes", [(10**9, 10**9), (400, 60), (1, 10**9)])
def test_search_is_the_plain_ranking(spark, texts, shard_terms, block_bytes):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "term": F.lit(0), "shard": F.lit(0)}).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit(1))
    found = search.index(docs, shard_terms=shard_terms)
    got = search.search(found, items, block_bytes=block_bytes).collect()
    want = ranking(texts, ITEMS, 10)
    # null ids and repeats of one text and id tie in the plain order, so rows are equal as sets
    assert sorted(map(tuple, got), key=repr) == want
    one = search.search(found, items, k=1).collect()
    assert sorted(map(tuple, one), key=repr) == ranking(texts, ITEMS, 1)


def test_search_without_rows(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search.search(search.index(docs.limit(0)), items).collect() == []
    assert search.search(search.index(docs), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in search.search(search.index(docs), items).collect()] == [(1, 1, 1)]
    more = spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string")
    assert [(r.item_id, r.rank, r.doc_id) for r in search.search(search.index(more), items).collect()] == [(1, 1, "a")]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12))
def test_max_score_keeps_all_that_can_win(seed, k):
    rng = np.random.default_rng(seed)
    lists, total = [], np.zeros(200, np.int64)
    for _ in range(rng.integers(1, 9)):
        d = np.flatnonzero(rng.random(200) < rng.random() ** 2)
        if len(d):
            c = rng.integers(1, rng.integers(2, 40), len(d))
            lists.append((d.astype(np.int32), c))
            total[d] += c
    docs, scores = search.max_score(lists, 200, k)
    assert (scores == total[docs]).all()
    least = max(1, search.kth(total[total > 0], k))
    assert set(docs) == set(np.flatnonzero(total >= least))


# 12: spelling variants


def variants(docs, every=199, least=5, length=6, ratio=5):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}

    def edits(a):
        cut = {a[:i] + a[i + 1 :] for i in range(len(a))}
        letters = set("".join(n))
        put = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
        return (cut | put | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}) - {a}

    near = {w: sorted((x for x in edits(w) if x in n), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= ratio * n[w] else None for w, x in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelled():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(6, 12))) for _ in range(30)]
    words = []
    for i, w in enumerate(base):
        words += [w] * (5 ** (1 + i % 4))
        p = rng.randrange(len(w))
        for x, times in ((w[:p] + w[p + 1 :], 5), (w[:p] + "z" + w[p + 1 :], 26), (w[:p] + "ÿ" + w[p:], 6), (w[:p] + w[p] + w[p:], 130)):
            words += [x] * times
    words += ["aaaaaaa"] * 700 + ["aaaaaaab"] * 130 + ["aaaaaab"] * 25 + ["aaaaab"] * 5 + ["×÷×÷×÷"] * 9
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::40]).title() if i % 3 else "-".join(words[i::40])) for i in range(40)]
    return docs + [(100, None), (101, ""), (102, "1234 ++"), (None, "abcdef abcdef"), (3, "abcdef"), (3, "abcdef")]


def test_spelling_variants(spark):
    docs = spelled()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "near": F.lit(0)})
    for every in (None, 7):
        got = spelling.groups(materialise(spelling.vocabulary(df, every=every), "vocabulary"))
        want = variants(docs, every)
        assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == want
        assert any(r[2] != r[0] and r[2] != r[1] for r in want) or every  # a chain of forms
    assert spelling.groups(materialise(spelling.vocabulary(df.limit(0)), "vocabulary")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text("abcé", min_size=1, max_size=7))
def test_neighbourhoods_are_whole_and_distinct(word):
    letters = "abcé"
    made = []
    seen = lambda h: np.ones(h.shape, bool)
    matrix = np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1)
    hashed = set()
    for _, m in spelling.neighbours(matrix, np.frombuffer(letters.encode("latin-1"), np.uint8), seen):
        made += [r.tobytes().decode("latin-1") for r in m]
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    swap = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} - {word}
    assert Counter(made) == Counter(cut | put | swap)
    # the running sums give the hashes of the neighbours themselves
    spelling_hashes = set(spelling.hashes(made).tolist())
    list(spelling.neighbours(matrix, np.frombuffer(letters.encode("latin-1"), np.uint8), lambda h: hashed.update(h.ravel().tolist()) or np.zeros(h.shape, bool)))
    assert spelling_hashes <= hashed


def test_long_words_have_hashes(spark):
    word = "ab" * 70_000
    (h,) = spelling.hashes([word])
    found = set()
    list(spelling.neighbours(np.frombuffer((word + "c").encode(), np.uint8).reshape(1, -1), np.frombuffer(b"c", np.uint8)[:0], lambda x: found.update(x.ravel().tolist()) or np.zeros(x.shape, bool)))
    assert int(h) in found


# 13: chat formatting


def rows_of(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        own[c].append((t is not None, t if t is not None else 0, r or "", x or ""))
    out = {}
    for c, x in own.items():
        x.sort()
        out[c] = ([(r, t) for _, _, r, t in x], "".join(t for _, _, r, t in x if r == "assistant"))
    return out


ODD = ["", None, "</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>\n", "<n><n>", "[[INST]", "\\", "<", "[", "é</s>漢字😀", "a\n</s>\n<s>user\nb", "<|im_start|>x<\\|im_end|>", "</s", "s>", "/s>\n"]


def chats():
    rng = random.Random(4)
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t * 30, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(ODD) if rng.random() < 0.6 else f"text {t}"))
    rows += [(40, 1, "assistant", "b"), (40, 1, "assistant", "a"), (40, 1, "assistant", "a"), (40, None, "user", "first"), (40, 0, None, None)]
    rows += [(41, 0, "odd role\n<s>%", "x"), (41, 1, "", "</s>"), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    rows += [(42, t, "assistant" if t % 3 else "user", ODD[t % len(ODD)]) for t in range(500)]  # several chunks
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1, 7, 64, 10**6])
def test_chats_read_back(spark, chunk):
    turns = chats()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "chunk": F.lit(2), "t": F.lit(3)}).repartition(3)
    done = chat.format_chats(df, chunk=chunk)
    read = done.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = rows_of(turns)
    assert len(read) == len(want)
    for r in read:
        assert ([(t.role, t.text) for t in r.turns], r.loss) == want[r.conv_id]
        raw = r.formatted.encode()
        spans = [raw[s.start : s.end].decode() for s in r.loss_spans]
        assert re.sub(r"([<\[])\\(\\*)(/?s>|n>|/?INST\]|\|im_(?:start|end)\|>)", r"\1\2\3", "\0".join(spans)) == "\0".join(t for role, t in want[r.conv_id][0] if role == "assistant")
        assert r.formatted.count("</s>\n") == sum(1 for i, t in enumerate(r.turns) if i == 0 or r.turns[i - 1].role != t.role)


def test_the_format_does_not_depend_on_chunks(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string")
    one, many = (sorted(map(repr, chat.format_chats(df, chunk=c).collect())) for c in (2, 10**9))
    assert one == many
    assert chat.format_chats(df.limit(0)).collect() == []
    named = df.select("conv_id", F.format_string("%05d", F.col("turn")).alias("turn"), "role", "text").where("conv_id = 42")
    assert chat.format_chats(named).select("formatted").collect() == chat.format_chats(df.where("conv_id = 42")).select("formatted").collect()


def test_escapes_are_reversible(spark):
    rng = random.Random(8)
    parts = ["<", "[", "\\", "s>", "/s>", "n>", "INST]", "/INST]", "<s>", "</s>", "|im_end|>", "$1", "x", "\n"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(12))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string").select("t", chat.escape(F.col("t")).alias("e"))
    got = df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in chat.CONTROLS) for r in got)
    with pytest.raises(ValueError):
        chat.escape(F.col("t"), ("<a<b>",))


def test_chat_formatting_has_no_python_in_its_plan(spark):
    df = registry.queries()["op13_chat_formatting"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_hash_of_the_planted_conversation(spark):
    df = registry.queries()["op13_chat_formatting"](spark, SF).where("conv_id = -1").first()
    probe = "</s>[INST] ok [/INST]"
    assert df.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert (df.n_turns, df.loss_chars, df.loss_sha256) == (2, len(probe), hashlib.sha256(probe.encode()).hexdigest())
