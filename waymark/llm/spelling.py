"""Spelling variants: words one edit apart, found by generating whole neighbourhoods.

Words are counted by Spark expressions, partial sums before the exchange. For each word
of the vocabulary all distinct deletions, replacements and insertions over the alphabet
that the vocabulary uses are made, in Arrow maps: a byte matrix of words of one length,
whose running sums give the hash of every neighbour. A neighbour whose hash is set in a
bitmap of the vocabulary goes on as a word, and an equi-join with the vocabulary keeps
those that exist, so no distance is ever computed. The bitmap has 32 bits a word up to
`most_bits` (32 MB in a broadcast); beyond, more neighbours reach the join and results
stay the same. A word's form is its near word of largest count where that is `ratio`
times its own or more; roots come from joining forms with themselves, each time twice as
far: counts grow by `ratio` a step, so a few rounds reach the end.

The alphabet has at most 90 code points (a-z and U+00C0 to U+00FF), so a word of n code
points has at most 181 n + 90 neighbours and as many near words.

Edge cases: a null or empty text has no words; a null id reads as an empty text; rows
that repeat an id count each; equal counts of near words are decided by code-point order;
an empty table, or one without frequent words, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import BASE, INVERSE, LETTERS, POWERS, Scratch, bitmap, has_bits, mix, prepare, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Bits of the bitmap: for a word, at least, and at most.
WORD_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Words whose neighbours one task makes, where there are more than cores.
TASK_WORDS = 50_000
#: Neighbours whose hashes a task holds at once.
AT_ONCE = 1 << 20


def slips(doc_id: Column, run: Column, every: int) -> Column:
    """`run` with one code point left out where its hash with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int | None = None, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """`word`, `n`: the words of at least `length` code points that occur at least `count` times.

    With `every`, one in so many runs loses a code point first (`slips`).
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{length},}}"), F.lit(0))
    found = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("run"))
    words = found.select((slips(F.col("id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def powers(n: int) -> np.ndarray:
    return POWERS[:n] if n <= len(POWERS) else np.concatenate([POWERS[:1], np.cumprod(np.full(n - 1, BASE))])


def hashes(words: list[str]) -> np.ndarray:
    """Sums of letters' random values times powers of BASE, mixed."""
    raw = [np.frombuffer(w.encode("latin-1"), np.uint8) for w in words]
    return mix(np.array([(LETTERS[w] * powers(len(w))).sum() for w in raw], np.uint64))


def neighbours(words: np.ndarray, alphabet: np.ndarray, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and neighbours (byte matrices) of words of one length, each neighbour once.

    `words` is a matrix of Latin-1 bytes; only neighbours whose hashes satisfy `keep` are built.
    """
    k, n = words.shape
    power = powers(n + 1)
    own = LETTERS[words] * power[:n]
    before = np.zeros((k, n + 1), np.uint64)
    np.cumsum(own, axis=1, out=before[:, 1:])
    whole = before[:, -1:]

    def built(rows: np.ndarray, at: np.ndarray, letters: np.ndarray | None, skip: int) -> np.ndarray:
        size = n - skip + (letters is not None)
        cols = np.arange(size)
        source = cols + np.where(cols >= (at + (letters is not None))[:, None], skip - (letters is not None), 0)
        out = words[rows[:, None], np.minimum(source, n - 1)]
        if letters is not None:
            out[np.arange(len(rows)), at] = letters
        return out

    # deletions: of equal letters in a row the first one only
    h = before[:, :-1] + (whole - before[:, 1:]) * INVERSE
    fresh = np.ones((k, n), bool)
    fresh[:, 1:] = words[:, 1:] != words[:, :-1]
    rows, at = np.nonzero(fresh & keep(mix(h)))
    yield rows, built(rows, at, None, 1)
    # replacements by another letter; insertions not behind an equal letter
    for i in range(n + 1):
        if i < n:
            h = (whole - own[:, i : i + 1]) + LETTERS[alphabet] * power[i]
            rows, a = np.nonzero((words[:, i : i + 1] != alphabet) & keep(mix(h)))
            yield rows, built(rows, np.full(len(rows), i), alphabet[a], 1)
        h = before[:, i : i + 1] + LETTERS[alphabet] * power[i] + (whole - before[:, i : i + 1]) * BASE
        other = keep(mix(h))
        if i:
            other &= words[:, i - 1 : i] != alphabet
        rows, a = np.nonzero(other)
        yield rows, built(rows, np.full(len(rows), i), alphabet[a], 0)


def candidates(vocab: DataFrame, alphabet: bytes, bits: np.ndarray) -> DataFrame:
    """`word`, `near`: the neighbours that the bitmap of the vocabulary does not rule out."""
    shared = vocab.sparkSession.sparkContext.broadcast(bits)
    letters = np.frombuffer(alphabet, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                step = max(1, AT_ONCE // max(n, len(letters)))
                for i in range(0, len(own), step):
                    group = own[i : i + step]
                    matrix = np.frombuffer(b"".join(words[j] for j in group), np.uint8).reshape(len(group), n)
                    for rows, made in neighbours(matrix, letters, lambda h: has_bits(table, h)):
                        if len(rows):
                            near = [r.tobytes().decode("latin-1") for r in made]
                            yield pa.RecordBatch.from_arrays([pa.array([words[j].decode("latin-1") for j in group[rows]], pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    return vocab.select("word").mapInArrow(run, "word string, near string")


def near_words(vocab: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """`word`, `n`, `near`, `near_n`: all ordered pairs of words of the vocabulary that are one edit apart."""
    spark = vocab.sparkSession
    prepare(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column("word").to_pylist()).view(np.int64))], names=["h"])

    used = vocab.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct()
    alphabet = "".join(sorted(r.c for r in used.collect()))
    size = LEAST_BITS
    total = vocab.count()
    while size < most_bits and size < WORD_BITS * total:
        size *= 2
    bits = bitmap(vocab.select("word").mapInArrow(hashed, "h long"), "h", size)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_WORDS))
    found = candidates(vocab.repartition(tasks), alphabet.encode("latin-1"), bits)
    known = found.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    return known.join(vocab, "word").select("word", "n", "near", "near_n")


def groups(vocab: DataFrame, ratio: int = RATIO, scratch: Scratch | None = None) -> DataFrame:
    """The vocabulary with `form`, `root`, `n_near`, `form_n`."""
    scratch = scratch or Scratch(vocab.sparkSession, "spelling")
    best = near_words(vocab).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best")
    )
    told = vocab.join(best, "word", "left")
    strong = -F.col("best.n") >= ratio * F.col("n")
    told = scratch.write(
        told.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.w")).alias("form"),
            F.when(strong, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = told.where("form is not null").select("word", F.col("form").alias("root"))
    step = 0
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.write(
            roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{step}"
        )
        scratch.drop(f"roots{step - 1}")
        roots, step = moved.select("word", "root"), step + 1
        if moved.where("moved").isEmpty():
            break
    done = told.join(roots, "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: One in so many runs loses a code point in the query.
EVERY = 199


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "spelling")
    docs = table(spark, sf_dir, "documents")
    return groups(scratch.write(vocabulary(docs, every=EVERY), "vocabulary"), scratch=scratch)


ORACLE = r"""
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
long AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY id, run),
bytes AS (SELECT id, run, c, hex(encode(id || ':' || run)) AS x FROM long),
hashed AS (
  SELECT run, c, xor(list_reduce(
    list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, crcs),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gaps AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM places),
cuts AS (SELECT DISTINCT word, n, a || z AS cut FROM gaps),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cuts c JOIN v ON c.cut = v.word
  UNION SELECT v.word, v.n, c.word, c.n FROM cuts c JOIN v ON c.cut = v.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n FROM near GROUP BY word, n),
told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word),
walk AS (
  SELECT word, word AS at FROM told
  UNION ALL SELECT walk.word, told.form FROM walk JOIN told ON walk.at = told.word WHERE told.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN told ON walk.at = told.word WHERE told.form IS NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN ends ON told.word = ends.word
"""
