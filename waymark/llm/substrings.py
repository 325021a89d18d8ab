"""Substring deduplication by repeated-phrase automata.

A word is removed if a window of `WINDOW` words covers it whose word sequence also
starts earlier (smaller id, or same document at an earlier word).

1. Sampling: of the 8-word hashes inside a window the least (by its upper 44 bits, the
   first of equal ones) is its anchor. Equal windows have equal anchors, so a window
   whose anchor occurs once is unique. Anchors are counted over all documents; those
   that recur set bits of a filter of fixed size, those over `HOT` occurrences bits of
   another. A false positive costs work below and changes nothing.
2. Segments: every text is read again, and each run of windows under one place of a
   recurring anchor becomes a row (anchor, text, place). All that follows is dealt by the
   anchor, that of a hot anchor by anchor and salt, so work stays linear in the segments.
3. Confirming: equal segments meet in a task and count once; digests (96 bits) of their
   windows are compared there, and those of hot anchors grouped over all tasks, with the
   first start and the count. The windows that recur, at their first places, form the
   passages.
4. Automata: passages and segments of the same anchors meet in the same task, passages
   first. Every `shard_words` words of them make a shard, whose passages become an
   Aho-Corasick automaton: seeds of `SEED` words at every `STRIDE`-th word, over two code
   characters a word (so that no node has over 256 children); each window holds a whole
   seed of its passage. All segments are streamed through; a hit is compared, and where
   it differs extended, word by word, so only equal words are ever removed.
5. The ranges found are united per document and the kept words are joined.

A task holds one shard and the passages of one anchor (and salt), whatever the corpus.

Edge cases: a null or empty text has no words and keeps the empty string; of rows that
repeat an id, equal windows at the same start do not remove one another, and different
texts stay apart; documents of fewer than `WINDOW` words stay whole; an empty table gives
no row; a null id sorts before all ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import BASE, Scratch, Words, as_bytes, bitmap, has_bits, mix, prepare, slices, table

WINDOW = 20
GRAM = 8
#: A window of 20 words holds a whole seed of 17 that starts at a multiple of 4 in its passage.
#: Long seeds, as passages of one anchor may differ only in what stands around a common phrase.
STRIDE, SEED = 4, 17
SHARD_WORDS = 500_000
#: Anchors of more occurrences are dealt by salt, in so many parts; bits of their filter.
HOT, SALTS, HOT_BITS = 2_000, 32, 1 << 23
LEAST_ID = -(1 << 63)
#: Bytes of texts that are worked on at once.
SLICE = 1 << 20
#: Upper bits of a hash that choose the anchor; the lower ones hold its place meanwhile.
BLOCK = 1 << 20


def _poly(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each run of k values, put together from runs of doubling length."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width, power, rest = np.zeros(n, np.uint64), 0, h, 1, base, k
    while rest:
        if rest & 1:
            out = out * power + part[done : done + n]
            done += width
        part, width, rest = part[:-width] * power + part[width:], 2 * width, rest >> 1
        power = np.uint64(int(power) ** 2 % (1 << 64))
    return mix(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each `span` successive values by their upper bits, the first of equal ones."""
    low = np.uint64(BLOCK - 1)
    out = []
    for start in range(0, max(1, len(values) - span + 1), BLOCK - span):
        own = values[start : start + BLOCK - 1]
        best, width = (own & ~low) | np.arange(len(own), dtype=np.uint64), 1
        while width < span:  # minima of doubling width; the last step overlaps
            step = min(width, span - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        out.append((best & low).astype(np.int64)[: BLOCK - span] + start)
    return np.concatenate(out)[: max(0, len(values) - span + 1)]


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash per start; its place; which starts have a window inside their text."""
    valid = np.zeros(max(0, len(w.hashes) - WINDOW + 1), bool)
    if not len(valid):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), valid
    grams = _poly(w.hashes, GRAM)
    place = _least(grams, WINDOW - GRAM + 1)
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        if b - a >= WINDOW:
            valid[a : b - WINDOW + 1] = True
    return grams[place], place, valid


def recurring(docs: DataFrame, text: str) -> DataFrame:
    """Anchors that occur more than once: a, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "t")
            for a, b in slices([len(t) for t in texts], 4 * SLICE):
                hashes, place, valid = anchors(Words(texts[a:b]))
                _, first = np.unique(place[valid], return_index=True)
                found, n = np.unique(hashes[valid][first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["a", "n"])

    counted = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(count, "a long, n long")
    return counted.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")


def segments(docs: DataFrame, seen: np.ndarray, hot: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """Per run of windows under a recurring anchor: anchor, hot, salt, k, h, s (first word), text."""
    sent = docs.sparkSession.sparkContext.broadcast((seen, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "t")
            keys, marks = batch.column("k").to_numpy(), batch.column("h").to_numpy()
            for lo, hi in slices([len(t) for t in texts], SLICE):
                w = Words(texts[lo:hi])
                hashes, place, valid = anchors(w)
                hit = valid & has_bits(sent.value[0], hashes)
                new = hit.copy()
                new[1:] &= ~hit[:-1] | (place[1:] != place[:-1])
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                ends = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True)) + WINDOW
                doc = np.searchsorted(w.bounds, start, "right") - 1
                mark, is_hot = marks[lo + doc], has_bits(sent.value[1], hashes[start])
                raw = w.raw
                own = [raw[a:b] for a, b in zip(w.starts[start].tolist(), w.ends[ends - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[start].view(np.int64)),
                        pa.array(is_hot),
                        pa.array(np.where(is_hot, mark.view(np.uint64) % np.uint64(SALTS), 0).astype(np.int32)),
                        pa.array(keys[lo + doc]),
                        pa.array(mark),
                        pa.array((start - w.bounds[doc]).astype(np.int32)),
                        pa.array(own, pa.binary()),
                    ],
                    names=["anchor", "hot", "salt", "k", "h", "s", "text"],
                )

    rows = _keyed(docs, doc_id, text).where(F.octet_length("t") > 0).select("k", "h", "t")
    return rows.mapInArrow(run, "anchor long, hot boolean, salt int, k long, h long, s int, text binary")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, k (the id as a number, for order), h (hash of the text), t (not null)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID)).alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))


def _shards(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """Rows of about so many words at a time (a word has six bytes or so), cut between keys.

    Rows of one key (anchor, salt) stay together unless they fill a shard and are hot.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes // 6
        if size < words:
            continue
        got = pa.Table.from_batches(held)
        anchor, salt = got.column("anchor").to_numpy(), got.column("salt").to_numpy()
        other = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
        cut = int(other[-1]) + 1 if len(other) else got.num_rows if got.column("hot")[-1].as_py() else 0
        if cut:
            yield got.slice(0, cut)
        held, size = got.slice(cut).to_batches(), 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _encoded(texts: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray]:
    """The distinct texts, and the number of each row's."""
    coded = texts.combine_chunks().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def runs(found: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Distinct segments of each shard with the windows first seen in them: rid, anchor, hot, k, s, text, at, windows.

    All segments of a cold anchor are in one shard, so `at` has the offsets of its
    windows that recur; those of a hot one are still to be compared (windows: o, d, e, n).
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _shards(batches, shard_words):
            texts, of = _encoded(got.column("text"))
            k, s = got.column("k").to_numpy(), got.column("s").to_numpy()
            order = np.lexsort((s, k, of))
            first = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]  # the first row of each text
            count = np.bincount(of, minlength=len(texts))
            w = Words(texts)
            d = _poly(w.hashes, WINDOW)
            e = (_poly(w.hashes, WINDOW, np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
            size = np.diff(w.bounds) - WINDOW + 1
            owner = np.repeat(np.arange(len(texts)), size)
            o = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            at = w.bounds[owner] + o
            d, e = d[at], e[at]
            order = np.lexsort((s[first][owner] + o, k[first][owner], e, d))
            new = np.concatenate([[True], (d[order][1:] != d[order][:-1]) | (e[order][1:] != e[order][:-1])])
            kept = order[new]
            n = np.add.reduceat(count[owner[order]], np.flatnonzero(new))
            hot = got.column("hot").to_numpy(zero_copy_only=False)[first][owner[kept]]
            use = hot | (n > 1)
            kept, n, hot = kept[use], n[use], hot[use]
            back = np.argsort(kept)
            kept, n, hot = kept[back], n[back], hot[back]
            held, size = np.unique(owner[kept], return_counts=True)
            lists = lambda own, values: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(own, np.cumsum(size) - size, dtype=np.int64))]) if len(size) else [0], pa.int32()), values
            )
            windows = pa.StructArray.from_arrays(
                [pa.array(o[kept][hot].astype(np.int32)), pa.array(d[kept][hot].view(np.int64)), pa.array(e[kept][hot].view(np.int32)), pa.array(n[hot].astype(np.int64))],
                names=["o", "d", "e", "n"],
            )
            rows = got.select(["anchor", "hot", "k", "s", "text"]).take(pa.array(first[held])).combine_chunks()
            columns = [rows.column(c).combine_chunks() for c in rows.column_names]
            columns += [lists(~hot, pa.array(o[kept][~hot].astype(np.int32))), lists(hot, windows)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.column_names, "at", "windows"])

    dealt = found.select("anchor", "hot", "salt", "k", "s", "text").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    made = dealt.mapInArrow(combine, "anchor long, hot boolean, k long, s int, text binary, at array<int>, windows array<struct<o:int,d:long,e:int,n:long>>")
    return made.withColumn("rid", F.monotonically_increasing_id())


def passages(own: DataFrame) -> DataFrame:
    """Runs with the offsets `at` of the windows that recur and start there first."""
    hot = own.where("hot")
    windows = hot.select("rid", "k", "s", F.inline("windows"))
    first = windows.groupBy("d", "e").agg(F.min(F.struct("k", (F.col("s") + F.col("o")).alias("p"), "rid", "o")).alias("f"), F.sum("n").alias("n"))
    at = first.where("n > 1").groupBy("f.rid").agg(F.collect_list("f.o").alias("at"))
    columns = ["anchor", "hot", "k", "s", "text", "at"]
    return own.where("not hot").select(columns).unionByName(hot.drop("at").join(at, "rid").select(columns))


def codes(w: Words) -> str:
    """Two characters a word."""
    return (w.hashes >> np.uint64(48)).astype("<u2").tobytes().decode("latin-1")


class Shard:
    """An automaton over the seeds of passages (k, s, words)."""

    def __init__(self, own: list[tuple[int, int, list[bytes]]]) -> None:
        self.own = own
        seeds: dict[str, list[tuple[int, int]]] = {}
        w = Words([b" ".join(words) for _, _, words in own])
        line = codes(w)
        for i, a in enumerate(w.bounds[:-1].tolist()):
            for o in range(0, len(own[i][2]) - SEED + 1, STRIDE):
                seeds.setdefault(line[2 * (a + o) : 2 * (a + o + SEED)], []).append((i, o))
        self.auto = ahocorasick.Automaton()
        for key, value in seeds.items():
            self.auto.add_word(key, value)
        self.auto.make_automaton()

    def matches(self, words: list[bytes], line: str) -> list[tuple[int, int, int, int]]:
        """Passage, its place against the words, and the range of words, of at least a window each."""
        out: list[tuple[int, int, int, int]] = []
        reached: dict[tuple[int, int], int] = {}
        for end, value in self.auto.iter(line) if len(self.auto) else ():
            if end % 2 == 0:  # not at a word's end
                continue
            p = (end + 1) // 2 - SEED
            for i, o in value:
                if reached.get((i, p - o), -1) > p:
                    continue
                passage = self.own[i][2]
                lo, hi = max(0, p - o), min(len(words), p - o + len(passage))
                if words[lo:hi] != passage[lo - p + o : hi - p + o]:
                    lo = hi = p
                    while lo > 0 and lo - p + o > 0 and words[lo - 1] == passage[lo - 1 - p + o]:
                        lo -= 1
                    while hi < len(words) and hi - p + o < len(passage) and words[hi] == passage[hi - p + o]:
                        hi += 1
                reached[i, p - o] = max(hi, p + 1)
                if hi - lo >= WINDOW:
                    out.append((i, p - o, lo, hi))
        return out


def _passages(own: pa.Table) -> Iterator[tuple[int, int, list[bytes]]]:
    """Maximal runs of the offsets: id, first word, words."""
    for k, s, text, at in zip(*(own.column(c).to_pylist() for c in ("k", "s", "text", "at"))):
        words, at = text.split(), sorted(at)
        a = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[i - 1] + 1:
                yield k, s + at[a], words[at[a] : at[i - 1] + WINDOW]
                a = i


def located(found: DataFrame, own: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Ranges of words (k, h, a, b) that windows of an earlier place cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[tuple[int, int, list[bytes]]] = []  # passages of the key that the last shard ended in
        carried_key: tuple[int, int] | None = None
        for got in _shards(batches, shard_words):
            flag, anchor, salt = (got.column(c).to_numpy() for c in ("flag", "anchor", "salt"))
            same = (anchor == anchor[-1]) & (salt == salt[-1]) & (flag == 0)
            ending = list(_passages(got.filter(pa.array(same))))
            whole = carried + list(_passages(got.filter(pa.array((flag == 0) & ~same)))) + ending
            last = (int(anchor[-1]), int(salt[-1]))
            carried = (carried if carried_key == last else []) + ending
            carried_key = last
            rows = got.filter(pa.array(flag == 1))
            if not whole or not rows.num_rows:
                continue
            shard = Shard(whole)
            texts, of = _encoded(rows.column("text"))
            w = Words(texts)
            line = codes(w)
            hits = [
                (t, whole[i][0], whole[i][1] - delta, lo, hi)
                for t, (a, b, text) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), texts))
                for i, delta, lo, hi in shard.matches(text.split(), line[2 * a : 2 * b])
            ]
            if not hits:
                continue
            hit = np.array(hits, np.int64)  # by text
            count = np.bincount(hit[:, 0], minlength=len(texts))
            row = np.repeat(np.arange(len(of)), count[of])
            own_at = np.arange(len(row)) - np.repeat(np.cumsum(count[of]) - count[of], count[of])
            at = (np.cumsum(count) - count)[of[row]] + own_at
            k, h, s = (rows.column(c).to_numpy() for c in ("k", "h", "s"))
            other = (hit[at, 1] != k[row]) | (hit[at, 2] != s[row])  # not the first place itself
            row, at = row[other], at[other]
            ranges = [pa.array((s[row] + hit[at, c]).astype(np.int32)) for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(h[row]), *ranges], names=["k", "h", "a", "b"])

    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    first = own.select("anchor", "hot", F.explode(salts).alias("salt"), F.lit(0).alias("flag"), "k", F.lit(0).cast("long").alias("h"), "s", "text", "at")
    rows = found.select("anchor", "hot", "salt", F.lit(1).alias("flag"), "k", "h", "s", "text", F.expr("cast(null as array<int>)").alias("at"))
    dealt = first.unionByName(rows).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "flag")
    return dealt.mapInArrow(run, "k long, h long, a int, b int")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and `kept`, the words left of changed texts."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "substrings")
    seen = scratch.write(recurring(docs, text), "anchors")
    filters = bitmap(seen, "a"), bitmap(seen.where(F.col("n") > HOT), "a", HOT_BITS)
    found = scratch.write(segments(docs, *filters, doc_id, text), "segments", "zstd")
    own = scratch.write(runs(found, shard_words), "runs", "zstd")
    first = scratch.write(passages(own), "passages", "zstd")
    scratch.drop("anchors", "runs")
    hits = scratch.write(located(found, first, shard_words), "hits")
    scratch.drop("segments", "passages")
    cuts = hits.groupBy("k", "h").agg(F.collect_set(F.struct("a", "b")).alias("cuts"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            for t, cuts in zip(as_bytes(batch, "t"), batch.column("cuts").to_pylist()):
                words, left, at = t.split(), [], 0
                for c in sorted(cuts or [], key=lambda c: c["a"]):
                    left += words[at : max(at, c["a"])]
                    at = max(at, c["b"])
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if gone[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    rows = _keyed(docs, doc_id, text).join(cuts, ["k", "h"], "left").select("doc_id", "t", "cuts")
    return rows.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
