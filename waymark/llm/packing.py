"""Sequence packing: first-fit decreasing in randomised groups of documents.

1. A map tokenises each text and appends the end id. Words repeat, so each worker
   keeps the ids of the words it has seen (bounded) and asks the tokenizer for new ones.
2. Documents go to groups by a seeded hash, so each group is a random sample of about
   `group_tokens` tokens; a group is packed by one task, on its own. The hash takes
   the id, the text's length and the input partition: rows that share an id spread.
3. In a group, ids are cut into full blocks of `capacity` and remainders; those are
   packed by first-fit decreasing, where a tournament tree of bin capacities finds the
   first bin with room in O(log n). Then the emptiest bins are dealt, with cuts where
   needed, into gaps of `min_gap` and more; what is left of the last bin is cut into
   powers of two, which need no padding.

Each id of a document lies in exactly one piece. Edge cases: a null or empty text has
the end id alone; repeated rows are packed each; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm._common import prepare, slices, table

CAPACITY = 4096
END_ID = 2
GROUP_TOKENS = 2_000_000
#: Gaps of fewer tokens are left to padding instead of cutting a document for them.
MIN_GAP = 32
SEED = 20
#: Word forms of one generation whose ids a worker keeps, and UTF-8 bytes of one slice of texts.
KNOWN_WORDS = 350_000
#: Characters of words of over 64 characters in it.
KNOWN_BYTES = 8 << 20
SLICE = 2 << 20
#: White space to str.split(), but not to the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
#: Digits, runs of ASCII signs, runs of all else.
RUNS = re.compile(r"[0-9]|[!-/:-@\[-`{-~]+|[^!-@\[-`{-~]+")
NO_LETTERS = {c: None for c in range(128) if not chr(c).isalpha()}
#: In a word that is not of letters alone: characters that make the tokenizer's parts others than `RUNS`.
#: Control characters are signs to it; letters that its normalisation takes apart leave
#: marks, which join the signs that follow; from U+0530 on, tables of letters differ.
TROUBLE = re.compile("[\x00-\x1b\x7f-\x9f\u0130\u0374\u0530-\U0010ffff]")


class WordTokens:
    """Ids of whole texts as little-endian bytes, put together from those of their parts.

    Valid for a tokenizer that drops white space and never merges across it, across the
    bounds of runs of letters and of ASCII signs, or between digits. Runs are kept in
    `runs`, words in `known`. Both are bounded by `most`: when one is full, it becomes the
    older generation, of which only what is used again is kept.
    """

    def __init__(self, path: str, most: int = KNOWN_WORDS) -> None:
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode(self, runs: list[str]) -> None:
        """Each run closes with an end-of-word id, so many are encoded as one text."""
        for i in range(0, len(runs), 2000):
            part = runs[i : i + 2000]
            raw = self.whole(" ".join(part))
            ends = np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1
            if len(ends) == len(part):
                cuts = [0, *(ends * self.dtype.itemsize).tolist()]
                self.runs.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
            else:
                self.runs.update((w, self.whole(w)) for w in part)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.most or self.long > KNOWN_BYTES:
            self.old, self.known, self.long = self.known, {}, 0
        if len(self.runs) > self.most or not self.known:
            self.old_runs, self.runs = self.runs, {}
        made: list[tuple[str, list[str]]] = []
        for w in words:
            if w in self.known:
                continue
            if w in self.old:
                self.known[w] = self.old[w]
                continue
            if len(w) > 64:
                self.long += len(w)
            form = w.lower() if w.isascii() else w
            if form.isalpha():
                made.append((w, [form]))
            elif TROUBLE.search(form):
                self.known[w] = self.whole(w)
            elif form[:-1].isalpha() and form[-1] in ".,;:!?":  # a sign after letters is a run of its own
                made.append((w, [form[:-1], form[-1]]))
            elif "'" not in w and "<" not in w and (w.isascii() or form.translate(NO_LETTERS).isalpha()):
                made.append((w, RUNS.findall(form)))
            else:  # contractions, special tokens, marks and signs beyond ASCII
                self.known[w] = self.whole(w)
        new = {r: None for _, own in made for r in own if r not in self.runs}
        self.runs.update((r, self.old_runs[r]) for r in new if r in self.old_runs)
        self._encode([r for r in new if r not in self.runs])
        runs = self.runs
        self.known.update((w, runs[own[0]] if len(own) == 1 else b"".join([runs[r] for r in own])) for w, own in made)

    def __call__(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # no cycles here, and full collections would visit every word
        try:
            return self._texts(texts)
        finally:
            gc.enable()

    def _texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices([len(t) for t in texts], SLICE):
            odd = {i for i in range(a, b) if ODD.search(texts[i])}
            words = [[] if i in odd else texts[i].split() for i in range(a, b)]
            self.learn(set().union(*words))
            for i, own in enumerate(words, a):
                out.append(self.whole(texts[i]) if i in odd else b"".join(map(self.known.__getitem__, own)))
        return out


_tokens: dict[tuple[str, int], WordTokens] = {}


def tokens(path: str, most: int = KNOWN_WORDS) -> WordTokens:
    if (path, most) not in _tokens:
        _tokens[path, most] = WordTokens(path, most)
    return _tokens[path, most]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. A tournament tree keeps the largest room of each subtree."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, at = sizes[item], 1
        while at < leaves:
            at *= 2
            if room[at] < n:
                at += 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(item)
        room[at] -= n
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins


def _last(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts a bin into sequences whose lengths are powers of two, largest first."""
    queue = pieces[::-1]
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            doc, start, n = queue.pop()
            take = min(n, want)
            out.append((doc, start, take))
            if take < n:
                queue.append((doc, start + take, n - take))
            want -= take
        yield out


def pack_group(sizes: list[int], capacity: int = CAPACITY, min_gap: int = MIN_GAP) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document number, start, length) for documents of `sizes` ids."""
    full = [(i, s) for i, n in enumerate(sizes) for s in range(0, n - n % capacity, capacity)]
    out = [[(i, s, capacity)] for i, s in full]
    rest = [i for i, n in enumerate(sizes) if n % capacity]
    bins = first_fit_decreasing([sizes[i] % capacity for i in rest], capacity)
    packed = [[(rest[k], sizes[rest[k]] - sizes[rest[k]] % capacity, sizes[rest[k]] % capacity) for k in own] for own in bins]
    filled = [sum(p[2] for p in own) for own in packed]
    order = sorted(range(len(packed)), key=lambda k: (-filled[k], k))
    i, j = 0, len(order) - 1
    while i < j:
        to, of = order[i], order[j]
        gap = capacity - filled[to]
        if not packed[of]:
            j -= 1
        elif gap < min_gap:
            i += 1
        else:
            doc, start, n = packed[of].pop()
            take = min(gap, n)
            packed[to].append((doc, start + n - take, take))
            if take < n:
                packed[of].append((doc, start, n - take))
            filled[to] += take
            filled[of] -= take
    for k in order:
        if packed[k]:
            if capacity - filled[k] >= min_gap and filled[k] & (filled[k] - 1):
                out.extend(_last(packed[k], filled[k]))
            else:
                out.append(packed[k])
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    seed: int = SEED,
    keep_ids: bool = False,
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With `keep_ids`, also `ids`, the piece's ids as little-endian 32-bit binary. A worker
    keeps two generations of `known_words` words: memory against time, the result is the same.
    """
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    groups = max(1, ceil(((size[0] or 0) / 2.5 + (size[1] or 0)) / group_tokens))
    name = docs.select(doc_id).schema[0]
    source = docs.select(
        F.col(doc_id),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.octet_length(text), F.spark_partition_id()), F.lit(groups)).cast("int").alias("group"),
    )

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens(tokenizer_path, known_words)
        end = np.array([end_id], made.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in made(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("group"), pa.array(ids, pa.binary())], names=[doc_id, "group", "ids"]
            )

    kind = name.dataType.simpleString()
    tokenised = source.mapInArrow(tokenise, f"`{doc_id}` {kind}, group int, ids binary")

    def fill(got: pa.Table) -> pa.Table:
        dtype = tokens(tokenizer_path, known_words).dtype
        group = got.column("group")[0].as_py()
        raw = got.column("ids").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (zlib.crc32(raw[i]), raw[i]))  # not the order of arrival
        sizes = [len(raw[i]) // dtype.itemsize for i in order]
        rows: list[tuple] = []
        for number, pieces in enumerate(pack_group(sizes, capacity)):
            offset = 0
            for k, start, n in pieces:
                ids = np.frombuffer(raw[order[k]], dtype, n, start * dtype.itemsize).astype("<u4").tobytes()
                rows.append((order[k], start, n, zlib.crc32(ids), sizes[k], (group << 32) + number, offset, ids if keep_ids else None))
                offset += n
        cols = list(zip(*rows))
        arrays = [got.column(doc_id).combine_chunks().take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:7])]
        names = [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            arrays, names = [*arrays, pa.array(cols[7], pa.binary())], [*names, "ids"]
        return pa.table(arrays, names=names)

    schema = f"`{doc_id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokenised.groupBy("group").applyInArrow(fill, schema + (", ids binary" if keep_ids else ""))


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
