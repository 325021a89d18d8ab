"""Document fingerprints in Spark expressions alone: invertible Bloom lookup sketches.

A text is cut into paragraphs: lines, and long lines at sentence ends, signs `|` and
`;`. Of a paragraph over `LONG` characters, every text has pieces that a local edit
leaves alone: it is cut after each word whose hash is 0 modulo `WORD_EVERY`; a piece
that is still too long (no spaces, or few such words) after each pair of characters
whose hash is 0 modulo `PAIR_EVERY`; and what is left, which repeats itself, every
`LONG` characters. The distinct 64-bit digests of its paragraphs go into a sketch of cells, each
digest into one cell of each of three tables; a cell holds a count, the xor of its
digests and the xor of their check hashes. Two sketches subtract cell by cell; peeling
cells that hold one digest recovers the digests that only one text has. When peeling
gets stuck, a larger sketch is tried: as many parts as the two texts' digests need, at
`LOAD` digests a part, each part a sketch of its own over one range of the digests.
A part that is stuck again gets a sketch of its own, four times as large, three times at
most; then its few digests are compared. So the likeness is exact for texts of any length.

Likeness: 2 x shared paragraphs / (paragraphs of both), 1 for two texts without any.

The next document is found without a global sort in one task: quantiles of the ids
give ranges of about `RANGE_ROWS` rows; each range is sorted on its own, and the first
row of each is also sent, marked, to the range before it.

Edge cases: ids are whole numbers, or texts of such (others raise a cast error, as
documents have an order by id); a null text counts as empty (no paragraph); a null id
sorts before all;
rows of one id are sorted by text, and each is the next of the one before; a table of
one row is followed by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm._common import table

TABLES = 3
#: Cells of a sketch; of a part of a larger one, try by try, and the digests it is meant for.
CELLS = 24
PART_CELLS = (24, 96, 384, 1536)
LOAD = 4
ROUNDS = 12
#: Characters of a paragraph that stays whole; of words and of character pairs, one in so many ends a piece.
LONG = 120
WORD_EVERY = 8
PAIR_EVERY = 32
RANGE_ROWS = 2000
MAX_RANGES = 20_000
LEAST_KEY = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: the end of a fold that keeps its start, which copies nothing."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def _cut(parts: Column, pieces: Callable[[Column], Column]) -> Column:
    """`parts` with `pieces` of each over-long one in its place."""
    long = lambda p: F.length(p) > LONG
    cut = lambda own: F.flatten(F.transform(own, lambda p: F.when(long(p), pieces(p)).otherwise(F.array(p))))
    return let(parts, lambda own: F.when(F.exists(own, long), cut(own)).otherwise(own))


def _word_pieces(part: Column) -> Column:
    """A part cut after words that their hash chooses; a part has no newline."""
    ends = lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_EVERY)) == 0
    marked = F.transform(F.split(part, "\\s+"), lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(F.concat(w, F.lit(" "))))
    return F.transform(F.split(F.array_join(marked, ""), "\n"), F.trim)


def _pair_pieces(part: Column) -> Column:
    """A part cut after characters that the hash of the character and the one before chooses."""

    def marked(chars: Column) -> Column:
        ends = lambda c, i: F.pmod(F.xxhash64(F.coalesce(F.get(chars, i - 1), F.lit("")), c), F.lit(PAIR_EVERY)) == 0
        return F.array_join(F.transform(chars, lambda c, i: F.when(ends(c, i), F.concat(c, F.lit("\n"))).otherwise(c)), "")

    return F.split(let(F.split(part, ""), marked), "\n")


def _even_pieces(part: Column) -> Column:
    return F.regexp_extract_all(part, F.lit(f"(?s).{{1,{LONG}}}"), F.lit(0))


def paragraphs(text: Column) -> Column:
    """The sorted distinct digests of a text's paragraphs."""
    parts = F.transform(F.split(text, "(?<=[.!?])\\s+|[\\n|;]+"), F.trim)
    for pieces in (_word_pieces, _pair_pieces, _even_pieces):
        parts = _cut(parts, pieces)
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p))))


def _check(digest: Column) -> Column:
    return F.hash(digest).cast("long")


def _slots(digest: Column, size: int) -> list[Column]:
    """s0, s1 ...: the numbers of the cells of `digest` out of `size`, one in each table."""
    per = size // TABLES
    low = lambda shift: F.call_function("shiftrightunsigned", digest, F.lit(shift)).bitwiseAND(F.lit(0x1FFFFF))
    return [(low(21 * t) % per + t * per).cast("int").alias(f"s{t}") for t in range(TABLES)]


def _xor(items: Column, name: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x[name]))


def sketch(digests: Column, size: int) -> Column:
    """The cells (c, k, h) of a set of digests."""
    per = size // TABLES

    def cells(items: Column) -> Column:
        def of(table: int) -> Column:
            held = lambda j: F.filter(items, lambda x: x[f"s{table}"] == j)
            cell = lambda own: F.struct(F.size(own).alias("c"), _xor(own, "k").alias("k"), _xor(own, "h").alias("h"))
            return F.transform(F.sequence(F.lit(table * per), F.lit((table + 1) * per - 1)), lambda j: let(held(j), cell))

        return F.concat(*map(of, range(TABLES)))

    return let(F.transform(digests, lambda x: F.struct(x.alias("k"), _check(x).alias("h"), *_slots(x, size))), cells)


def as_text(cells: Column) -> Column:
    """A sketch as hexadecimal text, 32 characters a cell."""
    low = F.lit(0xFFFFFFFF)
    return F.array_join(
        F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["c"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"].bitwiseAND(low)), 8, "0"))), ""
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    )


def _total(cells: Column) -> Column:
    """The sum of counts and the xor of digests and check hashes."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    add = lambda t, x: F.struct((t["c"] + x["c"]).alias("c"), t["k"].bitwiseXOR(x["k"]).alias("k"), t["h"].bitwiseXOR(x["h"]).alias("h"))
    return F.aggregate(cells, zero, add)


def peel(diff: Column, size: int) -> Column:
    """(a, b): arrays of the digests that only the first or second text has; null if stuck."""

    def step(acc: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(
                F.filter(acc["cells"], lambda c: (F.abs(c["c"]) == 1) & (c["h"] == _check(c["k"]))), lambda c: F.struct(c["c"].alias("c"), c["k"].alias("k"))
            )
        )

        def removed(keys: Column) -> Column:
            held = lambda items, j: F.filter(items, lambda x: (x["s0"] == j) | (x["s1"] == j) | (x["s2"] == j))
            less = lambda cell, own: F.struct(
                (cell["c"] - F.aggregate(own, F.lit(0), lambda n, x: n + x["c"])).alias("c"),
                cell["k"].bitwiseXOR(_xor(own, "k")).alias("k"),
                cell["h"].bitwiseXOR(_xor(own, "h")).alias("h"),
            )
            cells = let(
                F.transform(keys, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"), _check(x["k"]).alias("h"), *_slots(x["k"], size))),
                lambda items: F.transform(acc["cells"], lambda cell, j: let(held(items, j), lambda own: F.when(F.size(own) == 0, cell).otherwise(less(cell, own)))),
            )
            return F.struct(cells.alias("cells"), F.concat(acc["found"], keys).alias("found"), (F.size(keys) > 0).alias("live"))

        def taken(keys: Column) -> Column:
            """Where the keys add up to one table's cells, nothing is left to take them from."""
            with_check = F.transform(keys, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"), _check(x["k"]).alias("h")))
            last = F.struct(F.slice(acc["cells"], 1, 0).alias("cells"), F.concat(acc["found"], keys).alias("found"), F.lit(False).alias("live"))
            return F.when(_total(with_check) == _total(F.slice(acc["cells"], 1, size // TABLES)), last).otherwise(removed(keys))

        return F.when(~acc["live"], acc).otherwise(let(pure, taken))

    zero = F.struct(diff.alias("cells"), F.expr("cast(array() as array<struct<c:int,k:bigint>>)").alias("found"), F.lit(True).alias("live"))
    side = lambda found, sign: F.transform(F.filter(found, lambda x: x["c"] == sign), lambda x: x["k"])
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        zero,
        step,
        lambda acc: F.when(
            F.forall(acc["cells"], lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0)),
            F.struct(side(acc["found"], 1).alias("a"), side(acc["found"], -1).alias("b")),
        ),
    )


def signed_sketch(items: Column, size: int) -> Column:
    """The cells of the difference of two sets: items (k, c), c = 1 in the first set, -1 in the second."""
    per = size // TABLES

    def cells(own: Column) -> Column:
        def of(table: int) -> Column:
            held = lambda j: F.filter(own, lambda x: x[f"s{table}"] == j)
            cell = lambda h: F.struct(F.aggregate(h, F.lit(0), lambda n, x: n + x["c"]).alias("c"), _xor(h, "k").alias("k"), _xor(h, "h").alias("h"))
            empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
            return F.transform(F.sequence(F.lit(table * per), F.lit((table + 1) * per - 1)), lambda j: let(held(j), lambda h: F.when(F.size(h) == 0, empty).otherwise(cell(h))))

        return F.concat(*map(of, range(TABLES)))

    return let(F.transform(items, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"), _check(x["k"]).alias("h"), *_slots(x["k"], size))), cells)


def unmatched(items: Column) -> Column:
    """The number of signed digests that have no counterpart of the other sign, one by one."""
    lone = lambda x: ~F.exists(items, lambda y: (y["k"] == x["k"]) & (y["c"] == -x["c"]))
    return F.size(F.filter(items, lone))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The number of digests that one of `a` and `b` lacks: by their sketches, or larger ones.

    The larger sketch has parts by ranges of the digests, of about `LOAD` digests each;
    a part that is stuck is sketched again, larger; where the largest is stuck too, its
    digests are compared.
    """
    size = lambda d: F.size(d["a"]) + F.size(d["b"])

    def part(items: Column) -> Column:
        tries = [let(peel(signed_sketch(items, n), n), size) for n in PART_CELLS]
        return F.when(F.size(items) == 0, F.lit(0)).otherwise(F.coalesce(*tries, unmatched(items)))

    def parts(items: Column) -> Column:
        """A fold over the digests in order: whole parts are counted as they end."""
        ranges = F.greatest(F.ceil(F.size(items) / LOAD), F.lit(1)).cast("long")
        # the upper 31 bits of a digest, scaled to the number of parts
        of = lambda k, n: F.shiftright((F.shiftright(k, 33) + F.lit(1 << 30)) * n, 31)

        def step(acc: Column, x: Column) -> Column:
            ended = F.struct((acc["sum"] + part(acc["held"])).alias("sum"), F.array(F.struct(x["k"].alias("k"), x["c"].alias("c"))).alias("held"), x["p"].alias("p"))
            more = F.struct(acc["sum"].alias("sum"), F.array_append(acc["held"], F.struct(x["k"].alias("k"), x["c"].alias("c"))).alias("held"), acc["p"].alias("p"))
            return F.when(x["p"] == acc["p"], more).otherwise(ended)

        zero = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<struct<k:bigint,c:int>>)").alias("held"), F.lit(0).cast("long").alias("p"))
        return let(
            ranges,
            lambda n: F.aggregate(
                F.transform(items, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"), of(x["k"], n).alias("p"))),
                zero,
                step,
                lambda acc: acc["sum"] + part(acc["held"]),
            ),
        )

    signed = lambda own, c: F.transform(own, lambda k: F.struct(k.alias("k"), F.lit(c).alias("c")))
    larger = let(F.array_sort(F.concat(signed(a, 1), signed(b, -1))), parts)
    first = F.when(F.abs(F.size(a) - F.size(b)) <= CELLS, let(peel(subtract(cells_a, cells_b), CELLS), size))
    return F.coalesce(first, larger)


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(a == b, F.lit(1.0)).otherwise((total - difference(a, b, cells_a, cells_b)) / total)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS, also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text (not null) and next_text, the text of the next row by (id, text).

    `also`: columns made of `text`; each comes with that of the next row (next_ before its name).
    """
    also = also or {}
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_KEY))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("__k")
    n = min(MAX_RANGES, max(1, ceil(ids.count() / range_rows)))
    cuts = sorted(set(map(int, ids.approxQuantile("__k", [i / n for i in range(1, n)], 0.2 / n)))) if n > 1 else []

    def ranged(k: Column) -> Column:
        """The number of cuts that are not above k, by bisection."""
        if not cuts:
            return F.lit(0)
        bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(len(cuts).bit_length())),
            F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
            lambda s, _: let(
                F.floor((s["lo"] + s["hi"]) / 2).cast("int"),
                lambda m: F.when(s["lo"] >= s["hi"], s)
                .when(F.element_at(bounds, m + 1) <= k, F.struct((m + 1).alias("lo"), s["hi"].alias("hi")))
                .otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))),
            ),
        )
        return found["lo"]

    rows = rows.withColumn("__r", ranged(F.col("__k"))).withColumn("__s", F.lit(0))
    firsts = sorted((r["__r"], r["k"]) for r in rows.groupBy("__r").agg(F.min("__k").alias("k")).collect())
    if not firsts:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"), *(c.alias(f"{p}{k}") for k, c in also.items() for p in ("", "next_")))
    to = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]  # one row per range: n at most
    sent = docs.sparkSession.createDataFrame(to, "__to int, __k long")
    marked = (
        rows.join(F.broadcast(sent), "__k")
        .groupBy("__to", "__k")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "__k", "text", F.col("__to").alias("__r"), F.lit(1).alias("__s"))
    )
    order = Window.partitionBy("__r").orderBy("__s", "__k", "text")
    made = rows.unionByName(marked).withColumns(also)
    following = made.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *also)})
    return following.where("__s = 0").select("doc_id", "text", "next_text", *(f"{p}{k}" for k in also for p in ("", "next_")))


def edited(text: Column, following: Column) -> Column:
    """`text` whose last half (rounded down) gives way to the start of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), also={"a": paragraphs(F.col("text"))})
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    sets = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        "a",
        paragraphs(F.col("edit")).alias("e"),
        F.col("next_a").alias("n"),
    )
    cells = sets.withColumns({f"cells_{d}": sketch(F.col(d), CELLS) for d in "aen"})
    return cells.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("cells_a")).alias("fingerprint"),
        as_text(F.col("cells_e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("cells_a"), F.col("cells_e")).alias("near_edited"),
        likeness(F.col("a"), F.col("n"), F.col("cells_a"), F.col("cells_n")).alias("near_next"),
    )
