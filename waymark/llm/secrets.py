"""Secret scans in Spark expressions alone: base patterns and sliding-window entropy.

Base kinds: `assign` (a credential name, a separator, a value of 12 characters or
more), `access` (AKIA keys of 18 or more), `hex` (runs of 16 or more); each leftmost
and non-overlapping, found by the regular expressions of the JVM. Offsets are running
sums of the lengths of the matches and of the pieces between them, in blocks, so the
work is linear in the text.

The method adds spans. Candidates are runs of token characters that have a digit and
a letter. A window slides over each character by character; the counts of the
alphabet's characters in the window are kept (one character each in a short string)
and only those of the entering and the leaving character change, and with them the sum
of c log2 c. A candidate is reported as `entropy_hex` or `entropy_base64` where the
entropy of some window reaches the threshold of its character class, unless the allow
list (documentation samples, placeholders, identifiers of public formats) suppresses
it. The allow list judges the value: what follows the last `=` or `/` if that is as
long as a window, else the whole run; its words count between other than letters only,
so the name of a path or variable suppresses nothing. Base spans always stay.

All spans are code points, end exclusive. Edge cases: a null or empty text has no
spans; repeated rows are reported each; columns of the names of the results are
replaced; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import table

#: Fixed values of the contract: kinds in order, pattern, group whose length counts, least length.
BASE = (
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Character classes of the method: kind, candidate, alphabet, window, bits.
HEX, BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CLASSES = (
    ("entropy_hex", "[0-9a-fA-F]{24,}", HEX, 24, 3.0),
    ("entropy_base64", "[A-Za-z0-9+/_=-]{24,}", BASE64, 24, 3.9),
)
#: Values that are no secrets.
ALLOW = (
    "(?i)(?<![a-z])(example|sample|dummy|placeholder|changeme|test|lorem)(?![a-z])|(.)\\2{5,}|0123456789|abcdefgh"
    "|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|512)-"
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Matches whose offsets are summed up one by one; blocks of so many are summed up before.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """Sums of the values before each value of an int array, by blocks."""

    def sums(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    def blocks(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda i: F.slice(own, i * BLOCK + 1, BLOCK))

    def joined_blocks(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
        return let(before, lambda own: F.flatten(F.transform(parts, lambda b, i: sums(b, F.get(own, i)))))

    return F.when(F.size(sizes) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(sizes, lambda own: let(blocks(own), joined_blocks)))


def located(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """Spans of the matches of `pattern` in `text`."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def spans(own: Column) -> Column:
        before = running(F.transform(own, lambda x: x["gap"] + x["size"]))
        return F.zip_with(
            own,
            before,
            lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end")),
        )

    return let(F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))), spans)


def base_spans(text: Column) -> list[Column]:
    """One array of spans per base kind."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found = located(text, kind, rank, pattern)
        if group:
            parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            pairs = F.filter(F.arrays_zip(found.alias("s"), parts.alias("g")), lambda p: F.length(p["g"]) >= least)
            found = F.transform(pairs, lambda p: p["s"])
        else:
            found = F.filter(found, lambda s: s["end"] - s["start"] >= least)
        out.append(F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return out


def max_entropy(s: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of `s`.

    The fold carries the counts (a character each, from "A" for 0), the sum of
    c log2 c and the best so far.
    """
    clog = lambda c: c * log2(c) if c > 1 else 0.0
    gains = F.array(*(F.lit(clog(c + 1) - clog(c)) for c in range(window + 1)))
    held = lambda acc, code: F.ascii(F.substr(acc["counts"], code, F.lit(1))) - 65
    put = lambda counts, code, n: F.when(code > 0, F.overlay(counts, F.char(n + 65), code, F.lit(1))).otherwise(counts)

    def step(acc: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        was_in, was_out = held(acc, come), held(acc, go)
        total = acc["total"] + F.when(come > 0, F.get(gains, was_in)).otherwise(0.0) - F.when(go > 0, F.get(gains, was_out - 1)).otherwise(0.0)
        moved = F.struct(
            put(put(acc["counts"], come, was_in + 1), go, was_out - 1).alias("counts"),
            total.alias("total"),
            F.when(x["full"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
        )
        same = F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"), F.when(x["full"], F.least(acc["least"], acc["total"])).otherwise(acc["least"]).alias("least"))
        return F.when(come == go, same).otherwise(moved)

    def moves(codes: Column) -> Column:
        return F.transform(codes, lambda c, i: F.struct(c.alias("come"), F.coalesce(F.get(codes, i - window), F.lit(0)).alias("go"), (i >= window - 1).alias("full")))

    codes = F.transform(F.split(s, ""), lambda c: F.call_function("instr", F.lit(alphabet), c))
    zero = F.struct(F.lit("A" * len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    bits = lambda acc: F.greatest(F.lit(0.0), F.lit(log2(window)) - acc["least"] / window)
    return F.when(F.length(s) >= window, let(codes, lambda own: F.aggregate(moves(own), zero, step, bits))).otherwise(F.lit(0.0))


def entropy_spans(text: Column) -> list[Column]:
    """One array of spans per character class."""
    empty = F.expr(f"cast(array() as {SPAN})")
    out = []
    for rank, (kind, pattern, alphabet, window, bits) in enumerate(CLASSES, len(BASE)):

        def wanted(s: Column, alphabet: str = alphabet, window: int = window, bits: float = bits) -> Column:
            value = F.regexp_extract(s, f"[^=/]{{{window},}}$", 0)
            mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~F.when(value != "", value).otherwise(s).rlike(ALLOW)
            form = F.lower(s) if alphabet == HEX else s
            return F.when(mixed, max_entropy(form, alphabet, window) >= bits).otherwise(F.lit(False))

        pairs = F.arrays_zip(located(text, kind, rank, pattern).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
        found = F.transform(F.filter(pairs, lambda p: wanted(p["m"])), lambda p: p["s"])
        out.append(F.when(text.rlike(pattern), found).otherwise(empty))
    return out


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `assign`, `access`, `hex` (base spans) and `entropy` (added spans)."""
    body = F.coalesce(F.col(text), F.lit(""))
    base, added = base_spans(body), entropy_spans(body)
    docs = docs.drop("entropy", *(k for k, *_ in BASE if k != text))
    return docs.withColumns(dict(zip((k for k, *_ in BASE), base)) | {"entropy": F.concat(*added)})


def has_secret(text: Column) -> Column:
    """Whether any span, of a base kind or added, is found."""
    body = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a | b, (F.size(s) > 0 for s in base_spans(body) + entropy_spans(body)))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "entropy")).alias("spans"),
    )
