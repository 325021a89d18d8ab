"""English stems as Spark expressions: suffixes taken off in stages, within two regions of a word.

R1 is what follows the first consonant after a vowel, R2 the same within R1. Each stage
looks at the longest of its suffixes that the word has. A stage is one pass over an array
of words, so a word is computed once however often a stage looks at it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: words with stems of their own, and those that stay.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1_PREFIXES = "gener|commun|arsen"
DOUBLES = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
# Suffixes of the later stages and what stands in their place, longest first.
SECOND = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al",
    "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate",
    "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"


def _cut(w: Column, n: int, by: str = "") -> Column:
    """`w` without its last n letters, and `by` instead."""
    kept = F.substring(w, F.lit(1), F.length(w) - n)
    return F.concat(kept, F.lit(by)) if by else kept


def _region(w: Column, pattern: str) -> Column:
    """Where the region behind `pattern` starts; the word's length without it."""
    head = F.length(F.regexp_extract(w, pattern, 0))
    return F.when(head > 0, head).otherwise(F.length(w))


def _word(w: Column, r1: Column, r2: Column) -> Column:
    return F.struct(w.alias("w"), r1.cast("int").alias("r1"), r2.cast("int").alias("r2"))


def _longest(w: Column, suffixes: dict[str, Column]) -> Column:
    """What the longest suffix that `w` has says; `w` without any. Longest first."""
    out = None
    for s, value in suffixes.items():
        out = F.when(w.endswith(s), value) if out is None else out.when(w.endswith(s), value)
    return out.otherwise(w)


def _short_end(w: Column) -> Column:
    """Whether a word ends in a short syllable."""
    return w.rlike(f"{OTHER}{VOWEL}[^aeiouywxY]$|^{VOWEL}{OTHER}$")


def _plural(x: Column) -> Column:
    w = x["w"]
    own = {
        "sses": _cut(w, 2),
        "ied": F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)),
        "ies": F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)),
        "us": w,
        "ss": w,
        "s": F.when(w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w),
    }
    return _word(_longest(w, own), x["r1"], x["r2"])


def _past(x: Column) -> Column:
    """First pass of the past and -ing stage: r2 < 0 marks a word to be mended."""
    w = x["w"]
    in_r1 = lambda n: F.length(w) - n >= x["r1"]
    gone = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    out = None
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        n = len(s)
        if s.startswith("eed"):
            value = F.when(in_r1(n), _word(_cut(w, n, "ee"), x["r1"], x["r2"])).otherwise(x)
        else:
            value = F.when(gone(n).rlike(VOWEL), _word(gone(n), x["r1"], -1 - x["r2"])).otherwise(x)
        out = F.when(w.endswith(s), value) if out is None else out.when(w.endswith(s), value)
    return F.when(w.isin(*KEPT), x).otherwise(out.otherwise(x))


def _mended(x: Column) -> Column:
    w, r2 = x["w"], -1 - x["r2"]
    short = (F.length(w) <= x["r1"]) & _short_end(w)
    new = F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLES), _cut(w, 1)).when(short, F.concat(w, F.lit("e"))).otherwise(w)
    return F.when(x["r2"] < 0, _word(new, x["r1"], r2)).otherwise(x)


def _last_y(x: Column) -> Column:
    w = x["w"]
    return _word(F.when(w.rlike(f".{OTHER}[yY]$"), _cut(w, 1, "i")).otherwise(w), x["r1"], x["r2"])


def _second(x: Column) -> Column:
    w = x["w"]
    own = {}
    for s, by in SECOND.items():
        fits = F.length(w) - len(s) >= x["r1"]
        fits = fits & w.rlike("logi$") if s == "ogi" else fits & w.rlike("[cdeghkmnrt]li$") if s == "li" else fits
        own[s] = F.when(fits, _cut(w, len(s), by)).otherwise(w)
    return _word(_longest(w, own), x["r1"], x["r2"])


def _third(x: Column) -> Column:
    w = x["w"]
    own = {s: F.when(F.length(w) - len(s) >= x["r2" if s == "ative" else "r1"], _cut(w, len(s), by)).otherwise(w) for s, by in THIRD.items()}
    return _word(_longest(w, own), x["r1"], x["r2"])


def _fourth(x: Column) -> Column:
    w = x["w"]
    own = {}
    for s in FOURTH:
        fits = F.length(w) - len(s) >= x["r2"]
        own[s] = F.when(fits & w.rlike("[st]ion$") if s == "ion" else fits, _cut(w, len(s))).otherwise(w)
    return _word(_longest(w, own), x["r1"], x["r2"])


def _fifth(x: Column) -> Column:
    w = x["w"]
    at = F.length(w) - 1
    e = w.endswith("e") & ((at >= x["r2"]) | ((at >= x["r1"]) & ~_short_end(_cut(w, 1))))
    return F.lower(F.when(e | (w.endswith("ll") & (at >= x["r2"])), _cut(w, 1)).otherwise(w))


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words."""
    # y at the start or after a vowel is a consonant: written Y meanwhile
    marked = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y"))
    begun = F.transform(marked, lambda w: _word(w, _region(w, f"^(?:{R1_PREFIXES}|.*?{VOWEL}{OTHER})"), F.lit(0)))
    ranged = F.transform(begun, lambda x: _word(x["w"], x["r1"], x["r1"] + _region(F.substring(x["w"], x["r1"] + 1, F.length(x["w"])), f"^.*?{VOWEL}{OTHER}")))
    out = ranged
    for stage in (_plural, _past, _mended, _last_y, _second, _third, _fourth):
        out = F.transform(out, stage)
    done = F.transform(out, _fifth)
    special = F.create_map(*(F.lit(v) for kv in SPECIAL.items() for v in kv))
    kept = F.transform(words, lambda w: F.when(F.length(w) <= 2, w).otherwise(F.coalesce(special[w], F.when(w.isin(*KEPT), w))))
    return F.zip_with(kept, done, lambda a, b: F.coalesce(a, b))


def stem(word: Column) -> Column:
    return stems(F.array(word))[0]
