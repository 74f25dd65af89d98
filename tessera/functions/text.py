"""Text functions as columns: normal forms, hashes, character shares, quality scores, n-grams, classifiers, splitters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Character classes by script, and punctuation that texts are written with (fixed values; Java and RE2 read them alike).
SCRIPTS = {
    "hiragana": r"\x{3040}-\x{309F}",
    "katakana": r"\x{30A0}-\x{30FF}\x{FF66}-\x{FF9D}",
    "kanji": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "hangul": r"\x{AC00}-\x{D7A3}",
    "latin": "A-Za-zＡ-Ｚａ-ｚ",
    "digit": "0-9０-９",
}
PUNCTUATION = "。、・「」『』（）()［］【】，．,.!?！？：:;；…ー―─—–%％&/／＝=+×÷±°〜~|｜’'\"“”\\-"
#: What counts as meaningful: any of the scripts.
MEANINGFUL = "".join(SCRIPTS.values())
#: Letters and digits of any script: what keys keep.
WORD_CLASS = r"\p{L}\p{N}"
#: Blanks of any script.
BLANK = r"\s\p{Z}"


@F.arrow_udf(T.StringType())
def nfkc(column: pa.Array) -> pa.Array:
    """Unicode normal form KC; there is no built-in one."""
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in column.to_pylist()], pa.string())


def normalized(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, lower case, no white space (X1, X4); texts known to be ASCII skip the normal form."""
    return F.lower(F.regexp_replace(text if ascii_only else nfkc(text), r"(?U)\s+", ""))


def text_key(text: Column, n: int = 40) -> Column:
    """The first letters and digits of any script, lower-cased."""
    return F.left(F.lower(F.regexp_replace(text, rf"[^{WORD_CLASS}]+", "")), F.lit(n))


def normal_key(text: Column, n: int = 40) -> Column:
    """The start of the normal form without question numbers, blanks and separators."""
    numbered = F.regexp_replace(nfkc(text), r"問\s*[0-9]+", "")
    return F.left(F.regexp_replace(numbered, r"[\s\p{Z}\x{200B}-\x{200F},，.．、。()（）「」【】]+", ""), F.lit(n))


def string_hash(text: Column, start: int = 5381, times: int = 33, xor: bool = True) -> Column:
    """A 32-bit fold over code points: hash * times xor (or +) code (X2, X31); an empty string gives the start."""
    step = (lambda h, c: (h * times).bitwiseXOR(F.ascii(c).cast("long"))) if xor else (lambda h, c: h * times + F.ascii(c).cast("long"))
    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(chars, F.lit(start).cast("long"), lambda h, c: step(h, c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def split_of(key: Column, train: int = 70, validation: int = 15) -> Column:
    """train, val or test, by the key's hash modulo 100."""
    h = string_hash(key, 0, 31, xor=False) % 100
    return F.when(h < train, "train").when(h < train + validation, "val").otherwise("test")


def share(text: Column, pattern: str) -> Column:
    """Share of the characters that match."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), F.length(text)), F.lit(0.0))


def bare(text: Column) -> Column:
    """The text without blanks of any script."""
    return F.regexp_replace(text, f"[{BLANK}]+", "")


def script_shares(text: Column) -> Column:
    """A struct of each script's share of the characters other than blanks, 0 for blank texts."""
    return F.struct(*[share(bare(text), f"[{c}]").alias(name) for name, c in SCRIPTS.items()])


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 1 blank, 2 of a script, 4 of no script and no punctuation."""
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000))
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[i for i, c in enumerate(every) if c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] == "Z"]] = 1
    scripts = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), MEANINGFUL)
    kinds[[m.start() for m in re.finditer(f"[{scripts}]", every)]] |= 2
    for m in re.finditer(f"[^{scripts}{PUNCTUATION}]+", every):
        kinds[m.start() : m.end()] |= 4
    return kinds


def _repeated(x: np.ndarray) -> int:
    """Characters in runs of four or more of one, and those in runs of three or more of a pair, from left to right."""
    if len(x) < 4:
        return 0
    edges = np.flatnonzero(np.diff(x)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(x)]]))
    n = int(runs[runs >= 4].sum())
    # stretches of places that hold what the place two further holds, next to another character
    pair = np.concatenate([[0], ((x[2:] == x[:-2]) & (x[1:-1] != x[:-2])).view(np.int8), [0]])
    turns = np.flatnonzero(np.diff(pair))
    taken = 0
    for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
        if end - begin >= 4:
            begin = max(begin, taken)
            if (end + 2 - begin) // 2 >= 3:
                taken = begin + (end + 2 - begin) // 2 * 2
                n += taken - begin
    return n


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("rest", "meaningful", "odd", "repeated")]))
def _counted(column: pa.Array) -> pa.Array:
    """Characters other than blanks, those of a script and those of neither script nor punctuation among them, and repeated characters; null for null."""
    kinds, counts = _kinds(), np.zeros((4, len(column)), np.int32)
    for i, text in enumerate(column):
        if text.is_valid:
            x = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)
            of = kinds[x]
            blank = (of & 1).astype(bool)
            counts[:, i] = len(x) - blank.sum(), np.count_nonzero(of & 2), np.count_nonzero((of & 4).astype(bool) & ~blank), _repeated(x)
    names = ["rest", "meaningful", "odd", "repeated"]
    return pa.StructArray.from_arrays([pa.array(c) for c in counts], names, mask=pc.is_null(column))


def repeated_characters(text: Column) -> Column:
    """Characters in runs of four or more of one, or of three or more of a pair."""
    return F.coalesce(_counted(text)["repeated"], F.lit(0))


def meaningful_share(text: Column, kept: str = "") -> Column:
    """Share of characters of a script among those other than blanks; 0 for blank texts (X6). ``kept``: a blank that counts as a character."""
    n = _counted(text)
    rest = n["rest"] + (F.length(text) - F.length(F.replace(text, F.lit(kept), F.lit("")))) if kept else n["rest"]
    return F.coalesce(F.try_divide(n["meaningful"], rest), F.lit(0.0))


def broken_share(text: Column) -> Column:
    """Share of characters that are of no script and no punctuation, and half of those in runs, 1 at most; 1 for blank texts."""
    n = _counted(text)
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(n["odd"] + 0.5 * n["repeated"], n["rest"])), F.lit(1.0))


def text_quality(text: Column) -> Column:
    """Share of kana, kanji, hangul, Latin letters and digits among all characters."""
    return share(text, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FAF}\x{AC00}-\x{D7A3}a-zA-Z0-9]")


def garbled(text: Column) -> Column:
    """Few meaningful characters or none, or a character five times in a row, or a pair three times."""
    return (share(bare(text), r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}A-Za-z0-9]") < 0.6) | text.rlike(r"(.)\1{4,}") | text.rlike(r"(..)\1{2,}")


def quality_score(text: Column, confidence: Column | None = None) -> Column:
    """0 to 100: 100 less 70 of the broken share, 30 of what isn't meaningful, and 25 or 8 for texts under 10 or 25 characters.

    Mixed 0.7 to 0.3 with a confidence, if there is one; 0 for blank texts.
    """
    short = F.when(F.length(text) < 10, 25.0).when(F.length(text) < 25, 8.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100.0 - 70.0 * broken_share(text) - 30.0 * (1.0 - meaningful_share(text)) - short)
    if confidence is not None:
        score = F.coalesce(0.7 * score + 0.3 * 100.0 * confidence, score)
    return F.when(_counted(text)["rest"] > 0, score).otherwise(0.0)


def garbage_score(text: Column) -> Column:
    """0 to 1 from eight signals: short, symbols, digits, few different characters, long words, no blanks, broken characters, repeats."""
    n = F.greatest(F.length(text), F.lit(1))
    signals = [
        F.when(F.length(text) < 10, 0.3).otherwise(0.0),
        F.least(F.lit(0.3), share(text, rf"[^{WORD_CLASS}\s]")),
        F.when(share(text, r"\p{N}") > 0.5, 0.2).otherwise(0.0),
        F.when(F.size(F.array_distinct(F.split(text, ""))) / n < 0.02, 0.2).otherwise(0.0),
        F.when(text.rlike(r"[A-Za-z]{30,}"), 0.2).otherwise(0.0),
        # scripts without blanks between words are no sign of garbage
        F.when(~text.rlike(r"\s") & (share(text, "[A-Za-z]") > 0.5), 0.2).otherwise(0.0),
        F.least(F.lit(0.3), share(text, r"[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}]") * 3),
        F.when(text.rlike(r"(.)\1{7,}"), 0.2).otherwise(0.0),
    ]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, signals))


def japanese_spacing(text: Column) -> Column:
    """Blanks between Japanese characters go, as do those before Japanese punctuation; others become one (X11)."""
    japanese = SCRIPTS["hiragana"] + SCRIPTS["katakana"] + SCRIPTS["kanji"] + r"\x{3001}\x{3002}\x{FF01}-\x{FF5E}"
    joined = F.regexp_replace(text, rf"(?<=[{japanese}])[ \x{{3000}}\t]+(?=[{japanese}])", "")
    return F.trim(F.regexp_replace(joined, r"[ \x{3000}\t]+", " "))


#: Digits and circled numerals by value (fixed values).
KANJI_DIGITS = "〇一二三四五六七八九"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"


def kanji_number(text: Column) -> Column:
    """A kanji number up to 99 as an integer; null for anything else."""
    digit = lambda c: F.when(c == "", F.lit(None)).otherwise(F.instr(F.lit(KANJI_DIGITS), c) - 1)
    tens, ones = F.regexp_extract(text, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 1), F.regexp_extract(text, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 2)
    with_ten = F.coalesce(digit(tens), F.lit(1)) * 10 + F.coalesce(digit(ones), F.lit(0))
    return F.when(text.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), with_ten).when(text.rlike(f"^[{KANJI_DIGITS}]$"), digit(text)).cast("int")


def without_readings(text: Column) -> Column:
    """Kana readings in brackets after kanji go."""
    return F.regexp_replace(text, rf"(?<=[{SCRIPTS['kanji']}])[(（][{SCRIPTS['hiragana']}{SCRIPTS['katakana']}]+[)）]", "")


def readings(text: Column) -> Column:
    """(kanji, reading) pairs of kana in brackets after kanji."""
    pattern = rf"([{SCRIPTS['kanji']}]+)[(（]([{SCRIPTS['hiragana']}{SCRIPTS['katakana']}]+)[)）]"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("kanji"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("reading"))


def repaired_markers(text: Column) -> Column:
    """Question markers that recognition has misread get their sign again."""
    return F.regexp_replace(text, r"(?m)(^|[\s\x{3000}])[間同]\s*(?=[0-9０-９])", "$1問")


def formulas(text: Column) -> Column:
    """Stretches that read as a formula: an operator between terms of letters, digits or brackets."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9()^._]+(?: ?[=+*/<>≤≥≠±×÷−-] ?[A-Za-z0-9()^._]+)+)"), F.lit(1))


def bridged(tags: Column, bridges: dict[str, list[str]]) -> Column:
    """The tags with those that they lead to, in order, each once."""
    table = F.create_map(*[x for k, v in bridges.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(tags, more))


def longest_of(*texts: Column, least: int = 10) -> Column:
    """The longest of several readings of a text that has more than so many characters, the first of equals; else null."""
    best = F.array_max(F.array(*[F.struct(F.length(t).alias("n"), F.lit(-i).alias("i"), t.alias("t")) for i, t in enumerate(texts)]))
    return F.when(best["n"] > least, best["t"])


def failure_route(garbage: Column, confidence: Column, label: Column, number: Column) -> Column:
    """Why a record failed: noise before segmentation before classification."""
    return F.when((garbage >= 0.5) | (confidence < 0.5), "ocr_noise").when(number.isNull(), "segmentation_failure").when(label.isNull() | (label == "unknown"), "classifier_gap").otherwise("none")


def fuzzy_contains(text: Column, keyword: str, least: float = 0.72) -> Column:
    """The keyword, or a word near enough to it by edit distance."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    near = F.exists(words, lambda w: (1 - F.levenshtein(w, F.lit(keyword)) / F.greatest(F.length(w), F.lit(len(keyword)))) >= least)
    return F.contains(F.lower(text), F.lit(keyword)) | near


def keyword_count(text: Column, keyword: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))) / len(keyword)).cast("long")


def char_ngrams(text: Column, n: int) -> Column:
    """All n-grams of characters, repeats kept.

    Characters are cut once and joined with those that follow; a substring for each place would walk the text from its start.
    """
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    grams = characters
    for i in range(1, n):
        grams = F.zip_with(grams, F.slice(characters, F.lit(i + 1), F.length(text)), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= n, F.slice(grams, F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<string>"))


def lexicon_score(text: Column, keywords: list[str], patterns: list[str], per_word: float = 0.15, per_pattern: float = 0.2) -> Column:
    """Keyword hits, capped at 0.6, and pattern hits, capped at 0.4."""
    lower = F.lower(text)
    words = reduce(lambda a, b: a + b, [F.contains(lower, F.lit(k)).cast("int") for k in keywords], F.lit(0))
    found = reduce(lambda a, b: a + b, [lower.rlike(p).cast("int") for p in patterns], F.lit(0))
    return F.least(per_word * words, F.lit(0.6)) + F.least(per_pattern * found, F.lit(0.4))


def best_label(scores: dict[str, Column], floor: float = 0.0) -> Column:
    """The label of the highest score, the first of equals; null below the floor."""
    ranked = F.array_max(F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]))
    return F.when(ranked["s"] > floor, ranked["k"])


def first_match(text: Column, patterns: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def all_matches(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The names of all patterns that match."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in patterns]))


def choice_label(text: Column) -> Column:
    """The label a choice begins with."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]{1,2}|[A-Z])[.)]\s+", 1), F.lit(""))


def year_found(text: Column) -> Column:
    """A year from 1900 to 2099, first of the text."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).cast("int")


def softmax_margin(scores: Column, penalty: float = 0.7, margin: float = 0.05) -> Column:
    """Largest softmax share; times the penalty where the second is within the margin (M3)."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    ranked = F.reverse(F.array_sort(F.transform(e, lambda x: x / total)))
    return F.when((F.size(ranked) > 1) & (ranked[0] - F.get(ranked, F.lit(1)) < margin), ranked[0] * penalty).otherwise(ranked[0])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 for different lengths or a zero vector (M4)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def sql_round(x: Column, digits: int = 6) -> Column:
    """Halves of the product with a power of ten upwards, as DuckDB rounds doubles of 0 or more; round() takes those of the shortest decimal."""
    y = x * 10.0**digits
    below = F.floor(y).cast("double")
    return F.when(F.isnan(x), x).otherwise((below + (y - below >= 0.5).cast("int")) / 10.0**digits)


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves upwards, as in JavaScript."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
