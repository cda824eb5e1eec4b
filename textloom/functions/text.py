"""Column functions on text: character classes, counts, hashes, normal forms.

Patterns use only what both Java's and RE2's regular expressions read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space and letter ranges that the measures are defined over
SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
HIRAGANA, KATAKANA = r"[\x{3040}-\x{309f}]", r"[\x{30a0}-\x{30ff}]"
HANGUL, CJK, LATIN = r"[\x{ac00}-\x{d7af}]", r"[\x{4e00}-\x{9fff}]", r"[A-Za-z]"
WIDE = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
INVISIBLE = SPACE + r"\x{200b}-\x{200d}\x{2060}\x{ad}"


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def strip(text: Column, inner: str = SPACE) -> Column:
    """Without the characters of a class at both ends."""
    return F.regexp_replace(text, f"^[{inner}]+|[{inner}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def bare_words(text: Column) -> Column:
    """Lower case; everything but letters and digits as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def estimate_tokens(text: Column) -> Column:
    """Half a token for a wide character, a quarter for any other, rounded up."""
    wide = count_of(text, WIDE)
    return F.ceil(wide * 0.5 + (F.char_length(text) - wide) * 0.25).cast("long")


def estimate_output_tokens(text: Column) -> Column:
    return F.least(F.lit(131072), F.greatest(F.lit(2048), F.ceil(F.char_length(text) / 2) * 6)).cast("long")


def rolling_hash(text: Column) -> Column:
    """h = 31 h + code, kept to 31 bits, over the characters of the basic plane."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(2147483647)))


def fnv_hex(text: Column) -> Column:
    """FNV-1a in 32 bits over characters, eight hexadecimal digits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    folded = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def language_evidence(text: Column, sample_chars: int = 20000) -> dict[str, Column]:
    sample = F.substring(text, 1, sample_chars)
    counts = {k: count_of(sample, p) for k, p in (("hiragana", HIRAGANA), ("katakana", KATAKANA), ("hangul", HANGUL), ("cjk", CJK), ("latin", LATIN))}
    return counts


def language_label(kana: Column, hangul: Column, cjk: Column, latin: Column, min_chars: int = 80) -> Column:
    """ja, zh, ko, en or unknown by the shares of scripts among the letters counted."""
    n = kana + hangul + cjk + latin
    return (
        F.when(n < min_chars, "unknown")
        .when((kana >= 5) & (kana / n >= 0.03), "ja")
        .when((hangul >= 5) & (hangul / n >= 0.15), "ko")
        .when((cjk >= 5) & (kana == 0) & (cjk / n >= 0.25), "zh")
        .when(latin / n >= 0.5, "en")
        .otherwise("unknown")
    )


def language_confidence(label: Column, kana_ratio: Column, tagged_ja: Column) -> Column:
    ja = F.least(F.lit(1.0), 0.7 + F.least(kana_ratio, F.lit(0.3)) + F.when(tagged_ja, 0.1).otherwise(0.0))
    return F.when(label == "ja", ja).when(label.isin("ko", "zh"), 0.9).when(label == "en", 0.8).otherwise(0.0)


def count_sentences(text: Column) -> Column:
    """Pieces between sentence ends or line breaks that hold a letter: each is one match from its first letter to its end."""
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}a-zA-Z][^.!?;。！？；\n\r]*+")).cast("long")


def solid_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]", "")).cast("long")


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Halves go up, for negative numbers too."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def quote_count(text: Column) -> Column:
    return count_of(text, '[“”「」『』"]')


def sentence_units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^.!?。！？\n]+[.!?。！？]?"), F.lit(0))
