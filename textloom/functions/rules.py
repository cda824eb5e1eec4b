"""Predicates and decisions on texts, URLs and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import SPACE, collapse, count_of, count_sentences, quote_count, solid_length, strip

# fixed values: the speech verbs that mark dialogue
SPEECH = "said|asked|replied|answered|whispered|shouted|murmured|called|cried|snapped|remarked|wondered|added|insisted|began|continued|laughed|sighed|told"
SPEECH_RE = f"(?i)(^|[^A-Za-z0-9_])({SPEECH})($|[^A-Za-z0-9_])"
DASH_RE = rf"(^|[{SPACE}])[—–][{SPACE}]*\p{{Lu}}"
# fixed values: a pair of a quoted name and a number, as bundlers list their parts
TUPLE_RE = r"""\[\s*['"][^'"]+['"]\s*,\s*-?\d+(?:\.\d+)?\s*\]"""
# fixed values: strings that are no prose (addresses, mail, hex, dates, colours)
NOT_PROSE = [r"(?i)^https?://", r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+$", r"(?i)^[a-f0-9]{16,}$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?", r"(?i)^#[0-9a-f]{3,8}$"]
# fixed values: titles and phrases of parked domains
PARKED_TITLE = r"(?i)^\s*[^<>]{1,160}\s[-|·–—]\s[^<>]{1,100}\s+resources and information\.?\s*$"
PARKED_BODY = r"(?i)(^|[^A-Za-z0-9_])(this domain (is|may be) for sale|domain (is|has been) parked|buy this domain|this web page is parked|domain name.{0,80}for sale)($|[^A-Za-z0-9_])"
# fixed values: elements whose content is no text of a page
STRONG = r"(?i)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\s*>"


def is_valid_text(text: Column) -> Column:
    """Worth translating: 3 to 99,999 characters, no short capitals, tuple lists or base64."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.char_length(t)
    shouted = (n < 25) & t.rlike(r"^[A-Z0-9\s]+$") & ~t.rlike(r"^[0-9\s]+$")
    return (n >= 3) & (n < 100000) & ~shouted & (count_of(t, TUPLE_RE) < 8) & ~t.rlike("^[A-Za-z0-9+/=_-]{200,}$")


def is_prose(text: Column, min_length: int = 1) -> Column:
    def judged(t: Column) -> Column:
        out = (F.char_length(t) >= min_length) & t.rlike(r"\p{L}")
        for pattern in NOT_PROSE:
            out &= ~t.rlike(pattern)
        return out

    # as an element the text is stripped once, not again for each pattern
    return F.exists(F.array(strip(text)), judged)


def is_dialogue(text: Column) -> Column:
    return (quote_count(text) >= 2) | text.rlike(DASH_RE) | text.rlike(SPEECH_RE)


def dialogue_score(text: Column) -> Column:
    return (F.least(F.lit(10), quote_count(text)) + F.when(text.rlike(SPEECH_RE), 2).otherwise(0) + F.when(text.rlike(DASH_RE), 2).otherwise(0)).cast("long")


def contains_name(text: Column, name: Column) -> Column:
    """A Latin name as whole tokens, any other as a substring."""
    latin = name.rlike(r"(?i)^[a-z0-9 ._'’-]+$")
    padded = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    token = (F.char_length(padded(name)) >= 2) & F.concat(F.lit(" "), padded(text), F.lit(" ")).contains(F.concat(F.lit(" "), padded(name), F.lit(" ")))
    return F.when(F.btrim(name) == "", False).when(latin, token).otherwise(collapse(F.lower(text)).contains(collapse(F.lower(name))))


def target_present(text: Column, target: Column) -> Column:
    latin = target.rlike(r"(?i)^[a-z0-9 ._'’-]+$")
    padded = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    packed = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    token = (padded(target) == "") | F.concat(F.lit(" "), padded(text), F.lit(" ")).contains(F.concat(F.lit(" "), padded(target), F.lit(" ")))
    return F.when(latin, token).otherwise((packed(target) == "") | packed(text).contains(packed(target)))


def url_refusal(url: Column) -> Column:
    """Why a URL is not fetched: scheme, port, internal names, private IPv4 ranges; null if it may be."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^[^@]*@", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":\d+$", "")), r"\.$", "")
    octet = [F.try_element_at(F.split(host, r"\."), F.lit(i + 1)).try_cast("int") for i in range(4)]
    a, b, c, _ = octet
    reserved = (
        a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    too_large = (F.greatest(*octet) > 255)
    return (
        F.when(scheme == "", "invalid")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "host")
        .when(~port.isin("", "80", "443"), "port")
        .when((host == "localhost") | host.endswith(".localhost"), "localhost")
        .when(host.endswith(".internal") | host.endswith(".local"), "internal")
        .when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$") & (too_large | reserved), "private")
    )


def page_title(html: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), "<[^>]*>", ""))


def page_words(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), "(?s)" + STRONG, " ")
    return collapse(F.regexp_replace(bare, "<[^>]+>", " "))


def parking_reason(title: Column, body: Column) -> Column:
    n = F.char_length(body)
    pair = body.rlike(r"(?i)(^|\W)related searches(\W|$)") & body.rlike(r"(?i)(^|\W)privacy policy(\W|$)")
    return F.when(title.rlike(PARKED_TITLE), "title").when((n < 20000) & body.rlike(PARKED_BODY), "body").when((n < 5000) & pair, "template")


def mapping_counts(original: Column, translated: Column) -> dict[str, Column]:
    """What the two functions below read, once: solid characters and sentences of both sides."""
    sides = {"orig": original, "trans": translated}
    return {f"{k}_chars": solid_length(x) for k, x in sides.items()} | {f"{k}_sentences": count_sentences(F.coalesce(x, F.lit(""))) for k, x in sides.items()}


def mapping_ratios() -> tuple[Column, Column]:
    """Character and sentence ratios, over the columns of ``mapping_counts``; an empty original gives 1 or infinity."""
    pair = [(F.col(f"orig_{k}"), F.col(f"trans_{k}")) for k in ("chars", "sentences")]
    return tuple(F.when(a == 0, F.when(b == 0, 1.0).otherwise(float("inf"))).otherwise(b / a) for a, b in pair)


def mapping_reasons() -> Column:
    """Names of the tests by which a translation does not fit its original, over the columns of ``mapping_counts``."""
    o, t, so, st = (F.col(k) for k in ("orig_chars", "trans_chars", "orig_sentences", "trans_sentences"))
    chars, sentences = mapping_ratios()
    wide = (F.abs(t - o) >= 25) & (o > 0)
    both = (so >= 1) & (st >= 1)
    tests = [
        ((o == 0) & (t > 0), "empty-source"), (wide & (chars > 3.5), "too-long"), (wide & (o > 40) & (chars < 0.2), "too-short"),
        (both & (sentences > 2.5), "more-sentences"), (both & (sentences < 0.34), "fewer-sentences"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
