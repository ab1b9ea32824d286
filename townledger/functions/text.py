"""Scalar text functions as Column expressions; all but nfc and unescape stay in generated JVM code."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that search tokens leave out.
STOPWORDS = (
    "the", "an", "of", "on", "in", "to", "and", "for", "by", "did", "how", "what", "which",
    "was", "is", "are", "about", "with", "at", "be", "it", "this", "that", "from", "as",
)
# What is stripped from both ends of a token before it is judged.
TOKEN_EDGES = ".,;:!?()[]\"'$%-–/|*"
#: One character of white space, in a pattern with (?U): all of Unicode and the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]"
# A number as answers and sources are compared by; an amount of dollars with its scale.
NUMBER = r"\$?\d[\d,]*(?:\.\d+)?%?"
AMOUNT = r"\$\s?(\d[\d,]*(?:\.\d+)?)\s*(million|billion|thousand|bn|[kKmMbB])?\b"
# Questions with these words need more than one step.
MULTI_STEP = r"(?i)\b(compare|comparison|since|between|trend|over time|how many times|how often|each|every|all|total|list)\b"


def small_batches(spark: SparkSession) -> None:
    """From now on in this session, an Arrow batch for Python ends at 4 MB, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def nfc(c: Column) -> Column:
    """Composed characters (NFC), which Spark has no function for. Texts of characters below U+0300 are composed, so Python is sent the others only."""
    if session := SparkSession.getActiveSession():
        small_batches(session)

    @F.pandas_udf("string")
    def composed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.coalesce(composed(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def unescape(c: Column) -> Column:
    """Character references decoded, which Spark has no function for."""

    @F.pandas_udf("string")
    def decoded(v: pd.Series) -> pd.Series:
        return v.map(html.unescape, na_action="ignore")

    return decoded(c)


def normalize(c: Column) -> Column:
    """Composed characters, plain quotes and blanks, runs of blanks and tabs as one, no blanks at line ends; line ends stay."""
    plain = F.translate(nfc(c), "\u00a0‘’“”", " ''\"\"")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"(?m) +$", "")


def tokens(c: Column) -> Column:
    """Search tokens: runs of a-z and digits of at least two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


_SPACED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def word_runs(low: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """All runs of a-z and digits of a UTF-8 text in lower case, in order, a list for about size bytes of it: for use inside tasks."""
    low, at = low.translate(_SPACED), 0
    while at < len(low):
        end = low.find(b" ", at + size)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def search_terms(query: str) -> list[str]:
    """The search tokens of a query, worked out on the driver."""
    return [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= 2 and t not in STOPWORDS]


def valid_token_ratio(c: Column) -> Column:
    """The share of tokens that are words with a vowel (or one letter), numbers or codes; 0 without tokens."""
    parts = F.filter(F.transform(F.split(c, r"\s+"), lambda t: F.btrim(t, F.lit(TOKEN_EDGES))), lambda t: F.length(t) > 0)
    word = lambda t: t.rlike(r"^[A-Za-z]+(['’-][A-Za-z]+)*$") & ((F.length(t) == 1) | t.rlike("[aeiouyAEIOUY]"))
    number = lambda t: t.rlike(r"^[0-9]+([.,:/-][0-9]+)*[A-Za-z]{0,2}$")
    code = lambda t: t.rlike(r"^[A-Z]{1,5}[0-9]+[A-Za-z0-9-]*$")
    good = F.size(F.filter(parts, lambda t: word(t) | number(t) | code(t)))
    return F.coalesce(F.try_divide(good.cast("double"), F.size(parts).cast("double")), F.lit(0.0))


def solid_chars(c: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(c, r"\s", ""))


def needs_ocr(text: Column, image_ratio: Column) -> Column:
    """Little text on a page that is mostly image, or a fifth of the characters unreadable."""
    garbled = F.length(F.regexp_replace(text, "[^�-]", ""))
    return ((solid_chars(text) < 50) & (image_ratio >= 0.5)) | (F.coalesce(F.try_divide(garbled.cast("double"), F.length(text).cast("double")), F.lit(0.0)) >= 0.2)


def _plain_number(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[$,]", ""), "%$", ""), r"\.0+$", "")


def numeric_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), _plain_number))


def strict_numeric_tokens(c: Column) -> Column:
    """Numeric tokens but for whole numbers from 0 to 20 without a sign of dollars or percent."""
    raw = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    small = lambda t: ~t.rlike(r"[$%]") & _plain_number(t).rlike(r"^0*(1?[0-9]|20)$")
    return F.array_distinct(F.transform(F.filter(raw, lambda t: ~small(t)), _plain_number))


def numbers_supported(claim: Column, sources: Column) -> Column:
    return F.size(F.array_except(strict_numeric_tokens(claim), numeric_tokens(sources))) == 0


def amounts(c: Column) -> Column:
    """Dollar amounts of a text as doubles, with their scale."""
    text = squeeze(c)
    value = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1))
    scale = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(2))
    times = lambda s: F.when(s.isin("thousand", "k", "K"), 1e3).when(s.isin("million", "m", "M"), 1e6).when(s.isin("billion", "bn", "b", "B"), 1e9).otherwise(1.0)
    return F.zip_with(value, scale, lambda v, s: F.regexp_replace(v, ",", "").cast("double") * times(s))


def time_label(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(ms.isNull(), "").otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def time_ms(c: Column) -> Column:
    """H:MM:SS.mmm or H:MM:SS,mmm as milliseconds; null where it is none."""
    g = lambda i: F.regexp_extract(c, r"^(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})$", i).try_cast("long")
    return ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4)


def html_text(c: Column) -> Column:
    """Text without tags, character references decoded."""
    return squeeze(unescape(F.regexp_replace(c, "<[^>]*>", " ")))


def snippet(text: Column, at: Column, n: Column, around: int = 80) -> Column:
    first = F.greatest(F.lit(1), at - around)
    return F.substring(text, first, at + n + around - first)


def canonical_question(c: Column) -> Column:
    return F.regexp_replace(squeeze(F.lower(c)), r"[?.!]+$", "")


def stage_hash(content: Column, versions: str) -> Column:
    return F.sha2(F.concat_ws("|", content, F.lit(versions)), 256)


def is_easy(question: Column, top_score: Column) -> Column:
    return (top_score >= 0.8) & ~question.rlike(MULTI_STEP)


def title_tokens(c: Column) -> Column:
    """Words of a title that tell it from others: without adoption and numbering phrases, of three characters or more."""
    t = F.regexp_replace(F.lower(c), r"adopt(ed)? (a )?resolution( no\.?)?( \d{4}-\d+)?", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"ordinance( no\.?)? \d+[a-z]?", " "), "[^a-z0-9]", " ")
    return F.array_distinct(F.filter(F.split(t, " "), lambda x: F.length(x) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def grade_exact(kind: Column, gold: Column, answer: Column) -> Column:
    """Whether an answer holds the gold number, name, date (three spellings) or identifier."""
    as_number = lambda x: x.try_cast("decimal(38,10)")
    number = F.exists(numeric_tokens(answer), lambda t: F.coalesce(as_number(t) == as_number(gold), F.lit(False)))
    name = F.contains(squeeze(F.lower(answer)), squeeze(F.lower(gold)))
    day = F.try_to_date(gold, "yyyy-MM-dd")
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "M/d/yyyy")]
    date = F.coalesce(F.contains(F.lower(answer), F.lower(forms[0])) | F.contains(F.lower(answer), F.lower(forms[1])) | F.contains(answer, forms[2]), F.lit(False))
    bare = lambda x: F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return F.when(kind == "number", number).when(kind == "name", name).when(kind == "date", date).otherwise(F.contains(bare(answer), bare(gold)))


def ngrams(words: Column, n: int) -> Column:
    """The distinct runs of n words of an array as hashes of 64 bits; the words are worked out once, whatever their number."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    found = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))
    return F.element_at(found, 1)


def image_area_ratio(areas: Column, page: Column) -> Column:
    """The largest image's share of a page's area; 0 without images or area."""
    return F.coalesce(F.array_max(F.transform(areas, lambda a: F.try_divide(a.cast("double"), page.cast("double")))), F.lit(0.0))


def hit_heading(city: Column, body: Column, date: Column, kind: Column, item: Column) -> Column:
    return F.concat(city, F.lit(" "), body, F.lit(", "), date.cast("string"), F.lit(", "), kind, F.coalesce(F.concat(F.lit(", item "), item), F.lit("")))


def chunk_header(city: Column, body: Column, date: Column, kind: Column, item: Column, title: Column) -> Column:
    head = F.concat_ws(" ", city, body, date.cast("string"), kind)
    return F.substring(F.concat(head, F.coalesce(F.concat(F.lit(" | "), item, F.lit(" "), title), F.lit(""))), 1, 200)


def hit_snippet(c: Column) -> Column:
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, 240)


def recording_link(url: Column, ms: Column, seeks: Column) -> Column:
    """The recording at a time, where its player can seek; else null."""
    return F.when(seeks & ms.isNotNull(), F.concat(url, F.lit("&entrytime="), F.floor(ms / 1000).cast("string")))
