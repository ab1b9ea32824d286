"""English stems by suffix stripping (the Porter2 rules), as one Column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published rules: words with stems of their own, words that stay, beginnings that set the first region.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_WITHOUT_S = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = "gener|commun|arsen"
# Suffixes of steps 2 and 3 and what takes their place in the first region.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STEP_1 = ("sses", "ied", "ies", "us", "ss", "s", "eed", "eedly", "ed", "edly", "ing", "ingly")
#: What the rules take off or change, for telling which words may share a stem.
SUFFIXES = tuple(sorted({*STEP_1, *STEP_2, *STEP_3, *STEP_4, "e", "l", "y", "ly"}))
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
REGION = "^.*?[aeiouy][^aeiouy]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it may name many times and that is worked out once: Spark would copy a column into each place of its use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _suffix(w: Column, suffixes: Iterable[str]) -> Column:
    """The longest of the suffixes that w ends in, empty without one."""
    return F.regexp_extract(w, f"({'|'.join(sorted(suffixes, key=lambda s: (-len(s), s)))})$", 1)


def _less(w: Column, n: Column | int) -> Column:
    """w without its last n characters."""
    return w.substr(F.lit(1), F.length(w) - n)


def _word(state: Column, new: Callable[[Column, Column], Column], suffixes: Iterable[str] = ()) -> Column:
    """The state (w, stop, r1, r2) with new(state, the longest of the suffixes that w ends in) for w, if its word does not stop."""
    step = lambda s, m: F.struct(F.when(s["stop"], s["w"]).otherwise(new(s, m)).alias("w"), s["stop"].alias("stop"), s["r1"].alias("r1"), s["r2"].alias("r2"))
    return _let(state, lambda s: _let(_suffix(s["w"], suffixes), lambda m: step(s, m)) if suffixes else step(s, F.lit("")))


def _replaced(state: Column, suffixes: dict[str, str], region: str, **only: Callable[[Column], Column]) -> Column:
    """The longest suffix replaced where it lies in the region, and where its own condition holds."""
    put = F.create_map(*(F.lit(x) for pair in suffixes.items() for x in pair))

    def new(s: Column, m: Column) -> Column:
        inside = (m != "") & (F.length(s["w"]) - F.length(m) >= s[region])
        for suffix, condition in only.items():
            inside = inside & ((m != suffix) | condition(s))
        return F.when(inside, F.concat(_less(s["w"], F.length(m)), F.element_at(put, m))).otherwise(s["w"])

    return _word(state, new, suffixes)


def _plural(s: Column, m: Column) -> Column:
    w = s["w"]
    return F.when(m == "sses", _less(w, 2)).when(m.isin("ied", "ies"), F.when(F.length(w) > 4, _less(w, 2)).otherwise(_less(w, 1))).when((m == "s") & w.rlike("[aeiouy].+s$"), _less(w, 1)).otherwise(w)


def _past(s: Column, m: Column) -> Column:
    def cut(b: Column) -> Column:
        e = F.concat(b, F.lit("e"))
        mended = F.when(b.rlike("(?:at|bl|iz)$"), e).when(b.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(b, 1)).when((s["r1"] >= F.length(b)) & b.rlike(SHORT), e).otherwise(b)
        return F.when(m == "", s["w"]).when(m.isin("eed", "eedly"), F.when(F.length(b) >= s["r1"], F.concat(b, F.lit("ee"))).otherwise(s["w"])).when(b.rlike("[aeiouy]"), mended).otherwise(s["w"])

    return _let(_less(s["w"], F.length(m)), cut)


def _final_y(s: Column, _: Column) -> Column:
    return F.when(s["w"].rlike("^.+[^aeiouy][yY]$"), F.concat(_less(s["w"], 1), F.lit("i"))).otherwise(s["w"])


def _last(s: Column, _: Column) -> Column:
    w, left = s["w"], F.length(s["w"]) - 1
    goes = (left >= s["r2"]) & w.rlike("(?:e|ll)$") | (left >= s["r1"]) & w.endswith("e") & ~_less(w, 1).rlike(SHORT)
    return F.when(goes, _less(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of one or two characters, and words without a-z, stay; a null word has a null stem.

    Some twenty patterns for each word: apply it to distinct words.
    """
    odd = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    length = lambda w, pattern: F.length(F.regexp_extract(w, pattern, 0))
    region = lambda n, w: F.when(n > 0, n).otherwise(F.length(w))

    def begun(x: Column) -> Column:
        marked = F.coalesce(F.element_at(odd, x), F.regexp_replace(F.regexp_replace(x, "^y", "Y"), "([aeiouy])y", "$1Y"))
        stop = x.isNull() | (F.length(x) < 3) | x.isin(*IRREGULAR, *KEPT)
        first = lambda w: _let(region(length(w, f"^(?:{BEGINNINGS})|{REGION}"), w), lambda r1: second(w, r1))
        second = lambda w, r1: _let(length(w.substr(r1 + 1, F.length(w)), REGION), lambda n: F.struct(w.alias("w"), stop.alias("stop"), r1.alias("r1"), F.when(n > 0, n + r1).otherwise(F.length(w)).alias("r2")))
        return _let(marked, first)

    state = _word(_let(word, begun), _plural, ("sses", "ied", "ies", "us", "ss", "s"))
    state = _let(state, lambda s: F.struct(s["w"].alias("w"), (s["stop"] | s["w"].isin(*KEPT_WITHOUT_S)).alias("stop"), s["r1"].alias("r1"), s["r2"].alias("r2")))
    state = _word(state, _past, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    state = _word(state, _final_y)
    state = _replaced(state, STEP_2, "r1", ogi=lambda s: s["w"].rlike("logi$"), li=lambda s: s["w"].rlike("[cdeghkmnrt]li$"))
    state = _replaced(state, STEP_3, "r1", ative=lambda s: F.length(s["w"]) - 5 >= s["r2"])
    state = _replaced(state, dict.fromkeys(STEP_4, ""), "r2", ion=lambda s: s["w"].rlike("[st]ion$"))
    return F.lower(_word(state, _last)["w"])


def stems(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """A table of distinct words with the stem of each."""
    return words.withColumn(out, stem(F.col(word)))
