"""Text functions on columns: cleaning, tokens, stop words, entities; stemming where Spark has no function for it."""

from __future__ import annotations

import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn rt"
).split()
#: Words that the tokeniser splits in two.
CONTRACTIONS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}


def clean(text: Column) -> Column:
    """ASCII letters, digits and single spaces: links go to the end of their line, then tags and mentions, then the rest."""
    text = F.regexp_replace(text, r"(?d)http.+\n|(?d)http.+$|http$", " ")
    text = F.regexp_replace(text, r"[#@][0-9A-Za-z_]+", "")
    return F.trim(F.regexp_replace(text, r"[^0-9A-Za-z]+", " "))


_HALVES = "|".join(f"{a}(?={b}(?![0-9a-z]))" for a, b in map(str.split, CONTRACTIONS.values()))


def tokens(cleaned: Column) -> Column:
    """Words of cleaned text; the usual contractions are split."""
    split = F.regexp_replace(cleaned, f"(?i)(?<![0-9a-z])({_HALVES})", "$1 ")
    return F.array_remove(F.split(split, " "), "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def preprocess(
    text: Column, cleaning: bool = True, lower: bool = True, stop_words: bool = True, unique: bool = False, stem: bool = False,
    lemmatise=None, tagger=None,
) -> Column:
    """Clean, tokenise, gate by part of speech, lower, lemmatise, stem, drop stop words, make unique - each by its switch.

    ``lemmatise`` maps a word to its lemma, ``tagger`` words to tags; they run in Arrow UDFs, since no
    dictionary comes with the library. Unique tokens are sorted.
    """
    words = tokens(clean(text) if cleaning else text)
    if tagger is not None:
        words = part_of_speech_gate(tagger)(words)
    if lower:
        words = F.transform(words, F.lower)
    if lemmatise is not None:
        words = mapped(lemmatise)(words)
    if stem:
        words = mapped(porter)(words)
    if stop_words:
        words = without_stop_words(words)
    return F.array_sort(F.array_distinct(words)) if unique else words


def entities(text: Column, prefix: str) -> Column:
    """Words that start with ``prefix``, without it and without punctuation at their ends."""
    words = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: F.startswith(w, F.lit(prefix)))
    return F.transform(words, lambda w: F.btrim(w, F.lit(string.punctuation)))


def handle_query(handle: Column) -> Column:
    """A search for what a handle says, is told or is mentioned in."""
    return F.concat(F.lit("@"), handle, F.lit(" OR from:"), handle, F.lit(" OR to:"), handle)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _lists(values: pa.Array, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of the given sizes, null where those of ``like`` are."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=like.is_null() if like.null_count else None)


def mapped(f):
    """An Arrow UDF that applies ``f`` to each word of an array; each distinct word of a batch once, no other becomes an object."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        codes = words.flatten().dictionary_encode()
        made = pa.array([f(w) for w in codes.dictionary.to_pylist()], pa.string())
        return _lists(made.take(codes.indices), _sizes(words), words)

    return run


def lemmatised(words: Column, lemmas: dict[str, str]) -> Column:
    """Each word's lemma by a small dictionary, the word itself where it has none."""
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def part_of_speech_gate(tagger):
    """An Arrow UDF: the words if there are over three, a noun and a verb among them, else none; one row's words at a time are objects."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        flat, sizes = words.flatten(), _sizes(words)
        keep, at = np.zeros(len(sizes), bool), 0
        for i, n in enumerate(sizes.tolist()):
            if n > 3:
                tags = tagger(flat.slice(at, n).to_pylist())
                keep[i] = any(t.startswith("N") for t in tags) and any(t.startswith("V") for t in tags)
            at += n
        return _lists(flat.filter(pa.array(np.repeat(keep, sizes))), np.where(keep, sizes, 0), words)

    return run


def _measure(word: str) -> int:
    shape = "".join("v" if _vowel(word, i) else "c" for i in range(len(word)))
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _has_vowel(word: str) -> bool:
    return any(_vowel(word, i) for i in range(len(word)))


def _ends_cvc(w: str) -> bool:
    return len(w) >= 3 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
          ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The Porter (1980) stem of a lower-case word."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _ends_cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
