"""Stemmers for English and Russian, applied once per distinct term.

English: the suffix-stripping algorithm of 1980, where a rule whose condition on the stem fails lets later rules of
its step try. Russian: the Snowball algorithm without the endings that count only after а or я for verbs and
participles, as in technical texts they merge unlike nouns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Rewriting rules of steps 2 and 3 and the suffixes of step 4, in order of trial.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Endings of Russian words by class.
GERUND_AFTER_A = ("вшись", "вши", "в")
GERUND = ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
ADJECTIVE = ("ыми", "ими", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE = ("ующ", "ивш", "ывш")
REFLEXIVE = ("ся", "сь")
VERB = ("уйте", "ейте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю")
NOUN = ("иями", "ями", "ами", "иях", "ях", "ах", "ией", "иям", "ием", "ии", "ие", "ье", "ев", "ов", "еи", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")
SUPERLATIVE = ("ейше", "ейш")
DERIVATIONAL = ("ость", "ост")


def _shape(word: str) -> str:
    """A word as v (vowel) and c (consonant); y is a vowel after a consonant."""
    shape = ""
    for ch in word:
        shape += "v" if ch in "aeiou" or (ch == "y" and shape.endswith("c")) else "c"
    return shape


def _vc(stem: str) -> int:
    """The measure of a stem: how often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _rewrite(word: str, rules: list[tuple[str, str]]) -> str:
    return next((word[: -len(old)] + new for old, new in rules if word.endswith(old) and _vc(word[: -len(old)]) > 0), word)


def english(word: str) -> str:
    """Stem of a lower-case English word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    w = re.sub(r"(?<=ss)es$|(?<=i)es$|(?<=[^s])s$", "", word)
    if w.endswith("eed"):
        w = w[:-1] if _vc(w[:-3]) else w
    else:
        m = re.match(r"(.*?)(?:ed|ing)$", w)
        cut = re.sub(r"(?:ed|ing)$", "", w)
        if m and "v" in _shape(cut):
            w = cut
            if re.search("(?:at|bl|iz)$", w):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _vc(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _rewrite(_rewrite(w, STEP2), STEP3)
    if re.search("[st]ion$", w) and _vc(w[:-3]) > 1:
        w = w[:-3]
    else:
        hit = next((s for s in STEP4 if w.endswith(s)), None)
        if hit and _vc(w[: -len(hit)]) > 1:
            w = w[: -len(hit)]
    if w.endswith("e"):
        m = _vc(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _vc(w) > 1 else w


def _ending(endings: tuple[str, ...], before: str = "") -> re.Pattern:
    """A regular expression of the longest of these endings at the end of a word."""
    return re.compile(f"{before}(?:{'|'.join(sorted(endings, key=len, reverse=True))})$")


_gerund, _gerund_a = _ending(GERUND), _ending(GERUND_AFTER_A, "(?<=[ая])")
_reflexive, _adjective, _participle, _verb, _noun = map(_ending, (REFLEXIVE, ADJECTIVE, PARTICIPLE, VERB, NOUN))
_superlative, _derivational = _ending(SUPERLATIVE), _ending(DERIVATIONAL)
_rv = re.compile("[^аеиоуыэюя]*[аеиоуыэюя]")
_r2 = re.compile(".*?[аеиоуыэюя][^аеиоуыэюя].*?[аеиоуыэюя][^аеиоуыэюя]")


def _strip(word: str, region: int, ending: re.Pattern) -> str | None:
    """The word without that ending if all of it lies in the region, else None. The letter before may lie outside."""
    for m in ending.finditer(word, min(region, len(word))):
        return word[: m.start()]
    return None


def russian(word: str) -> str:
    """Stem of a lower-case Russian word with ё already е; a word without a vowel stays."""
    m = _rv.match(word)
    rv = m.end() if m else len(word)
    m = _r2.match(word)
    r2 = m.end() if m else len(word)
    w = _strip(word, rv, _gerund)
    if w is None:
        w = _strip(word, rv, _gerund_a)
    if w is None:
        w = _strip(word, rv, _reflexive) or word
        bare = _strip(w, rv, _adjective)
        if bare is not None:
            w = _strip(bare, rv, _participle) or bare
        else:
            bare = _strip(w, rv, _verb)
            if bare is None:
                bare = _strip(w, rv, _noun)
            w = w if bare is None else bare
    if len(w) > rv and w.endswith("и"):
        w = w[:-1]
    cut = _strip(w, r2, _derivational)
    w = w if cut is None else cut
    if w.endswith("нн"):
        w = w[:-1]
    else:
        cut = _strip(w, rv, _superlative)
        if cut is not None:
            w = cut[:-1] if cut.endswith("нн") else cut
    return w[:-1] if w.endswith("ь") else w


def stem(term: str) -> str:
    """By alphabet: Russian if there is a Cyrillic letter, English if all is ASCII letters, else unchanged."""
    if re.search("[а-яё]", term):
        return russian(term)
    return english(term) if re.fullmatch("[a-z]+", term) else term


@F.pandas_udf(StringType())
def stem_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of a column of terms, Arrow batch by batch; null stays null."""
    for terms in batches:
        known = {t: stem(t) for t in terms.dropna().unique()}
        yield terms.map(known)
