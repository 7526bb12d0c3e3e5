"""English lexemes: stop words and the Porter2 stemmer, applied once for each distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a text search ignores (fixed values).
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())
#: Forms that the rules leave alone or send elsewhere (fixed values).
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split()},
}
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again."""
    m = re.match("gener|commun|arsen", w) or re.search(VOWEL + OTHER, w)
    r1 = m.end() if m else len(w)
    m = re.search(VOWEL + OTHER, w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"{OTHER}{VOWEL}[^aeiouywxY]$|^{VOWEL}{OTHER}$", w))


def stem(w: str) -> str:
    """The Porter2 stem of a lower-cased word."""
    if len(w) < 3:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"'s'?$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL + ".*.s$", w):
        w = w[:-1]
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and re.search(f"{OTHER}[yY]$", w):
        w = w[:-1] + "i"

    def swap(w: str, pairs) -> str:
        for a, b in pairs:
            if w.endswith(a):
                return w[: -len(a)] + b if len(w) - len(a) >= r1 else w
        return w

    before = w
    w = swap(w, STEP2)
    if w == before and len(w) - 3 >= r1 and w.endswith("logi"):
        w = w[:-1]
    elif w == before and len(w) - 2 >= r1 and re.search("[cdeghkmnrt]li$", w):
        w = w[:-2]
    before = w
    w = swap(w, STEP3)
    if w == before and w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    for a in STEP4:
        if w.endswith(a):
            w = w[: -len(a)] if len(w) - len(a) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def query_lexemes(q: str) -> list[str]:
    """Distinct stems of a query's words, stop words aside."""
    return list(dict.fromkeys(stem(w) for w in re.findall("[a-z0-9]+", q.lower()) if w not in STOP_WORDS))


def lexemes(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, lexeme) for the distinct words of a column; stop words drop out. Python sees each word once."""

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem)

    distinct = words.select(F.col(column).alias("word")).distinct().where(~F.col("word").isin(*sorted(STOP_WORDS)))
    return distinct.select("word", stems("word").alias("lexeme"))
