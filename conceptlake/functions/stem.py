"""English stems by the published Porter2 algorithm, and the words that are no lexemes."""

from __future__ import annotations

import re

#: Stop words of the English configuration.
STOP = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off
over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than
too very s t can will just don should now""".split())
#: Fixed values of the algorithm: words with stems of their own, before and after the first step.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
KEPT = frozenset({"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"})
#: Suffixes of steps 2, 3 and 4, the longest first.
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
REGION = re.compile(r"[aeiouy][^aeiouy]")
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _behind(word: str, start: int) -> int:
    m = REGION.search(word, start)
    return m.end() if m else len(word)


def _without_ending(word: str) -> str:
    """Step 1b: ed, ing and what follows them."""
    for end in ("eedly", "eed"):
        if word.endswith(end):
            return word[: -len(end)] + "ee" if len(word) - len(end) >= _first(word) else word
    for end in ("ingly", "edly", "ing", "ed"):
        if word.endswith(end):
            rest = word[: -len(end)]
            if not re.search("[aeiouy]", rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if DOUBLE.search(rest):
                return rest[:-1]
            return rest + "e" if SHORT.search(rest) and _first(rest) >= len(rest) else rest
    return word


def _first(word: str) -> int:
    """Where the region behind the first vowel and consonant begins."""
    m = re.match("gener|commun|arsen", word)
    return m.end() if m else _behind(word, 0)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of under three letters, or with others than a to z and ', stay."""
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in KEPT:
        return word
    word = _without_ending(word)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    one = _first(word)
    two = _behind(word, one)
    for end, new in STEP_2:
        if word.endswith(end):
            rest = word[: -len(end)]
            if len(rest) >= one and (end != "ogi" or rest.endswith("l")) and (end != "li" or rest[-1:] in tuple("cdeghkmnrt")):
                word = rest + new
            break
    for end, new in STEP_3:
        if word.endswith(end):
            if len(word) - len(end) >= (two if end == "ative" else one):
                word = word[: -len(end)] + new
            break
    for end in STEP_4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if len(rest) >= two and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        if len(word) - 1 >= two or (len(word) - 1 >= one and not SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.replace("Y", "y")


def lexeme(word: str, config: str) -> str | None:
    """What a word is searched by under a text configuration; None for a stop word."""
    if config == "simple":
        return word
    return None if word in STOP else stem(word)
