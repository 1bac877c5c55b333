"""English stems by the published Porter2 algorithm, for one word at a time: callers stem each different word once."""

from __future__ import annotations

import re

#: Fixed values of the published algorithm: letters, exceptional words, and suffixes with what replaces them.
VOWEL, DOUBLES, BEFORE_LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_region = re.compile(f"[{VOWEL}][^{VOWEL}]")
_short = re.compile(f"[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]$|^[{VOWEL}][^{VOWEL}]$")
_vowel = re.compile(f"[{VOWEL}]")


def regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(at: int) -> int:
        found = _region.search(word, at)
        return found.end() if found else len(word)

    first = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(_short.search(word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWEL):
            letters[i] = "Y"  # a consonant
    word = "".join(letters)
    r1, r2 = regions(word)

    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel.search(word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    # participles
    ending = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and _vowel.search(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWEL:
        word = word[:-1] + "i"

    # derived endings
    ending = _longest(word, STEP_2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if ending == "li":
            word = before if before[-1:] and before[-1] in BEFORE_LI else word
        elif ending != "ogi" or before.endswith("l"):
            word = before + STEP_2[ending]
    ending = _longest(word, STEP_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP_3[ending]
    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(ending)]

    # a last e or l
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
