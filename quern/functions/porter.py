"""The suffix stripper of M. F. Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import re



def _form(stem: str) -> str:
    """The stem as a string of c and v; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or ch == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant changes."""
    return len(re.findall("v+c", _form(stem)))


def _short_end(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


#: Fixed values: (suffix, replacement) of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, rules) -> str:
    for suffix, by in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + by if measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    # 1a: plurals
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + by
            break
    # 1b: past and progressive
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _form(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    # 1c
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    # 4: the longest suffix decides
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    # 5
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not _short_end(base):
            word = base
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
