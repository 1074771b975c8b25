"""English suffix stripping for one word, after the published second Porter algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

VOWEL = "aeiouy"
# Doubled consonants that lose one letter.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Whole words with their own stem, and words left alone.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
}
KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffix replacements inside the first region.
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _regions(word: str) -> tuple[int, int]:
    special = re.match(r"(gener|commun|arsen)", word)
    step = re.compile(rf"[{VOWEL}][^{VOWEL}]")
    if special:
        r1 = special.end()
    else:
        m = step.search(word)
        r1 = m.end() if m else len(word)
    m = step.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(rf"[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]$", word) or re.fullmatch(rf"[{VOWEL}][^{VOWEL}]", word))


def _longest(word: str, table) -> str | None:
    return next((s for s in sorted(table, key=len, reverse=True) if word.endswith(s)), None)


@lru_cache(maxsize=65536)
def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in WHOLE:
        return WHOLE[word]
    if word in KEPT:
        return word
    word = re.sub(rf"(^|(?<=[{VOWEL}]))y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # plural endings
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(rf"[{VOWEL}].", word[:-1]):
        word = word[:-1]
    if word in KEPT_AFTER_1A:
        return word
    # past and progressive endings
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(f"[{VOWEL}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWEL:
        word = word[:-1] + "i"
    end = _longest(word, STEP2)
    if end and len(word) - len(end) >= r1:
        base = word[: -len(end)]
        if end == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif end == "li":
            word = base if base and base[-1] in "cdeghkmnrt" else word
        else:
            word = base + STEP2[end]
    end = _longest(word, STEP3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - 5 >= r2):
        word = word[: -len(end)] + STEP3[end]
    end = _longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
