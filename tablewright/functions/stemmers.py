"""Suffix stripping for German, Spanish and French words, after the published algorithms.

Each takes one word in lower case and gives its stem. Regions are offsets: a suffix lies in a region
when it starts at or behind the offset.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from tablewright.functions.stemming import english

ACUTE = str.maketrans("áéíóú", "aeiou")


class _Word:
    """A word while it is stripped, with the regions it had at the start."""

    def __init__(self, text: str, vowels: str):
        self.text, self.vowels = text, vowels
        step = re.compile(f"[{vowels}][^{vowels}]")
        ends = [len(text), len(text)]
        m = step.search(text)
        if m:
            ends[0] = m.end()
            n = step.search(text, m.end())
            ends[1] = n.end() if n else len(text)
        self.r1, self.r2 = ends
        self.rv = len(text)

    def ends(self, suffixes: Iterable[str], within: int = 0) -> str | None:
        """The longest of the suffixes that the word ends with and that lies in the region ``within``."""
        found = [s for s in suffixes if self.text.endswith(s) and len(self.text) - len(s) >= within]
        return max(found, key=len, default=None)

    def within(self, suffix: str, region: int) -> bool:
        return self.text.endswith(suffix) and len(self.text) - len(suffix) >= region

    def before(self, suffix: str) -> str:
        return self.text[: len(self.text) - len(suffix)]

    def put(self, suffix: str, new: str = "") -> None:
        self.text = self.before(suffix) + new

    def drop(self, suffix: str, region: int) -> bool:
        """Take the suffix off if it is there and in the region."""
        found = self.within(suffix, region)
        if found:
            self.put(suffix)
        return found


# -- German ----------------------------------------------------------------------

# Fixed values of the German rules.
GERMAN_VOWELS = "aeiouyäöü"
GERMAN_S = "bdfghklmnrt"
GERMAN_ST = "bdfghklmnt"


@lru_cache(maxsize=65536)
def german(word: str) -> str:
    v = GERMAN_VOWELS
    w = _Word(re.sub(f"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), word.replace("ß", "ss")), v)
    w.r1 = max(w.r1, 3)
    end = w.ends(("em", "ern", "er", "e", "en", "es", "s"))
    if end and w.within(end, w.r1) and (end != "s" or w.before(end)[-1:] in set(GERMAN_S)):
        w.put(end)
        if end in ("e", "en", "es") and w.text.endswith("niss"):
            w.put("s")
    end = w.ends(("en", "er", "est", "st"))
    if end and w.within(end, w.r1) and (end != "st" or (len(w.text) >= 6 and w.before(end)[-1:] in set(GERMAN_ST))):
        w.put(end)
    end = w.ends(("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and w.within(end, w.r2):
        base = w.before(end)
        if end in ("ig", "ik", "isch"):
            if not base.endswith("e"):
                w.put(end)
        else:
            w.put(end)
            if end in ("end", "ung"):
                if w.within("ig", w.r2) and not w.text.endswith("eig"):
                    w.put("ig")
            elif end in ("lich", "heit"):
                w.drop("er", w.r1) or w.drop("en", w.r1)
            else:
                w.drop("lich", w.r2) or w.drop("ig", w.r2)
    return w.text.lower().translate(str.maketrans("äöü", "aou"))


# -- Spanish ---------------------------------------------------------------------

# Fixed values of the Spanish rules.
SPANISH_VOWELS = "aeiouáéíóúü"
SPANISH_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
SPANISH_HOSTS = "iéndo ándo ár ér ír ando iendo ar er ir yendo".split()
SPANISH_PLAIN = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
).split()
SPANISH_AGENTS = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
# suffix -> what stands for it, endings that may go with it
SPANISH_OTHERS = {
    "logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente",
    "amente": "", "mente": "", "idad": "", "idades": "", "iva": "", "ivo": "", "ivas": "", "ivos": "",
}
SPANISH_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
SPANISH_GU = "en es éis emos".split()
SPANISH_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías "
    "irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen "
    "aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis "
    "isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _spanish_rv(text: str) -> int:
    v = SPANISH_VOWELS
    if len(text) < 3:
        return len(text)
    if text[1] not in v:
        m = re.compile(f"[{v}]").search(text, 2)
    elif text[0] in v:
        m = re.compile(f"[^{v}]").search(text, 2)
    else:
        return 3
    return m.end() if m else len(text)


def _spanish_pronoun(w: _Word) -> None:
    pronoun = w.ends(SPANISH_PRONOUNS, w.rv)
    if not pronoun:
        return
    rest = _Word(w.before(pronoun), w.vowels)
    host = rest.ends(SPANISH_HOSTS, w.rv)
    if host and (host != "yendo" or rest.before(host).endswith("u")):
        w.text = rest.before(host) + host.translate(ACUTE)


def _spanish_standard(w: _Word) -> bool:
    end = w.ends([*SPANISH_PLAIN, *SPANISH_AGENTS, *SPANISH_OTHERS])
    if not end or not w.within(end, w.r1 if end == "amente" else w.r2):
        return False
    w.put(end, SPANISH_OTHERS.get(end, ""))
    if end in SPANISH_AGENTS:
        w.drop("ic", w.r2)
    elif end == "amente":
        if w.drop("iv", w.r2):
            w.drop("at", w.r2)
        else:
            w.drop("os", w.r2) or w.drop("ic", w.r2) or w.drop("ad", w.r2)
    elif end == "mente":
        w.drop("ante", w.r2) or w.drop("able", w.r2) or w.drop("ible", w.r2)
    elif end in ("idad", "idades"):
        w.drop("abil", w.r2) or w.drop("ic", w.r2) or w.drop("iv", w.r2)
    elif end in ("iva", "ivo", "ivas", "ivos"):
        w.drop("at", w.r2)
    return True


def _spanish_verb(w: _Word) -> None:
    end = w.ends(SPANISH_Y, w.rv)
    if end and w.before(end).endswith("u"):
        w.put(end)
        return
    end = w.ends([*SPANISH_GU, *SPANISH_VERBS], w.rv)
    if end:
        w.put(end)
        if end in SPANISH_GU and w.text.endswith("gu"):
            w.put("u")


@lru_cache(maxsize=65536)
def spanish(word: str) -> str:
    w = _Word(word, SPANISH_VOWELS)
    w.rv = _spanish_rv(word)
    _spanish_pronoun(w)
    if not _spanish_standard(w):
        _spanish_verb(w)
    end = w.ends(("os", "a", "o", "á", "í", "ó", "e", "é"), w.rv)
    if end:
        w.put(end)
        if end in ("e", "é") and w.text.endswith("gu") and w.within("u", w.rv):
            w.put("u")
    return w.text.translate(ACUTE)


# -- French ----------------------------------------------------------------------

# Fixed values of the French rules; capitals are vowels that count as consonants.
FRENCH_VOWELS = "aeiouyâàëéêèïîôûù"
FRENCH_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FRENCH_ATION = "atrice ateur ation atrices ateurs ations".split()
FRENCH_SWAPS = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FRENCH_REST = (
    "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
).split()
FRENCH_I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it"
).split()
FRENCH_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FRENCH_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_marked(word: str) -> str:
    v, out = FRENCH_VOWELS, list(word)
    for i, c in enumerate(word):
        before = i > 0 and out[i - 1] in v
        after = i + 1 < len(word) and word[i + 1] in v
        if c in "ui" and before and after or c == "y" and (before or after) or c == "u" and i > 0 and word[i - 1] == "q":
            out[i] = c.upper()
    return "".join(out)


def _french_rv(text: str) -> int:
    v = FRENCH_VOWELS
    if text.startswith(("par", "col", "tap")) or (len(text) > 2 and text[0] in v and text[1] in v):
        return 3
    m = re.compile(f"[{v}]").search(text, 1)
    return m.end() if m else len(text)


def _french_standard(w: _Word) -> tuple[bool, bool]:
    """Was an ending replaced; do verb endings follow?"""
    end = w.ends([*FRENCH_PLAIN, *FRENCH_ATION, *FRENCH_SWAPS, *FRENCH_REST])
    if not end:
        return False, True
    base = w.before(end)
    in_r1, in_r2, in_rv = (len(base) >= r for r in (w.r1, w.r2, w.rv))
    adverb = end in ("amment", "emment", "ment", "ments")
    if end in FRENCH_PLAIN and in_r2:
        w.put(end)
    elif end in FRENCH_ATION and in_r2:
        w.put(end)
        if w.text.endswith("ic"):
            w.drop("ic", w.r2) or w.put("ic", "iqU")
    elif end in FRENCH_SWAPS and in_r2:
        w.put(end, FRENCH_SWAPS[end])
    elif end in ("ement", "ements") and in_rv:
        w.put(end)
        if w.drop("iv", w.r2):
            w.drop("at", w.r2)
        elif w.text.endswith("eus"):
            if not w.drop("eus", w.r2) and w.within("eus", w.r1):
                w.put("eus", "eux")
        elif not (w.drop("abl", w.r2) or w.drop("iqU", w.r2)):
            for accented in ("ièr", "Ièr"):
                if w.within(accented, w.rv):
                    w.put(accented, "i")
    elif end in ("ité", "ités") and in_r2:
        w.put(end)
        if w.text.endswith("abil"):
            w.drop("abil", w.r2) or w.put("abil", "abl")
        elif w.text.endswith("ic"):
            w.drop("ic", w.r2) or w.put("ic", "iqU")
        else:
            w.drop("iv", w.r2)
    elif end in ("if", "ive", "ifs", "ives") and in_r2:
        w.put(end)
        if w.drop("at", w.r2) and w.text.endswith("ic"):
            w.drop("ic", w.r2) or w.put("ic", "iqU")
    elif end == "eaux":
        w.put(end, "eau")
    elif end == "aux" and in_r1:
        w.put(end, "al")
    elif end in ("euse", "euses") and (in_r1 or in_r2):
        w.put(end, "" if in_r2 else "eux")
    elif end in ("issement", "issements") and in_r1 and base[-1:] not in set(w.vowels):
        w.put(end)
    elif end in ("amment", "emment") and in_rv:
        w.put(end, "ant" if end == "amment" else "ent")
    elif end in ("ment", "ments") and len(base) > w.rv and base[-1] in w.vowels:
        w.put(end)
    else:
        return False, True
    return True, adverb


def _french_verb(w: _Word) -> bool:
    end = w.ends(FRENCH_I_VERBS, w.rv)
    base = w.before(end) if end else ""
    if end and len(base) > w.rv and base[-1] not in w.vowels:
        w.put(end)
        return True
    end = w.ends(["ions", *FRENCH_E_VERBS, *FRENCH_A_VERBS], w.rv)
    if not end or end == "ions" and not w.within(end, w.r2):
        return False
    w.put(end)
    if end in FRENCH_A_VERBS:
        w.drop("e", w.rv)
    return True


def _french_residue(w: _Word) -> None:
    if w.text.endswith("s") and w.text[-2:-1] not in {"", *"aiouès"}:
        w.put("s")
    end = w.ends(("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), w.rv)
    if end == "ion":
        base = w.before(end)
        if w.within(end, w.r2) and len(base) > w.rv and base[-1] in "st":
            w.put(end)
    elif end == "ë":
        if w.before(end).endswith("gu"):
            w.put(end)
    elif end:
        w.put(end, "" if end == "e" else "i")


@lru_cache(maxsize=65536)
def french(word: str) -> str:
    w = _Word(_french_marked(word), FRENCH_VOWELS)
    w.rv = _french_rv(w.text)
    replaced, verbs = _french_standard(w)
    if _french_verb(w) if verbs else replaced:
        w.text = re.sub("Y$", "i", re.sub("ç$", "c", w.text))
    else:
        _french_residue(w)
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    w.text = re.sub(f"[éè](?=[^{FRENCH_VOWELS}]+$)", "e", w.text)
    return w.text.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "spanish": spanish, "french": french}
