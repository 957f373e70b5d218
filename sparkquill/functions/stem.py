"""Suffix stripping for English (after the published Porter2 rules) and lighter rules for French, German and Spanish."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_KEEP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    if r1 < len(w):
        return False
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def english(w: str) -> str:
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                body = w[: -len(end)]
                if any(c in _VOWELS for c in body):
                    w = body
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                        w = w[:-1]
                    elif _short(w, min(r1, len(w)) if r1 <= len(w) else r1):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in tuple("st"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], r1 if r1 < len(w) - 1 else len(w) - 1)):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def _strip(w: str, endings: tuple[str, ...], least: int) -> str:
    for end in endings:
        if w.endswith(end) and len(w) - len(end) >= least:
            return w[: -len(end)]
    return w


_FR = ("issements", "issement", "atrices", "atrice", "ateurs", "ateur", "ations", "ation", "ements", "ement", "euses", "euse", "ences", "ence", "ités", "ité", "ives", "ive", "ifs", "if", "eaux", "aient", "erions", "eraient", "erait", "erons", "eront", "antes", "ants", "ante", "ant", "ées", "és", "ée", "er", "ez", "ent", "es", "é", "e", "s")
_DE = ("erinnen", "erin", "heiten", "heit", "keiten", "keit", "ungen", "ung", "ischen", "isch", "lichen", "lich", "igen", "ig", "ern", "em", "en", "er", "es", "e", "s")
_ES = ("amientos", "amiento", "imientos", "imiento", "aciones", "ación", "uciones", "ución", "adoras", "adores", "adora", "ador", "ancias", "ancia", "encias", "encia", "mente", "idades", "idad", "ivas", "iva", "ivos", "ivo", "ando", "iendo", "aban", "aba", "ados", "adas", "ado", "ada", "idos", "idas", "ido", "ida", "ar", "er", "ir", "os", "as", "es", "o", "a", "e")
_ACUTE = str.maketrans("áéíóú", "aeiou")


def french(w: str) -> str:
    return _strip(w, _FR, 3)


def german(w: str) -> str:
    w = w.replace("ß", "ss")
    w = _strip(_strip(w, _DE, 3), _DE, 4)
    return w.translate(str.maketrans("äöü", "aou"))


def spanish(w: str) -> str:
    return _strip(w, _ES, 3).translate(_ACUTE)


STEMMERS = {"english": english, "french": french, "german": german, "spanish": spanish}


@lru_cache(1 << 16)
def stem(config: str, word: str) -> str:
    return STEMMERS[config](word)
