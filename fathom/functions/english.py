"""The English stemmer of the Snowball project, after its published description (Porter's second algorithm)."""

from __future__ import annotations

import re

# Fixed values of the algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STARTS = ("gener", "commun", "arsen")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}]")
_SHORT = re.compile(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    """Where the region behind the first vowel with a consonant after it begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, ends) -> str:
    """The longest of the endings that the word has, or the empty one."""
    return max((e for e in ends if word.endswith(e)), key=len, default="")


def english_stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay, and typographic apostrophes count as plain."""
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return word
    if w in SPECIAL:
        return SPECIAL[w]
    w = w.removeprefix("'")
    w = re.sub(f"(^|[{_V}])y", r"\1Y", w)
    first = next((len(s) for s in STARTS if w.startswith(s)), None) or _after(w, 0)
    second = _after(w, first)

    w = w[: len(w) - len(_ending(w, ("'", "'s", "'s'")))]
    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in WHOLE:
        return w

    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    at = len(w) - len(end)
    if end in ("eed", "eedly"):
        w = w[:at] + "ee" if at >= first else w
    elif end and re.search(f"[{_V}]", w[:at]):
        w = w[:at]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= first and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"

    end = _ending(w, STEP2)
    at = len(w) - len(end)
    if end and at >= first and (end != "ogi" or w[:at].endswith("l")) and (end != "li" or w[:at].endswith(tuple("cdeghkmnrt"))):
        w = w[:at] + STEP2[end]
    end = _ending(w, STEP3)
    at = len(w) - len(end)
    if end and at >= (second if end == "ative" else first):
        w = w[:at] + STEP3[end]
    end = _ending(w, STEP4)
    at = len(w) - len(end)
    if end and at >= second and (end != "ion" or w[:at].endswith(("s", "t"))):
        w = w[:at]

    at = len(w) - 1
    if w.endswith("e") and (at >= second or (at >= first and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and at >= second:
        w = w[:-1]
    return w.lower()
