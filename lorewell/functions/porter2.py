"""English (Porter2) stemming, from the published algorithm.

The stem of a whole label is taken as if the label were one word, blanks
included. Only `stem` is used outside; it is called on distinct values.
"""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

# Words with a stem of their own.
SPECIAL = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
    "inning": "inning",
    "innings": "inning",
    "outing": "outing",
    "outings": "outing",
    "canning": "canning",
    "cannings": "canning",
    "herring": "herring",
    "herrings": "herring",
    "earring": "earring",
    "earrings": "earring",
    "proceed": "proceed",
    "proceeds": "proceed",
    "proceeded": "proceed",
    "proceeding": "proceed",
    "exceed": "exceed",
    "exceeds": "exceed",
    "exceeded": "exceed",
    "exceeding": "exceed",
    "succeed": "succeed",
    "succeeds": "succeed",
    "succeeded": "succeed",
    "succeeding": "succeed",
}

# Suffix -> replacement, longest match decides.
STEP2 = {
    "ization": "ize",
    "ational": "ate",
    "fulness": "ful",
    "ousness": "ous",
    "iveness": "ive",
    "tional": "tion",
    "biliti": "ble",
    "lessli": "less",
    "entli": "ent",
    "ation": "ate",
    "alism": "al",
    "aliti": "al",
    "ousli": "ous",
    "iviti": "ive",
    "fulli": "ful",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "izer": "ize",
    "ator": "ate",
    "alli": "al",
    "bli": "ble",
    "ogi": "og",
    "li": "",
}
STEP3 = {
    "ational": "ate",
    "tional": "tion",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ative": "",
    "ical": "ic",
    "ness": "",
    "ful": "",
}
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion", "al", "er", "ic",
)

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_VOWEL = re.compile(f"[{VOWELS}]")
_EARLY_R1 = ("gener", "commun", "arsen")


def _region_after(word: str, start: int) -> int:
    hit = _REGION.search(word, start)
    return hit.end() if hit else len(word)


def _regions(word: str) -> tuple[int, int]:
    early = next((p for p in _EARLY_R1 if word.startswith(p)), None)
    r1 = len(early) if early else _region_after(word, 0)
    return r1, _region_after(word, r1)


def _mark_consonant_y(word: str) -> str:
    out = []
    for i, ch in enumerate(word):
        if ch == "y" and (i == 0 or (out[-1] in VOWELS)):
            ch = "Y"
        out.append(ch)
    return "".join(out)


def _ends_short_syllable(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return (
        len(word) > 2
        and word[-1] not in VOWELS + "wxY"
        and word[-2] in VOWELS
        and word[-3] not in VOWELS
    )


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _plural(word: str) -> str:
    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if suffix == "s" and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if suffix in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    if r1 >= len(base) and _ends_short_syllable(base):
        return base + "e"
    return base


def _derived(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, STEP2)
    if suffix is not None:
        base = word[: -len(suffix)]
        allowed = len(base) >= r1
        if suffix == "ogi":
            allowed = allowed and base.endswith("l")
        if suffix == "li":
            allowed = allowed and base[-1:] in tuple(LI_ENDINGS)
        if allowed:
            word = base + STEP2[suffix]
    suffix = _longest(word, STEP3)
    if suffix is not None:
        base = word[: -len(suffix)]
        if len(base) >= (r2 if suffix == "ative" else r1):
            word = base + STEP3[suffix]
    suffix = _longest(word, STEP4)
    if suffix is not None:
        base = word[: -len(suffix)]
        if len(base) >= r2 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    return word


def _final(word: str, r1: int, r2: int) -> str:
    base = word[:-1]
    if word.endswith("l") and len(base) >= r2 and base.endswith("l"):
        return base
    if word.endswith("e") and (
        len(base) >= r2 or (len(base) >= r1 and not _ends_short_syllable(base))
    ):
        return base
    return word


def stem(label: str) -> str:
    word = label.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = _mark_consonant_y(word)
    r1, r2 = _regions(word)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    word = _plural(word)
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    return _final(word, r1, r2).replace("Y", "y")
