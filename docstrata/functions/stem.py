"""Porter's stemmer (Porter 1980), written from the paper's rules as tables of endings."""

from __future__ import annotations

import re

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy][aeiou]*"
_MEASURED = re.compile(f"^(?:{_C})?({_V}{_C})")
_MORE = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_ONCE = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
# Fixed: the paper's endings of steps 2, 3 and 4.
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate",
    alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter_stem(word: str) -> str:
    """The stem of an ASCII lower-case word; words of one or two letters, and other words, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _MEASURED.match(w[:-3]) else w
    else:
        e = _ending(w, ("ed", "ing"))
        if e and _VOWEL.match(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE.search(w):
                w = w[:-1]
            elif _ONCE.match(w) and _CVC.match(w):
                w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        e = _ending(w, table)
        if e and _MEASURED.match(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    e = _ending(w, _STEP4)
    if e and _MORE.match(w[: -len(e)]) and (e != "ion" or w[-4] in "st"):
        w = w[: -len(e)]
    if w.endswith("e") and (_MORE.match(w[:-1]) or (_MEASURED.match(w[:-1]) and not _CVC.match(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _MORE.match(w[:-1]) else w
