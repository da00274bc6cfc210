"""A stemmer for Romanian words, after the published suffix-stripping algorithm for the language.

The regions R1, R2 and RV, the plural step, the combining suffixes, the standard suffixes, the verb endings and the final
vowel follow the publication. Tokens have lost their diacritics, so endings that are spelt with one never match; they are
listed as published all the same.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

# Letters and endings of the published algorithm.
VOWELS = "aăâeiîou"
PLURALS = {
    "": "ul ului",
    "a": "aua",
    "e": "ea ele elor",
    "i": "ii iua iei iile iilor ilor ile",
    "at": "atei",
    "aţi": "aţie aţia",
}
COMBINED = {
    "abil": "abilitate abilitati abilităi abilităţi",
    "ibil": "ibilitate",
    "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători",
    "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}
STANDARD = """
at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila
ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă
""".split()
NOUNS = "iune iuni".split()
PERSONS = "ism isme ist ista iste isti istă işti".split()
VERBS = """
are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai
ia iaţi iau ui âi
""".split()
PAST = "şi răm răţi ră sem seşi se serăm serăţi seră".split()
PLAIN_VERBS = "ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră".split()
LAST = "a e i ie ă".split()

_AFTER_CONSONANT = {*VERBS, *(v + e for v, e in product("auiâ", PAST))}


def _longest(word: str, endings: dict[str, str]) -> tuple[str, str] | None:
    """The longest ending of a word, and what it is replaced by."""
    for n in range(min(len(word), 9), 0, -1):
        if word[-n:] in endings:
            return word[-n:], endings[word[-n:]]
    return None


def _table(groups: dict[str, str]) -> dict[str, str]:
    return {e: to for to, spec in groups.items() for e in spec.split()}


_PLURALS, _COMBINED = _table(PLURALS), _table(COMBINED)
_STANDARD = dict.fromkeys(STANDARD, "") | dict.fromkeys(NOUNS, "") | dict.fromkeys(PERSONS, "ist")
_VERBS = dict.fromkeys([*_AFTER_CONSONANT, *PLAIN_VERBS], "")
_LAST = dict.fromkeys(LAST, "")


def _after(word: str, start: int) -> int:
    """Place after the first consonant that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _marked(word: str) -> str:
    """i and u between vowels are consonants: capitals."""
    out = list(word)
    for i in range(1, len(word) - 1):
        if word[i] in "iu" and out[i - 1] in VOWELS and word[i + 1] in VOWELS:
            out[i] = word[i].upper()
    return "".join(out)


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    word = _marked(word)
    r1 = _after(word, 0)
    r2, rv = _after(word, r1), _rv(word)
    inside = lambda ending, region: len(word) - len(ending) >= region

    hit = _longest(word, _PLURALS)
    if hit and inside(hit[0], r1) and not (hit[0] == "ile" and word[:-3].endswith("ab")):
        word = word[: -len(hit[0])] + hit[1]
    removed = False
    while (hit := _longest(word, _COMBINED)) and inside(hit[0], r1):
        word, removed = word[: -len(hit[0])] + hit[1], True
    hit = _longest(word, _STANDARD)
    if hit and inside(hit[0], r2):
        bare = word[: -len(hit[0])]
        if hit[0] not in NOUNS:
            word, removed = bare + hit[1], True
        elif bare.endswith("ţ"):
            word, removed = bare[:-1] + "t", True
    if not removed:
        # The longest ending that lies in RV counts.
        endings = [e for n in range(min(len(word) - rv, 9), 0, -1) if (e := word[-n:]) in _VERBS]
        if endings:
            bare = word[: -len(endings[0])]
            if endings[0] not in _AFTER_CONSONANT or (len(bare) > rv and (bare[-1] not in VOWELS or bare[-1] == "u")):
                word = bare
    hit = _longest(word, _LAST)
    if hit and inside(hit[0], rv):
        word = word[: -len(hit[0])]
    return word.lower()
