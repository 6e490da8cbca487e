"""English stems by the published Porter2 rules, for the vocabulary of an index (a helper that sees one word at a time)."""

from __future__ import annotations

import re

#: Whole words with stems of their own, and words that stay as they are.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = frozenset("sky news howe atlas cosmos bias andes".split())
SAME_WITHOUT_S = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes and what they become in the second and third step, the longest first; suffixes that the fourth deletes.
SECOND = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
THIRD = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
FOURTH = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
HAS_VOWEL, CONSONANT_Y = re.compile(VOWEL), re.compile(f"(?<={VOWEL})y|^y")
REGION = re.compile(f"{VOWEL}{OTHER}")
SHORT_END = re.compile(f"(?:^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$")
#: The tables by suffix, with the lengths of suffixes, the longest first.
LENGTHS = range(7, 1, -1)
SECOND_OF, THIRD_OF, FOURTH_OF = dict(SECOND), dict(THIRD), frozenset(FOURTH)
SECOND_ENDS, THIRD_ENDS, FOURTH_ENDS = tuple(SECOND_OF), tuple(THIRD_OF), tuple(FOURTH)
LI_AFTER, DOUBLES = frozenset("cdeghkmnrt"), ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def regions(word: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, consonant that follows a vowel begin."""
    head = next((h for h in ("gener", "commun", "arsen") if word.startswith(h)), None)
    first = len(head) if head else (m.end() if (m := REGION.search(word)) else len(word))
    return first, (m.end() if (m := REGION.search(word, first)) else len(word))


def replaced(word: str, table: dict[str, str], r1: int, r2: int) -> str:
    """word with its longest suffix of the table replaced, if that lies in the first region (and meets its own condition); it has one."""
    suffix = next(s for n in LENGTHS if (s := word[-n:]) in table)
    at = len(word) - len(suffix)
    fits = word[at - 1 : at] == "l" if suffix == "ogi" else word[at - 1 : at] in LI_AFTER if suffix == "li" else at >= r2 if suffix == "ative" else True
    return word[:at] + table[suffix] if at >= r1 and fits else word


def english_stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) < 3 or word in SAME:
        return word
    if word in OWN:
        return OWN[word]
    word = word.lstrip("'")
    if "y" in word:
        word = CONSONANT_Y.sub("Y", word)
    r1, r2 = regions(word)
    if "'" in word:
        word = re.sub("'s?'?$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and HAS_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in SAME_WITHOUT_S:
        return word
    if word.endswith(("eedly", "eed")):
        at = len(word) - (5 if word.endswith("y") else 3)
        word = word[:at] + "ee" if at >= r1 else word
    elif word.endswith(("ingly", "edly", "ing", "ed")):
        at = len(word) - (5 if word.endswith("ingly") else 4 if word.endswith("y") else 3 if word.endswith("g") else 2)
        if HAS_VOWEL.search(word[:at]):
            word = word[:at]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and SHORT_END.search(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    if word.endswith(SECOND_ENDS):
        word = replaced(word, SECOND_OF, r1, r2)
    if word.endswith(THIRD_ENDS):
        word = replaced(word, THIRD_OF, r1, r2)
    if word.endswith(FOURTH_ENDS):
        suffix = next(s for n in LENGTHS if (s := word[-n:]) in FOURTH_OF)
        at = len(word) - len(suffix)
        if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
            word = word[:at]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def plural_stem(word: str) -> str:
    """Harman's S stemmer: the first of ies (not after e or a), es (not after a, e or o), s (not after u or s) that ends the word decides."""
    if word.endswith("ies") and word[-4:-3] not in ("e", "a"):
        return word[:-3] + "y"
    if word.endswith("es") and word[-3:-2] not in ("a", "e", "o"):
        return word[:-1]
    if word.endswith("s") and not word.endswith("es") and word[-2:-1] not in ("u", "s"):
        return word[:-1]
    return word
