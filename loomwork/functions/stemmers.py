"""Stemmers for English and Russian, after the published definitions of the Snowball algorithms.

Words are expected in lower case. ``snowball`` picks the Russian stemmer for words with Cyrillic letters, else the English one.
"""

from __future__ import annotations

# Fixed values of the English definition: exceptions, suffixes and what replaces them.
ENGLISH_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENGLISH_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# Fixed values of the Russian definition: endings by kind; those of the first list of a pair need an a or ya before them.
RUSSIAN_VOWELS = "аеиоуыэюя"
GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
REFLEXIVE = ("ся", "сь")
ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
SUPERLATIVE, DERIVATIONAL = ("ейш", "ейше"), ("ост", "ость")


def _after_pair(word: str, start: int, vowels: str) -> int:
    """Where the part begins that follows the first non-vowel after a vowel from start on."""
    for i in range(start + 1, len(word)):
        if word[i - 1] in vowels and word[i] not in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in ENGLISH_WHOLE:
        return ENGLISH_WHOLE[word]
    # A y that is a consonant is marked by a capital.
    marked = ["Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word)]
    w = "".join(marked)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after_pair(w, 0, VOWELS) if r1 is None else r1
    r2 = _after_pair(w, r1, VOWELS)
    w = w.removesuffix("'s'") if w.endswith("'s'") else w.removesuffix("'s") if w.endswith("'s") else w.removesuffix("'")
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in ENGLISH_AFTER_1A:
        return w
    # Past forms.
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # Double and single endings of nouns and adjectives.
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in set("cdeghkmnrt")):
            w = stem + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in RUSSIAN_VOWELS), len(word))
    r2 = _after_pair(word, _after_pair(word, 0, RUSSIAN_VOWELS), RUSSIAN_VOWELS)
    head, w = word[:rv], word[rv:]

    def cut(w: str, *groups) -> str | None:
        """w without its longest ending; endings of a pair's first list need an a or ya before them in w."""
        guarded, free = groups if len(groups) == 2 else ((), groups[0])
        found = _longest(w, [s for s in guarded if w.endswith(("а" + s, "я" + s))] + [s for s in free if w.endswith(s)])
        return w[: -len(found)] if found else None

    first = cut(w, *GERUND)
    if first is not None:
        w = first
    else:
        bare = cut(w, REFLEXIVE)
        w = w if bare is None else bare
        adjective = cut(w, ADJECTIVE)
        if adjective is not None:
            participle = cut(adjective, *PARTICIPLE)
            w = adjective if participle is None else participle
        else:
            verb = cut(w, *VERB)
            noun = cut(w, NOUN) if verb is None else None
            w = verb if verb is not None else noun if noun is not None else w
    w = w.removesuffix("и")
    end = _longest(w, DERIVATIONAL)
    if end and len(head) + len(w) - len(end) >= r2:
        w = w[: -len(end)]
    if w.endswith("нн"):
        w = w[:-1]
    elif (end := _longest(w, SUPERLATIVE)) is not None:
        w = w[: -len(end)]
        w = w[:-1] if w.endswith("нн") else w
    else:
        w = w.removesuffix("ь")
    return head + w


def snowball(word: str) -> str:
    return russian(word) if any("а" <= c <= "я" or c == "ё" for c in word) else english(word)
