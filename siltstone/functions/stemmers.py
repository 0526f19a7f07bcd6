"""Stemmers by the published Snowball descriptions, and suffix stripping for Indonesian."""

from __future__ import annotations

from collections.abc import Callable

from .regions import Stem
from .regions import after_vc as _after_vc
from .regions import longest as _longest
from .romance import french, italian, portuguese, spanish

# ---------------------------------------------------------------- English

EV = "aeiouy"
# Fixed values of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "dying": "die", "lying": "lie", "tying": "tie",
}
KEEP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in EV and w[1] not in EV
    return len(w) > 2 and w[-1] not in EV + "wxY" and w[-2] in EV and w[-3] not in EV


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word[1:] if word[0] == "'" else word
    if w[:1] == "y":
        w = "Y" + w[1:]
    w = "".join("Y" if c == "y" and i and w[i - 1] in EV else c for i, c in enumerate(w))
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = start if start is not None else _after_vc(w, EV)
    r2 = _after_vc(w, EV, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in EV for c in w[:-2]):
        w = w[:-1]
    if w in KEEP_AFTER_1A:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in EV for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in EV:
        w = w[:-1] + "i"
    s = _longest(w, [*STEP2, "ogi", "li"])
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(s)] + STEP2[s]
    s = _longest(w, [*STEP3, "ative"])
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(s)] + STEP3[s]
    s = _longest(w, [*STEP4, "ion"])
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# ---------------------------------------------------------------- German


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = "".join(
        c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v else c for i, c in enumerate(w)
    )
    first = _after_vc(w, v)
    r2 = _after_vc(w, v, first)
    r1 = max(first, 3)
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif s in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            t = _longest(w, ("lich", "ig"))
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# ---------------------------------------------------------------- Scandinavian languages


def _north(word: str, vowels: str) -> int:
    return max(_after_vc(word, vowels), 3)


def _ending(word: str, r1: int, suffixes) -> str:
    return _longest(word[r1:], suffixes) if r1 < len(word) else ""


def swedish(word: str) -> str:
    r1 = _north(word, "aeiouyäåö")
    w = word
    s = _ending(w, r1, (
        "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas "
        "es ades andes ens arens hetens erns at andet het ast s"
    ).split())
    if s and (s != "s" or w[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        w = w[: -len(s)]
    if _ending(w, r1, ("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    s = _ending(w, r1, ("lig", "ig", "els", "löst", "fullt"))
    if s:
        w = w[:-1] if s in ("löst", "fullt") else w[: -len(s)]
    return w


def norwegian(word: str) -> str:
    r1 = _north(word, "aeiouyæåø")
    w = word
    s = _ending(w, r1, (
        "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert"
    ).split())
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s == "s":
        if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or w[-2:-1] == "k" and w[-3:-2] and w[-3] not in "aeiouyæåø":
            w = w[:-1]
    elif s:
        w = w[: -len(s)]
    if _ending(w, r1, ("dt", "vt")):
        w = w[:-1]
    s = _ending(w, r1, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))
    return w[: -len(s)] if s else w


def danish(word: str) -> str:
    vowels = "aeiouyæåø"
    r1 = _north(word, vowels)
    w = word
    s = _ending(w, r1, (
        "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens "
        "hedens erens ers ets erets et eret s"
    ).split())
    if s and (s != "s" or w[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        w = w[: -len(s)]
    if _ending(w, r1, ("gd", "dt", "gt", "kt")):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    s = _ending(w, r1, ("ig", "lig", "elig", "els", "løst"))
    if s == "løst":
        w = w[:-1]
    elif s:
        w = w[: -len(s)]
        if _ending(w, r1, ("gd", "dt", "gt", "kt")):
            w = w[:-1]
    if len(w) > r1 and len(w) > 2 and w[-1] == w[-2] and w[-1] not in vowels:
        w = w[:-1]
    return w


# ---------------------------------------------------------------- Dutch

DV = "aeiouyè"


def _undoubled(s: Stem) -> None:
    if s.w.endswith(("kk", "dd", "tt")):
        s.w = s.w[:-1]


def _dutch_en(s: Stem, suffix: str) -> None:
    base = s.w[: len(s.w) - len(suffix)]
    if base and base[-1] not in DV and not base.endswith("gem") and s.drop(suffix, s.r1):
        _undoubled(s)


def _dutch_e(s: Stem) -> bool:
    done = len(s.w) > 1 and s.w[-2] not in DV and s.drop("e", s.r1)
    if done:
        _undoubled(s)
    return done


def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    out = list(w)
    for i, c in enumerate(w):
        before, after = out[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if c == "y" and (not before or before in DV) or c == "i" and before and after and before in DV and after in DV:
            out[i] = c.upper()
    s = Stem("".join(out), DV, 0)
    s.r1 = max(s.r1, 3)
    found = s.within(0, ("heden", "en", "ene", "s", "se"))
    if found == "heden":
        s.drop(found, s.r1, "heid")
    elif found in ("en", "ene"):
        _dutch_en(s, found)
    elif found and s.w[: -len(found)] and s.w[-len(found) - 1] not in DV + "j":
        s.drop(found, s.r1)
    short = _dutch_e(s)
    if not s.w.endswith("cheid") and s.drop("heid", s.r2) and s.w.endswith("en"):
        _dutch_en(s, "en")
    found = s.within(0, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if found in ("end", "ing"):
        if s.drop(found, s.r2):
            if not (s.w.endswith("ig") and not s.w.endswith("eig") and s.drop("ig", s.r2)):
                _undoubled(s)
    elif found == "ig":
        if not s.w.endswith("eig"):
            s.drop(found, s.r2)
    elif found == "lijk":
        if s.drop(found, s.r2):
            _dutch_e(s)
    elif found == "baar" or found and short:
        s.drop(found, s.r2)
    w = s.w
    if len(w) > 3 and w[-1] not in DV + "I" and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-4] not in DV:
        w = w[:-2] + w[-1]
    return w.lower()


# ---------------------------------------------------------------- Russian

RV = "аеиоуыэюя"
# Fixed values of the published algorithm; those first named stand after а or я.
R_GERUND = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
R_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
R_PARTICIPLE = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
R_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
R_NOUN = (
    "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
).split()


def _russian_pair(s: Stem, suffixes: tuple[list[str], list[str]]) -> bool:
    """Drop the longest of two groups; of the first only after а or я."""
    found = s.within(s.rv, suffixes[0] + suffixes[1])
    base = s.w[s.rv : len(s.w) - len(found)]
    return (found in suffixes[1] or base.endswith(("а", "я"))) and s.drop(found)


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    s = Stem(w, RV, next((i + 1 for i, c in enumerate(w) if c in RV), len(w)))
    if not _russian_pair(s, R_GERUND):
        s.drop(s.within(s.rv, ("ся", "сь")))
        if s.drop(s.within(s.rv, R_ADJECTIVE)):
            _russian_pair(s, R_PARTICIPLE)
        elif not _russian_pair(s, R_VERB):
            s.drop(s.within(s.rv, R_NOUN))
    s.drop("и", s.rv)
    s.drop(s.within(s.rv, ("ост", "ость")), s.r2)
    found = s.within(s.rv, ("ейш", "ейше", "нн", "ь"))
    if found == "нн":
        s.w = s.w[:-1]
    elif s.drop(found) and found != "ь" and s.w[s.rv :].endswith("нн"):
        s.w = s.w[:-1]
    return s.w


# ---------------------------------------------------------------- Indonesian


def indonesian(word: str) -> str:
    """Suffixes only: one particle, one possessive, one of -kan and -an, never leaving a stub."""
    for group, least in ((("lah", "kah", "tah", "pun"), 3), (("nya", "ku", "mu"), 3), (("kan", "an"), 4)):
        for s in group:
            if word.endswith(s) and len(word) - len(s) >= least:
                word = word[: -len(s)]
                break
    return word


STEMMERS: dict[str, Callable[[str], str]] = {
    "english": english,
    "french": french,
    "german": german,
    "spanish": spanish,
    "italian": italian,
    "portuguese": portuguese,
    "dutch": dutch,
    "swedish": swedish,
    "norwegian": norwegian,
    "danish": danish,
    "russian": russian,
    "indonesian": indonesian,
}
LANGUAGES = tuple(STEMMERS)


def stemmer(language: str) -> Callable[[str], str]:
    return STEMMERS[language]
