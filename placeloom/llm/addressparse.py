"""Components of a postal address, from one spelling.

Everything is brought to Latin letters, so Cyrillic, transliterated and mixed spellings
meet in one alphabet. Tokens are assigned to components all at once: each may be several
things at some cost, a house, a block and a building occur at most once, and of all
assignments the one of least cost is taken. What lies inside a building, remarks and
postcodes are set aside.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Transliteration of the Cyrillic alphabet.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Latin letters that look like Cyrillic ones.
LOOKALIKE = {"a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у"}
# Kinds of street and their abbreviations, transliterated.
KINDS = {
    "ulitsa": "ulitsa ul u",
    "pereulok": "pereulok per per-k",
    "prospekt": "prospekt prosp pr-t pr-kt",
    "proezd": "proezd pr-d pr-zd",
    "shosse": "shosse sh",
    "bulvar": "bulvar bulv bul b-r",
    "naberezhnaya": "naberezhnaya nab nab-ya",
    "ploshchad": "ploshchad pl pl-d",
    "tupik": "tupik tup",
    "alleya": "alleya al",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
GENDER = {"ulitsa": "f", "naberezhnaya": "f", "ploshchad": "f", "alleya": "f", "shosse": "n", "pereulok": "m", "prospekt": "m", "proezd": "m", "bulvar": "m", "tupik": "m"}
# Words before or after the name of a locality.
TOWN = {"g", "gorod"}
VILLAGE = {"p", "pos", "poselok", "s", "selo", "der", "derevnya"}
# Words for a house, a block and a building, and for what lies inside.
HOUSE = {"d", "dom", "no", "n", "vl", "vladenie"}
BLOCK = {"k", "korp", "korpus"}
BUILDING = {"s", "str", "stroenie"}
INNER = {"of", "ofis", "pom", "pomeshchenie", "pomeschenie", "etazh", "et", "podezd", "pod", "kv", "kvartira", "komnata", "kom", "pav", "pavilon", "vkhod", "tts", "tk", "trts", "lit", "litera", "sektsiya", "kod", "domofon"}
ORDINALS = {"perv": 1, "vtor": 2, "tret": 3, "chetvert": 4, "pyat": 5, "shest": 6, "sedm": 7, "vosm": 8, "devyat": 9, "desyat": 10}

# Words that a number before them makes a name with, as in dates and anniversaries: months, years.
NUMBER_NAMES = {"yanvarya", "fevralya", "marta", "aprelya", "maya", "iyunya", "iyulya", "avgusta", "sentyabrya", "oktyabrya", "noyabrya", "dekabrya", "let", "letiya", "letie", "goda", "godovshchiny"}
# Those of them that the name goes on after.
SPANS = {"let", "letiya", "letie", "godovshchiny"}

_ORD_WORD = re.compile(r"(perv|vtor|tret|chetvert|pyat|shest|sedm|vosm|devyat|desyat)(?:aya|yy|oy|oe|iy|ya|e|ye|ee|ogo|ego|oy)$")
_ORD_NUM = re.compile(r"(\d{1,3})-?(?:ya|y|e|oe|aya|iy|yy|go|ogo)$")
# Latin groups that stand for one Cyrillic letter, each as one sign.
SIGNS = {"zh": "Z", "kh": "H", "ts": "T", "ch": "C", "sh": "S", "yu": "U", "ya": "A"}
_GROUP = re.compile("|".join(SIGNS))
_ENDING = re.compile(r"(?:aA|AA|iy|yy|oy|oe|ee)$")


_CYRILLIC, _LATIN_LETTER = re.compile("[а-я]"), re.compile("[a-z]")
_TRANSLITERATED = str.maketrans(LATIN)


def to_latin(text: str) -> str:
    """Lower case, compatibility forms resolved, look-alikes of a Cyrillic text read as Cyrillic, all transliterated."""
    t = unicodedata.normalize("NFKC", text.replace("№", " no ")).lower().replace("ё", "е")
    t = unicodedata.normalize("NFKC", t)
    if _CYRILLIC.search(t) and _LATIN_LETTER.search(t):
        mostly = len(_CYRILLIC.findall(t)) > len(_LATIN_LETTER.findall(t.replace(" no ", " ")))
        words = re.split(r"([^a-zа-я]+)", t)
        for i, w in enumerate(words):
            if w and w != "no" and _LATIN_LETTER.search(w) and (mostly or _CYRILLIC.search(w)) and all(not ("a" <= c <= "z") or c in LOOKALIKE for c in w):
                words[i] = "".join(LOOKALIKE.get(c, c) for c in w)
        t = "".join(words)
    return t.translate(_TRANSLITERATED)


@lru_cache(maxsize=1 << 16)
def signs(word: str) -> str:
    """A Latin word with one sign per Cyrillic letter, so that one slip of the pen is one edit."""
    return _GROUP.sub(lambda m: SIGNS[m[0]], word)


_ORD_FORMS = [(signs(w + e), n) for w, es, n in (("perv", "aya yy oe", 1), ("vtor", "aya oy oe", 2), ("tret", "ya iy e", 3), ("chetvert", "aya yy oe", 4), ("pyat", "aya yy oe", 5), ("shest", "aya oy oe", 6), ("sedm", "aya oy oe", 7), ("vosm", "aya oy oe", 8)) for e in es.split()]


@lru_cache(maxsize=1 << 16)
def ordinal_of(word: str) -> int:
    """The number that a Latin word such as ``vtoraya`` means, one slip allowed; 0 for other words."""
    m = _ORD_WORD.match(word)
    if m:
        return ORDINALS[m[1]]
    own = signs(word)
    return next((n for form, n in _ORD_FORMS if len(form) >= 5 and _near(own, form)), 0) if 4 <= len(own) <= 9 else 0


def gender_of(word: str) -> str:
    """The gender that the ending of a word in signs shows."""
    m = _ENDING.search(word)
    return {"aA": "f", "AA": "f", "oe": "n", "ee": "n"}.get(m[0], "m") if m else ""


def stem_of(word: str) -> str:
    """A street word in signs without its ending of gender."""
    return _ENDING.sub("", word)


@dataclass
class Parsed:
    house: str = ""
    letter: str = ""
    block: str = ""
    building: str = ""
    kind: str = ""
    ordinal: int = 0
    postcode: str = ""
    words: list[str] = field(default_factory=list)
    #: Named localities: mark (t, v), place of their first word in ``words``, number of words.
    localities: list[tuple[str, int, int]] = field(default_factory=list)
    beside: list[bool] = field(default_factory=list)

    @property
    def number(self) -> str:
        return f"{self.house}{self.letter}|{self.block}|{self.building}"


_TOKEN = re.compile(r"\d+-?(?:ya|aya|oe|iy|yy|y|e|ogo|go)(?![a-z])|\d+[a-z]?(?:[/-]\d+(?:[a-z](?![a-z]))?)+|\d+|=?[a-z]+(?:-[a-z]+)*|,")


def _words(text: str) -> list[str]:
    t = re.sub(r"\([^)]*\)?", " ", text)
    t = re.sub(r"[«»“”„\"']", '"', t)
    t = re.sub(r'(?<=\d)[\s-]*"([a-z]{1,4})"', r" =\1 ", t).replace('"', " ")
    t = re.sub(r"(?<=\d)[\s-]*([a-z]{0,4}?)(korp|str|k|s)(?=\d)", r" \1 \2 ", t)
    return _TOKEN.findall(re.sub(r"[;|\n]|(?<![0-9a-z])/|/(?![0-9])", ",", t))


def parse(address: str | None) -> Parsed | None:
    """The components of one address, None for a text without any."""
    if not address:
        return None
    return _assign(_words(to_latin(address)))


def _near(word: str, target: str) -> bool:
    """At most one letter more, less, other or swapped."""
    a, b = word, target
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb or ra == rb[1:] or ra[1:] == rb[1:] or (len(ra) > 1 and len(rb) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:])


_LONG = [(signs(w), k) for w, k in KIND_OF.items() if len(w) >= 5]


@lru_cache(maxsize=1 << 16)
def kind_of(word: str) -> str:
    k = KIND_OF.get(word, "")
    if not k and len(word) >= 4:
        own = signs(word)
        for w, name in _LONG:
            if _near(own, w):
                return name
    return k


_LETTERS = {"zh", "ch", "sh", "shch", "ts", "kh", "yu", "ya"}
#: Costs: a house without its mark; a number that names nothing; a number that belongs to a name that is no date; a block
#: or building told by its place alone; an address without a house; a number before a date's word taken as a house; a word
#: a slip away from a kind of street, and the same beside a kind without a slip; a mark that marks nothing.
BARE_HOUSE, UNUSED, NAME_NUMBER, BY_PLACE, NO_HOUSE, DATE_AS_HOUSE, KIND_SLIP, SECOND_KIND, IDLE_MARK = 1.0, 2.0, 1.5, 0.5, 4.0, 6.0, 0.5, 1.5, 2.0
#: What a later of equal numbers costs more.
LATER = 0.01


def _candidates(s: list[str], j: int, kinds: set[str]) -> list[tuple[str, float]]:
    """What a token may be, as (component, cost); a number's cost as a house and the like is set by ``_assign``."""
    t, nxt = s[j], s[j + 1] if j + 1 < len(s) else ""
    if _ORD_NUM.match(t):
        return [("ordinal", 0.0)]
    if t[0].isdigit():
        return [("postcode", 0.0)] if len(t) == 6 and t.isdigit() else [("number", 0.0)]
    out = []
    if nxt[:1].isdigit() and not _ORD_NUM.match(nxt):
        if t in HOUSE:
            return [("house mark", 0.0)]
        if t in BLOCK:
            out = [("block mark", 0.0)]
        elif t in BUILDING:
            out = [("building mark", 0.0)]
    idle = IDLE_MARK if out else 0.0
    if t in TOWN | VILLAGE:
        out.append(("village" if t in VILLAGE else "town", idle))
    elif len(t) > 3 and ordinal_of(t):
        out.append(("ordinal", idle))
    elif kind_of(t):
        slip = t not in KIND_OF
        out.append(("kind", KIND_SLIP if slip and not kinds else SECOND_KIND if slip else idle))
        if slip and kinds:
            out.append(("name", 1.0))
    else:
        out.append(("name", idle))
    return out


def _is_letter(s: list[str], j: int) -> bool:
    """Whether a token behind a house number is its letter."""
    one, after = s[j], s[j + 1] if j + 1 < len(s) else ""
    if one[0] == "=":  # in quotation marks
        return True
    if not (one.isalpha() and (len(one) == 1 or one in _LETTERS)):
        return False
    return not (one in BLOCK | BUILDING and after.isdigit()) and not (one in KIND_OF and after) and not (one in TOWN | VILLAGE and after.isalpha() and after not in HOUSE | BLOCK | BUILDING)


def _assign(tok: list[str]) -> Parsed:
    # segments between commas, empty ones kept: registers write their parts by place
    segs: list[list[str]] = [[]]
    for t in tok:
        if t == ",":
            segs.append([])
        else:
            segs[-1].append(t)
    positional = any(not s for s in segs[1:-1])
    # states (last component, segment of the house or -1, block and building taken): cost, components so far
    states: dict[tuple, tuple[float, tuple]] = {("", -1, False, False): (0.0, ())}
    flat: list[tuple[int, int]] = []
    for si, s in enumerate(segs):
        # a part that speaks of the inside of the building says nothing else
        end = next((j for j, t in enumerate(s) if t in INNER or t.isdigit() and j + 1 < len(s) and s[j + 1] in ("etazh", "et", "podezd")), len(s))
        segs[si] = s = s[:end]
        kinds = {t for t in s if t in KIND_OF}
        if s:
            states = {("", *k[1:]): v for k, v in sorted(states.items(), key=lambda x: -x[1][0])}  # of equal states the cheapest stays
        for j, t in enumerate(s):
            flat.append((si, j))
            own = _candidates(s, j, kinds)
            nxt = s[j + 1] if j + 1 < len(s) else ""
            date = nxt in NUMBER_NAMES
            late = LATER * len(flat)
            new: dict[tuple, tuple[float, tuple]] = {}
            for (prev, hseg, block, building), (cost, path) in states.items():
                if prev == "house" and _is_letter(s, j):
                    options = [("letter", 0.0)]
                elif own[0][0] != "number":
                    options = own
                else:
                    options = [("unused", UNUSED)]
                    parts = t.count("/") + t.count("-")
                    if prev == "block mark" and not block:
                        options.append(("block", 0.0))
                    elif prev == "building mark" and not building:
                        options.append(("building", 0.0))
                    elif hseg < 0 and parts < 2:
                        options.append(("house", late + (0.0 if prev == "house mark" else DATE_AS_HOUSE if date else BARE_HOUSE)))
                    elif positional and len(s) == 1 and not parts:
                        if si == hseg + 1 and not block:
                            options.append(("block", BY_PLACE))
                        elif si == hseg + 2 and not building:
                            options.append(("building", BY_PLACE))
                    if prev not in ("house mark", "block mark", "building mark") and t.isdigit() and len(t) <= 4 and (date or nxt.isalpha() and len(nxt) > 2 and nxt not in KIND_OF):
                        options.append(("name number", 0.0 if date else NAME_NUMBER))
                for label, c in options:
                    key = (label, si if label == "house" else hseg, block or label == "block", building or label == "building")
                    if key not in new or cost + c < new[key][0]:
                        new[key] = (cost + c, (path, label))
            states = new
    (_, path) = min((c + (NO_HOUSE if k[1] < 0 else 0.0), n, p) for n, (k, (c, p)) in enumerate(states.items()))[::2]
    labels: list[str] = []
    while path:
        path, label = path
        labels.append(label)
    labels.reverse()
    return _components(segs, dict(zip(flat, labels)))


def _components(segs: list[list[str]], labels: dict[tuple[int, int], str]) -> Parsed:
    out = Parsed()
    for si, s in enumerate(segs):
        start, marker, road = len(out.words), "", False
        named = sum(labels[si, j] == "name" and t not in SPANS for j, t in enumerate(s))
        for j, t in enumerate(s):
            label = labels[si, j]
            if label == "postcode":
                out.postcode = t
            elif label == "ordinal":
                m = _ORD_NUM.match(t)
                out.ordinal, road = int(m[1]) if m else ordinal_of(t), True
            elif label == "name number":
                out.ordinal, road = out.ordinal or int(t), True
            elif label == "house":
                out.house = re.sub(r"(?<!\d)0+(?=\d)", "", t)
            elif label == "letter":
                out.letter = t.lstrip("=")
            elif label == "block":
                out.block = t
            elif label == "building":
                out.building = t
            elif label == "kind":
                out.kind, road = out.kind or kind_of(t), True
            elif label in ("town", "village"):
                marker = label[0]
            elif label == "name" and not (named and t in SPANS):
                out.words.append(signs(t.lstrip("=")))
        fresh = len(out.words) - start
        out.beside += [road] * fresh
        if marker and not road and 0 < fresh <= 3 and not any(x[0].isdigit() for x in s):
            out.localities.append((marker, start, fresh))
    return out
