"""Encoding engines over public vocabulary files.

Every engine cuts a text into *units* that its merges never cross, encodes each
distinct unit once and puts a text together by gathering. Units concatenate to the
text, so the offsets of the tokens come out as well.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from placeloom.llm.mph import PerfectHash

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the published pattern that splits text before the merges of the byte-level rank files.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct units kept by a worker before it starts afresh; only memory depends on it.
CACHE_UNITS = 400_000


#: Put before the first unit of a text: a model may treat the start of a text in its own way.
MARK = "\ud800"
_COARSE = re.compile(r"\s*[^\s0-9]+|\s*[0-9]+|\s+").findall


def coarse_cut(text: str) -> list[str]:
    """Words and runs of digits, each with the white space before it. Most texts need no finer cut."""
    units = _COARSE(text)
    if units:
        units[0] = MARK + units[0]
    return units


class Units:
    """The distinct units met by this process, numbered; shared by all engines."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.age = 0

    def number(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units, one text after another, and how many units each text has."""
        if len(self.text) > CACHE_UNITS:
            self.code, self.text, self.age = {}, [], self.age + 1
        fresh = list(set().union(*cut).difference(self.code))
        self.code.update(zip(fresh, range(len(self.text), len(self.text) + len(fresh))))
        self.text += fresh
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        return np.fromiter(map(self.code.__getitem__, chain.from_iterable(cut)), dtype=np.int32, count=int(sizes.sum())), sizes


UNITS = Units()


class UnitTable:
    """What an engine makes of the numbered units, in flat arrays: the ids, the character after each token
    within its unit (-1 - that where a token ends within a character), and by unit where its tokens start,
    how many they are and how many characters it has."""

    def __init__(self, engine: "Engine"):
        self.engine = engine
        self.age = -1

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
        out[: len(a)] = a
        return out

    def refresh(self) -> "UnitTable":
        """Encode the units that were numbered since the last call."""
        if self.age != UNITS.age:
            self.age, self.done, self.used = UNITS.age, 0, 0
            self.ids, self.ends = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
            self.start, self.count, self.chars = (np.zeros(1 << 14, dtype=np.int32) for _ in range(3))
        fresh = UNITS.text[self.done :]
        if fresh:
            self.start, self.count, self.chars = (self._room(x, self.done + len(fresh)) for x in (self.start, self.count, self.chars))
        for unit, (ids, ends) in zip(fresh, self.engine.encode_units(fresh)):
            n, i = len(ids), self.done
            self.ids, self.ends = (self._room(x, self.used + n) for x in (self.ids, self.ends))
            self.ids[self.used : self.used + n] = ids
            self.ends[self.used : self.used + n] = ends
            self.start[i], self.count[i], self.chars[i] = self.used, n, len(unit) - unit.startswith(MARK)
            self.used += n
            self.done += 1
        return self

    def gather(self, flat: np.ndarray) -> np.ndarray:
        """Positions in the flat arrays of all tokens of the numbered units."""
        n = self.count[flat]
        first = np.repeat(self.start[flat] - (np.cumsum(n, dtype=np.int32) - n), n)
        first += np.arange(len(first), dtype=np.int32)
        return first

    def token_ends(self, flat: np.ndarray, shift: np.ndarray | None = None) -> np.ndarray:
        """The character after each token of the texts one after another, -1 - that within a character.

        ``shift`` is added to the characters of each unit.
        """
        before = np.cumsum(self.chars[flat], dtype=np.int64) - self.chars[flat]
        if shift is not None:
            before += shift
        before = np.repeat(before, self.count[flat])
        rel = self.ends[self.gather(flat)]
        odd = rel < 0
        if odd.any():
            np.negative(before, out=before, where=odd)
        before += rel
        return before


#: What makes a text special to an engine.
ODD_NUMERAL, ODD_SPACE = 1, 2


@lru_cache(maxsize=1)
def _oddities() -> np.ndarray:
    """Of each code point whether it is a numeral but no ASCII digit, and white space but no space or line feed, or ▁."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.zeros(0x110000, dtype=np.uint8)
    for bit, pattern in ((ODD_NUMERAL, r"(?![0-9])\p{N}"), (ODD_SPACE, r"[^\S \n]|▁")):
        out[[ord(c) for c in (regex if bit == ODD_NUMERAL else re).findall(pattern, every)]] |= bit
    return out


def oddities(texts: list[str]) -> list[int]:
    """The oddities in each text, all texts at once."""
    if all(map(str.isascii, texts)):
        return [ODD_SPACE * bool(_ODD_ASCII(t)) for t in texts]
    flags = _oddities()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    at = np.flatnonzero(flags)
    out = np.zeros(len(texts), dtype=np.uint8)
    np.bitwise_or.at(out, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))).searchsorted(at, "right"), flags[at])
    return out.tolist()


_ODD_ASCII = re.compile(r"[^\S \n]").search


class Engine:
    """Encodes units. A text that is ``special`` to an engine, for an oddity in it, is cut by the engine itself."""

    #: Oddities at which the coarse cut would part what the engine keeps together.
    odd = 0

    def special(self, text: str) -> bool:
        return bool(self.odd and text and oddities([text])[0] & self.odd)

    def cut(self, text: str) -> list[str]:
        return coarse_cut(text)

    def encode_units(self, units: list[str]) -> Iterable[tuple[list[int], list[int]]]:
        raise NotImplementedError

    def table(self) -> UnitTable:
        if not hasattr(self, "_table"):
            self._table = UnitTable(self)
        return self._table.refresh()

    def encode(self, text: str) -> list[int]:
        flat, _ = UNITS.number([self.cut(text) if self.special(text) else coarse_cut(text)] if text else [[]])
        t = self.table()
        return t.ids[t.gather(flat)].tolist()


def numbered(texts: list[str], engines: list["Engine"], first: list[bool] | None = None) -> Iterator[tuple[list[int], list["Engine"], np.ndarray, np.ndarray]]:
    """(which texts, for which engines, their unit numbers, units a text): plain texts once for all engines.

    ``first`` says which texts are no later ranges of another: only those begin as a text does.
    """

    def inner(units: list[str], i: int) -> list[str]:
        if first is not None and not first[i] and units and units[0].startswith(MARK):
            units[0] = units[0][1:]
        return units

    bits, mask = oddities(texts), 0
    for e in engines:
        mask |= e.odd
    plain = [i for i, b in enumerate(bits) if not b & mask]
    other = [i for i, b in enumerate(bits) if b & mask]
    if plain:
        yield (plain, engines, *UNITS.number([inner(coarse_cut(texts[i]), i) for i in plain]))
    for e in engines if other else ():
        yield (other, [e], *UNITS.number([inner(e.cut(texts[i]) if bits[i] & e.odd else coarse_cut(texts[i]), i) for i in other]))


class ByteBpe(Engine):
    """Byte-level BPE in two tiers.

    A minimal perfect hash resolves units that are whole entries of the vocabulary.
    The others are merged: bytes in a linked list, adjacent pairs in a heap by rank.
    """

    odd = ODD_NUMERAL  # joins a run of digits

    def __init__(self, path: str, pattern: str = BYTE_PATTERN):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {int(b): base64.b64decode(a) for a, b in pairs}
        self.ranks = {v: k for k, v in self.tokens.items()}
        self.pattern = pattern
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))

    def _compiled(self):
        if not hasattr(self, "_native"):
            import regex

            self._native = regex.compile(self.pattern).findall
            self._known: dict[str, tuple[list[int], list[int]]] = {}
        return self._native

    def cut(self, text: str) -> list[str]:
        return self._compiled()(text)

    def encode_units(self, units: list[str]) -> Iterable[tuple[list[int], list[int]]]:
        split = self._compiled()
        if len(self._known) > CACHE_UNITS:
            self._known.clear()
        known = self._known
        parts = [split(u[1:] if u.startswith(MARK) else u) for u in units]
        new = list(set().union(*parts).difference(known))
        raw = [u.encode("utf-8", "surrogatepass") for u in new]
        for piece, data, one in zip(new, raw, self.whole.lookup(raw).tolist()):
            ids = [one] if one >= 0 else self.merge(data)
            known[piece] = (ids, self._ends(piece, data, ids))
        for ps in parts:
            if len(ps) == 1:
                yield known[ps[0]]
                continue
            ids, ends, at = [], [], 0
            for p in ps:
                i, e = known[p]
                ids += i
                ends += [x + at if x >= 0 else x - at for x in e]
                at += len(p)
            yield ids, ends

    def merge(self, data: bytes) -> list[int]:
        """The ids of ``data``: always the leftmost pair of the lowest rank is merged next."""
        n = len(data)
        ranks, tokens = self.ranks, self.tokens
        part = [ranks[data[i : i + 1]] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                heap.append((r, i, part[i], part[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] == a else n
            if j >= n or part[j] != b:
                continue
            part[i], part[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                q = ranks.get(tokens[r] + tokens[part[k]])
                if q is not None:
                    heapq.heappush(heap, (q, i, r, part[k]))
            h = left[i]
            if h >= 0:
                q = ranks.get(tokens[part[h]] + tokens[r])
                if q is not None:
                    heapq.heappush(heap, (q, h, part[h], r))
        return [x for x in part if x >= 0]

    def _ends(self, unit: str, data: bytes, ids: list[int]) -> list[int]:
        """Characters complete after each token; -1 - that where the token ends within a character."""
        if len(ids) == 1:
            return [len(unit)]
        out, at = [], 0
        for i in ids:
            at += len(self.tokens[i])
            inside = at < len(data) and data[at] & 0xC0 == 0x80
            chars = len(data[:at].decode("utf-8", "ignore"))
            out.append(-1 - chars if inside else chars)
        return out


class WordBpe(Engine):
    """A JSON vocabulary of lower-cased words.

    White space is dropped and each digit stands alone before the merges, so words and
    short runs of digits are the units.
    """

    def __init__(self, path: str):
        self.path = path

    def _tokenizer(self):
        if not hasattr(self, "_native"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._native = Tokenizer.from_file(self.path)
            self._native.encode_special_tokens = True
        return self._native

    def encode_units(self, units: list[str]) -> Iterable[tuple[list[int], list[int]]]:
        units = [u[1:] if u.startswith(MARK) else u for u in units]
        for unit, e in zip(units, self._tokenizer().encode_batch(units, add_special_tokens=False)):
            ends = [b for _, b in e.offsets]
            if ends:
                ends[-1] = len(unit)
            yield e.ids, ends


class PieceBpe(Engine):
    """A sentence-piece model.

    No piece of several characters has a digit, or white space after another character,
    so ` word` and short runs of digits are units; ▁ stands for a space.
    """

    odd = ODD_SPACE  # may join what stands before it; ▁ is a space to the model

    def __init__(self, path: str):
        self.path = path

    def _processor(self):
        if not hasattr(self, "_native"):
            import sentencepiece

            self._native = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self._lead = {x: len(self._native.encode(x)) for x in ("\n", "")}
        return self._native

    _cut = staticmethod(re.compile(r"\n|[ ▁]*[^ ▁\n0-9]+|[ ▁]*[0-9]+|[ ▁]+").findall)

    def cut(self, text: str) -> list[str]:
        units = self._cut(text)
        if units:
            units[0] = MARK + units[0]
        return units

    def encode_units(self, units: list[str]) -> Iterable[tuple[list[int], list[int]]]:
        sp = self._processor()
        skip = self._lead["\n"]
        plain, drop = [], []
        for u in units:
            # the model puts a space before a text: it stands for the first unit's own, or for the unit's first space
            if u.startswith(MARK):
                plain.append(u[1:])
                drop.append(0)
            elif u[0] in " ▁":
                plain.append(u[1:])
                drop.append(0)
            else:
                plain.append("\n" + u)
                drop.append(skip)
        for u, p, d, ids in zip(units, plain, drop, sp.encode(plain, num_threads=1) if plain else []):
            if p == "":  # a lone space
                ids = [sp.piece_to_id("▁")]
            ids = ids[d:]
            yield ids, self._ends(sp, u, ids)

    def _ends(self, sp, unit: str, ids: list[int]) -> list[int]:
        lead = unit.startswith(MARK)
        body = unit[1:] if lead else unit
        if len(ids) == 1:
            return [len(body)]
        data, out, at = (" " * lead + body).encode("utf-8", "surrogatepass"), [], 0
        for i in ids:
            at += 1 if sp.is_byte(i) else len(sp.id_to_piece(i).replace("▁", " ").encode())
            inside = at < len(data) and data[at] & 0xC0 == 0x80
            chars = max(0, len(data[:at].decode("utf-8", "ignore")) - lead)
            out.append(-1 - chars if inside else chars)
        if out:
            out[-1] = len(body)
        return out


_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(name: str, folder: str | None = None) -> Engine:
    """The engine of a public tokenizer by its name; kept for the life of the process."""
    folder = folder or TOKENIZER_DIR
    key = (name, folder)
    if key not in _ENGINES:
        at = lambda ext: os.path.join(folder, name + ext)
        if os.path.exists(at(".tiktoken")):
            _ENGINES[key] = ByteBpe(at(".tiktoken"))
        elif os.path.exists(at(".model")):
            _ENGINES[key] = PieceBpe(at(".model"))
        elif os.path.exists(at(".json")):
            _ENGINES[key] = WordBpe(at(".json"))
        else:
            raise FileNotFoundError(f"no vocabulary {name} in {folder}")
    return _ENGINES[key]
