"""JSON documents of a batch as one table of nodes, found in their bytes all at once.

No document is parsed by itself. The structural characters of all documents of a batch are
found in its Arrow buffer, strings by the parity of the quotation marks, nesting by running
sums of brackets, and what contains what by sorting on depth and place. Validity comes from
the pairs of neighbouring tokens in each container.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, SCALAR = range(4)
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_SCALAR = rf"^(?:true|false|null|{_NUMBER})$"

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: any other sign
_OPEN, _CLOSE, _COMMA, _COLON, _BLANK, _QUOTE = range(1, 7)
for _signs, _c in ((b"{[", _OPEN), (b"}]", _CLOSE), (b",", _COMMA), (b":", _COLON), (b" \t\r\n", _BLANK), (b'"', _QUOTE)):
    _CLASS[list(_signs)] = _c
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPES = np.zeros(256, dtype=bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True

# tokens as members of a container: opening of it, key, string, scalar, container, comma, colon, closing of it
_O, _K, _S, _V, _C, _M, _L, _E = range(8)


def _grammar() -> np.ndarray:
    """Which token may follow which, in an object (0) and in an array (1)."""
    ok = np.zeros((2, 8, 8), dtype=bool)
    values = (_S, _V, _C)
    for kind, firsts in ((0, (_K,)), (1, values)):
        for a in firsts:
            ok[kind, _O, a] = ok[kind, _M, a] = True
        ok[kind, _O, _E] = True
        for v in values:
            ok[kind, v, _M] = ok[kind, v, _E] = True
    ok[0, _K, _L] = True
    for v in values:
        ok[0, _L, v] = True
    return ok


_FOLLOWS = _grammar()


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes between each start and end."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


class Nodes:
    """The values in the documents, in order of place: ``row``, ``kind``, ``parent`` (-1 for a document's root),
    ``key`` (its place in ``fields``, -1 for others and in arrays), and where a value's bytes ``start`` and ``end``,
    without the quotation marks of a string. ``valid`` says which documents are complete JSON; others have no nodes."""

    def __init__(self, documents: pa.Array, fields: Sequence[str]):
        texts = documents.cast(pa.binary()).fill_null(b"")
        if texts.offset:
            texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1).astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8, count=offsets[-1]) if raw is not None and offsets[-1] else np.zeros(0, dtype=np.uint8)
        self.rows = len(texts)
        self.valid = np.ones(self.rows, dtype=bool)
        self._offsets = offsets
        self._tokens()
        self._nest()
        self._check(fields)

    def _row_of(self, at: np.ndarray) -> np.ndarray:
        return self._offsets.searchsorted(at, "right") - 1

    def _bad(self, at: np.ndarray) -> None:
        self.valid[self._row_of(at)] = False

    def _tokens(self) -> None:
        """Strings, scalars and structural signs: their place, and where strings and scalars end."""
        data, n = self.data, len(self.data)
        kind = _CLASS[data]
        first = np.zeros(n + 1, dtype=bool)
        first[self._offsets] = True
        # runs of backslashes: what follows an odd one is escaped
        slash = np.flatnonzero(data == 92)
        quotes = np.flatnonzero(kind == _QUOTE)
        starts = np.zeros(0, dtype=np.int64)
        if len(slash):
            new = np.concatenate(([True], (np.diff(slash) > 1) | first[slash[1:]]))
            begin = slash[new][np.cumsum(new) - 1]
            escape = slash[(slash - begin) % 2 == 0]  # each begins an escape
            escaped = np.zeros(n + 1, dtype=bool)
            escaped[escape + 1] = True
            quotes = quotes[~escaped[quotes] | first[quotes]]
            starts = escape
        many = np.bincount(self._row_of(quotes), minlength=self.rows)
        self.valid &= many % 2 == 0
        quotes = quotes[self.valid[self._row_of(quotes)]]
        opens, closes = quotes[0::2], quotes[1::2]
        depth = np.zeros(n + 1, dtype=np.int8)
        depth[opens] += 1
        depth[closes] -= 1
        inside = np.cumsum(depth[:n], dtype=np.int8).astype(bool)  # from the opening mark to before the closing one
        self._bad(np.flatnonzero(inside & (data < 32)))
        if len(starts):
            starts = starts[inside[starts]]
            named = np.append(data, 0)[starts + 1]
            self._bad(starts[~_ESCAPES[named]])
            units = starts[named == 117]
            wide = np.append(data, np.zeros(6, dtype=np.uint8))
            self._bad(units[~np.logical_and.reduce([_HEX[wide[units + k]] for k in range(2, 6)])])
        inside[closes] = True
        outside = ~inside
        other = outside & (kind == 0)
        before = np.concatenate(([False], other[:-1])) & ~first[:n]
        after = np.concatenate((other[1:], [False])) & ~first[1 : n + 1]
        begin, end = np.flatnonzero(other & ~before), np.flatnonzero(other & ~after) + 1
        if len(begin):
            right = pc.match_substring_regex(spans(data, begin, end), _SCALAR).to_numpy(zero_copy_only=False)
            self._bad(begin[~right])
        signs = np.flatnonzero(outside & (kind >= _OPEN) & (kind <= _COLON))
        at = np.concatenate((signs, opens, begin))
        code = np.concatenate((np.array([0, _C, _E, _M, _L], dtype=np.int8)[kind[signs]], np.full(len(opens), _S, np.int8), np.full(len(begin), _V, np.int8)))
        ends = np.concatenate((signs, closes, end))
        order = np.argsort(at, kind="stable")
        self.at, self.code, self.end = at[order], code[order], ends[order]
        self._keep(self.valid[self._row_of(self.at)])

    def _keep(self, which: np.ndarray) -> None:
        self.at, self.code, self.end = self.at[which], self.code[which], self.end[which]

    def _nest(self) -> None:
        """The depth of each token; documents whose brackets do not close in order are left out."""
        row = self._row_of(self.at)
        step = (self.code == _C).astype(np.int64) - (self.code == _E)
        total = np.cumsum(step)
        counts = np.bincount(row, minlength=self.rows)
        last = np.cumsum(counts) - 1
        has = counts > 0
        base = np.zeros(self.rows, dtype=np.int64)
        base[has] = total[last[has] - counts[has] + 1] - step[last[has] - counts[has] + 1]
        depth = total - base[row]
        ok = has.copy()
        ok[has] = depth[last[has]] == 0
        ok[row[depth < 0]] = False
        keep = ok[row]
        self.valid &= ok
        self._keep(keep)
        self.token_row, self.depth = row[keep], depth[keep]

    def _check(self, fields: Sequence[str]) -> None:
        """Members of each container in order: their container, what they are, and whether they may follow one another."""
        n = len(self.at)
        token = np.arange(n)
        self._ends = self.end
        opener, closer = self.code == _C, self.code == _E
        # every token is a member at its depth; an opening bracket also begins a container one deeper, a closing one ends it
        level = np.where(opener, self.depth - 1, np.where(closer, self.depth + 1, self.depth))
        entry = np.concatenate((token, token[opener]))
        level = np.concatenate((level, self.depth[opener]))
        code = np.concatenate((self.code, np.full(int(opener.sum()), _O, dtype=np.int8)))
        order = np.lexsort((self.at[entry], level, self.token_row[entry]))
        entry, level, code = entry[order], level[order], code[order]
        box = np.maximum.accumulate(np.where(code == _O, np.arange(len(code)), 0)) if len(code) else np.zeros(0, dtype=np.int64)
        holder = np.where(level > 0, entry[box] if len(code) else 0, -1)  # token of the opening bracket
        prev = np.concatenate(([_O], code[:-1]))[: len(code)]
        in_object = np.zeros(len(code), dtype=bool)
        inner = level > 0
        in_object[inner] = self.data[self.at[holder[inner]]] == 123
        code = np.where((code == _S) & in_object & (prev != _L), _K, code)
        prev = np.concatenate(([_O], code[:-1]))[: len(code)]
        good = _FOLLOWS[np.where(in_object, 0, 1), prev, code] | (code == _O)
        shut = code == _E  # brackets of one kind: { and }, [ and ] differ by two
        good &= ~shut | (self.data[self.at[entry]] == self.data[self.at[np.maximum(holder, 0)]] + 2)
        root = level == 0
        good[root] = np.isin(code[root], (_S, _V, _C))
        self.valid[self.token_row[entry[~good]]] = False
        roots = np.bincount(self.token_row[entry[root]], minlength=self.rows)
        self.valid &= roots == 1

        value = np.isin(code, (_S, _V, _C)) & self.valid[self.token_row[entry]]
        where = np.flatnonzero(value)
        own = entry[where]
        by_place = np.argsort(own, kind="stable")
        where, own = where[by_place], own[by_place]
        node_of = np.full(n + 1, -1, dtype=np.int64)
        node_of[own] = np.arange(len(own))
        self.row = self.token_row[own]
        self.depth = self.depth[own]
        brackets = self.data[self.at[own]]
        self.kind = np.select([code[where] == _S, code[where] == _V, brackets == 123], [STRING, SCALAR, OBJECT], ARRAY)
        self.parent = node_of[holder[where]]
        self.start = self.at[own] + (self.kind == STRING)
        self.end = self._ends[own]
        boxes = np.isin(code, (_E,)) & self.valid[self.token_row[entry]]
        self.end[node_of[holder[boxes]]] = self.at[entry[boxes]] + 1
        # in an object the key stands two members before its value
        keyed = np.flatnonzero(in_object[where])
        key = entry[where[keyed] - 2]
        names = self._text(self.at[key] + 1, self._ends[key])
        code_of = pc.fill_null(pc.index_in(names, value_set=pa.array(list(fields), pa.string())), -1).to_numpy(zero_copy_only=False)
        self.key = np.full(len(own), -1, dtype=np.int64)
        self.key[keyed] = code_of
        self.level = self.depth - (self.kind <= ARRAY)  # containers around it
        del self.at, self.code, self.token_row, self._ends, self.depth

    def _text(self, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
        """Strings between quotation marks, their escapes resolved."""
        raw = spans(self.data, start, end)
        out = raw.cast(pa.string())
        odd = np.flatnonzero(pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False))
        if len(odd):
            plain = json.loads(b'["' + b'","'.join(raw.take(pa.array(odd)).to_pylist()) + b'"]')
            mask = np.zeros(len(raw), dtype=bool)
            mask[odd] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array([_whole_signs(s) for s in plain], pa.string()))
        return out

    def text(self, nodes: np.ndarray) -> pa.StringArray:
        """The text of each node: a string's content, else the bytes as they stand; null for null and for node -1."""
        some = nodes >= 0
        at = np.where(some, nodes, 0)
        if not len(self.kind):
            return pa.nulls(len(nodes), pa.string())
        out = spans(self.data, np.where(some, self.start[at], 0), np.where(some, self.end[at], 0)).cast(pa.string())
        strings = np.flatnonzero(some & (self.kind[at] == STRING))
        mask = np.zeros(len(nodes), dtype=bool)
        mask[strings] = True
        out = pc.replace_with_mask(out, pa.array(mask), self._text(self.start[nodes[strings]], self.end[nodes[strings]]))
        null = ~some | ((self.kind[at] == SCALAR) & (self.data[self.start[at]] == 110))
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)

    def child(self, key: int) -> np.ndarray:
        """For each node the last of its members that has a key, or -1."""
        out = np.full(len(self.kind), -1, dtype=np.int64)
        own = np.flatnonzero(self.key == key)
        out[self.parent[own]] = own
        return out


def _whole_signs(s: str) -> str:
    """A string with half surrogate pairs, which are no text, replaced."""
    return s if s.isascii() or not any("\ud800" <= c <= "\udfff" for c in s) else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
