"""Cutting oversized texts at natural boundaries, within a limit of tokens.

A text is read as ranges of bytes that end at safe cuts, places which no token crosses, each
with the halo of white space behind it. For a range a worker makes its boundary table: the
characters of every token and what kind of boundary its end is. ``Cutter`` stitches the
tables of a text in order, by running sums of tokens and characters, chooses the pieces and
hands them out by offset; it holds no more of a text than a range and the piece in the making.
So the pieces depend on the text alone, whatever the ranges.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.encoding import text_slices, token_offsets
from placeloom.llm.tokenizing import TOKENIZER_DIR, engine, numbered
from placeloom.session import shuffle_width

#: Bytes of a range, about; a text of more is spread over the workers range by range.
RANGE_BYTES = 65_536
#: Characters whose tables are made at a time by a worker.
SLICE_CHARS = 2_000_000
#: Rows that a table of limits may have; it goes to the driver.
MAX_LIMITS = 1_000
#: Tokens that one character may have, at most; so many are looked at beyond the limit.
CHAR_TOKENS = 64

# Places that no token of any engine crosses: before the white space behind a character that is none, and between an
# ASCII digit and a letter. Characters of the blocks that hold white space or ▁ are passed over.
_SAFE = re.compile(
    rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=[\xe4-\xef][\x80-\xbf]{2})|(?<=[\xf0-\xf4][\x80-\xbf]{3}))(?=[\n ])"
    rb"|(?<=[0-9])(?=[A-Za-z]|\xd0[\x90-\xbf]|\xd1[\x80-\x8f])|(?:(?<=[A-Za-z])|(?<=\xd0[\x90-\xbf])|(?<=\xd1[\x80-\x8f]))(?=[0-9])"
)
_HALO = re.compile(rb"[ \t\r\n]+|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*")

_BLANK, _SPACE, _MARK, _CLAUSE, _CLOSER, _DIGIT = 1, 2, 4, 8, 16, 32
#: Classes of boundaries, the best first: at an empty line, at a line end, after a sentence and before white space, before
#: white space, and where white space is lost, after a sentence and after a clause; then any token, and none.
EMPTY_LINE, LINE, SENTENCE, WORD, GLUED_SENTENCE, GLUED_CLAUSE, TOKEN, NONE = range(1, 9)


def _flags() -> np.ndarray:
    """What a character is, by code point up to U+FFFF; others are nothing of it."""
    f = np.zeros(1 << 16, dtype=np.uint8)
    for bit, chars in ((_BLANK, " \t\r\n"), (_MARK, ".!?…。！？"), (_CLAUSE, ",;:，；：、"), (_CLOSER, "\"»”)]")):
        f[[ord(c) for c in chars]] |= bit
    for i in range(1 << 16):
        if chr(i).isspace():
            f[i] |= _SPACE
        elif chr(i).isdecimal():
            f[i] |= _DIGIT
    return f


_FLAGS = _flags()


def boundary_classes(text: str) -> np.ndarray:
    """The class of each place of a text, from before its first character to behind its last."""
    n = len(text)
    out = np.full(n + 1, TOKEN, dtype=np.uint8)
    if n < 2:
        return out
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    f = _FLAGS[np.minimum(cp, 0xFFFF)]
    here = f[1:]
    # of a run of closing marks counts the character before it
    closer = (f & _CLOSER) > 0
    base = f
    if closer.any():
        at = np.arange(n, dtype=np.int32)
        at[closer] = 0
        base = f[np.maximum.accumulate(at)]
    mark, clause = (base[:-1] & _MARK) > 0, (base[:-1] & _CLAUSE) > 0
    space = (here & _SPACE) > 0
    inner = out[1:n]
    inner[clause & ((here & (_SPACE | _DIGIT | _CLAUSE | _CLOSER)) == 0)] = GLUED_CLAUSE
    inner[mark & ((here & (_SPACE | _DIGIT | _MARK | _CLOSER)) == 0)] = GLUED_SENTENCE
    inner[space & ((f[:-1] & _SPACE) == 0)] = WORD
    inner[space & mark] = SENTENCE
    lines = np.flatnonzero(cp == 10)
    if len(lines):
        blank = (f & _BLANK) > 0
        starts = np.flatnonzero(blank & np.concatenate(([True], ~blank[:-1])))
        run = starts.searchsorted(lines, "right") - 1
        many = np.bincount(run, minlength=len(starts))
        out[lines + 1] = LINE
        out[starts[many == 1]] = LINE
        out[starts[many > 1]] = EMPTY_LINE
        last = lines[np.cumsum(many[many > 0]) - 1]
        out[last[many[run[np.searchsorted(lines, last)]] > 1] + 1] = EMPTY_LINE
    return out


def next_cut(kinds: bytes, odd: bytes, start: int, top: int, limit: int, overlap: int) -> tuple[int, int]:
    """(token after the piece, first token of the next piece) for a piece from ``start`` to at most ``top``.

    ``kinds`` has the class of each token's end, NONE where a piece can't end there; ``odd`` is 1 where a
    token ends within a character. The piece ends at the last boundary of the best class in the second
    half of what the limit allows, else in the first half, else after any token. Where no end leaves the
    overlap between characters, the overlap grows to a whole character, else there is none; a character
    of more tokens than the limit is a piece of its own.
    """
    for low in (start + max(limit // 2, overlap), start + overlap):
        for c in range(EMPTY_LINE, TOKEN):
            if (i := kinds.rfind(c, low, top)) >= 0:
                return i + 1, i + 1 - overlap
    low = start + overlap
    if kept := kinds[low:top].rstrip(bytes([NONE])):
        return low + len(kept), start + len(kept)
    if (i := odd.rfind(0, low, top)) >= 0 and (j := odd.rfind(0, start, i + 1 - overlap)) >= 0:
        return i + 1, j + 1
    i = odd.rfind(0, start, top)
    if i < 0:
        i = odd.find(0, top)
    end = i + 1 if i >= 0 else len(odd)
    return end, end


def read_limits(limits: DataFrame) -> list[tuple[str, int, int]]:
    rows = limits.select("tokenizer", "max_tokens", "overlap_tokens").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    rules = sorted({(r.tokenizer, int(r.max_tokens), int(r.overlap_tokens or 0)) for r in rows if r.tokenizer and r.max_tokens})
    if any(not 0 <= o < m for _, m, o in rules):
        raise ValueError("the overlap must be less than the limit")
    return rules


def _odd_or_overlapping(ends: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a token ends within a character; and where it, or the place ``overlap`` tokens before, does."""
    odd = ends < 0
    if not overlap:
        return odd, odd
    barred = odd.copy()
    barred[overlap:] |= odd[:-overlap]
    return odd, barred


class Cutter:
    """Stitches the tables of one text, range by range, for one limit, and gives its pieces as they are complete."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.ends, self.kinds = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        self.pieces, self.start = 0, 0  # tokens of the text before self.ends[0] are done with
        self.char = 0

    def feed(self, ends: np.ndarray, kinds: np.ndarray, final: int | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(piece number, tokens, first character, character behind the last). ``final``: the characters of the text, with its last table."""
        self.ends, self.kinds = np.concatenate((self.ends, ends)), np.concatenate((self.kinds, kinds))
        n, start = len(self.ends), 0
        slack = CHAR_TOKENS if final is None else 0
        if n > self.limit + slack:
            odd, barred = _odd_or_overlapping(self.ends, self.overlap)
            marks, odds = np.where(barred, NONE, self.kinds).tobytes(), odd.tobytes()
            while n - start > self.limit + slack:
                cut, following = next_cut(marks, odds, start, start + self.limit, self.limit, self.overlap)
                self.pieces += 1
                yield self.pieces, cut - start, self.char, int(self.ends[cut - 1]) if cut < n or final is None else final
                start = following
                self.char = int(self.ends[start - 1])
            self.ends, self.kinds = self.ends[start:], self.kinds[start:]
        if final is not None and self.pieces and len(self.ends):
            self.pieces += 1
            yield self.pieces, len(self.ends), self.char, final


PIECE = "tokenizer string, piece_no int, n_tokens int, char_start bigint, char_end bigint, piece_text string"
_PIECE_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
_PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _tables(texts: list[str], halos: list[str], first: list[bool], engines: dict) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which texts, engine, token offsets, token ends, classes of the ends, starts of the texts) of ranges.

    Ends count from the start of the first text, each having its halo and a sign behind it.
    """
    names = {id(e): n for n, e in engines.items()}
    for which, own, flat, sizes in numbered(texts, list(engines.values()), first):
        classes = boundary_classes("\0".join(texts[i] + halos[i] for i in which))
        behind = np.array([len(halos[i]) + 1 for i in which], dtype=np.int64)
        starts = np.cumsum([0, *(len(texts[i]) for i in which)])[:-1] + np.cumsum(behind) - behind
        shift = np.repeat(np.cumsum(behind) - behind, sizes)
        for e in own:
            table = e.table()
            ends = table.token_ends(flat, shift)
            yield which, names[id(e)], token_offsets(table, flat, sizes), ends, classes[np.abs(ends)], starts


def split_oversized(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, tokenizer, piece_no, n_tokens, char_start, char_end, piece_text): the pieces of texts over the limit, from 1.

    Sizes are tokens of the whole text's encoding: no piece has more than max_tokens of them and
    consecutive pieces share exactly overlap_tokens. Texts within the limit, null and empty texts give
    no row; repeated rows are split again; a null id stays null; other columns are not read. Pieces begin
    and end between characters, at an empty line, a line, a sentence or a word where there is one; see
    ``next_cut`` for texts without such places. Pieces do not depend on ``range_bytes``.

    A text of one range is cut where it is read, without a shuffle. The ranges of a longer one are spread
    over the workers to be tokenised, then stream through one worker a text in order, which keeps the
    piece in the making only. A stretch without a safe cut is one range, however long: no token of such a
    stretch could be told without the rest of it.
    """
    folder = folder or TOKENIZER_DIR
    rules = read_limits(limits)
    names = sorted({n for n, _, _ in rules})
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).filter("t <> ''")
    size = F.octet_length("t")

    def batch_of(ids: pa.Array, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(r, t) for r, t in zip(rows, _PIECE_TYPES))], names=["doc_id", *_PIECE_NAMES])

    def single(batches):
        """The pieces of texts of one range: all tables of a batch are made at once."""
        engines = {n: engine(n, folder) for n in names}
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in text_slices(texts, SLICE_CHARS):
                part = texts[x:y]
                found, rows = [], [[] for _ in _PIECE_TYPES]
                for which, name, offsets, ends, kinds, starts in _tables(part, [""] * len(part), [True] * len(part), engines):
                    for own, limit, overlap in rules:
                        if own != name:
                            continue
                        odd, barred = _odd_or_overlapping(ends, overlap)
                        marks, odds = np.where(barred, NONE, kinds).tobytes(), odd.tobytes()
                        for j in np.flatnonzero(np.diff(offsets) > limit).tolist():
                            a, z, i = int(offsets[j]), int(offsets[j + 1]), which[j]
                            text, base, start, no = part[i], int(starts[j]), a, 0
                            while True:
                                last = z - start <= limit
                                cut, following = (z, z) if last else next_cut(marks, odds, start, start + limit, limit, overlap)
                                cut, following = min(cut, z), min(following, z)
                                no += 1
                                c0 = int(ends[start - 1]) - base if start > a else 0
                                c1 = len(text) if cut == z else int(ends[cut - 1]) - base
                                found.append(x + i)
                                for col, v in zip(rows, (name, no, cut - start, c0, c1, text[c0:c1])):
                                    col.append(v)
                                start = following
                                if start >= z:
                                    break
                yield batch_of(b.column(0).take(pa.array(found, pa.int64())), rows)

    def ranges(batches):
        """Byte ranges of long texts, cut from the buffer without decoding it."""
        for b in batches:
            data = b.column(1).cast(pa.binary())
            for i in range(len(data)):
                whole = data[i].as_buffer()
                key, at, k, end = xxhash.xxh3_128_digest(whole), 0, 0, len(whole)
                view = memoryview(whole)
                while at < end:
                    m = _SAFE.search(view, min(end, at + range_bytes))
                    to = m.start() if m else end
                    h = _HALO.match(view, to)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), pa.array([key], pa.binary()), pa.array([k], pa.int32()), pa.array([to == end]), pa.array([to - at], pa.int64()), pa.array([bytes(view[at : h.end() if h else to])], pa.binary())],
                        names=["doc_id", "key", "k", "last", "n", "slice"],
                    )
                    at, k = to, k + 1

    def tabulate(batches):
        """The boundary tables of ranges, a byte a token and engine where characters a token are few, and a byte for its class."""
        engines = {n: engine(n, folder) for n in names}
        for b in batches:
            raw = zip(b.column("slice").to_pylist(), b.column("n").to_pylist())
            both = [(s[:n].decode(), s[n:].decode()) for s, n in raw]
            texts, halos = [t for t, _ in both], [h for _, h in both]
            steps, kinds = ([[b""] * len(names) for _ in texts] for _ in range(2))
            for x, y in text_slices(texts, SLICE_CHARS):
                for which, name, offsets, ends, classes, starts in _tables(texts[x:y], halos[x:y], [k == 0 for k in b.column("k").to_pylist()[x:y]], engines):
                    e = names.index(name)
                    for j, i in enumerate(which):
                        own = ends[offsets[j] : offsets[j + 1]]
                        own = np.where(own >= 0, own - starts[j], own + starts[j])
                        steps[x + i][e] = pack_ends(own)
                        kinds[x + i][e] = classes[offsets[j] : offsets[j + 1]].tobytes()
            binaries = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "k", "last")), pa.array(texts, pa.string()), pa.array(steps, binaries), pa.array(kinds, binaries)], names=["doc_id", "key", "k", "last", "body", "ends", "kinds"])

    def stitch(batches):
        """Pieces from the tables of each text in order. Rows of the same id and text lie together: each range counts as often as the first."""
        text: _Stream | None = None
        kind_of = None

        def sent(pieces: list[tuple]) -> pa.RecordBatch:
            return batch_of(pa.array([p[0] for p in pieces], kind_of), [list(c) for c in zip(*(p[1:] for p in pieces))] or [[] for _ in _PIECE_TYPES])

        for b in batches:
            kind_of, pieces = b.schema.field(0).type, []
            cols = {c: b.column(c).to_pylist() for c in ("doc_id", "key", "k", "last", "body", "ends", "kinds")}
            for i, own in enumerate(zip(cols["doc_id"], cols["key"])):
                if text is None or text.own != own:
                    pieces += text.pop() if text else []
                    text = _Stream(own, rules, names)
                if cols["k"][i] == 0:
                    text.times += 1
                if cols["k"][i] == text.next:
                    pieces += text.pop()
                    text.push(cols["body"][i], cols["ends"][i], cols["kinds"][i], cols["last"][i])
            yield sent(pieces)
        if text:
            yield sent(text.pop())

    width = shuffle_width(docs.sparkSession)
    near = slim.filter(size <= range_bytes).mapInArrow(single, f"doc_id {kind}, {PIECE}")
    cut = slim.filter(size > range_bytes).mapInArrow(ranges, f"doc_id {kind}, key binary, k int, last boolean, n bigint, slice binary")
    tables = cut.repartition(width, "key", "k").mapInArrow(tabulate, f"doc_id {kind}, key binary, k int, last boolean, body string, ends array<binary>, kinds array<binary>")
    far = tables.repartition(width, "doc_id", "key").sortWithinPartitions("doc_id", "key", "k").mapInArrow(stitch, f"doc_id {kind}, {PIECE}")
    return near.unionByName(far)


def pack_ends(ends: np.ndarray) -> bytes:
    """Token ends as differences, a byte each where they fit (first byte 1), else four; negative within a character."""
    done = np.where(ends >= 0, ends, -1 - ends)
    step = np.diff(done, prepend=0)
    signed = np.where(ends >= 0, step, -1 - step)
    small = len(signed) == 0 or (signed.max() < 128 and signed.min() >= -128)
    return (b"\1" + signed.astype(np.int8).tobytes()) if small else (b"\4" + signed.astype("<i4").tobytes())


def unpack_ends(data: bytes, chars: int) -> np.ndarray:
    """The ends that ``pack_ends`` packed, counted on from ``chars``."""
    signed = np.frombuffer(data, dtype=np.int8 if data[0] == 1 else np.dtype("<i4"), offset=1).astype(np.int64)
    done = np.cumsum(np.where(signed >= 0, signed, -1 - signed)) + chars
    return np.where(signed >= 0, done, -1 - done)


class _Stream:
    """The ranges of one text as they come: its cutters, and its characters from the start of the oldest piece in the making."""

    def __init__(self, own: tuple, rules: list[tuple[str, int, int]], names: list[str]):
        self.own, self.rules, self.names = own, rules, names
        self.cutters = [Cutter(limit, overlap) for _, limit, overlap in rules]
        self.times, self.next, self.chars, self.base, self.held = 0, 0, 0, 0, ""
        self.ready: list[tuple] = []

    def push(self, body: str, ends: list[bytes], kinds: list[bytes], last: bool) -> None:
        self.held += body
        for cutter, (name, _, _) in zip(self.cutters, self.rules):
            e = self.names.index(name)
            table = unpack_ends(ends[e], self.chars), np.frombuffer(kinds[e], dtype=np.uint8)
            for no, n, c0, c1 in cutter.feed(*table, final=self.chars + len(body) if last else None):
                self.ready.append((self.own[0], name, no, n, c0, c1, self.held[c0 - self.base : c1 - self.base]))
        self.chars += len(body)
        self.next += 1
        keep = min((c.char for c in self.cutters), default=self.chars)
        self.held, self.base = self.held[keep - self.base :], keep

    def pop(self) -> list[tuple]:
        """The pieces of the ranges before the last one, and of it once no more of its copies can come."""
        out, self.ready = [p for p in self.ready for _ in range(self.times)], []
        return out


assert sys.byteorder == "little"
