"""Records that differ only in outward form.

Canonical content is one byte string per row. Rows are radix-partitioned on those
bytes: a bucket that holds too many rows is split by its next bytes, again and again,
until every bucket fits or holds one content only. The rows of a bucket are then counted
in a trie of the bytes behind the bucket's own, whose terminals hold the first id of a
content and its number of copies.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.session import cut_lineage, shuffle_width

#: Rows of a bucket that one task sorts and counts.
BUCKET_ROWS = 100_000
#: Bytes of a trie's edge.
EDGE = 8
#: Bytes by which an oversized bucket is split at a time, after what all its rows share.
STRIDE = 3

_NOT_WORD = re.compile(r"[\W_]+")
_NOT_DIGIT = re.compile(r"\D+")
_PARTS = re.compile(r"[,;|]")


def canonical_text(v: str | None) -> str:
    """Letters and digits of a text, case, Unicode form, white space, punctuation and ё aside."""
    if not v:
        return ""
    v = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", v).casefold())
    v = v.replace("ё", "е")
    return _NOT_WORD.sub("", v)


def canonical_parts(v: str | None) -> str:
    """As ``canonical_text`` for the parts of an address, in sorted order."""
    if not v:
        return ""
    return "\x1f".join(sorted(filter(None, map(canonical_text, _PARTS.split(unicodedata.normalize("NFKC", v))))))


def canonical_phone(v: str | None) -> str:
    """The digits of a phone, a leading 8 read as 7."""
    if not v:
        return ""
    d = "".join(str(unicodedata.digit(c)) for c in _NOT_DIGIT.sub("", unicodedata.normalize("NFKC", v)))
    return "7" + d[1:] if d[:1] == "8" else d


def canonical_rows(df: DataFrame, id_col: str, title: str, address: str, phone: str) -> DataFrame:
    """(id, key): the canonical bytes of each row. The address comes first as it tells most rows apart."""

    def run(batches):
        memo: dict[str | None, str] = {}
        for b in batches:
            t, a, p = (b.column(i).to_pylist() for i in (1, 2, 3))
            memo.clear()
            keys = []
            for x, y, z in zip(t, a, p):
                k = memo.get(x)
                if k is None:
                    k = memo[x] = canonical_text(x)
                keys.append(f"{canonical_parts(y)}\x1e{canonical_phone(z)}\x1e{k}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["id", "key"])

    cols = [F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate((title, address, phone)))]
    return df.select(*cols).filter(F.col("id").isNotNull()).mapInArrow(run, "id bigint, key binary")


def common_prefix(a: bytes, b: bytes) -> int:
    """The number of leading bytes that both have."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixPlan:
    """The splits found: ``inner`` has, for the prefix of a bucket that was split, the length of its
    children's prefixes; ``uniform``, for a large content, the smallest id of its rows and how many they are."""

    def __init__(self, stride: int = STRIDE) -> None:
        self.inner: dict[bytes, int] = {b"": stride}
        self.uniform: dict[bytes, tuple[int, int]] = {}

    def bucket(self, key: bytes) -> bytes:
        """The prefix of the leaf that holds ``key``; a key that ends at an inner prefix is a leaf itself."""
        at = b""
        while (upto := self.inner.get(at)) is not None:
            if len(key) == len(at):
                break
            at = key[:upto]
        return at


def radix_plan(keys: DataFrame, capacity: int = BUCKET_ROWS, stride: int = STRIDE) -> RadixPlan:
    """Split oversized buckets by further bytes until each fits.

    One aggregation a level, over the rows of the buckets split last; each batch adds up its own
    rows before the shuffle. Only buckets of more than ``capacity`` rows come to the driver, so
    at most rows / capacity of them a level. The bytes that all rows of a bucket share are
    skipped, so there are about as many levels as digits in rows / capacity.
    """
    plan = RadixPlan(stride)
    level = {b""}
    while level:

        def tally(batches, plan=plan, level=frozenset(level)):
            for b in batches:
                part: dict[bytes, list] = {}
                for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at, above = b"", b""
                    while (upto := plan.inner.get(at)) is not None and len(k) > len(at):
                        above, at = at, k[:upto]
                    if above not in level or k in plan.uniform:
                        continue
                    s = part.get(at)
                    if s is None:
                        part[at] = [1, k, k, i]
                    else:
                        s[0] += 1
                        s[1], s[2], s[3] = min(s[1], k), max(s[2], k), min(s[3], i)
                n, lo, hi, first = zip(*part.values()) if part else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(n, pa.int64()), pa.array(lo, pa.binary()), pa.array(hi, pa.binary()), pa.array(first, pa.int64())], names=["bucket", "n", "lo", "hi", "first"])

        found = (
            keys.mapInArrow(tally, "bucket binary, n bigint, lo binary, hi binary, first bigint")
            .groupBy("bucket")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"))
            .filter(F.col("n") > capacity)
            .collect()
        )
        level = set()
        for r in found:
            lo, hi = bytes(r["lo"]), bytes(r["hi"])
            if lo == hi:
                plan.uniform[lo] = (r["first"], r["n"])
            else:
                plan.inner[bytes(r["bucket"])] = common_prefix(lo, hi) + stride
                level.add(bytes(r["bucket"]))
    return plan


class BucketTrie:
    """A trie of byte strings whose terminals count copies and keep the smallest row id.

    A node is a dict from the next ``EDGE`` bytes to a node; what is left of a key leads to its terminal.
    """

    def __init__(self) -> None:
        self.root: dict = {}
        self.terminals: list[list[int]] = []

    def add(self, key: bytes, at: int, row_id: int) -> list[int]:
        """Count a row whose key is read from byte ``at`` on; returns its terminal, [first id, copies]."""
        node, n = self.root, len(key)
        while n - at > EDGE:
            step = key[at : at + EDGE]
            child = node.get(step)
            if child is None:
                child = node[step] = {}
            node, at = child, at + EDGE
        last = (key[at:],)  # a tuple, so that it is no edge to a node
        end = node.get(last)
        if end is None:
            end = node[last] = [row_id, 0]
            self.terminals.append(end)
        elif row_id < end[0]:
            end[0] = row_id
        end[1] += 1
        return end


def _counted(df: DataFrame, id_col: str, title: str, address: str, phone: str, capacity: int) -> tuple[RadixPlan, DataFrame, DataFrame]:
    """The plan; (first_id, row_id) of the rows of large contents; (id, key, bucket) of the others, bucket by bucket."""
    keys = cut_lineage(canonical_rows(df, id_col, title, address, phone))
    plan = radix_plan(keys, capacity)

    def assign(batches):
        uniform = plan.uniform
        for b in batches:
            ids, ks = b.column(0), b.column(1).to_pylist()
            firsts = [uniform[k][0] if k in uniform else None for k in ks]
            buckets = [plan.bucket(k) if f is None else None for k, f in zip(ks, firsts)]
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(firsts, pa.int64()), pa.array(buckets, pa.binary())], names=["id", "key", "hot", "bucket"])

    tagged = keys.mapInArrow(assign, "id bigint, key binary, hot bigint, bucket binary")
    hot = tagged.filter("hot is not null").select(F.col("hot").alias("first_id"), F.col("id").alias("row_id"))
    cold = tagged.filter("hot is null").select("id", "key", "bucket").repartition(shuffle_width(df.sparkSession), "bucket").sortWithinPartitions("bucket")
    return plan, hot, cold


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[int]], list[int], list[list[int]]]]:
    """(terminals, row ids, terminal of each row) of the buckets one after another; a bucket's rows fit in memory."""
    bucket, trie, ids, ends = None, BucketTrie(), [], []
    for b in batches:
        for i, k, at in zip(*(b.column(c).to_pylist() for c in ("id", "key", "bucket"))):
            if at != bucket:
                if ids:
                    yield trie.terminals, ids, ends
                bucket, trie, ids, ends = at, BucketTrie(), [], []
            ids.append(i)
            ends.append(trie.add(k, len(at), i))
    if ids:
        yield trie.terminals, ids, ends


def format_duplicates(df: DataFrame, id_col: str = "raw_id", title: str = "title", address: str = "address", phone: str = "phone", capacity: int = BUCKET_ROWS) -> DataFrame:
    """(first_id, row_id): each row but the first of its content, with the first (smallest id).

    Two rows have the same content when title, address and phone agree in canonical form.
    Blank equals blank, so rows blank in all three are copies of one another. Rows without
    an id are left out; a repeated row (same id and content) is given as often as the table has
    it. Other columns are not read. A content with more rows than ``capacity`` is found by the
    radix splits with its first id, so its rows need no shuffle and stay spread.
    """
    _, hot, cold = _counted(df, id_col, title, address, phone, capacity)

    def rows(batches):
        for _, ids, ends in _tries(batches):
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.int64()), pa.array(ids, pa.int64())], names=["first_id", "row_id"])

    return hot.unionByName(cold.mapInArrow(rows, "first_id bigint, row_id bigint")).filter("first_id < row_id")


def format_counts(df: DataFrame, id_col: str = "raw_id", title: str = "title", address: str = "address", phone: str = "phone", capacity: int = BUCKET_ROWS) -> DataFrame:
    """(first_id, copies): one row for each distinct content, its first (smallest) id and how many rows have it.

    Contents are those of ``format_duplicates``. The copies add up to the rows that have an id.
    """
    plan, _, cold = _counted(df, id_col, title, address, phone, capacity)
    pair = "first_id bigint, copies bigint"

    def terminals(batches):
        for ends, _, _ in _tries(batches):
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["first_id", "copies"])

    large = df.sparkSession.createDataFrame(list(plan.uniform.values()), pair)  # at most rows / capacity
    return large.unionByName(cold.mapInArrow(terminals, pair))
