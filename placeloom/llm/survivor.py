"""The best representative of each group of duplicate records.

``trusted_survivors`` follows a stated order of trust and is what p6_found needs: its
winner is fixed by rule, which posterior probabilities cannot reproduce. ``fuse_claims``
is the Bayesian fusion with copy detection for data where no such order is given.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import cut_lineage, shuffle_width

FIELDS = ("address", "phone", "website", "opening_hours", "email")
#: Trust of a detail level, the highest first; any other level comes last.
LEVELS = ("CARD", "LIST_ONLY", "LIST")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def _filled(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def trusted_survivors(df: DataFrame, fields: Sequence[str] = FIELDS, key: str = "place_id", row_id: str = "raw_id", level: str = "detail_level", sources: str = "source_records", at: str = "captured_at", min_rows: int = 2) -> DataFrame:
    """(place_id, field_name, raw_id): for each group and field, the row whose value survives.

    Among the rows where the field has a letter or digit: highest level, then most entries of
    the JSON array ``sources`` (unreadable ones are none), then latest ``at`` (null is earliest),
    then smallest row id. Rows with a null or blank key are in no group; groups of fewer than
    ``min_rows`` rows and fields blank throughout give no row; a repeated row counts twice but
    does not change the winner. Other columns are not read.

    One shuffle on the key of a partly aggregated row per key and partition: a key that holds a
    third of all rows reaches its reducer as one row per map task.
    """
    name = F.upper(_strip(F.col(level).cast("string")))
    rank = F.lit(0)
    for i, one in enumerate(reversed(LEVELS), 1):
        rank = F.when(name == one, F.lit(i)).otherwise(rank)
    base = df.select(
        _strip(F.col(key).cast("string")).alias("place_id"),
        F.struct(
            rank.alias("rank"),
            F.coalesce(F.json_array_length(F.col(sources)), F.lit(0)).alias("entries"),
            F.col(at).alias("at"),
            (-F.col(row_id).cast("long")).alias("neg"),
        ).alias("trust"),
        *[_filled(F.col(f).cast("string")).alias(f"has_{i}") for i, f in enumerate(fields)],
    ).filter("place_id <> ''")
    best = base.groupBy("place_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.col(f"has_{i}"), F.col("trust"))).alias(f"best_{i}") for i in range(len(fields))])
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"best_{i}").alias("best")) for i, f in enumerate(fields)])
    return (
        best.filter(F.col("n") >= min_rows)
        .select("place_id", F.explode(each).alias("e"))
        .filter("e.best is not null")
        .select("place_id", F.col("e.field_name").alias("field_name"), (-F.col("e.best.neg")).alias("raw_id"))
    )


def claims_of(df: DataFrame, fields: Sequence[str] = FIELDS, key: str = "place_id", source: Column | None = None) -> DataFrame:
    """(object, field_name, source, value, copies): what each source says of each object, repeats counted."""
    source = F.coalesce(source if source is not None else F.col("source"), F.lit(""))
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("v")) for f in fields])
    return (
        df.select(_strip(F.col(key).cast("string")).alias("object"), source.cast("string").alias("source"), F.explode(each).alias("e"))
        .filter((F.col("object") != "") & _filled(F.col("e.v")))
        .select("object", "source", F.col("e.field_name").alias("field_name"), F.lower(F.regexp_replace("e.v", r"(?U)[^\p{L}\p{N}+@:/.,-]+", " ")).alias("value"))
        .groupBy("object", "field_name", "source", "value")
        .agg(F.count("*").alias("copies"))
    )


#: Sources whose accuracies, and pairs of them whose dependence, go to every worker; beyond, fusion is refused.
MAX_SOURCES, MAX_PAIRS = 100_000, 2_000_000
#: Pairs of claims that a worker compares at a time; a larger object is taken by itself.
PAIR_CHUNK = 2_000_000


class Beliefs:
    """What is known of the sources between rounds: accuracies, and for pairs (code = one * 2^32 + other) the chance that one depends on the other.

    ``early`` ranks the sources: those that copy least come first.
    """

    def __init__(self, sources: int):
        self.accuracy = np.full(sources, 0.8)
        self.code, self.depends = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.early = np.arange(sources)

    def dependence(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The chance that either of two sources copies the other."""
        if not len(self.code):
            return np.zeros(len(one))
        code = np.minimum(one, other) * (1 << 32) + np.maximum(one, other)
        at = np.minimum(self.code.searchsorted(code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.depends[at], 0.0)


def _within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs of one group; ``group`` is sorted."""
    size = np.bincount(np.unique(group, return_inverse=True)[1]) if len(group) else np.zeros(0, dtype=np.int64)
    end = np.repeat(np.cumsum(size), size)
    after = end - np.arange(len(group)) - 1
    i = np.repeat(np.arange(len(group)), after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def weigh(obj: np.ndarray, source: np.ndarray, value: np.ndarray, beliefs: Beliefs, false_values: float, copy_rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each claim, votes and posterior of each group) of claims sorted by object, a group being a value of an object."""
    order = np.lexsort((beliefs.early[source], value, obj))
    o, s, v = obj[order], source[order], value[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(fresh) - 1
    # of a value's sources the first keeps its vote; a later one keeps what it did not copy from those before
    i, j = _within(group)
    kept = np.bincount(j, weights=np.log1p(-np.minimum(copy_rate * beliefs.dependence(s[i], s[j]), 1 - 1e-6)), minlength=len(o))
    a = beliefs.accuracy[s]
    votes = np.bincount(group, weights=np.log(false_values * a / (1 - a)) * np.exp(kept))
    owner = o[fresh]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
    most = np.maximum(np.maximum.reduceat(votes, first), 0.0) if len(first) else np.zeros(0)
    held = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    e = np.exp(votes - most[held])
    posterior = e / (np.bincount(held, weights=e, minlength=len(first)) + np.exp(-most))[held]  # the last term: no one is right
    back = np.empty(len(o), dtype=np.int64)
    back[order] = group
    return back, votes, posterior


def dependences(pairs: pd.DataFrame, accuracy: np.ndarray, n: float, prior_copy: float, copy_rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one copies other, other copies one, neither): posterior chances of pairs of sources.

    ``pairs`` has one, other, alike, same_true, same_false and differ. Shared false values speak for copying, differing
    ones against it. Of the directions that one is likelier in which the shared values are as right as the original's
    are elsewhere: a copier's shared values have the accuracy of the source it copies.
    """
    a1, a2 = (np.clip(accuracy[pairs[c].to_numpy()], 0.05, 0.99) for c in ("one", "other"))
    both_true, both_false = a1 * a2, (1 - a1) * (1 - a2) / n
    alike, true, false, differ = (pairs[c].to_numpy(float) for c in ("alike", "same_true", "same_false", "differ"))
    apart = np.maximum(1e-12, 1 - both_true - both_false)

    def log_chance(original: np.ndarray | None) -> np.ndarray:
        c = 0.0 if original is None else copy_rate
        src = 0.0 if original is None else original
        t, f = c * src + (1 - c) * both_true, c * (1 - src) + (1 - c) * both_false
        return alike * np.log(t + f) + true * np.log(t) + false * np.log(f) + differ * np.log((1 - c) * apart)

    logs = np.stack([log_chance(a2) + np.log(prior_copy / 2), log_chance(a1) + np.log(prior_copy / 2), log_chance(None) + np.log(1 - prior_copy)])
    e = np.exp(logs - logs.max(axis=0))
    return tuple(e / e.sum(axis=0))


def fuse_claims(claims: DataFrame, rounds: int = 3, false_values: int = 20, prior_copy: float = 0.1, copy_rate: float = 0.8) -> DataFrame:
    """(object, field_name, value, posterior, votes): the value of maximum posterior of each field.

    Each round: (1) a claim votes with ln(n·A/(1-A)), A being its source's accuracy and n the
    number of false values, times the chance that the source did not copy it from one counted
    before; (2) the posterior of a value is its share of exp(votes) in the field; (3) a source's
    accuracy is the mean posterior of its claims; (4) of each pair of sources, the numbers of
    shared true, shared false and differing values give the posterior chance that one copies the
    other, in either direction. Sources that copy least are counted first.

    Ties go to the smallest value. Null or blank values make no claim. Claims are partitioned by
    object once; every round reads them where they lie and sends on sums by source and by pair of
    sources only. A worker holds the distinct claims of one object, 24 bytes each. More than
    ``MAX_SOURCES`` sources or ``MAX_PAIRS`` dependent pairs are an error.
    """
    spark = claims.sparkSession
    n = float(false_values)
    named = claims.select("source").distinct().limit(MAX_SOURCES + 1).collect()
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    number = {s: i for i, s in enumerate(sorted(r.source for r in named))}
    table = spark.createDataFrame(list(number.items()) or [("", 0)], "source string, s int")
    coded = claims.join(F.broadcast(table), "source").select("object", "field_name", F.xxhash64("object", "field_name").alias("o"), "s", F.xxhash64("value").alias("v"), "value")
    laid = cut_lineage(coded.repartition(shuffle_width(spark), "object", "field_name").sortWithinPartitions("o", "object", "field_name", "value", "s"))
    beliefs = Beliefs(max(1, len(number)))

    def objects(batches, columns: int):
        """Claims of whole objects, about PAIR_CHUNK pairs at a time, as columns."""
        held: list[pa.Table] = []

        def sized(t: pa.Table):
            o = t.column("o").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1], [True])))
            pairs = np.cumsum((np.diff(edge) ** 2))
            a = 0
            while a < len(edge) - 1:
                done = pairs[a - 1] if a else 0
                z = max(a + 1, int(pairs.searchsorted(done + PAIR_CHUNK, "right")))
                yield t.slice(edge[a], edge[z] - edge[a])
                a = z

        for b in batches:
            t = pa.Table.from_batches([b])
            if not b.num_rows:
                continue
            o = b.column(b.schema.get_field_index("o")).to_numpy()
            first = np.flatnonzero(o != o[-1])
            cut = int(first[-1]) + 1 if len(first) else 0  # the last object may go on
            if cut or (held and held[-1].column("o")[-1].as_py() != o[0]):
                yield from sized(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield from sized(pa.concat_tables(held))

    def arrays(t: pa.Table):
        return (t.column(c).to_numpy() for c in ("o", "s", "v"))

    def tally(beliefs: Beliefs, start: bool):
        """Sums by source and by pair of sources; at the start only agreement counts, as nothing is believed yet."""

        def run(batches):
            right, many = np.zeros(len(beliefs.accuracy)), np.zeros(len(beliefs.accuracy))
            codes, sums = [], []

            def squeeze() -> None:
                code, at = np.unique(np.concatenate(codes), return_inverse=True)
                total = np.stack([np.bincount(at, weights=x) for x in np.concatenate(sums, axis=1)]).astype(float)
                codes[:], sums[:] = [code], [total]

            for t in objects(batches, 3):
                o, s, v = arrays(t)
                _, o = np.unique(o, return_inverse=True)
                order = np.argsort(o, kind="stable")
                o, s, v = o[order], s[order].astype(np.int64), v[order]
                if start:
                    post = np.zeros(len(o))
                else:
                    group, _, posterior = weigh(o, s, v, beliefs, n, copy_rate)
                    post = posterior[group]
                right += np.bincount(s, weights=post, minlength=len(right))
                many += np.bincount(s, minlength=len(many))
                i, j = _within(o)
                other = s[i] != s[j]
                i, j = i[other], j[other]
                same = v[i] == v[j]
                p = post[i]
                codes.append(np.minimum(s[i], s[j]) * (1 << 32) + np.maximum(s[i], s[j]))
                sums.append(np.stack([same & start, same * p * (not start), same * (1 - p) * (not start), ~same]).astype(float))
                if sum(map(len, codes)) > 4 * PAIR_CHUNK:
                    squeeze()
            own = np.flatnonzero(many)
            rows = [pa.table({"code": own, "a": right[own], "b": many[own], "c": np.zeros(len(own)), "d": np.zeros(len(own)), "pair": np.zeros(len(own), dtype=bool)})]
            if codes:
                squeeze()
                rows.append(pa.table({"code": codes[0], **dict(zip("abcd", sums[0])), "pair": np.ones(len(codes[0]), dtype=bool)}))
            yield from pa.concat_tables(rows).to_batches()

        return run

    def learned(beliefs: Beliefs, start: bool) -> Beliefs:
        sums = laid.select("o", "s", "v").mapInArrow(tally(beliefs, start), "code bigint, a double, b double, c double, d double, pair boolean")
        total = cut_lineage(sums.groupBy("pair", "code").agg(*[F.sum(c).alias(c) for c in "abcd"]))
        own = total.filter("not pair").limit(MAX_SOURCES + 1).toPandas()  # a row a source
        # a pair that never agrees cannot depend
        pairs = total.filter("pair and a + b + c > 0").limit(MAX_PAIRS + 1).toPandas()
        if len(pairs) > MAX_PAIRS:
            raise ValueError(f"more than {MAX_PAIRS} pairs of sources that agree")
        out = Beliefs(len(beliefs.accuracy))
        out.accuracy = beliefs.accuracy.copy()
        if not start:
            out.accuracy[own["code"].to_numpy()] = np.clip(own["a"] / own["b"], 0.05, 0.99)
        pairs = pairs.sort_values("code")
        code = pairs["code"].to_numpy()
        counted = pd.DataFrame({"one": code >> 32, "other": code & 0xFFFFFFFF, "alike": pairs["a"], "same_true": pairs["b"], "same_false": pairs["c"], "differ": pairs["d"]})
        forth, back, _ = dependences(counted, beliefs.accuracy, n, prior_copy, copy_rate)
        out.code, out.depends = code, forth + back
        copies = np.bincount(counted["one"], weights=forth, minlength=len(out.accuracy)) + np.bincount(counted["other"], weights=back, minlength=len(out.accuracy))
        out.early = np.empty(len(copies), dtype=np.int64)
        out.early[np.lexsort((np.arange(len(copies)), -out.accuracy, copies))] = np.arange(len(copies))
        return out

    if number:
        beliefs = learned(beliefs, True)
        for _ in range(rounds - 1):
            beliefs = learned(beliefs, False)

    def choose(batches):
        for t in objects(batches, 6):
            o, s, v = arrays(t)
            _, code = np.unique(o, return_inverse=True)
            order = np.argsort(code, kind="stable")
            group, votes, posterior = weigh(code[order], s[order].astype(np.int64), v[order], beliefs, n, copy_rate)
            post = posterior[group]
            # rows of an object lie in the order of values, so the first of the best is the smallest
            rows = np.arange(len(order))
            best = np.lexsort((rows, -np.round(post, 12), code[order]))
            c = code[order][best]
            top = best[np.concatenate(([True], c[1:] != c[:-1]))]
            picked = t.take(pa.array(order[top]))
            out = pa.table({"object": picked["object"], "field_name": picked["field_name"], "value": picked["value"], "posterior": post[top], "votes": votes[group[top]]})
            yield from out.to_batches()

    return laid.mapInArrow(choose, "object string, field_name string, value string, posterior double, votes double")
