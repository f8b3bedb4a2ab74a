"""Mixing sources to target shares of tokens.

Rates of documents come from entropy balancing: among all rates that meet the token target
of each source, those closest (in relative entropy) to taking every document once. They are
tilted exponentially, rate = exp(tilt * tokens), up to the cap. The dual is convex with one
multiplier a source; Newton's method needs two sums a source and step, which the executors
add up over counts of documents by size. Rates are then rounded to copies, the largest
documents first, with the error carried on to smaller ones.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.llm.encoding import count_tokens
from placeloom.session import cut_lineage, shuffle_width

#: Sources that a table of targets may have; its rows go to the driver.
MAX_SOURCES = 10_000
#: Documents of a source that are rounded one after another, about; a larger source is cut into buckets by hash of the id.
BUCKET_DOCS = 10_000


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weight and cap by source; rows of equal source count once, null or not positive weights as none."""
    rows = targets.select("doc_source", "weight", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_source), r.weight or 0)):
        if r.doc_source is not None and r.weight and r.weight > 0 and r.max_repeats and r.max_repeats > 0:
            out[r.doc_source] = (float(r.weight), int(r.max_repeats))
    return out


def token_goals(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """The tokens each source should give: the largest mix of exact shares, or a mix of ``total`` tokens as near to them as caps allow.

    Sources without tokens cannot give any; the others keep their weights among themselves.
    """
    live = {s: (w, cap * available[s]) for s, (w, cap) in targets.items() if available.get(s, 0) > 0}
    whole = sum(w for w, _ in live.values())
    if not live:
        return {}
    if total is None:
        scale = min(most / (w / whole) for w, most in live.values())
        return {s: min(most, scale * w / whole) for s, (w, most) in live.items()}
    goals: dict[str, float] = {}
    left, open_ = float(total), dict(live)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [s for s, (w, most) in open_.items() if left * w / weight >= most]
        if not full:
            goals |= {s: left * w / weight for s, (w, _) in open_.items()}
            break
        for s in full:
            goals[s] = open_.pop(s)[1]
            left -= goals[s]
        left = max(left, 0.0)
    return goals


def solve_rates(sizes: DataFrame, goals: dict[str, float], stats: dict[str, tuple[int, int]], caps: dict[str, int], steps: int = 60) -> dict[str, float]:
    """The tilt b of each source so that rate = min(cap, exp(b * tokens / mean)) gives its goal of tokens.

    ``sizes`` has doc_source, n_tokens and their count ``n``; ``stats`` the number of documents and of
    tokens by source. The tilt is infinite where all documents must be taken as often as allowed. Newton
    steps on the logarithm of the tokens, halved into the bracket found so far where they leave it; a
    source that has not met its goal after ``steps`` of them is an error.
    """
    spark = sizes.sparkSession
    mean = {s: stats[s][1] / stats[s][0] for s in goals}
    out = {s: float("inf") for s in goals if goals[s] >= caps[s] * stats[s][1] * (1 - 1e-9)}
    at = {s: 0.0 for s in goals if s not in out}
    low, high = dict.fromkeys(at, -float("inf")), dict.fromkeys(at, float("inf"))
    for _ in range(steps):
        if not at:
            return out
        table = spark.createDataFrame([(s, b, mean[s], float(caps[s])) for s, b in sorted(at.items())], "doc_source string, b double, mean double, cap double")
        z = F.col("n_tokens") / F.col("mean")
        e = F.exp(F.least(F.lit(50.0), F.col("b") * z))
        taken = F.sum(F.col("n") * F.least(e, F.col("cap")) * z).alias("taken")
        slope = F.sum(F.col("n") * F.when(e < F.col("cap"), e).otherwise(F.lit(0.0)) * z * z).alias("slope")
        for x in sizes.join(F.broadcast(table), "doc_source").groupBy("doc_source").agg(taken, slope).collect():
            s, b = x.doc_source, at[x.doc_source]
            want = goals[s] / mean[s]
            if abs(x.taken - want) <= 1e-9 * want:
                out[s] = at.pop(s)
                continue
            (low if x.taken < want else high)[s] = b
            step = math.log(x.taken / want) * x.taken / x.slope if x.taken > 0 and x.slope > 0 else math.copysign(1.0, x.taken - want)
            new = b - step
            if not low[s] < new < high[s]:
                new = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else b - math.copysign(min(abs(step), 1 + abs(b)), step)
            at[s] = new
    raise RuntimeError(f"no rates after {steps} steps for {sorted(at)}")


def mix_sources(docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, doc_source, n_tokens, copies): how often each document occurs in the mix, never above its source's cap.

    Every document has a row. Null and empty texts, null sources and sources without a target get 0
    copies. Copies are rounded in hash buckets of about ``BUCKET_DOCS`` documents of a source, a smaller
    source being one bucket; what a bucket misses is at most about one of its smallest documents. So a
    source of any size is spread, and the mix does not depend on the number of partitions.
    """
    sized = cut_lineage(count_tokens(docs, id_col, text_col, tokenizer, folder, keep=(source_col,)).select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("doc_source"), "n_tokens"))
    rules = read_targets(targets)
    used = sized.filter((F.col("n_tokens") > 0) & F.col("doc_source").isin(list(rules)))
    counted = cut_lineage(used.groupBy("doc_source", "n_tokens").agg(F.count("*").alias("n")))
    stats = {r.doc_source: (r.n, r.t) for r in counted.groupBy("doc_source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()}
    goals = token_goals({s: t for s, (_, t) in stats.items()}, rules, total)
    caps = {s: c for s, (_, c) in rules.items()}
    rates = solve_rates(counted, goals, stats, caps)
    mean = {s: stats[s][1] / stats[s][0] for s in goals}

    def run(batches):
        carry: dict[tuple[str, int], float] = {}
        for b in batches:
            copies = []
            for s, n, bucket in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if s not in rates or not n:
                    copies.append(0)
                    continue
                r = min(float(caps[s]), math.exp(min(50.0, rates[s] * n / mean[s])))
                k = int(r + 1e-9)
                left = carry.get((s, bucket), 0.0) + (r - k) * n
                if left >= n / 2 and k < caps[s]:
                    k += 1
                    left -= n
                carry[s, bucket] = left
                copies.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(copies, pa.int32())], names=["doc_id", "doc_source", "n_tokens", "copies"])

    kind = sized.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    parts = spark.createDataFrame([(s, -(-stats[s][0] // BUCKET_DOCS)) for s in sorted(goals)], "doc_source string, parts long")
    rest = F.lit(shuffle_width(spark)).cast("long")  # of documents that get no copies
    bucket = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", rest)).alias("bucket")
    spread = sized.join(F.broadcast(parts), "doc_source", "left").select("doc_id", "doc_source", "n_tokens", bucket).repartition(shuffle_width(spark), "doc_source", "bucket").sortWithinPartitions(F.desc("n_tokens"), "doc_id")
    return spread.mapInArrow(run, f"doc_id {kind}, doc_source string, n_tokens bigint, copies int")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_source, weight, max_repeats, available_tokens, mixed_tokens, share): target and actual share of each source."""
    got = mix.groupBy("doc_source").agg(F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    got = got.withColumn("total", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))  # a row per source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = targets.select("doc_source", "weight", "max_repeats").join(got, "doc_source", "left")
    return out.select("doc_source", "weight", "max_repeats", zero("available_tokens").alias("available_tokens"), zero("mixed_tokens").alias("mixed_tokens"), F.coalesce(zero("mixed_tokens") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("share"))
