r"""Mixing sources to target weights: whole passes over a source, and a subset of documents that fits what is left.

Targets share all words of the corpus by the sources' weights; none exceeds `most_passes` times its source, the excess goes to the
others by weight. A source is taken as a whole as often as its target allows. For the rest its documents are counted by exact
length: all lengths give the same share of their documents, shares of single documents carried on from length to length, and a
bounded knapsack over the remaining budget of about the longest document, up to `dp_words` if that isn't met, comes by dynamic programming as
near as subsets can without exceeding it. Of each length, the documents of the smallest seeded hashes are selected.

Large lengths are ranked in two steps, so no task sorts a hot source: documents are counted by slices of the hash range, and only
those of the slice where the selection ends are ranked.

Defined cases: a null text has size 0 and is taken 0 words; a null source is one of its own and comes last; rows that are equal in id, text and source
stand for each other and are numbered, so that any number of them can be selected; an empty table gives an empty mix; other columns pass through, those named
as the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE, Aside, cut, maybe_in, stored, table

ADDED = ["size", "source_size", "target", "passes", "picked", "taken"]


@dataclass(frozen=True)
class MixRules:
    weights: tuple = (1, 2, 3)
    most_passes: int = 3
    seed: int = 42
    dp_words: int = 1 << 16
    slice_docs: int = 1024


def targets(sources: DataFrame, rules: MixRules) -> DataFrame:
    """sources (source, source_size) with `target`. One row a source stays distributed; the driver sees sums.

    Each round holds the sources that their share would overfill at their limit and shares the rest anew, until none is overfull.
    """
    # Ranks of sources by code point, null last: numbered in ranges, whose counts are one number a partition.
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["count"] for r in dealt.groupBy("_p").count().collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    before = F.get(F.array(*[F.lit(offsets.get(p, 0)) for p in range(max(offsets, default=0) + 1)]), F.col("_p"))  # a number a partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in rules.weights])
    df = cut(dealt.withColumn("_w", F.get(weights, (own + before) % len(rules.weights))).drop("_p"))
    limit = F.col("source_size") * float(rules.most_passes)
    words = float(df.agg(F.sum("source_size")).first()[0] or 0)
    share = 0.0
    while words:
        full = F.col("_w") * share >= limit
        held, weight = df.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        new = (words - held) / weight if weight else share
        if new <= share * (1 + 1e-12):
            break
        share = new
    return df.withColumn("target", F.least(F.col("_w") * share, limit)).drop("_w")


def shared(n: np.ndarray, c: np.ndarray, goal: int) -> np.ndarray:
    """How many of c documents of each length n, ascending, make up about `goal` words, the same share of all lengths.

    Shares of single documents are carried on to the next length, so the words are off by less than the longest document.
    """
    upto = np.floor(np.cumsum(c) * (goal / max(1, int((n * c).sum())))).astype(np.int64)
    return np.minimum(np.diff(np.concatenate([[0], upto])), c)


def nearest(w: np.ndarray, c: np.ndarray, room: int) -> np.ndarray:
    """How many of at most c documents of each weight w reach the largest sum up to `room`, by dynamic programming.

    Counts fall into packages of 1, 2, 4, ... documents; each reachable sum keeps the package that reached it first.
    """
    reach, first = np.zeros(room + 1, bool), np.full(room + 1, -1, np.int64)
    reach[0] = True
    packages = []
    usable = np.flatnonzero((w <= room) & (c > 0))
    for i in usable[np.random.Generator(np.random.PCG64(1)).permutation(len(usable))]:  # no length is preferred
        left, size = min(int(c[i]), room // int(w[i])), 1
        while left and not reach[room]:
            size = min(size, left)
            x = size * int(w[i])
            if x <= room:
                new = np.flatnonzero(reach[: room + 1 - x] & ~reach[x:]) + x
                first[new] = len(packages)
                reach[new] = True
                packages.append((i, size, x))
            left, size = left - size, size * 2
        if reach[room]:
            break
    out, at = np.zeros(len(w), np.int64), int(np.flatnonzero(reach)[-1])
    while at:
        i, size, x = packages[first[at]]
        out[i] += size
        at -= x
    return out


def knapsack(n: np.ndarray, c: np.ndarray, rest: int, dp_words: int) -> np.ndarray:
    """How many of at most c documents of each length n, ascending, come near `rest` words without exceeding it; the nearest if rest <= dp_words.

    While more than dp_words are left, lengths count in steps of equally many words, rounded up; shorter ones give a share of what no
    other fits.
    """
    out = np.zeros(len(n), np.int64)
    while True:
        step = max(1, -(-rest // dp_words))
        long = n >= step
        got = nearest(-(-n // step), np.where(long, c - out, 0), rest // step)
        if step > 1 and not got.any():
            left = np.where(long, 0, c - out)
            all_ = int((left * n).sum())
            got = left if all_ <= rest else shared(n, left, rest - int(n[~long].max()))
        out, rest = out + got, rest - int((got * n).sum())
        if step == 1 or not got.any():
            return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near `budget` from below. Lengths are distinct and above 0.

    All lengths give the same share of a part of the budget; the knapsack fills the rest, of which it gets more while it isn't met.
    A budget of at most dp_words is met by the nearest subset.
    """
    order = np.argsort(lengths)
    n, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    budget = min(int(budget), int((n * c).sum()))
    best, off = np.zeros(len(n), np.int64), budget
    for slack in sorted({min(budget, int(x)) for x in (n.max(initial=0), max(n.max(initial=0), dp_words // 2), max(n.max(initial=0), dp_words))}):
        take = shared(n, c, budget - slack)
        take = take + knapsack(n, c - take, budget - int((take * n).sum()), dp_words)
        if budget - int((take * n).sum()) < off:
            best, off = take, budget - int((take * n).sum())
        if not off:
            break
    out = np.zeros(len(n), np.int64)
    out[order] = best
    return out


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """docs with their size in words, their source's size and target, and the words taken: `passes` of the source, plus one if `picked`."""
    mine = Aside(docs, ADDED)
    text = mine.col("text")
    size = F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    sized = mine.df.select(*mine.kept(), mine.col("source").alias("source"), size.alias("size"), F.xxhash64(F.lit(rules.seed), mine.col("doc_id"), text, mine.col("source")).alias("h"))
    narrow = stored(sized.select("source", "size", "h"), "sizes")
    again = stored(narrow.groupBy("source", "size", "h").agg(F.count("*").alias("n")).filter("n > 1 AND size > 0"), "again")
    if not again.isEmpty():
        single = narrow.join(again.select("h"), "h", "left_anti").select("source", "size", "h")
        counted = again.select("source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), "h").select("source", "size", F.xxhash64("h", "i").alias("h"))
        narrow = stored(single.unionByName(counted), "sizes")
        sized = numbered(sized, again)
    lengths = cut(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    aims = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), rules)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target") / F.col("source_size"), 9))).otherwise(0).cast("long")
    aims = cut(aims.withColumn("passes", whole).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(take=fit(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"].iloc[0]), rules.dp_words))

    each = lengths.filter("size > 0").join(aims.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    takes = each.groupBy("source").applyInPandas(fitted, "source string, size bigint, n bigint, budget bigint, take bigint")
    # Slices of the hash range: as many as keep each to about slice_docs documents.
    takes = cut(takes.select(F.col("source").alias("s"), F.col("size").alias("z"), "take", F.ceil(F.col("n") / rules.slice_docs).alias("slices")))
    by_length = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    small = narrow.filter("size > 0").join(takes, by_length).drop("s", "z")
    ends = cut(bounds(small).select(F.col("source").alias("s"), F.col("size").alias("z"), "last"))
    aims = aims.select(F.col("source").alias("s"), "source_size", "target", "passes")
    decided = lengths.drop("n").join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s").join(ends, by_length, "left").drop("s", "z")
    decided = cut(decided.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "passes", "last"))
    placed = sized.join(decided, by_length).withColumn("picked", F.coalesce(F.col("h") <= F.col("last"), F.lit(False)))
    taken = F.col("size") * (F.col("passes") + F.col("picked").cast("long"))
    return mine.back(placed, "size", "source_size", "target", "passes", "picked", taken.alias("taken"))


def numbered(rows: DataFrame, again: DataFrame, together: int = 12) -> DataFrame:
    """rows with the hashes that stand several times (again: h) replaced by hashes of h and a number from 0 within h.

    Only such rows are moved. They are numbered in blocks of 2**together rows of the table that they are written to; blocks' counts
    are added up by hash, so equal rows are never gathered.
    """
    maybe = maybe_in(again, ["h"])
    rows = rows.withColumn("_m", maybe)
    met = rows.filter("_m").join(again.select("h", F.lit(True).alias("_again")), "h", "left").withColumn("_at", F.monotonically_increasing_id())
    met = stored(met.withColumn("_b", F.shiftright("_at", together)), "repeated")
    counts = met.filter("_again").groupBy("h", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("h").orderBy("_b")) - F.col("_n")  # a row a block
    own = F.row_number().over(Window.partitionBy("h", "_b").orderBy("_at")) - 1
    moved = met.filter("_again").withColumn("_i", own).join(counts.select("h", "_b", before.alias("_before")), ["h", "_b"])
    moved = moved.withColumn("h", F.xxhash64("h", (F.col("_before") + F.col("_i")).cast("long")))
    names = [c for c in rows.columns if c != "_m"]
    return rows.filter("NOT _m").select(names).unionByName(met.filter("_again IS NULL").select(names)).unionByName(moved.select(names))


def bounds(rows: DataFrame) -> DataFrame:
    """source, size, last: the hash of the last document selected, of rows (source, size, h, take, slices)."""
    width = F.lit(2.0**64) / F.col("slices")
    rows = rows.withColumn("slice", F.least(F.floor((F.col("h").cast("double") + 2.0**63) / width), F.col("slices") - 1))
    counts = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("c"), F.first("take").alias("take"))
    before = F.sum("c").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("c")
    ending = counts.withColumn("before", before).filter((F.col("before") < F.col("take")) & (F.col("before") + F.col("c") >= F.col("take")))
    ending = ending.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slice").alias("e"), (F.col("take") - F.col("before")).alias("rank"))
    ending = cut(ending)  # a row a length; one plan of all its joins and windows would take the driver's memory
    inside = rows.join(ending, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("e")))
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("source", "size").orderBy("h")))
    return ranked.filter(F.col("r") == F.col("rank")).select("source", "size", F.col("h").alias("last"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents appear as often as the mix takes them."""
    mine = Aside(docs)
    mixed = mix(mine.df.withColumns({c: mine.col(c) for c in ("doc_id", "text", "source")}))
    times = F.array_repeat(F.lit(1), (F.col("passes") + F.col("picked").cast("long")).cast("int"))
    return mine.back(mixed.withColumn("time", F.explode(times)))
