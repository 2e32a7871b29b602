r"""Benchmark decontamination: training token windows against the set of normalised benchmark n-grams.

Words are runs of digits, letters and characters beyond ASCII, with A to Z lower-cased. A window is `n` consecutive words of an
item, or all words of a shorter one. The benchmark's windows travel to the tasks as a hash set, sorted hashes and the words' bytes in
plain arrays of some 50 bytes a word, while they are at most `max_broadcast_words` words and `max_broadcast_bytes` bytes, which are counted first, items without words left out; beyond
that the windows of documents and items are joined by hash. Either way a hit is one of equal words, not of equal hashes.

Defined cases: a null text has no words and hits nothing; items without words have no window; equal items are all named; a null
item id is written as an empty one; an empty benchmark hits nothing; other columns pass through, those named as the added ones
are replaced. Both paths give the same columns, by the text alone: a doc_id may be null, repeated or absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import Aside, ascii_lower, maybe_in, table, tidy
from marketloom.llm.fingerprints import LOWER, ODD, Powers, buffers, mix, runs_of, word_hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
APART = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ADDED = ["n_words", "n_hit", "items", "hits"]
KIND = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("hits", SPANS)]
HIT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,hits:array<struct<start:int,end:int>>>"


@dataclass(frozen=True)
class DecontaminationRules:
    n: int = 10
    max_broadcast_words: int = 1_000_000
    max_broadcast_bytes: int = 32_000_000


def spans(lower: bytes, turns: list) -> list[dict]:
    """Spans of code points of turns (first word, word after the last) in order."""
    where, out, chars, at = [m.span() for m in WORD.finditer(lower)], [], 0, 0
    for a, b in turns:
        start = chars + len(lower[at : where[a][0]].decode())
        chars, at = start + len(lower[where[a][0] : where[b - 1][1]].decode()), where[b - 1][1]
        out.append({"start": start, "end": chars})
    return out


def batch_words(texts: pa.Array, powers: Powers) -> tuple:
    """The bytes of all texts, A to Z lower-cased, their offsets, and the words' hashes, first word of each text, starts and ends."""
    data, offsets = buffers(texts)
    return LOWER[data], offsets, *word_hashes(data, offsets, powers, spaces=APART)


def window_hashes(words: np.ndarray, k: int, powers: Powers, seed: int) -> np.ndarray:
    """Hashes of each k neighbouring words."""
    n = max(0, len(words) - k + 1)
    powers.grow(len(words) + 1)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.up[: len(words)], dtype=np.uint64)])
    return mix((upto[k : k + n] - upto[:n]) * powers.down[:n] + np.array([1000 * seed + k], np.uint64) * ODD[3])


def equal_words(k: int, mine: tuple, i: np.ndarray, theirs: tuple, j: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """Whether the k words from word i on of one text buffer (bytes, starts, ends) are those from word j on of another."""
    if len(i) > at_once:
        return np.concatenate([equal_words(k, mine, i[a : a + at_once], theirs, j[a : a + at_once]) for a in range(0, len(i), at_once)])
    (da, sa, ea), (db, sb, eb) = mine, theirs
    i, j = i[:, None] + np.arange(k), j[:, None] + np.arange(k)
    a, b = sa[i], sb[j]
    size = ea[i] - a
    same = (size == eb[j] - b).all(1)
    a, b, size = a[same].ravel(), b[same].ravel(), size[same].ravel()
    upto = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(upto[-1])
    differ = np.concatenate([[0], np.cumsum(da[np.repeat(a - upto[:-1], size) + inside] != db[np.repeat(b - upto[:-1], size) + inside])])
    count = differ[upto[1:]] - differ[upto[:-1]]
    same[np.flatnonzero(same)[count.reshape(-1, k).any(1)]] = False
    return same


def window_set(items: list[str], texts: pa.Array, n: int) -> dict:
    """The benchmark's windows as plain arrays: their words' bytes, and by window size the sorted hashes, first words and items.

    Had two different windows one hash, all are hashed anew with another seed; so a hash names one window.
    """
    powers = Powers()
    data, _, words, firsts, starts, ends = batch_words(texts, powers)
    count = np.diff(firsts)
    size, buffer = np.minimum(count, n), (data, starts, ends)
    for seed in range(100):
        by_size = {}
        for k in np.unique(size[size > 0]).tolist():
            hashes = window_hashes(words, k, powers, seed)
            of = np.flatnonzero(size == k)
            many = count[of] - k + 1
            item = np.repeat(of, many)
            first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + firsts[item]
            order = np.lexsort([item, hashes[first]])
            h, first, item = hashes[first][order], first[order], item[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            begin = np.flatnonzero(new)
            if not equal_words(k, buffer, first, buffer, first[begin][np.cumsum(new) - 1]).all():
                break
            keep = np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])
            by_size[k] = (h[begin], first[begin], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, begin))]) if len(begin) else np.zeros(1, np.int64), item[keep])
        else:
            return {"seed": seed, "items": items, "buffer": buffer, "windows": by_size}
    raise RuntimeError("no seed tells the windows apart")


def scan(texts: pa.Array, windows: dict, powers: Powers) -> pa.Array:
    """n_words, n_hit, items and hits of each text."""
    data, offsets, words, firsts, starts, ends = batch_words(texts, powers)
    n, count = len(texts), np.diff(firsts)
    doc = np.repeat(np.arange(n), count)
    edge, pairs = np.zeros(len(words) + 1, np.int64), [np.zeros((0, 2), np.int64)]
    for k, (hashes, first, begin, items) in windows["windows"].items():
        if len(words) < k:
            continue
        h = window_hashes(words, k, powers, windows["seed"])
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = np.flatnonzero((hashes[at] == h) & (doc[: len(h)] == doc[k - 1 :]))
        hit = hit[equal_words(k, (data, starts, ends), hit, windows["buffer"], first[at[hit]])]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + k, -1)
        met = np.unique(np.stack([doc[hit], at[hit]], 1), axis=0)
        many = begin[met[:, 1] + 1] - begin[met[:, 1]]
        lag = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.stack([np.repeat(met[:, 0], many), items[np.repeat(begin[met[:, 1]], many) + lag]], 1))
    covered = np.cumsum(edge[:-1]) > 0
    upto = np.concatenate([[0], np.cumsum(covered)])
    # Turns of covered words, which end where a text does.
    before = np.concatenate([[False], covered[:-1] & (doc[1:] == doc[:-1])]) if len(doc) else covered
    after = np.concatenate([covered[1:] & (doc[1:] == doc[:-1]), [False]]) if len(doc) else covered
    a, b = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    places = [pa.array((chars[x] - chars[offsets[doc[i]]]).astype(np.int32)) for x, i in ((starts[a], a), (ends[b], b))]
    each = lambda d: pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    names = [sorted({windows["items"][i] for i in x.tolist()}) for x in np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))] if n else []
    fields = [pa.array(count, pa.int64()), pa.array(upto[firsts[1:]] - upto[firsts[:-1]], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.ListArray.from_arrays(each(doc[a]), pa.StructArray.from_arrays(places, ["start", "end"]))]
    return pa.StructArray.from_arrays([f.cast(k.type) for f, k in zip(fields, KIND)], fields=list(KIND))


def _by_broadcast(docs: DataFrame, benchmark: DataFrame, rules: DecontaminationRules) -> DataFrame:
    rows = benchmark.collect()  # its words, bytes and rows were counted
    windows = docs.sparkSession.sparkContext.broadcast(window_set([r[0] or "" for r in rows], pa.array([r[1] for r in rows], pa.string()), rules.n))

    def found(texts: pa.Array) -> pa.Array:
        powers = Powers()
        return pa.concat_arrays([pa.array([], pa.struct(list(KIND))), *(scan(t, windows.value, powers) for t in runs_of(texts))])

    return docs.withColumn("hit", F.arrow_udf(tidy(found), HIT)(F.col("text")))


def _by_join(docs: DataFrame, benchmark: DataFrame, rules: DecontaminationRules) -> DataFrame:
    """Windows of documents join different windows of the benchmark by hash and are compared; what a text hits comes back by the text's digest.

    A document's window meets one row at most, so a window that stands everywhere makes a skewed join, which Spark splits, and no product.
    """
    words = lambda c: F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD_SQL})"))
    items = benchmark.select(F.coalesce("item_id", F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(rules.n)))
    sizes = [r[0] for r in items.select("k").distinct().collect()]  # at most n
    gram = F.slice("w", F.col("i"), F.col("k"))
    items = items.select("item", "k", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i")).select("item", gram.alias("g")).distinct()
    different = items.select("g").distinct().select(F.xxhash64("g").alias("h"), "g")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")
    each = docs.select(sha, words(F.col("text")).alias("w"))
    starts = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"))))
    none = F.array().cast("array<struct<k:int,i:int>>")
    at = F.concat(none, *[F.coalesce(starts(k), none) for k in sizes])
    mine = each.select("sha", "w", F.explode(at).alias("at")).select("sha", "w", "at.*").select("sha", "k", "i", gram.alias("mine")).withColumn("h", F.xxhash64("mine"))
    # A bitmap of the benchmark's hashes keeps other windows from being shuffled.
    met = mine.filter(maybe_in(different, ["h"])).join(different, "h").filter("mine = g").select("sha", "k", "i", "g")
    where = met.groupBy("sha").agg(F.array_sort(F.collect_set(F.struct("i", "k"))).alias("places"))
    named = met.select("sha", "g").distinct().join(items, "g").groupBy("sha").agg(F.sort_array(F.collect_set("item")).alias("items"))
    state = F.struct(F.lit(1).alias("end"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate("places", state, lambda a, x: F.struct(F.greatest(a["end"], x["i"] + x["k"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["i"] + x["k"] - F.greatest(a["end"], x["i"]))).alias("n")))["n"]
    met = where.join(named, "sha").select("sha", "items", count.alias("n_hit"), "places")
    df = docs.withColumn("sha", sha).join(met, "sha", "left")

    def placed(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([spans(t.encode().lower(), _turns(x)) if x else [] for t, x in zip(texts.to_pylist(), hits.to_pylist())], SPANS)

    place = F.arrow_udf(tidy(placed), "array<struct<start:int,end:int>>")(F.col("text"), F.col("places")).alias("hits")
    n = F.size(words(F.col("text"))).cast("long").alias("n_words")
    hit = F.struct(n, F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), place)
    return df.withColumn("hit", hit)


def _turns(hits: list) -> list:
    """Turns of words under windows (i from 1, k words) in order; windows that touch are one turn."""
    out: list = []
    for x in hits:
        a, b = x["i"] - 1, x["i"] - 1 + x["k"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: DecontaminationRules = DecontaminationRules()) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted) and hits (spans of code points)."""
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    benchmark = benchmark.withColumn("_n", F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD_SQL))).filter("_n > 0")
    n_words, n_bytes = benchmark.agg(F.sum("_n"), F.sum(F.octet_length("text") + F.octet_length(F.coalesce("item_id", F.lit(""))))).first()
    small = (n_words or 0) <= rules.max_broadcast_words and (n_bytes or 0) <= rules.max_broadcast_bytes
    how, mine, benchmark = _by_broadcast if small else _by_join, Aside(docs, ADDED), benchmark.drop("_n")
    found = how(mine.df.select(*mine.kept(), mine.col("text").alias("text")), benchmark, rules)
    return mine.back(found, *[F.col(f"hit.{c}").alias(c) for c in ADDED])


def without_hits(docs: DataFrame) -> DataFrame:
    """Rows of decontaminate() with the hit spans cut out of the text."""
    kept = F.aggregate("hits", F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), lambda a, x: F.struct(F.concat(a["t"], F.col("text").substr(a["at"] + 1, x["start"] - a["at"])).alias("t"), x["end"].alias("at")))
    return docs.withColumn("text", F.when(F.size("hits") == 0, F.col("text")).otherwise(F.concat(kept["t"], F.col("text").substr(kept["at"] + 1, F.length("text")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark window go."""
    mine = Aside(docs)
    found = decontaminate(mine.df.withColumn("text", mine.col("text")), table(spark, sf_dir, "benchmark"))
    return mine.back(found.filter("n_hit = 0"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
