r"""Periodic runs of words: stretches that repeat a block of words, found by matching blocks, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q, of length max(least, 2 q) at least, that no neighbouring word extends.
Words are compared by their bytes. Of a run of period q, max(q, least - q) words stand q before others of the run. Among so many lies a block of B words
whose place is a multiple of B, for any power of two B with 2 B - 1 of them at most. So every period has its B, and the largest is
taken: blocks of B words are searched across the document by an Aho-Corasick automaton over sequences of word numbers (the first
`key_words` of longer blocks are, and the rest is compared), and
occurrences at those distances that belong to B seed a comparison word by word in both directions. A stretch's smallest period is
the least distance that gives it, since a period of at most half the length divides all others that it has.

Scales are taken from short periods to long ones. Two rules keep the work in proportion to n log n without leaving out a run:
- a block is searched only if each of its words stands again within reach;
- a key of k words within a known run of a period up to k / 2 has, within that run, no occurrences but those at multiples of the
  period, which give that run again. An occurrence in another run of that period, apart from it, is one of a longer period only if both
  runs' starts or both runs' ends are equally far apart.

Texts are read in slices of documents whose words are numbered together; no match crosses documents. Every text is whole in one
task, and work per text is narrow: nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and the empty text; repeated rows and rows without doc_id are documents of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import held, table, tidy
from marketloom.llm.fingerprints import TABLE, Powers, buffers, word_hashes

FAR = 1 << 62


@dataclass(frozen=True)
class RunRules:
    least: int = 12
    #: Bytes of the texts that are searched together, words of the longest key, and of the keys of one automaton.
    slice_bytes: int = 1 << 20
    key_words: int = 64
    automaton_words: int = 1 << 18


def scales(longest: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Block size, shortest and longest period of each scale, for texts of `longest` words, from short to long periods."""
    q, found = 1, None
    while 2 * q <= longest:
        block = 1 << ((max(q, least - q) + 1) // 2).bit_length() - 1
        last = q if 2 * q < least else min(4 * block - 2, longest // 2)
        if found and found[0] == block:
            found = (block, found[1], last)
        else:
            if found:
                yield found
            found = (block, q, last)
        q = last + 1
    if found:
        yield found


class Runs:
    """The runs found so far, as starts, ends and periods, ordered by start and end."""

    def __init__(self):
        self.starts = self.ends = self.periods = np.zeros(0, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        s, e, q = (np.concatenate(x) for x in ((self.starts, starts), (self.ends, ends), (self.periods, periods)))
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.starts, self.ends, self.periods = s[first], e[first], q[first]

    def around(self, block: int) -> Callable[[np.ndarray], np.ndarray]:
        """Of blocks' places, the number of the run of a period up to half the block that they lie in, or -1.

        Two such runs share fewer words than a block has, so there is one at most, and of those that start before a place the last reaches furthest.
        """
        own = np.flatnonzero((2 * self.periods <= block) & (self.ends - self.starts >= block))
        starts, ends = self.starts[own], self.ends[own]

        def of(places: np.ndarray) -> np.ndarray:
            if not len(own):
                return np.full(len(places), -1)
            k = np.searchsorted(starts, places, "right") - 1
            return np.where((k >= 0) & (ends[k] >= places + block), own[k], -1)

        return of


def reach(ids: np.ndarray, at: np.ndarray, apart: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on, in the direction of step and at most room, equal the words `apart` after them."""
    out = np.zeros(len(at), np.int64)
    for low in range(0, len(at), 1 << 16):
        active, width = low + np.flatnonzero(room[low : low + (1 << 16)] > 0), 8
        while len(active):
            offsets = out[active][:, None] + np.arange(width)
            within = offsets < room[active][:, None]
            where = at[active][:, None] + step * np.where(within, offsets, 0)
            same = within & (ids[where] == ids[where + apart[active][:, None]])
            n = np.where(same.all(1), width, same.argmin(1))
            out[active] += n
            active = active[n == width]
            width = max(8, min(2 * width, (1 << 20) // max(1, len(active))))
    return out


def occurrences(ids: np.ndarray, places: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the keys of `size` words at places (ascending), all their occurrences that start at low and end at high, or between: the numbers of the places, the occurrences' places."""
    import ahocorasick

    automaton, numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
    keys = np.array([numbers.setdefault(tuple(ids[p : p + size].tolist()), len(numbers)) for p in places.tolist()], np.int64)
    for key, number in numbers.items():
        automaton.add_word(key, number)
    automaton.make_automaton()
    apart = np.flatnonzero(low[1:] >= high[:-1]) + 1
    found = []
    for a, b in zip(low[np.append(0, apart)].tolist(), high[np.append(apart, len(high)) - 1].tolist()):
        hits = np.array(list(automaton.iter(tuple(ids[a:b].tolist()))), np.int64).reshape(-1, 2)
        hits[:, 0] += a + 1 - size
        found.append(hits)
    at, key = np.concatenate(found).T
    apiece = np.int64(len(ids) + 1)
    order = np.sort(key * apiece + at)
    first, last = np.searchsorted(order, keys * apiece + low), np.searchsorted(order, keys * apiece + high - size, "right")
    n = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(places)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, order[first[which] + inside] % apiece


def find(ids: np.ndarray, bounds: np.ndarray, rules: RunRules = RunRules()) -> Runs:
    """All runs of the sequences ids[bounds[i]:bounds[i + 1]], by places in ids. Equal words have equal ids, below 2**31."""
    n, runs = len(ids), Runs()
    if not n:
        return runs
    low, high = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    order = np.argsort(ids, kind="stable")
    again = np.full(n, FAR)
    same = (ids[order[1:]] == ids[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    for block, shortest, longest in scales(int(np.diff(bounds).max()), rules.least):
        key, whole = min(block, rules.key_words), n // block * block
        places = block * np.flatnonzero(again[:whole].reshape(-1, block).max(1) <= longest)
        first, last = places + shortest, np.minimum(places + longest + key, high[places])
        around = runs.around(key)
        run = around(places)
        useful = (first + block <= high[places]) & ((run < 0) | (runs.ends[run] < last) if len(runs.ends) else True)
        places, first, last = places[useful], first[useful], last[useful]
        found = [], [], []
        for k in range(0, len(places), max(1, rules.automaton_words // key)):
            some = slice(k, k + max(1, rules.automaton_words // key))
            which, at = occurrences(ids, places[some], key, first[some], last[some])
            p = places[some][which]
            d, own, other = at - p, around(p), around(at)
            known = (own >= 0) & (own == other) | (at + block > high[p])
            if len(runs.ends):
                alike = (runs.starts[other] - runs.starts[own] == d) | (runs.ends[other] - runs.ends[own] == d)
                known |= (own >= 0) & (other >= 0) & (runs.ends[own] < runs.starts[other]) & ~alike
            p, d = p[~known], d[~known]
            same = reach(ids, p + key, d, np.full(len(p), block - key), 1) == block - key
            p, d = p[same], d[same]
            order = np.lexsort((p, d))
            p, d = p[order], d[order]
            head = np.ones(len(p), bool)
            head[1:] = (d[1:] != d[:-1]) | (p[1:] - p[:-1] > block)  # blocks that follow each other lie in one stretch
            p, d = p[head], d[head]
            left = reach(ids, p - 1, d, p - low[p], -1)
            right = reach(ids, p + block, d, high[p] - p - block - d, 1)
            start, end = p - left, p + block + d + right
            keep = end - start >= np.maximum(rules.least, 2 * d)
            for x, y in zip(found, (start[keep], end[keep], d[keep])):
                x.append(y)
        if found[0]:
            runs.add(*(np.concatenate(x) for x in found))
    return runs


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A number of each word, the same for the same bytes. Words of one hash are compared by bytes; if two differ, a dictionary numbers all."""
    _, where, ids = np.unique(hashes, return_index=True, return_inverse=True)
    first, lengths = starts[where][ids], ends - starts
    same = bool((lengths == lengths[where][ids]).all())
    upto, i = np.concatenate([[0], np.cumsum(lengths)]), 0
    while same and i < len(ids):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        inside = np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], lengths[i:j])
        same = bool((data[np.repeat(starts[i:j], lengths[i:j]) + inside] == data[np.repeat(first[i:j], lengths[i:j]) + inside]).all())
        i = j
    if same:
        return ids.astype(np.int64)
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(data[a:b].tobytes(), len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)


#: For a document's id and number of words: the places of the words to take in their stead, or None.
Reorder = Callable[[int | None, int], np.ndarray | None]
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def collapse(docs: DataFrame, rules: RunRules = RunRules(), reorder: Reorder = lambda doc_id, n: None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, in words, by start, then period) and the collapsed text of each document.

    The collapsed text has the words that no run contains after its first period, joined by one space.
    """

    def of(doc_ids: list, data: np.ndarray, offsets: np.ndarray, powers: Powers) -> pa.RecordBatch:
        hashes, firsts, starts, ends = word_hashes(data, offsets, powers, TABLE)
        ids, raw, moved = word_numbers(data, starts, ends, hashes), data.tobytes(), {}
        for r, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
            order = reorder(doc_ids[r], b - a)
            if order is not None:
                moved[r] = a + order
                starts[a:b], ends[a:b], ids[a:b] = starts[moved[r]], ends[moved[r]], ids[moved[r]]
        runs = find(ids, firsts, rules)
        order = np.lexsort((runs.ends, runs.periods, runs.starts))
        s, e, q = runs.starts[order], runs.ends[order], runs.periods[order]
        depth = np.zeros(len(ids) + 1, np.int64)
        np.add.at(depth, s + q, 1)
        np.add.at(depth, e, -1)
        kept = np.cumsum(depth)[:-1] == 0
        cut = np.searchsorted(s, firsts)
        texts = []
        for r, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
            if r not in moved and cut[r] == cut[r + 1]:
                texts.append(b" ".join(raw[offsets[r] : offsets[r + 1]].split()))
            else:
                own = a + np.flatnonzero(kept[a:b])
                texts.append(b" ".join([raw[i:j] for i, j in zip(starts[own].tolist(), ends[own].tolist())]))
        base = np.repeat(firsts[:-1], np.diff(cut))
        rows = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc_ids, pa.int64()), "n_words": pa.array(np.diff(firsts)),
            "runs": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows), "collapsed": pa.array(texts, pa.binary()).cast(pa.string()),
        })

    def found(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            row = 0
            while row < len(batch):
                last = min(len(batch), max(row + 1, int(np.searchsorted(offsets, offsets[row] + rules.slice_bytes, "right")) - 1))
                yield of(batch.column(0)[row:last].to_pylist(), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], powers)
                row = last

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(found), FOUND)


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's contract: a tenth of the documents, by the checksum of their ids, end in words that repeat. Documents without id don't."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(table(spark, sf_dir, "documents"), reorder=periodic_tail)
    greatest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = held(found, _g=greatest, runs_sha256=F.sha2(F.array_join(lines, ""), 256), collapsed_sha256=F.sha2("collapsed", 256))
    length = -F.col("_g.l")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_g.s").alias("start"), length.alias("length"), F.col("_g.q").alias("period"),
        F.floor(1000 * length / F.col("_g.q")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
