r"""Suffix-array dedup: bytes of 100-byte strings that also occur earlier are removed, over the whole corpus.

Sampling. Of the 32-byte strings within any `length`-byte string the one of the least hash is its anchor. Equal strings have equal
anchors, so strings are compared only around anchors: what all strings of one anchor cover is its context, up to 68 bytes before it
and 100 from it on.

1. Which anchors repeat. Every task sends parts of its anchors' and contexts' hashes by bucket; the buckets tell of an anchor whether
   it repeats, repeats with several contexts, or with more than `most_contexts`. What they tell is packed in a table of as many
   cells as eight times the repeating anchors, at most 2**table_bits. Anchors that share a cell are only looked at in vain.
2. Anchors that may repeat are dealt by bucket, of equal contexts of a task only the earliest; the others are covered by it. In a
   bucket the earliest of equal contexts stays and the others are covered. Contexts are equal if their SHA-256 digests are, 128 bits of them.
3. Suffix sort. The different contexts of an anchor are sorted by what follows the anchor, and by what stands before it, read
   backwards: mergesorts that compare two suffixes by their longest common extension, found by binary search over prefix
   polynomial hashes. Neighbours' extensions are verified byte by byte; had hashes collided, the bytes are sorted themselves.
   In either order, contexts that share k bytes are a run; strings that start l bytes before the anchor are equal where both runs
   are, for l before and length - l after. The earliest of them stays, the others are covered.
   Anchors of more contexts than `most_contexts` are not gathered in one group. Each task sorts its own contexts in this way, and what
   it finds to be the earliest of equal strings goes by its digest to a bucket, where the earliest of all tasks' stays.
4. The covered intervals of a row are merged and cut out of its bytes.

Earlier means a smaller doc_id, or the same and an earlier start. Defined cases: a null text is empty; texts shorter than `length`
lose nothing; rows without doc_id lose nothing and remove nothing; rows of one doc_id are one document's, each with starts of its own, so equal
rows lose what one of them would and a text that stands in no earlier place is kept in each; rows are told apart by doc_id and the
64-bit hash of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import release, shared_path, stored, table, tidy
from marketloom.llm.fingerprints import ODD, TABLE, Powers, buffers, mix

NONE, REPEATED, SEVERAL, MANY = range(4)
SEEN = np.dtype([("id", "<u4"), ("low", "<u4"), ("high", "<u4")])
FOUND = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1")])
SENT = np.dtype([("anchor", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("several", "u1")])
STRING = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("pos", "<i4")])
BYTE = [bytes([k]) for k in range(256)]


@dataclass(frozen=True)
class SuffixRules:
    length: int = 100
    gram: int = 32
    most_contexts: int = 16_384
    table_bits: int = 28
    flush: int = 1 << 18
    piece: int = 1 << 19
    sort_rows: int = 1 << 13

    @property
    def before(self) -> int:
        return self.length - self.gram


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def parts(ids: list, keys: list, data: np.ndarray, offsets: np.ndarray, rules: SuffixRules) -> Iterator[tuple]:
    """Runs of texts, or overlapping parts of longer ones, as (doc, first byte, start, end, first and last string start, key) of data."""
    held, size = [], 0
    for i, doc in enumerate(ids):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if doc is None or b - a < rules.length:
            continue
        for s in range(a, b - rules.length + 1, rules.piece):
            t = min(s + rules.piece, b - rules.length + 1)
            lo, hi = max(a, s - rules.before), min(b, t + rules.before + rules.length)
            held.append((doc, lo - a, lo, hi, s - lo, t - lo, keys[i]))
            size += hi - lo
            if size >= rules.piece:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(batch: pa.RecordBatch, rules: SuffixRules, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of a batch (doc_id, text, key) as FOUND rows, the bytes they were found in and where in them each stands."""
    data, offsets = buffers(batch.column(1))
    w = rules.before + 1
    for held in parts(batch.column(0).to_pylist(), batch.column(2).to_pylist(), data, offsets, rules):
        buf = np.concatenate([data[lo:hi] for _, _, lo, hi, *_ in held])
        sizes = np.array([hi - lo for _, _, lo, hi, *_ in held])
        begins = np.cumsum(sizes) - sizes
        h = powers.prefix(buf)
        at = np.arange(len(buf) - rules.gram + 1)
        grams = mix((h[rules.gram :] - h[: len(at)]) * powers.down[: len(at)])
        least = sliding_least(grams, w)
        valid = np.zeros(len(least) + 1, np.int32)
        for begin, (_, _, _, _, s, t, _) in zip(begins.tolist(), held):
            valid[begin + s] += 1
            valid[begin + t] -= 1
        least[np.cumsum(valid[:-1]) == 0] = 0
        edge = np.full(w - 1, ~np.uint64(0))
        # A gram is an anchor if it is the least of some valid string: the greatest minimum of the strings around it equals it.
        greatest = ~sliding_least(np.concatenate([edge, ~least, edge]), w)[: len(grams)]
        where = np.flatnonzero((greatest == grams) & (greatest > 0))
        doc = np.searchsorted(begins, where, "right") - 1
        begin, end = begins[doc], begins[doc] + sizes[doc]
        where, doc, begin, end = (x[where + rules.gram <= end] for x in (where, doc, begin, end))
        lo, hi = np.maximum(where - rules.before, begin), np.minimum(where + rules.length, end)
        out = np.zeros(len(where), FOUND)
        out["anchor"] = mix(grams[where])  # least hashes are low ones; mixed once more they fill buckets and cells evenly
        out["left"], out["right"] = where - lo, hi - where
        out["context"] = mix(powers.between(h, lo, hi) + out["left"].astype(np.uint64) * ODD[0] + out["right"].astype(np.uint64) * ODD[1])
        out["doc"], out["key"] = (np.array([x[k] for x in held], np.int64)[doc] for k in (0, 6))
        out["pos"] = np.array([x[1] for x in held])[doc] + (where - begin)
        yield out, buf, where


def whole(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts sorted keys into runs of at most `most` rows that part no equal ones, or of one longer group."""
    edges = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    start = 0
    while start < len(keys):
        k = int(np.searchsorted(edges, start, "right"))
        end = int(edges[max(k, int(np.searchsorted(edges, start + most, "right")) - 1)])
        yield start, end
        start = end


def by_bucket(rows: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers by the highest bits of their keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


def batch_of(buckets: list, payloads: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def distinct(rows: np.ndarray, *names: str) -> np.ndarray:
    """The earliest row of each value of names, and a mask of the rows that are not it, in the order of names, doc and pos."""
    rows = rows[np.lexsort([rows["pos"], rows["doc"], *(rows[n] for n in reversed(names))])]
    new = np.ones(len(rows), bool)
    for n in names:
        new[1:] &= rows[n][1:] == rows[n][:-1]
    new[1:] = ~new[1:]
    return rows, new


def repeats(docs: DataFrame, rules: SuffixRules, bits: int) -> tuple[np.ndarray, int]:
    """Step 1: the packed table, two bits a cell, and how many of an anchor's highest bits number its cell."""

    def send(rows: list) -> pa.RecordBatch:
        rows, new = distinct(np.concatenate(rows), "anchor", "context")
        # Equal contexts of one task go as two; of an anchor's contexts as many as tell that there are too many.
        twice = np.flatnonzero(~new & np.concatenate([[False], new[:-1]]))
        rows = np.concatenate([rows[new], rows[twice]])
        rows = rows[np.argsort(rows["anchor"], kind="stable")]
        start = np.flatnonzero(np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]]))
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        rows = rows[rank <= 2 * rules.most_contexts]
        out = np.zeros(len(rows), SEEN)
        out["id"] = (rows["anchor"] >> np.uint64(32 - bits)).astype(np.uint32)
        out["low"], out["high"] = rows["context"].astype(np.uint32), (rows["context"] >> np.uint64(32)).astype(np.uint32)
        return batch_of(*zip(*((k, out[i].tobytes()) for k, i in by_bucket(rows, rows["anchor"], bits)))) if len(rows) else batch_of([], [])

    def seen(batches):
        powers, held = Powers(), []
        for batch in batches:
            for found, _, _ in anchors(batch, rules, powers):
                held.append(found)
                if sum(map(len, held)) >= rules.flush:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    def told(key, rows):
        x = np.concatenate([np.frombuffer(p.as_py(), SEEN) for p in rows.column("payload")])
        context = x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32)
        order = np.lexsort([context, x["id"]])
        ids, context = x["id"][order], context[order]
        same = np.concatenate([[False], ids[1:] == ids[:-1]])
        start = np.flatnonzero(~same)
        kinds = np.add.reduceat((~same | np.concatenate([[True], context[1:] != context[:-1]])).astype(np.int64), start)
        count = np.diff(np.append(start, len(ids)))
        level = np.where(kinds > rules.most_contexts, MANY, np.where(kinds > 1, SEVERAL, np.where(count > 1, REPEATED, NONE))).astype(np.uint8)
        some = level > 0
        data = ids[start][some].astype("<u4").tobytes() + level[some].tobytes()
        release()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([int(some.sum())], pa.int64()), "payload": pa.array([data], pa.binary())})

    kind = "bucket int, payload binary"
    levels = stored(docs.mapInArrow(tidy(seen), kind).groupBy("bucket").applyInArrow(told, "bucket int, n bigint, payload binary"), "levels")
    repeated = levels.agg(F.sum("n")).first()[0] or 0
    table_bits = min(rules.table_bits, max(bits + 2, (8 * repeated).bit_length()))
    cells = 1 << (table_bits - bits)

    def celled(batches):
        for batch in batches:
            for bucket, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out = np.zeros(cells, np.uint8)
                np.maximum.at(out, np.frombuffer(data, "<u4", n) >> np.uint32(32 - (table_bits - bits)), np.frombuffer(data, np.uint8, n, 4 * n))
                yield batch_of([bucket], [packed(out).tobytes()])

    out, size = np.zeros(1 << (table_bits - 2), np.uint8), cells // 4
    for r in levels.mapInArrow(celled, kind).toLocalIterator():  # table_bits bound what reaches the driver
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["payload"], np.uint8)
    return out, table_bits


def packed(levels: np.ndarray) -> np.ndarray:
    x = levels.reshape(-1, 4)
    return x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6


def level_of(table_: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    cell = (anchor >> np.uint64(64 - bits)).astype(np.int64)
    return table_[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8) & 3


# Step 3: suffixes are rows of a matrix of bytes, with their lengths.


def common(hashes: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common extension of rows i and j, by binary search over the hashes of their prefixes."""
    low, high = np.zeros(len(i), np.int64), np.minimum(lengths[i], lengths[j]).astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = hashes[i, middle] == hashes[j, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(data: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by group, then suffix, and each one's common extension with the one before (-1 at a group's first).

    group is sorted. All groups are merged at once: runs of 1, 2, 4, ... rows of one group, two by two; a row finds its place in the
    other run by binary search.
    """
    n, width = data.shape
    up = Powers()
    up.grow(width + 1)
    hashes = np.zeros((n, width + 1), np.uint64)
    np.cumsum(TABLE[data] * up.up[:width], axis=1, out=hashes[:, 1:])
    start = np.searchsorted(group, group)  # of each row's group
    end = np.searchsorted(group, group, "right")
    order, place = np.arange(n), np.arange(n)
    run = 1
    largest = int((end - start).max(initial=0))
    padded = np.zeros((n, width + 1), np.int16)
    padded[:, :width] = data
    padded[:, :width] += 1
    padded[np.arange(width + 1) >= lengths[:, None]] = 0
    while run < largest:
        inside = place - start
        block = inside // (2 * run)
        second = inside % (2 * run) >= run
        other = start + block * 2 * run + np.where(second, 0, run)
        low = np.minimum(other, end)
        high = np.minimum(other + run, end)
        first = low.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            mine, theirs = order[active], order[middle]
            k = common(hashes, lengths, mine, theirs)
            less = np.where(second[active], padded[theirs, k] <= padded[mine, k], padded[theirs, k] < padded[mine, k])
            low[active] = np.where(less, middle + 1, low[active])
            high[active] = np.where(less, high[active], middle)
            active = active[low[active] < high[active]]
        own = start + block * 2 * run + np.where(second, run, 0)
        target = start + block * 2 * run + (place - own) + (low - first)
        new = np.empty_like(order)
        new[target] = order
        order, run = new, run * 2
    extension = np.full(n, -1, np.int64)
    if n > 1:
        mates = np.flatnonzero(group[1:] == group[:-1]) + 1
        extension[mates] = common(hashes, lengths, order[mates - 1], order[mates])
        a, b = padded[order[mates - 1]], padded[order[mates]]
        apart = np.argmax((a != b) | (a == 0), axis=1)
        ordered = np.take_along_axis(a, apart[:, None], 1) <= np.take_along_axis(b, apart[:, None], 1)
        if (apart != extension[mates]).any() or not ordered.all():  # hashes collided
            order = np.lexsort([*padded.T[::-1], group])
            a, b = padded[order[mates - 1]], padded[order[mates]]
            extension[mates] = np.argmax((a != b) | (a == 0), axis=1)
    return order, extension


def equal_strings(rows: np.ndarray, context: list[bytes], rules: SuffixRules) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of different contexts of anchors, sorted by anchor: for each k the rows that have a string k bytes before the anchor, and which of
    them have an earlier equal one. Rows of the same document and place are as early as each other."""
    n = len(rows)
    before, after = np.zeros((n, rules.before), np.uint8), np.zeros((n, rules.length), np.uint8)
    for i, (c, k) in enumerate(zip(context, rows["left"].tolist())):
        x = np.frombuffer(c, np.uint8)
        before[i, :k] = x[:k][::-1]
        after[i, : len(x) - k] = x[k:]
    group = np.cumsum(np.concatenate([[0], rows["anchor"][1:] != rows["anchor"][:-1]])) if n else np.zeros(0, np.int64)
    right, right_shared = suffix_sort(after, rows["right"], group)
    left, left_shared = suffix_sort(before, rows["left"], group)
    rank, order = np.zeros(n, np.int64), np.lexsort([rows["pos"], rows["doc"]])
    rank[order[1:]] = np.cumsum((rows["doc"][order[1:]] != rows["doc"][order[:-1]]) | (rows["pos"][order[1:]] != rows["pos"][order[:-1]]))
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(rules.before + 1):
        run_right[right] = np.cumsum(right_shared < rules.length - k)
        run_left[left] = np.cumsum(left_shared < k)
        some = np.flatnonzero((rows["left"] >= k) & (rows["right"] >= rules.length - k))
        if len(some):
            key = run_right[some] * (n + 1) + run_left[some]
            order = np.lexsort([rank[some], key])
            some, key = some[order], key[order]
            begin = np.concatenate([[True], key[1:] != key[:-1]])
            yield k, some, rank[some] > rank[some][begin][np.cumsum(begin) - 1]


def cover(rows: np.ndarray, context: list[bytes], rules: SuffixRules) -> tuple[np.ndarray, np.ndarray]:
    """Of different contexts of anchors, sorted by anchor: how many bytes before each anchor, and from it on, are covered."""
    reach_left, reach_right = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, some, later in equal_strings(rows, context, rules):
        later = some[later]
        reach_left[later] = np.maximum(reach_left[later], k)
        reach_right[later] = np.maximum(reach_right[later], rules.length - k)
    return reach_left, reach_right


KIND = "doc bigint, key bigint, bucket int, payload binary"
KNOWN = "doc bigint, key bigint, payload binary"


def dealt(doc: list, key: list, bucket: list, payload: list) -> pa.RecordBatch:
    columns = zip([doc, key, bucket, payload], [pa.int64(), pa.int64(), pa.int32(), pa.binary()])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["doc", "key", "bucket", "payload"])


def intervals_of(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows of KIND that hold the merged intervals of each row of the table that rows come from."""
    order = np.lexsort([lo, rows["key"], rows["doc"]])
    doc, key, lo, hi = rows["doc"][order], rows["key"][order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)]):
        reach = np.maximum.accumulate(hi[a:b])
        new = np.concatenate([[True], lo[a + 1 : b] > reach[:-1]])
        ends = reach[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)]
        out.append(np.stack([lo[a:b][new], ends], 1).astype("<i4").tobytes())
    return dealt(doc[first].tolist(), key[first].tolist(), [None] * len(out), out)


def digest_of(pieces: Iterator[bytes]) -> np.ndarray:
    """Pairs of 64-bit numbers: the first half of each piece's SHA-256."""
    return np.frombuffer(b"".join([hashlib.sha256(x).digest()[:16] for x in pieces]), "<u8").reshape(-1, 2)


def earliest(rows: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by names, doc, pos and key; of those, which have an earlier equal one; and which repeat the row before in all."""
    order = np.lexsort([rows["key"], rows["pos"], rows["doc"], *(rows[n] for n in reversed(names))])
    x = rows[order]
    begin = np.ones(len(x), bool)
    begin[1:] = np.logical_or.reduce([x[n][1:] != x[n][:-1] for n in names])
    first = x[begin][np.cumsum(begin) - 1]
    again = ~begin
    again[1:] &= (x["doc"][1:] == x["doc"][:-1]) & (x["pos"][1:] == x["pos"][:-1]) & (x["key"][1:] == x["key"][:-1])
    return order, (x["doc"] != first["doc"]) | (x["pos"] != first["pos"]), again


SAME = ("anchor", "d1", "d2", "left")
PLACE = ("doc", "key", "pos", "left", "right")


def wired(rows: np.ndarray, contexts: np.ndarray) -> bytes:
    """Rows of SENT by columns: those of anchors with one context go by its digest, the others by anchor and context."""
    several = rows["several"] > 0
    out = [np.array([(~several).sum(), several.sum()], "<i8").tobytes()]
    for some, names in ((~several, ("d1", "d2", *PLACE)), (several, ("anchor", *PLACE))):
        out += [np.ascontiguousarray(rows[n][some]).tobytes() for n in names]
    return b"".join([*out, *contexts[several].tolist()])


def unwired(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Rows of SENT, anchors left out where one context's digest stands for them, and their contexts."""
    one, many = np.frombuffer(raw, "<i8", 2).tolist()
    rows, at = np.zeros(one + many, SENT), 16
    rows["several"][one:] = 1
    for part, names in ((rows[:one], ("d1", "d2", *PLACE)), (rows[one:], ("anchor", *PLACE))):
        for n in names:
            part[n] = np.frombuffer(raw, SENT[n], len(part), at)
            at += SENT[n].itemsize * len(part)
    size = rows["left"][one:].astype(np.int64) + rows["right"][one:]
    ends = at + np.cumsum(size)
    contexts = [raw[e - k : e] for e, k in zip(ends.tolist(), size.tolist())]
    digest = digest_of(BYTE[k] + c for k, c in zip(rows["left"][one:].tolist(), contexts))
    rows["d1"][one:], rows["d2"][one:] = digest[:, 0], digest[:, 1]
    return rows, [b""] * one + contexts


def covered(docs: DataFrame, rules: SuffixRules = SuffixRules()) -> DataFrame:
    """doc, key and payload: intervals (pairs of little-endian 32-bit integers) of bytes to remove, in any number of rows a text. docs: doc_id, text, key."""
    spark = docs.sparkSession
    bits = min(16, max(6, (8 * docs.rdd.getNumPartitions() - 1).bit_length()))
    table_, table_bits = repeats(docs, rules, bits)
    levels = spark.sparkContext.broadcast(table_)

    def send(rows: list, contexts: list) -> Iterator[pa.RecordBatch]:
        rows, contexts = np.concatenate(rows), np.concatenate(contexts)
        order, later, again = earliest(rows, *SAME)
        x = rows[order[later]]
        yield intervals_of(x, x["pos"] - x["left"], x["pos"] + x["right"])
        order = order[~later & ~again]
        rows, contexts = rows[order], contexts[order]
        buckets, payloads, small = [], [], zstandard.ZstdCompressor(3)
        for k, i in by_bucket(rows, rows["anchor"], bits):
            payloads.append(small.compress(wired(rows[i], contexts[i])))
            buckets.append(k)
        yield dealt([None] * len(buckets), [None] * len(buckets), buckets, payloads)

    def send_strings(rows: list, contexts: list) -> Iterator[pa.RecordBatch]:
        """Anchors of very many contexts: the task's own are sorted, and the earliest of equal strings go on."""
        rows, contexts = np.concatenate(rows), np.concatenate(contexts)
        order, later, again = earliest(rows, *SAME)
        x = rows[order[later]]
        yield intervals_of(x, x["pos"] - x["left"], x["pos"] + x["right"])
        order = order[~later & ~again]
        rows, contexts = rows[order], contexts[order]
        reach_left, reach_right, out = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), []
        for k, some, later in equal_strings(rows, contexts.tolist(), rules):
            gone, first = some[later], some[~later]
            reach_left[gone], reach_right[gone] = np.maximum(reach_left[gone], k), np.maximum(reach_right[gone], rules.length - k)
            x = np.zeros(len(first), STRING)
            starts = rows["left"][first].astype(np.int64) - k
            digest = digest_of(contexts[i][a : a + rules.length] for i, a in zip(first.tolist(), starts.tolist()))
            x["d1"], x["d2"], x["doc"], x["key"], x["pos"] = digest[:, 0], digest[:, 1], rows["doc"][first], rows["key"][first], rows["pos"][first] - k
            out.append(x)
        some = np.flatnonzero(reach_right)
        yield intervals_of(rows[some], rows["pos"][some] - reach_left[some], rows["pos"][some] + reach_right[some])
        x = np.concatenate(out)
        buckets, payloads = [], []
        for k, i in by_bucket(x, x["d1"], bits):
            buckets.append((1 << bits) + k)
            payloads.append(x[i].tobytes())
        yield dealt([None] * len(buckets), [None] * len(buckets), buckets, payloads)

    def found(batches):
        powers, few, many = Powers(), ([], []), ([], [])
        for batch in batches:
            for x, buf, where in anchors(batch, rules, powers):
                level = level_of(levels.value, x["anchor"], table_bits)
                keep = np.flatnonzero(level > NONE)
                raw, x, level = buf.tobytes(), x[keep], level[keep]
                lo, hi = where[keep] - x["left"], where[keep] + x["right"]
                pieces = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
                out = np.zeros(len(x), SENT)
                for name in ("anchor", "doc", "key", "pos", "left", "right"):
                    out[name] = x[name]
                digest = digest_of(BYTE[k] + p for k, p in zip(x["left"].tolist(), pieces))
                out["d1"], out["d2"], out["several"] = digest[:, 0], digest[:, 1], level >= SEVERAL
                context = np.full(len(x), b"", object)
                for i in np.flatnonzero(level >= SEVERAL).tolist():
                    context[i] = pieces[i]
                for held, mine, most, give in ((few, level < MANY, rules.flush // 2, send), (many, level == MANY, rules.sort_rows, send_strings)):
                    if mine.any():
                        held[0].append(out[mine])
                        held[1].append(context[mine])
                        if sum(map(len, held[0])) >= most:
                            yield from give(*held)
                            held[0].clear()
                            held[1].clear()
                            release()
        if few[0]:
            yield from send(*few)
        if many[0]:
            yield from send_strings(*many)

    def resolved(key, part):
        if key[0].as_py() < 0:
            return part.select(["doc", "key", "payload"])
        out = []
        if key[0].as_py() >= 1 << bits:
            rows = np.concatenate([np.frombuffer(p.as_py(), STRING) for p in part.column("payload")])
            order, later, _ = earliest(rows, "d1", "d2")
            x = rows[order[later]]
            out.append(intervals_of(x, x["pos"], x["pos"] + rules.length))
        else:
            rows, contexts = [], []
            for p in part.column("payload"):
                x, own = unwired(zstandard.ZstdDecompressor().decompress(p.as_py()))
                rows.append(x)
                contexts += own
            rows = np.concatenate(rows)
            order, later, again = earliest(rows, *SAME)
            x = rows[order[later]]
            out.append(intervals_of(x, x["pos"] - x["left"], x["pos"] + x["right"]))
            order = order[~later & ~again]
            rows = rows[order]
            mates = np.zeros(len(rows), bool)
            same = rows["anchor"][1:] == rows["anchor"][:-1]
            mates[1:] |= same
            mates[:-1] |= same
            pick = np.flatnonzero(mates & (rows["several"] > 0))
            # Sorting takes some 3 KB a row, so of a bucket only some anchors are sorted at a time.
            for a, b in whole(rows["anchor"][pick], rules.sort_rows):
                x = rows[pick[a:b]]
                left, right = cover(x, [contexts[i] for i in order[pick[a:b]]], rules)
                some = right > 0
                out.append(intervals_of(x[some], x["pos"][some] - left[some], x["pos"][some] + right[some]))
        release()
        return pa.Table.from_batches([b.select(["doc", "key", "payload"]) for b in out])

    path = shared_path(spark, "covered")
    # Intervals that tasks know already pass through in groups of their own.
    made = docs.mapInArrow(tidy(found), KIND).withColumn("bucket", F.coalesce("bucket", -1 - F.pmod(F.xxhash64("doc", "key"), F.lit(1 << bits)).cast("int")))
    made.groupBy("bucket").applyInArrow(resolved, KNOWN).write.parquet(path)
    return spark.read.schema(KNOWN).parquet(path)


def removed(docs: DataFrame, rules: SuffixRules = SuffixRules(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; `kept` bytes if asked for."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Keys tell rows of one doc_id apart, where there are any; else they need no room.
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    docs = docs.withColumn("_key", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    spans = covered(docs, rules).groupBy("doc", "key").agg(F.collect_list("payload").alias("_spans"))
    both = docs.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("_key") == F.col("key")), "left").select("doc_id", "text", "_spans")

    def cut_out(batches):
        for batch in batches:
            rows = []
            data, offsets = buffers(batch.column(1))
            raw = memoryview(data)
            for i, spans in enumerate(batch.column(2).to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                x = np.concatenate([np.frombuffer(s, "<i4") for s in spans]).reshape(-1, 2).astype(np.int64) if spans else np.zeros((0, 2), np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                digest, at, n, runs, kept = hashlib.sha256(), 0, 0, 0, []
                for lo, hi in x.tolist():
                    hi = min(hi, b - a)
                    if hi <= at and runs:
                        continue
                    if lo > at or not runs:
                        digest.update(raw[a + at : a + lo])
                        if with_text:
                            kept.append(bytes(raw[a + at : a + lo]))
                        runs, at = runs + 1, lo
                    n, at = n + hi - at, hi
                digest.update(raw[a + at : b])
                if with_text:
                    kept.append(bytes(raw[a + at : b]))
                rows.append((b - a, n, runs, digest.hexdigest(), b"".join(kept) if with_text else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.mapInArrow(tidy(cut_out), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
