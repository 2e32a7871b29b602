r"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Documents are encoded and cut into pieces of at most `capacity` tokens; a document of one piece is never cut. How many pieces each
length has is all that planning needs: at most `capacity` numbers come to the driver, whatever the corpus. Best fit in descending
order of length runs over counts: sequences of equal contents are one group with a range of sequence numbers, a length's pieces go to the
group with the least room that takes one, as many to each of its sequences as fit, and new sequences are opened when no group has room.
The plan has a row for every group that a length's pieces went to: the first of their ranks, how many, the sequences, and where in them.

Pieces are ranked within their length without gathering them: a task numbers its own, tasks' counts are added up by length, and a
piece takes the planned slot that holds its rank. So a length that a third of all pieces have is spread over all tasks. The plan is
broadcast up to `most_slots` rows and joined by a shuffle beyond; both take every piece to the same slot.

Pieces lie in a stored table, written by the tasks that numbered them, so ranks don't change when executors are lost.

Defined cases: a null text is an empty one, whose only token is the end id; rows of one doc_id and rows without one are documents of
their own; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import stored, table, tidy
from marketloom.llm.tokens import kept_encoder, slices, vocabulary_path


@dataclass(frozen=True)
class PackingRules:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 1
    capacity: int = 4096
    most_words: int = 700_000
    most_slots: int = 100_000


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
SLOTS = "length bigint, first bigint, n bigint, sequence bigint, each bigint, used bigint"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots for counts pieces of each length, and the number of sequences.

    A slot (length, first, n, sequence, each, used): the pieces of ranks first to first + n - 1 go to the sequences from `sequence`
    on, `each` to a sequence, one after the other from place `used` on.
    """
    slots, n_sequences = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left: first sequence, number of sequences
    rooms = np.zeros(capacity + 1, np.int64)  # groups of each room

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((first, n))
            rooms[room] += 1

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                first, n = groups[room].pop()
                rooms[room] -= 1
            else:
                room, first, n = capacity, n_sequences, -(-left // (capacity // length))
                n_sequences += n
            each = room // length
            full, rest = min(n, left // each), left % each
            partly = full < n and rest > 0
            taken = full * each + (rest if partly else 0)
            slots.append((length, rank, taken, first, each, capacity - room))
            put(room - each * length, first, full)
            if partly:
                put(room - rest * length, first + full, 1)
            put(room, first + full + partly, n - full - partly)
            rank, left = rank + taken, left - taken
    return slots, n_sequences


def cut(docs: DataFrame, rules: PackingRules, with_ids: bool = False) -> DataFrame:
    """The documents' pieces: doc_id, piece, start, length, ids_crc32, the task that made it and its place among that task's pieces of its length; ids if asked for."""
    path = vocabulary_path(rules.vocabulary)

    def made(batches):
        from pyspark import TaskContext

        encode, part, seen = kept_encoder(path, rules.most_words), TaskContext.get().partitionId(), np.zeros(rules.capacity + 1, np.int64)
        for batch in batches:
            for doc_ids, texts in slices(batch):
                ids, sizes = encode(texts, rules.end_id)
                data, ends = ids.astype("<u4"), np.cumsum(sizes)
                n = -(-sizes // rules.capacity)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * rules.capacity
                length = np.minimum(rules.capacity, np.repeat(sizes, n) - start)
                at = np.repeat(ends - sizes, n) + start
                order = np.argsort(length, kind="stable")
                own, firsts, many = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(firsts, many) + np.repeat(seen[own], many)
                seen[own] += many
                cuts = list(zip(at.tolist(), (at + length).tolist()))
                rows = {
                    "doc_id": pa.array(doc_ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))), "piece": pa.array(piece, pa.int32()), "start": start, "length": length,
                    "ids_crc32": pa.array([zlib.crc32(data[a:b]) for a, b in cuts], pa.int64()), "part": pa.array(np.full(len(length), part), pa.int32()), "place": place,
                }
                if with_ids:
                    rows["ids"] = pa.array([data[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(rows)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(made), PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, rules: PackingRules = PackingRules(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; its ids if asked for."""
    spark = docs.sparkSession
    pieces = stored(cut(docs, rules, with_ids), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("_n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row a length
    slots, _ = plan(histogram, rules.capacity)
    planned = spark.createDataFrame(slots, SLOTS).select(F.col("length").alias("_l"), "first", "n", "sequence", "each", "used")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    ranked = pieces.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("_before")), ["part", "length"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("place"))
    planned = F.broadcast(planned) if len(slots) <= rules.most_slots else planned
    found = ranked.join(planned, (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n")))
    k = F.col("_rank") - F.col("first")
    sequence, offset = (F.col("sequence") + F.expr("(_rank - first) div each")), F.col("used") + F.pmod(k, F.col("each")) * F.col("length")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *["ids"] * with_ids)


def sequences(docs: DataFrame, rules: PackingRules = PackingRules()) -> DataFrame:
    """The packed sequences: sequence_id, ids, and the lengths of the pieces in them, in order. A sequence has at most `capacity` tokens."""
    rows = pack(docs, rules, with_ids=True)
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.length").alias("lengths"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
