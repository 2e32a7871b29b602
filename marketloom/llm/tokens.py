r"""Token ids as directly addressable codes.

Documents are dealt by ranges of doc_id, encoded, and packed in segments. A segment is one file body: a header, the documents'
ids and first tokens, and the codes; beside it stands the number of its partition's tokens before it. Every id is split into chunks of `bits` bits, lowest first; level k holds the k-th chunks of
the ids that have one, a continuation bitmap tells which of its ids go on, and a rank directory counts the set bits before each
block of 512. The chunk of id i at the next level stands at rank(i), so any token is read without decoding what is around it.

Segments are binary rows of a Parquet table, so they are written and committed by Spark in whatever store its paths name, and a
lost executor's files are written anew. Reading needs the table alone.

Ids are those that the tokenizers library gives for the whole text without adding special tokens: strings of special tokens that
stand in a text are those tokens. A text is encoded word by word where the tokenizer never joins what white space parts, which is
read from its file; then a word that comes again in a task is encoded once. Other tokenizers get whole texts.

lookup() finds tokens by their place in the whole output, through the segments' first places and their rank directories.

Defined cases: a null text is an empty one, whose only token is the end id; a null doc_id comes first; rows of one doc_id follow
by hash and text; an empty table gives no segment; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import shared_path, table, tidy
from marketloom.llm.fingerprints import TABLE, Powers, buffers, word_hashes

MAGIC, BLOCK = b"DACS", 512
HEAD = "<4sBBxxQQ"  # magic, bits, levels, documents, tokens


@dataclass(frozen=True)
class TokenRules:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    bits: int = 8
    segment_tokens: int = 1 << 20
    most_words: int = 700_000


def pack(doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """A segment's file body. starts: the first token of each document, counted in the segment."""
    levels, rest = [], ids.astype(np.uint32)
    mask = (1 << bits) - 1
    while True:
        more = rest > mask
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(more[: len(more) // BLOCK * BLOCK].reshape(-1, BLOCK).sum(1))]).astype("<u8")
        chunks = (rest & mask).astype("<u1" if bits <= 8 else "<u2")
        levels.append([struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)), ranks.tobytes(), bitmap.tobytes(), chunks.tobytes()])
        rest = rest[more] >> bits
        if not len(rest):
            break
    head = struct.pack(HEAD, MAGIC, bits, len(levels), len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype("<u1").tobytes(), starts.astype("<u8").tobytes(), *(x for lv in levels for x in lv)])


class Segment:
    """A segment read from its file body: its documents, any single token, and all of a document's."""

    def __init__(self, body: bytes):
        magic, self.bits, n_levels, self.n_docs, self.n_tokens = struct.unpack_from(HEAD, body)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.starts = take("<i8", self.n_docs), take("<u1", self.n_docs), take("<u8", self.n_docs)
        self.levels = []
        for _ in range(n_levels):
            n, n_bitmap, n_ranks = struct.unpack_from("<QQQ", body, at)
            at += 24
            self.levels.append((take("<u8", n_ranks), take("<u1", n_bitmap), take("<u1" if self.bits <= 8 else "<u2", n)))

    def token(self, i: int) -> int:
        """The i-th id, read through the rank directories."""
        out = shift = 0
        for ranks, bitmap, chunks in self.levels:
            out |= int(chunks[i]) << shift
            shift += self.bits
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            before = np.unpackbits(bitmap[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(ranks[i // BLOCK]) + int(before.sum())
        return out

    def ids(self) -> np.ndarray:
        out, where = np.zeros(self.n_tokens, np.uint32), None
        for k, (_, bitmap, chunks) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(self.bits * k)
            more = np.unpackbits(bitmap, bitorder="little", count=len(chunks)).view(bool)
            if where is None:
                out |= part
                where = np.flatnonzero(more)
            else:
                out[where] |= part
                where = where[more]
        return out

    def bounds(self) -> np.ndarray:
        return np.append(self.starts, np.uint64(self.n_tokens)).astype(np.int64)


#: A word of letters, and marks after it: the tokenizer takes either as one piece, whatever stands around the word.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
# What a tokenizer file must say for its words to be encoded one by one.
WORD_END = "</w>"
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def wordwise(path: str) -> bool:
    """Whether a tokenizer encodes a text as its words, parted by ASCII white space, one after the other. Read from its file."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in said["added_tokens"])
    model = said["model"]
    same = all(said[k] == v for k, v in WORDWISE.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END
    return apart and same and not model["dropout"] and not said["truncation"] and not said["padding"]


class Encoder:
    """Ids of texts, as the tokenizers library gives them.

    Where the tokenizer is wordwise() each different word is encoded once. A word is found by its 64-bit hash and its bytes are compared;
    texts of a batch in which two words share a hash are encoded whole, as are all texts of other tokenizers. `literal`: strings of special tokens are
    ordinary text; by default they are the library's special tokens.
    """

    def __init__(self, path: str, most: int, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.powers, self.by_word = Tokenizer.from_file(path), most, Powers(), wordwise(path)
        if literal:
            self.tokenizer.encode_special_tokens = True
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.parts, self.hashes = {"": b""}, np.zeros(0, np.uint64)  # sorted
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.begins, self.lengths, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def encoded(self, words: list[str], together: int = 64, at_once: int = 4096) -> list[bytes]:
        """Ids of each word. Letters are encoded many in a text and told apart by their last ids; other words one by one."""
        encode = lambda texts: self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        parts = self.parts
        split = [(m[1].lower(), m[2]) if (m := PLAIN.fullmatch(w)) else (None, w) for w in words]
        cores = list({c for c, _ in split if c}.difference(parts))
        single = list({m for _, m in split}.difference(parts))
        for i in range(0, len(cores), at_once):
            some = cores[i : i + at_once]
            rows = [some[k : k + together] for k in range(0, len(some), together)]
            for row, e in zip(rows, encode([" ".join(r) for r in rows])):
                ids = np.array(e.ids, "<u4")
                cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                data = ids.tobytes()
                if len(cuts) != len(row) or cuts[-1] != len(data):
                    single += row
                else:
                    parts.update(zip(row, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        for i in range(0, len(single), at_once):
            some = single[i : i + at_once]
            parts.update(zip(some, [np.array(e.ids, "<u4").tobytes() for e in encode(some)]))
        return [parts[c] + parts[m] if c else parts[m] for c, m in split]

    def whole(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As a call, every text given to the library as it is."""
        ids = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end_id after each text's, and how many each text has."""
        if not self.by_word:
            return self.whole(texts, end_id)
        data, offsets = buffers(texts)
        hashes, firsts, starts, ends = word_hashes(data, offsets, self.powers, TABLE)
        different, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self.forget()
        new = np.flatnonzero(~np.isin(different, self.hashes, assume_unique=True))
        if len(new):
            raw, a, b = data.tobytes(), starts[where[new]], ends[where[new]]
            own = [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]
            ids = self.encoded([w.decode() for w in own])
            sizes, lengths = np.array([len(x) // 4 for x in ids], np.int64), b - a
            order = np.argsort(all_ := np.concatenate([self.hashes, different[new]]))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])[order]
            self.begins = np.concatenate([self.begins, len(self.letters) + np.cumsum(lengths) - lengths])[order]
            self.hashes, self.sizes, self.lengths = all_[order], np.concatenate([self.sizes, sizes])[order], np.concatenate([self.lengths, lengths])[order]
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(own), np.uint8)])
        known = np.searchsorted(self.hashes, different)[which]
        lengths = ends - starts
        if (self.lengths[known] != lengths).any():
            return self.whole(texts, end_id)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.arange(upto[-1])
        if (data[np.repeat(starts - upto[:-1], lengths) + inside] != self.letters[np.repeat(self.begins[known] - upto[:-1], lengths) + inside]).any():
            return self.whole(texts, end_id)
        sizes = self.sizes[known]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.pool[np.repeat(self.starts[known] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[firsts]
        return np.insert(flat, bounds[1:], end_id), np.diff(bounds) + 1


def kept_encoder(path: str, most: int, literal: bool = False) -> Encoder:
    """The worker process's encoder: words that one of its tasks has met are known to the next. Kept in a module of its own, as this one's code is copied to workers."""
    kept = sys.modules.setdefault("_marketloom_kept", types.ModuleType("_marketloom_kept")).__dict__.setdefault("encoders", {})
    key = (path, literal)
    if key not in kept:
        kept[key] = Encoder(path, most, literal)
    return kept[key]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[list, pa.Array]]:
    """The doc_ids and texts of a batch, in runs of at most `most` bytes of text, or one longer text."""
    _, offsets = buffers(batch.column(1))
    row = 0
    while row < len(batch):
        last = min(len(batch), max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield batch.column(0)[row:last].to_pylist(), batch.column(1)[row:last]
        row = last


SEGMENTS = "partition int, number int, first bigint, n_docs bigint, n_tokens bigint, body binary"


def segments(docs: DataFrame, rules: TokenRules = TokenRules()) -> DataFrame:
    """Segments of all documents: by partition, then number, they are in ascending doc_id order."""
    path = vocabulary_path(rules.vocabulary)

    def packed(batches):
        from pyspark import TaskContext

        encode, part, number, first = kept_encoder(path, rules.most_words), TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def body():
            ids, nulls, lengths = np.array([d or 0 for d in docs], np.int64), np.array([d is None for d in docs]), np.concatenate([n for _, n in held])
            data = pack(ids, nulls, np.cumsum(lengths) - lengths, np.concatenate([x for x, _ in held]), rules.bits)
            return pa.RecordBatch.from_pydict({"partition": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "first": [first], "n_docs": [len(docs)], "n_tokens": [size], "body": pa.array([data], pa.binary())})

        for batch in batches:
            for ids, texts in slices(batch):
                held.append(encode(texts, rules.end_id))
                docs += ids
                size += len(held[-1][0])
                if size >= rules.segment_tokens:
                    yield body()
                    number, first, docs, held, size = number + 1, first + size, [], [], 0
        if docs:
            yield body()

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return dealt.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(packed), SEGMENTS)


def write(docs: DataFrame, path: str, rules: TokenRules = TokenRules()) -> None:
    segments(docs, rules).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the segments at path."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    totals = {r[0]: r[1] for r in rows.groupBy("partition").agg(F.sum("n_tokens")).collect()}  # one number a partition
    offsets, total = {}, 0
    for p in sorted(totals):
        offsets[p] = total
        total += totals[p]
    shared = spark.sparkContext.broadcast(offsets)

    def unpacked(batches):
        for batch in batches:
            for part, first, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seg = Segment(body)
                data, bounds = seg.ids().astype("<u4"), seg.bounds()
                crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(seg.doc_ids, pa.int64(), mask=seg.nulls.astype(bool)), "start": bounds[:-1] + (shared.value[part] + first),
                    "n_tokens": np.diff(bounds), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return rows.select("partition", "first", "body").mapInArrow(tidy(unpacked), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, positions: DataFrame, together: int = 4096) -> DataFrame:
    """position and id of the tokens at positions (position) of the whole output; places beyond it give no row.

    Segments and positions meet by cells of 2**20 places, of which a segment covers few; a segment's body is read once for up to
    `together` of its positions, and no code is decoded but those asked for.
    """
    rows, cell = spark.read.schema(SEGMENTS).parquet(path), 20
    sums = rows.groupBy("partition").agg(F.sum("n_tokens").alias("_n"))
    before = sums.select(F.col("partition").alias("_p"), (F.sum("_n").over(Window.orderBy("partition")) - F.col("_n")).alias("_b"))  # one row a partition
    placed = rows.select("partition", "number", "first", "n_tokens").join(before, F.col("partition") == F.col("_p"))
    low = F.col("_b") + F.col("first")
    placed = placed.select("partition", "number", low.alias("_low"), (low + F.col("n_tokens")).alias("_high"))
    placed = placed.withColumn("_cell", F.explode(F.sequence(F.shiftright("_low", cell), F.shiftright(F.col("_high") - 1, cell))))
    asked = positions.select(F.col("position").cast("bigint").alias("position")).distinct().withColumn("_cell", F.shiftright("position", cell))
    met = asked.join(placed, "_cell").filter("position >= _low AND position < _high").withColumn("_s", F.pmod(F.xxhash64("position"), F.lit(1 + (1 << cell) // together)))
    met = met.groupBy("partition", "number", "_low", "_s").agg(F.collect_list("position").alias("_at"))
    both = met.join(rows.select("partition", "number", "body"), ["partition", "number"]).select("_low", "_at", "body")

    def found(batches):
        for batch in batches:
            for first, at, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seg = Segment(body)
                yield pa.RecordBatch.from_pydict({"position": pa.array(at, pa.int64()), "id": pa.array([seg.token(p - first) for p in at], pa.int64())})

    return both.mapInArrow(tidy(found), "position bigint, id bigint")


def encode(docs: DataFrame, rules: TokenRules = TokenRules()) -> DataFrame:
    """Writes the segments of docs to the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, rules)
    return read(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents' places and digests in the written token files."""
    return encode(docs)
