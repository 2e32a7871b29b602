r"""Token counts of flat token files: searches for end-of-document ids, block by block.

A flat file is nothing but ids of one width, a document's ids followed by the end id; it has no index. Files are cut into blocks of
`block_tokens` ids. Each block is searched at once for the end id and gives the documents that begin and end in it, where its first
and last end stand, and how many there are. A prefix scan over a file's blocks, of one small row each, hands every block the last
end before it and the number of documents before it; so the document that ends first in a block gets its whole length, over however
many blocks it runs. What follows the last end of a file is an unended document.

Files are read by byte ranges through the file system that their URI names. Writing gives a manifest, a row a file; what a lost or
repeated task left behind is in no manifest.

Strings of special tokens in a text are encoded as ordinary text, so that the end id stands nowhere but at ends.

Defined cases: an empty file has no documents; an id that needs more bytes than the width raises; two ends in a row are a document of the end id alone; a null text is an empty one; an
empty table gives no file; a byte count that is no multiple of the width raises.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import shared_path, table, tidy
from marketloom.llm.tokens import kept_encoder, slices, vocabulary_path


@dataclass(frozen=True)
class CountRules:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 49407
    width: int = 2
    block_tokens: int = 1 << 20
    file_tokens: int = 1 << 24
    most_words: int = 700_000


def opened(uri: str):
    """The file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write_flat(docs: DataFrame, folder: str, rules: CountRules = CountRules()) -> DataFrame:
    """Writes flat files below folder. Rows: file, n_bytes, and the doc_ids in their order, kept beside the files as Parquet."""
    path = vocabulary_path(rules.vocabulary)

    def written(batches):
        encode = kept_encoder(path, rules.most_words, literal=True)
        system, base = opened(folder)
        system.create_dir(f"{base}/flat")
        state = {"out": None, "ids": [], "n": 0, "name": ""}

        def closed():
            state["out"].close()
            state["out"] = None
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/flat/{state['name']}"], "n_bytes": [state["n"] * rules.width], "doc_ids": pa.array([state["ids"]], pa.list_(pa.int64()))})

        for batch in batches:
            for ids, texts in slices(batch):
                if state["out"] is None:
                    state |= {"name": f"{uuid.uuid4().hex}.bin", "ids": [], "n": 0}
                    state["out"] = system.open_output_stream(f"{base}/flat/{state['name']}")
                flat, _ = encode(texts, rules.end_id)
                if flat.max(initial=0) >> (8 * rules.width):
                    raise ValueError(f"id {flat.max()} needs more than {rules.width} bytes")
                state["out"].write(flat.astype(f"<u{rules.width}").tobytes())
                state["ids"] += ids
                state["n"] += len(flat)
                if state["n"] >= rules.file_tokens:
                    yield closed()
        if state["out"] is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(written), "file string, n_bytes bigint, doc_ids array<bigint>")
    rows.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def count_flat(files: DataFrame, rules: CountRules = CountRules()) -> DataFrame:
    """file, ordinal (from 0), start, n_tokens (with the end id) and ended, of every document of files (file, n_bytes)."""
    size, width, end_id = rules.block_tokens, rules.width, rules.end_id
    blocks = files.select("file", "n_bytes", F.assert_true(F.col("n_bytes") % width == 0).alias("_ok")).filter("n_bytes > 0 AND _ok IS NULL")
    blocks = blocks.select("file", (F.col("n_bytes") / width).cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") / width - 1) / size))).alias("block"))
    blocks = blocks.repartition("file", "block")

    def searched(batches):
        for batch in batches:
            for file, n, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, path = opened(file)
                first = block * size
                with system.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(min(size, n - first) * width, first * width), f"<u{width}")
                ends = np.flatnonzero(data == end_id) + first
                yield pa.RecordBatch.from_pydict({
                    "file": [file], "n": pa.array([n], pa.int64()), "block": pa.array([block], pa.int64()), "n_ends": pa.array([len(ends)], pa.int64()),
                    "last_end": pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64())),
                })

    found = blocks.mapInArrow(tidy(searched), "file string, n bigint, block bigint, n_ends bigint, last_end bigint, ends array<bigint>")
    # The scan: over a file's blocks, the last end and the number of ends before each.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    found = found.withColumns({
        "_last": F.coalesce(F.max("last_end").over(before), F.lit(-1).cast("bigint")), "_docs": F.coalesce(F.sum("n_ends").over(before), F.lit(0).cast("bigint")),
        "_end": F.coalesce(F.max("last_end").over(whole), F.lit(-1).cast("bigint")), "_all": F.sum("n_ends").over(whole),
    })
    begun = lambda i: F.when(i == 0, F.col("_last")).otherwise(F.get("ends", i - 1)) + 1
    inside = F.transform("ends", lambda e, i: F.struct((F.col("_docs") + i).alias("ordinal"), begun(i).alias("start"), (e + 1 - begun(i)).alias("n_tokens"), F.lit(True).alias("ended")))
    rest = F.struct(F.col("_all").alias("ordinal"), (F.col("_end") + 1).alias("start"), (F.col("n") - F.col("_end") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    tail = F.when((F.col("block") == F.floor((F.col("n") - 1) / size)) & (F.col("_end") < F.col("n") - 1), F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0))
    return found.select("file", F.inline(F.concat(inside, tail)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: documents are written as flat files, which are then counted; the manifest's order names the documents."""
    manifest = write_flat(table(spark, sf_dir, "documents"), shared_path(spark, "flat"))
    named = manifest.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    named = named.withColumn("ordinal", F.col("ordinal").cast("bigint")).hint("merge")  # a packed manifest looks small, its documents are not
    return count_flat(manifest.select("file", "n_bytes")).join(named, ["file", "ordinal"]).select("doc_id", "n_tokens", "ended")
