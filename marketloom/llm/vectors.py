r"""Vector codes: product quantisation in whole numbers, whose search drops codebook entries by partial distances.

Components are taken as floor(scale x). Vectors are cut into `parts` equal consecutive parts; a part's codebook starts as that part
of the `entries` vectors of the smallest vec_ids, and each round assigns every part to its nearest entry and moves an entry to the
floor of its parts' mean.

Search: a part's positions are taken in descending order of the codebook's variance there. After the first of them, each vector's
entry of the least partial distance so far (the lowest, of several) is measured completely; that is the first best distance. From
then on masks over all pairs of a vector and an entry drop those whose accumulated distance strictly exceeds the vector's best
complete distance, so entries equally near stay and the lowest of them is taken. Distances are 64-bit whole numbers: results are exact.

What travels: a round's sums of entries, at most parts x entries rows a task before they are added up, and to the driver the
codebooks alone, whose size is given by the rules and the vectors' length. Vectors stay in one stored table, from which every round reads.

Defined cases: vectors that are null or hold a null, NaN or infinite component are dropped; fewer vectors than entries make smaller
codebooks; vectors shorter than the longest, and lengths that the parts don't divide, are filled up with zeros at the end; rows of
one vec_id are vectors of their own, in the order of their components, rows without vec_id come last; null labels are one label; an
empty table gives an empty result; a component beyond `most` in size would overflow the sums and raises an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import stored, table, tidy


@dataclass(frozen=True)
class VectorRules:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    most: int = 1 << 26
    #: Vectors that are searched together.
    block: int = 2048


def nearest(x: np.ndarray, book: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of x, the number of the nearest row of book (the lowest, of several) and its squared distance."""
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ordered = np.ascontiguousarray(book[:, order])
    for a in range(0, len(x), block):
        rows = np.ascontiguousarray(x[a : a + block][:, order])
        # Every entry by the first positions, then one whole distance a row.
        head = min(4, len(order))
        partial = np.zeros((len(rows), len(book)), np.int64)
        for k in range(head):
            partial += (rows[:, k, None] - ordered[None, :, k]) ** 2
        best = ((rows - ordered[partial.argmin(1)]) ** 2).sum(1)
        row, entry = np.nonzero(partial <= best[:, None])
        distance = partial[row, entry]
        for k in range(head, len(order)):
            distance += (rows[row, k] - ordered[entry, k]) ** 2
            near = distance <= best[row]
            row, entry, distance = row[near], entry[near], distance[near]
        # Pairs are in order of row, then entry: the first of a row's least distances.
        order_ = np.lexsort((entry, distance, row))
        first = order_[np.r_[True, row[order_][1:] != row[order_][:-1]]] if len(row) else order_
        codes[a : a + block], errors[a : a + block] = entry[first], distance[first]
    return codes, errors


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def whole(vectors: DataFrame, rules: VectorRules) -> DataFrame:
    """vec_id, label and whole components of the vectors that count."""
    known = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("_e"))
    finite = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("_e", lambda x: F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * rules.scale))
    return known.filter(F.col("_e").isNotNull() & finite).select("vec_id", "label", scaled.alias("v"))


def codebooks(vectors: DataFrame, width: int, rules: VectorRules) -> np.ndarray:
    """The final codebooks (part, entry, position) of stored whole vectors."""
    # One row an entry of the first codebooks.
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(rules.entries).select("v").collect()
    books = np.array([r["v"] + [0] * (width - len(r["v"])) for r in first], np.int64).reshape(len(first), rules.parts, width // rules.parts).transpose(1, 0, 2)
    for _ in range(rules.rounds):
        books = moved(vectors, books, width, rules)
    return books


def moved(vectors: DataFrame, books: np.ndarray, width: int, rules: VectorRules) -> np.ndarray:
    """The codebooks after one round."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, size = books.shape

    def summed(batches):
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width).reshape(-1, parts, size)
            for p in range(parts):
                codes, _ = nearest(x[:, p], shared.value[p], rules.block)
                order = np.argsort(codes, kind="stable")
                found, starts = np.unique(codes[order], return_index=True)
                if len(found):
                    sums[p * entries + found] += np.add.reduceat(x[order, p], starts)
                    counts[p * entries + found] += np.diff(np.append(starts, len(order)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"entry": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64()), "sums": pa.array(list(sums[used]), pa.list_(pa.int64()))})

    rows = vectors.select("v").mapInArrow(tidy(summed), "entry bigint, n bigint, sums array<bigint>")
    added = rows.select("entry", "n", F.posexplode("sums")).groupBy("entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    out = books.reshape(-1, size).copy()
    # One row a component of a codebook.
    for r in added.collect():
        out[r["entry"], r["pos"]] = r["s"] // r["n"]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, rules: VectorRules = VectorRules()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (an index of an entry for each part) and error of the vectors that count, and the codebooks."""
    kept = stored(whole(vectors, rules), "vectors")
    longest, greatest = kept.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if greatest is not None and greatest > rules.most:
        raise ValueError(f"a component of {greatest} is beyond {rules.most}")
    width = -(-max(longest or 0, 1) // rules.parts) * rules.parts
    books = codebooks(kept, width, rules)
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts = rules.parts

    def coded(batches):
        for batch in batches:
            x = matrix(batch.column(2), width).reshape(len(batch), parts, -1)
            found = [nearest(x[:, p], shared.value[p], rules.block) for p in range(parts)]
            codes, errors = np.stack([c for c, _ in found], 1), sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(codes), pa.list_(pa.int64())), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(tidy(coded), f"vec_id bigint, label {label}, code array<bigint>, error bigint"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = encode(table(spark, sf_dir, "embeddings"))
    rows = stored(rows, "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.lower(F.array_join(F.transform("code", lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds(n: int) -> str:
    """Assignment k takes codebook k; codebook k + 1 has its means, or codebook k's entries where nothing is assigned."""
    made = ["b0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, x FROM q QUALIFY e < 256)"]
    for k in range(n + 1):
        made.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT q.vec_id, q.label, q.p, b.e, q.xx + list_inner_product(b.x, b.x) - 2 * list_inner_product(q.x, b.x) AS d FROM q JOIN b{k} b ON b.p = q.p) GROUP BY 1, 2, 3)")
        if k < n:
            made.append(f"m{k} AS (SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS c FROM (SELECT q.p, a.e, q.x, unnest(range(1, len(q.x) + 1)) AS i FROM a{k} a JOIN q ON q.vec_id = a.vec_id AND q.p = a.p) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            made.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)")
    return ",\n".join(made)


ORACLE = f"""
WITH v AS (SELECT vec_id, label, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS MATERIALIZED (SELECT vec_id, label, p, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, label, p, v[(p * (len(v) // 4) + 1)::INT:((p + 1) * (len(v) // 4))::INT] AS x FROM v, range(4) r(p))),
{_rounds(4)},
r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS i FROM b4)) AS codebooks_sha256
FROM r
"""
