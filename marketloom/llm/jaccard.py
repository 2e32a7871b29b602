r"""N-gram Jaccard join: token-combination prefixes over shingle sets, then verification.

A token is the 64-bit hash of a shingle. Documents of equal sets form a class, for which its row of the smallest doc_id stands; only those
representatives are joined, since a class's members share all of its links. They are numbered in the order of their doc_ids. Sets so
small that no other set comes near enough are classes, too, but are not joined.

Order: by how often a token occurs, as a count sketch of fixed size tells it in steps, then by hash. Two sets of sizes m and n and
similarity t share at least k tokens among the first m - a + k of one and the first n - a + k of the other, where
a = ceil(t (m + n) / (1 + t)) is what they share in all. The index holds prefixes for k = 2 and the smallest partner allowed.
- Rare classes of tokens are indexed singly.
- Frequent classes, of more than `frequent` representatives, are indexed by combinations of two such tokens of one prefix. A pair
  shares two tokens of the prefixes: one is rare, or both are frequent, so either index finds it.
Candidates are taken in two turns. First each key's representatives meet the one among them whose tokens are the most common, the
middle of a group of near copies, and verified links are merged to components. A key whose representatives are then in one component
is settled, for no further link could join more of them. Of the other keys all pairs across components whose tokens stand early
enough in both prefixes are candidates. So large groups of near copies cost a few pairs a member.

A bitmap of `bits` bits stands for each set: the parity of its tokens by cell. Bitmaps cannot differ in more cells than their sets do
in tokens, so candidates whose bitmaps differ in more than a link allows are left out.

Verification recomputes sets from the texts and compares sizes of intersection and union in integers. A text meets its candidates
in groups around one of them, which are split where they are large.

Defined cases: texts without words, and null ones, have an empty set, link with nothing and are components of their own; equal
rows are one class; rows of one doc_id are documents of their own; rows without doc_id link with nothing and get a null component; an empty table gives an
empty result; other columns are not read, and in the stage pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import Aside, cut, maybe_in, release, stored, table, tidy
from marketloom.llm.components import components
from marketloom.llm.fingerprints import Powers, mix, shingle_sets


@dataclass(frozen=True)
class JaccardRules:
    width: int = 3
    percent: int = 90
    frequent: int = 64
    sketch_bits: int = 22
    group: int = 256
    bits: int = 1024


def count_sketch(docs: DataFrame, rules: JaccardRules) -> np.ndarray:
    """How common each cell of the sketch is, in steps: counts of distinct tokens of all documents, by their lowest bits.

    A task sends its counts in parts, which are added up part by part; the driver gets 2**sketch_bits short numbers, whatever the input.
    All tasks' rows of a part meet in one group, so a part is 32 KB: some 60 MB from 1,900 tasks.
    """
    size = 1 << rules.sketch_bits
    parts = max(1, size >> 14)

    most = np.iinfo(np.uint16).max

    def counted(batches):
        powers, counts = Powers(), np.zeros(size, np.uint16)

        def add(held):
            cells, n = np.unique(np.concatenate(held) & np.uint64(size - 1), return_counts=True)
            cells = cells.astype(np.int64)
            counts[cells] = np.minimum(counts[cells].astype(np.int64) + n, most)

        for batch in batches:
            held, n = [], 0
            for _, tokens in shingle_sets(batch.column(0), rules.width, powers):
                held.append(tokens)
                n += len(tokens)
                if n > 1 << 19:
                    add(held)
                    held, n = [], 0
            if held:
                add(held)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "counts": [x.tobytes() for x in counts.reshape(parts, -1)]})

    def added(key, rows):
        total = np.zeros(size // parts, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint16)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": [np.minimum(total, most).astype(np.uint16).tobytes()]})

    rows = docs.select("text").mapInArrow(tidy(counted), "part int, counts binary").groupBy("part").applyInArrow(added, "part int, counts binary").collect()
    if not rows:
        return np.zeros(size, np.uint8)
    total = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in sorted(rows)])
    usual = max(2.0, 1.25 * total.mean())
    levels = np.floor(2 * np.log2(np.maximum(total, usual) / usual)).astype(np.uint8)
    del rows, total
    release()
    return levels


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, which tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def prefixes(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """doc_id, key, n, digest of the set (two hashes) the tokens of the prefix, in order, the set's bitmap, and how common its tokens are."""
    common = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, rules))
    percent, bits = rules.percent, rules.bits

    def made(batches):
        powers, cells = Powers(), np.uint64((1 << rules.sketch_bits) - 1)
        levels = common.value
        for batch in batches:
            rows = []
            for r, tokens in shingle_sets(batch.column(1), rules.width, powers):
                n = len(tokens)
                if not n:
                    rows.append((r, 0, None, None, [], [], 0))
                    continue
                p = min(n, n - (percent * n + 99) // 100 + 2)
                level = levels[tokens & cells]
                first = tokens[np.argsort(level, kind="stable")[:p]]
                sums = [int(mix(tokens + np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (1, 2)]
                parity = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
                rows.append((r, n, *sums, first.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64), int(level.sum())))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            own = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:]))], ["doc_id", "key", "n", "d1", "d2", "tokens", "bitmap", "common"])

    return keyed(docs).mapInArrow(tidy(made), "doc_id bigint, key bigint, n bigint, d1 bigint, d2 bigint, tokens array<bigint>, bitmap array<bigint>, common bigint")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """Those of pairs (a, b) of representatives (rep, doc_id, key) whose texts' sets are similar enough, with the sizes of intersection and union."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps, "rep")
    asked = stored(asked, "asked")
    # Equal rows give their text once. Members come to the texts by the same keys, so texts are dealt out once before they meet in groups.
    texts = wanted(asked, keyed(docs)).groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    groups_ = pairs.groupBy("a").agg(F.ceil(F.count("*") / rules.group).cast("int").alias("_s"))
    members = pairs.join(groups_, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_s")).cast("int").alias("s"), F.col("b").alias("d"))
    heads = groups_.select("a", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("s"), F.col("a").alias("d"))
    rows = members.unionByName(heads).join(asked.withColumnRenamed("rep", "d"), "d").join(texts, ["doc_id", "key"]).select("a", "s", "d", "text")
    dealt = rows.repartition("a", "s").sortWithinPartitions("a", "s", F.col("d") != F.col("a"))
    percent = rules.percent

    def compared(batches):
        powers, head, x = Powers(), None, None
        for batch in batches:
            a, s, d, keep = batch.column("a").to_pylist(), batch.column("s").to_pylist(), batch.column("d").to_pylist(), []
            for i, y in shingle_sets(batch.column("text"), rules.width, powers):
                if a[i] == d[i]:
                    head, x = (a[i], s[i]), y
                elif head == (a[i], s[i]):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - same
                    if same and 100 * same >= percent * union:
                        keep.append((a[i], d[i], same, union))
            cols = list(zip(*keep)) if keep else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "same", "union"])

    return dealt.mapInArrow(tidy(compared), "a bigint, b bigint, same bigint, union bigint")


def folded(bits: int, words: int = 4) -> Column:
    """The column `bitmap` of so many bits as the parity of its words by place, `words` of them. Sets differ in no fewer tokens than these do in bits."""
    return F.array(*[reduce(Column.bitwiseXOR, [F.get("bitmap", F.lit(k)) for k in range(i, bits // 64, words)]) for i in range(min(words, bits // 64))])


def near(pairs: DataFrame, bitmaps: DataFrame, rules: JaccardRules) -> DataFrame:
    """Those of pairs (a, b) whose bitmaps (rep, n, bitmap and its fold) leave room for a link. Folds go first, so few pairs are moved with whole bitmaps."""
    for bits in ("fold", "bitmap"):
        side = lambda k: bitmaps.select(F.col("rep").alias(k), F.col("n").cast("int").alias(f"_n{k}"), F.col(bits).alias(f"_m{k}"))  # noqa: E731, B023
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        sizes = F.col("_na").cast("long") + F.col("_nb")
        differ = F.aggregate(F.zip_with("_ma", "_mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        pairs = both.filter(differ <= sizes - 2 * F.ceil(sizes * rules.percent / (100 + rules.percent))).select("a", "b")
    return pairs


def wanted(asked: DataFrame, texts: DataFrame, most_bits: int = 27) -> DataFrame:
    """Rows of texts whose doc_id and key may stand in asked: so other texts are not shuffled."""
    return texts.filter(maybe_in(asked, ["doc_id", "key"], most_bits))


def links(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes (doc_id, key, n, rep, first doc_id), the representatives (rep, doc_id, key), and enough verified links between these to join what is linked."""
    made = stored(prefixes(docs, rules), "prefixes")
    firsts = made.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "key")).alias("r")).select("d1", "d2", "n", "r.doc_id", "r.key")
    # Numbers rise with doc_id, within and across the ranges.
    firsts = stored(firsts.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("rep", F.monotonically_increasing_id()), "classes")
    label = firsts.select("d1", "d2", "n", "rep", F.col("doc_id").alias("first"))
    classes = made.select("doc_id", "key", "d1", "d2", "n").join(label, ["d1", "d2", "n"], "left")
    known = F.col("doc_id").isNotNull()
    classes = stored(classes.select("doc_id", "key", "n", F.when(known, F.col("rep")).alias("rep"), F.when(known, F.coalesce("first", "doc_id")).alias("first")), "members")
    reps = firsts.select("rep", "doc_id", "key")

    linkable = firsts.filter(F.col("n") * (100 - rules.percent) >= rules.percent).select("rep", "doc_id", "key")
    own = made.join(linkable, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])  # one a rep, where the join has dealt it
    bitmaps = stored(own.select("rep", "n", "bitmap", folded(rules.bits).alias("fold")), "bitmaps")
    rows = own.select("rep", "n", "common", F.posexplode("tokens").alias("pos", "token"))
    most = F.max(F.struct("common", (-F.col("rep")).alias("r"), "n")).alias("_h")
    counts = rows.groupBy("token").agg(F.count("*").alias("df"), most).filter("df > 1").select("token", "df", (-F.col("_h.r")).alias("head"), F.col("_h.n").alias("m"))
    index = stored(rows.drop("common").join(counts, "token"), "index")
    fits = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * rules.percent
    first = index.filter((F.col("rep") != F.col("head")) & fits(F.col("m"), F.col("n"))).groupBy("head", "rep").agg(F.count("*").alias("_c")).filter("_c > 1")
    first = cut(near(first.select(F.col("head").alias("a"), F.col("rep").alias("b")), bitmaps, rules))
    found = cut(verified(first, reps, docs, rules).select("a", "b"))
    label = components(found)

    # Second turn: keys whose representatives are in several components.
    label = label.select(F.col("node").alias("rep"), "component")
    index = stored(index.drop("head", "m").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
    several = index.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("token")
    index = index.join(several, "token")
    pos = F.col("pos").cast("int")
    rare = index.filter(F.col("df") <= rules.frequent).select("token", "rep", "n", pos.alias("p1"), pos.alias("p2"), "component", F.lit(1).alias("tokens"))
    common = index.filter(F.col("df") > rules.frequent).groupBy("rep", "n", "component").agg(F.array_sort(F.collect_list(F.struct(pos.alias("p"), "token"))).alias("_t"))
    combined = lambda x, y: F.struct(F.xxhash64(x["token"], y["token"]).alias("token"), x["p"].alias("p1"), y["p"].alias("p2"))
    combos = F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice("_t", i + 2, F.size("_t")), lambda y: combined(x, y))))
    paired = common.select("rep", "n", "component", F.explode(combos).alias("_k")).select("_k.token", "rep", "n", "_k.p1", "_k.p2", "component", F.lit(2).alias("tokens"))
    keys = stored(rare.unionByName(paired), "keys")
    x, y = keys.alias("x"), keys.alias("y")
    all_ = F.ceil((F.col("x.n") + F.col("y.n")) * rules.percent / (100 + rules.percent))
    # A single token may be the second that is shared; of two the first stands one place earlier.
    early = [F.col(f"{s}.p1") <= F.col(f"{s}.n") - all_ + 2 - F.col("x.tokens") for s in "xy"] + [F.col(f"{s}.p2") <= F.col(f"{s}.n") - all_ + 1 for s in "xy"]
    apart = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & fits(F.col("x.n"), F.col("y.n"))
    met = x.join(y, reduce(Column.__and__, early, (F.col("x.token") == F.col("y.token")) & (F.col("x.tokens") == F.col("y.tokens")) & apart))
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    more = verified(cut(near(second, bitmaps, rules)), reps, docs, rules).select("a", "b")
    return classes, reps, cut(found.unionByName(more))


def groups(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    classes, reps, found = links(docs, rules)
    label = components(found).join(reps.select(F.col("rep").alias("component"), F.col("doc_id").alias("least")), "component").select(F.col("node").alias("rep"), "least")
    return classes.join(label, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "first").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def surplus(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """doc_id and key of the rows that go, `goes`, as another of their group stays, and of those that stand several times.

    Of a group the row of the smallest doc_id stays, of several the one of the smallest key.
    """
    classes, reps, found = links(docs, rules)
    label = components(found).select(F.col("node").alias("rep"), "component")
    heads = reps.select(F.col("rep").alias("_head"), F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    rows = classes.filter("doc_id IS NOT NULL").join(label, "rep", "left").withColumn("_head", F.coalesce("component", "rep")).join(heads, "_head", "left")
    other = F.coalesce((F.col("_d") != F.col("doc_id")) | (F.col("_k") != F.col("key")), F.lit(False))
    return rows.groupBy("doc_id", "key").agg(F.max(other).alias("goes"), F.count("*").alias("_n")).filter("goes OR _n > 1").select("doc_id", "key", "goes")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near duplicates (shingles of five words, 80 %) one document stays, the first by doc_id, then key; of equal rows one.

    Rows are told apart by doc_id and key. Only those that may go, or may stand several times, are shuffled.
    """
    mine = Aside(docs)
    df = mine.df.withColumns({"doc_id": mine.col("doc_id").cast("bigint"), "key": F.xxhash64(mine.col("text"))})
    spare = stored(surplus(docs, JaccardRules(width=5, percent=80)), "surplus")
    asked = F.col("doc_id").isNotNull() & maybe_in(spare, ["doc_id", "key"])
    df = df.withColumn("_asked", asked)
    met = df.filter("_asked").join(spare.filter("goes").select("doc_id", "key"), ["doc_id", "key"], "left_anti").dropDuplicates(["doc_id", "key"])
    return mine.back(df.filter("NOT _asked").unionByName(met))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
