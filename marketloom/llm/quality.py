"""Quality rules: base counts, and the divergence of a document from the references of its language.

References are two histograms a language: of character classes and of its common words, lower-cased and without what is no letter. They
are sums over all documents that the base rule passes and that are long enough to be judged, and then, once more, over those of
them that these sums keep, so that junk has no part in what it is judged by. A document whose
Jensen-Shannon distance from either is too large is rejected; short documents are not judged that way. Everything is a
DataFrame function, so a document is never seen by Python.

Defined cases: a null text counts as an empty one, which has no words and fails the base rule; a null or unlisted language is
judged by the pooled character reference alone, and by none where less than half of its letters are Latin; without any document
there are no references and nothing is judged by them.
Further columns pass through; the operator's own are named by `BASE` and `VERDICT` and replace input columns so named.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE, Aside, held, stored, table

# Fifty common words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur".split(),
    "en": "the of and to a in is that it for was on with be by as this are at from he his have not had but they which or you she an were her we their one been has all would there when what who will if no more so".split(),
    "es": "de la que el en y los se del las por un no con su una es para al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split(),
    "fr": "de la le et les des en un du une que pour est qui par dans sur au pas avec il ne se ce plus son a sont ou aux elle cette mais comme ses ont nous vous été leur sa même on deux ces tout sans fait être peut".split(),
}
OTHER = "*"
MARKS = {"upper": r"\p{Lu}", "digit": r"\p{N}", "punctuation": r"\p{P}", "symbol": r"\p{S}"}
CLASSES = [*MARKS, "space"]
LETTER, LATIN = r"\p{L}", r"\p{IsLatin}"
SYMBOLS = "#*$%&|<>"  # marks, all of them
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
HISTOGRAMS = ["lang_", "classes_", "hist_", "size_"]
VERDICT = ["class_distance", "word_distance", "kept"]


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    class_min_chars: int = 200
    max_class_distance: float = 0.25
    word_min_words: int = 80
    max_word_distance: float = 0.28
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


@dataclass(frozen=True)
class References:
    """By language: shares of the character classes (letters last) and of the common words (others last)."""

    classes: dict
    words: dict


def _count(text: str, kind: str) -> Column:
    """How many characters of a kind the column has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def _with_histograms(docs: DataFrame, text: Column, lang: Column, rules: QualityRules) -> DataFrame:
    """Adds text_, words_, and the histograms."""
    lang = F.when(lang.isin(*rules.common_words), lang).otherwise(OTHER)
    df = held(docs.withColumn("text_", F.coalesce(text, F.lit(""))), words_=F.array_remove(F.split(F.col("text_"), f"[{SPACE}]+"), ""), lang_=lang)
    # The classes but space are counted in what is left without all other characters; words hold all that is no space.
    marks = F.regexp_replace("text_", f"[^{''.join(MARKS.values())}]+", "")
    df = held(df, marks_=marks, size_=F.length("text_"), word_chars_=F.length(F.array_join("words_", "")))
    df = held(df, counts_=F.array(*[_count("marks_", c) for c in MARKS.values()], F.col("size_") - F.col("word_chars_")))
    every = sorted({w for ws in rules.common_words.values() for w in ws})
    plain = F.array_remove(F.split(F.lower("text_"), r"[^\p{L}]+"), "")
    # The listed languages are written in Latin letters, so their references say nothing about a text in other ones.
    foreign = (F.col("lang_") == OTHER) & (2 * F.regexp_count("text_", F.lit(LATIN)) < F.regexp_count("text_", F.lit(LETTER)))
    classes = F.concat("counts_", F.array(F.col("size_") - F.aggregate("counts_", F.lit(0), lambda a, x: a + x)))
    df = held(df, classes_=F.when(~foreign, classes), plain_=plain)
    lists = F.create_map(*[x for k, ws in rules.common_words.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    common = F.concat(F.lit(" "), F.array_join(F.filter("plain_", lambda w: w.isin(*every)), "  "), F.lit(" "))
    df = held(df, n_plain_=F.size("plain_"), common_=common, list_=lists[F.col("lang_")])
    # Each common word stands between two spaces of its own, so what replacing it takes away tells how often it is there.
    bytes_ = lambda c: F.octet_length(c)
    own = F.transform("list_", lambda c: ((bytes_("common_") - bytes_(F.replace(F.col("common_"), F.concat(F.lit(" "), c, F.lit(" "))))) / (bytes_(c) + 2)).cast("int"))
    df = held(df.drop("plain_"), own_=own)
    return held(df, hist_=F.concat("own_", F.array(F.col("n_plain_") - F.aggregate("own_", F.lit(0), lambda a, x: a + x))))


def sums(featured: DataFrame, rules: QualityRules) -> References:
    """Sums of the histograms of rows of features(), by language: one row for each listed language and one for the others."""
    n, w = len(CLASSES) + 1, max(map(len, rules.common_words.values())) + 1
    long_class, long_word = F.col("size_") >= rules.class_min_chars, F.col("n_words") >= rules.word_min_words
    rows = (
        featured.groupBy("lang_")
        .agg(*[F.sum(F.when(long_class, F.col("classes_")[i])).alias(f"c{i}") for i in range(n)], *[F.sum(F.when(long_word, F.get("hist_", F.lit(i)))).alias(f"w{i}") for i in range(w)])
        .collect()
    )
    classes = {r["lang_"]: [r[f"c{i}"] or 0 for i in range(n)] for r in rows}
    if classes:
        classes[OTHER] = [sum(v[i] for v in classes.values()) for i in range(n)]
    words = {r["lang_"]: [r[f"w{i}"] or 0 for i in range(len(rules.common_words[r["lang_"]]) + 1)] for r in rows if r["lang_"] != OTHER}
    share = lambda table: {k: [float(x) / sum(v) for x in v] for k, v in table.items() if sum(v)}
    return References(share(classes), share(words))


def fit_references(featured: DataFrame, rules: QualityRules = QualityRules()) -> References:
    """References from rows of features(): from those that pass the base rule, then from those of them that these references keep."""
    good = featured.filter("NOT base_failed")
    return sums(_judged(good, sums(good, rules), rules).filter("kept"), rules)


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def _distance(counts: str, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, from 0 to 1, of counts, whose sum is total, from shares; null where there are no shares or counts."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(counts, shares, lambda c, q: part(c / total, (c / total + q) / 2) + part(q, (c / total + q) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def _lookup(table: dict, key: Column) -> Column:
    if not table:
        return F.lit(None).cast("array<double>")
    return F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])[key]


def _repeat_words(df: DataFrame, k: int) -> DataFrame:
    """Adds n_repeat_words: words covered by windows of k words that occur twice or more. Windows are told apart by 64-bit hashes."""
    n = F.size("words_")
    windows = F.when(n >= k, F.transform(F.arrays_zip(*[F.slice("words_", j + 1, n - k + 1) for j in range(k)]), lambda w: F.xxhash64(w)))
    df = held(df, windows_=F.coalesce(windows, F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("windows_")) < F.size("windows_")
    # sort_array() compares by the type's own order, array_sort() by a lambda.
    ranked = F.when(repeats, F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = held(df, ranked_=ranked)
    same = lambda x, j: F.coalesce(F.get("ranked_", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ranked_", j + 1)["h"] == x["h"], F.lit(False))
    found = F.sort_array(F.transform(F.filter("ranked_", same), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(found, start, lambda a, i: F.struct((i + k).alias("end"), (a["n"] + i + k - F.greatest(a["end"], i)).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def features(docs: DataFrame, rules: QualityRules = QualityRules(), keep: list[str] | None = None, text: Column | None = None, lang: Column | None = None) -> DataFrame:
    """docs with the base counts and the histograms; keep: the columns that go along."""
    text, lang = F.col("text") if text is None else text, F.col("lang") if lang is None else lang
    df = _repeat_words(_with_histograms(docs, text, lang, rules), rules.window)
    df = held(df, lines_=F.filter(F.split("text_", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    n = F.col("n_words")
    df = df.select(
        *(docs.columns if keep is None else keep), *HISTOGRAMS, "n_repeat_words",
        F.size("words_").cast("long").alias("n_words"),
        F.col("word_chars_").cast("long").alias("word_chars"),
        _count("marks_", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
    )
    return df.withColumn("base_failed", (n < rules.min_words) | (F.col("n_repeat_words") * 100 > n * rules.max_repeat_percent))


def _judged(featured: DataFrame, references: References, rules: QualityRules) -> DataFrame:
    own_or_pooled = F.coalesce(_lookup(references.classes, F.col("lang_")), _lookup(references.classes, F.lit(OTHER)))
    # Lambdas would add a total or look shares up again for each element.
    df = held(featured, class_total_=_total("classes_"), word_total_=_total("hist_"), class_shares_=own_or_pooled, word_shares_=_lookup(references.words, F.col("lang_")))
    df = held(
        df,
        class_distance=F.when(F.col("size_") >= rules.class_min_chars, _distance("classes_", F.col("class_total_"), F.col("class_shares_"))),
        word_distance=F.when(F.col("n_words") >= rules.word_min_words, _distance("hist_", F.col("word_total_"), F.col("word_shares_"))),
    ).drop("class_total_", "word_total_", "class_shares_", "word_shares_")
    far = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    kept = ~F.col("base_failed") & ~far("class_distance", rules.max_class_distance) & ~far("word_distance", rules.max_word_distance)
    return df.withColumn("kept", kept)


def verdict(featured: DataFrame, references: References, rules: QualityRules = QualityRules()) -> DataFrame:
    """Rows of features() with the distances and `kept`, without the histograms."""
    return _judged(featured, references, rules).drop(*HISTOGRAMS)


def _keyed(mine: Aside, rules: QualityRules) -> tuple[DataFrame, DataFrame]:
    """The rows with keys k1 and k2, and a verdict for each key. Features are computed and written once, without the texts; verdicts come back by key."""
    text, lang = mine.col("text"), mine.col("lang")
    df = mine.df.withColumns({"k1": mine.col("doc_id").cast("bigint"), "k2": F.xxhash64(text, lang)})
    featured = stored(features(df, rules, ["k1", "k2"], text, lang), "features")
    return df, verdict(featured, fit_references(featured, rules), rules).dropDuplicates(["k1", "k2"])


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with the base counts, the distances and `kept`. Rows are told apart by doc_id and the 64-bit hash of text and language."""
    mine = Aside(docs, BASE + VERDICT)
    df, found = _keyed(mine, rules)
    found = found.withColumnsRenamed({"k1": "j1", "k2": "j2"})
    return mine.back(df.join(found, F.col("k1").eqNullSafe(F.col("j1")) & (F.col("k2") == F.col("j2"))), *BASE, *VERDICT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the features are small, so they are written once and serve both the references and the verdicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    featured = stored(features(docs, keep=["doc_id"]), "features")
    return verdict(featured, fit_references(featured)).select("doc_id", *BASE, "kept", *VERDICT[:2])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the rules reject go. Features are computed once for the references and once for the verdicts, so that no text is shuffled or written."""
    mine, rules = Aside(docs), QualityRules()
    text, lang = mine.col("text"), mine.col("lang")
    references = fit_references(stored(features(mine.df, rules, [], text, lang), "features"), rules)
    return mine.back(verdict(features(mine.df, rules, mine.kept(), text, lang), references, rules).filter("kept"))
