r"""Quality rules: repetition and length counts, and a hashed n-gram likelihood ratio.

Words and pairs of words are hashed into BUCKETS multinomial cells. Over all
texts their counts give the raw corpus' distribution; over the texts that the
labels trust (quality above 0) the target's, both with one count added to each
cell. A document's score is the mean, over its n-grams, of
log(target / raw): the length-normalised log-likelihood ratio. It is kept if
the score reaches THRESHOLD, whatever the other documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, table, text_of

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
BUCKETS = 1 << 16
WINDOW = 5
THRESHOLD = -0.25


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: Column, n: int) -> Column:
    """Hashes of the runs of n words, in order, from the words' hashes."""
    few = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(n))))).otherwise(few)


def repeated_words(hashes: Column) -> Column:
    """Number of words in windows (hashes, in order) that occur twice or more."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(a: Column) -> Column:
        return F.filter(a, lambda x, k: ((k > 0) & (F.get(a, k - 1)["h"] == x["h"])) | F.coalesce(F.get(a, k + 1)["h"] == x["h"], F.lit(False)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda acc, n: acc + n)

    def once(array: Column, f) -> Column:
        """f of a value that is computed once."""
        return F.element_at(F.transform(F.array(array), f), 1)

    count = once(ranked, lambda a: once(F.sort_array(F.transform(again(a), lambda x: x["i"])), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(count).cast("long")


def _cells(hashes: Column) -> Column:
    """Cells of the words and of the pairs of adjacent words, from the words' hashes."""
    single = F.transform(hashes, lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))
    after = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), after, lambda a, b: F.xxhash64(a, b).bitwiseAND(BUCKETS - 1).cast("int"))
    return F.concat(single, pairs)


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weights, the array of log(target / raw) over all cells.

    The counts cover every row of docs, and of these every row with a trusted
    label. The table has BUCKETS cells, whatever the corpus.
    """
    trusted = labels.where("quality > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = bounded(rows, trusted, "doc_id", "left")
    rows = rows.withColumn("hashed", _hashes(words_of(F.col("text"))))  # a column: inside a lambda it would be made anew for each element
    cells = rows.select("trusted", F.explode_outer(_cells(F.col("hashed"))).alias("cell")).where("cell is not null")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    totals = every.agg(
        F.sum(F.coalesce("raw", F.lit(0)) + 1).alias("all_raw"), F.sum(F.coalesce("target", F.lit(0)) + 1).alias("all_target"),
        F.sort_array(F.collect_list(F.struct("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("cells"),
    )
    ratio = F.transform("cells", lambda c: F.log((c["target"] + 1) / F.col("all_target")) - F.log((c["raw"] + 1) / F.col("all_raw")))
    return totals.select(ratio.alias("weights"))


def _constant(spark: SparkSession, numbers: list[float]) -> Column:
    """The numbers as one literal: a subquery can't stand in a higher-order function, and array() is built anew for each row."""
    context = spark.sparkContext
    array = context._gateway.new_array(context._jvm.double, len(numbers))
    for k, x in enumerate(numbers):
        array[k] = float(x)
    return F.lit(array)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    Null and empty texts have no words: zero counts, base_failed, llr 0. Texts
    are read whole. Repeated rows and repeated doc_ids are judged one by one, a
    null doc_id too (it has no label). Without trusted rows the target is
    uniform; other columns are ignored; an empty table gives no rows.
    """
    weights = log_ratios(docs, labels).first()  # one row of BUCKETS numbers
    shared = _constant(docs.sparkSession, weights["weights"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("hashed", _hashes(F.col("words")))
    rows = rows.withColumn("hashes", _windows(F.col("hashed"), WINDOW)).withColumn("cells", _cells(F.col("hashed")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.get(shared, c))
    out = rows.withColumn("lines", lines).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        (total / F.greatest(F.size("cells"), F.lit(1))).alias("llr"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.round("llr", 9) >= threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), F.round("llr", 6).alias("llr"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
