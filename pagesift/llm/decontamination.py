"""Benchmark decontamination: a hash set of normalised test n-grams against the token windows of every document.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.bloom import bloom_filter, might_contain

from .common import digest_of, id_of, key_of, keyed, stage, text_of

WINDOW = 10
#: Bits of the hash set for each distinct n-gram.
BITS_PER_GRAM = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, in order."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct rows (item, h, n, gram): every window of ``window`` consecutive words; a shorter item (not an empty
    one) is one window of its own length."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = items.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    return grams.select("item", F.xxhash64("gram").alias("h"), "n", "gram").distinct()


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((k, d, places), (k, d, items)) of the documents that hold windows of the benchmark; a document is known by its
    key and its text's digest.  ``places``: the distinct (at, n) of its windows; ``items``: the distinct item ids.

    The distinct n-grams' hashes form a Bloom filter of bounded size.  Every window of every document is hashed where
    it lies and tested against it; for items shorter than ``window`` only where the first word is that of such an
    item.  What passes leaves the row, is joined with the distinct n-grams word by word, and only then with the items
    that hold them, so an n-gram that all items share is one row of the first join.  The plan is the same at every size.
    """
    grams = stage(benchmark_windows(benchmark, window, item_id_col, item_text_col), "benchmark-windows")
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most ``window`` values
    every, words = bloom_filter(grams, "h", BITS_PER_GRAM)
    first, first_words = bloom_filter(grams.where(F.col("n") < window).select(F.xxhash64(F.get("gram", F.lit(0))).alias("f")), "f", BITS_PER_GRAM)
    rows = docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("t"), words_of(text_of(text_col)).alias("w"))
    at = rows.select("k", "t", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")) if lengths else rows.select("k", "t", "w", F.lit(1).alias("at")).limit(0)
    hashes = []
    for n in lengths:
        fits = F.col("at") <= F.size("w") - (n - 1)
        if n < window:
            fits = fits & might_contain(first.scalar(), first_words, F.xxhash64(F.get("w", F.col("at") - 1)))
        hashes.append(F.when(fits, F.xxhash64(F.slice("w", F.col("at"), F.lit(n)))).alias(f"h{n}"))
    tested = at.where(F.size("w") > 0).select("k", "t", "w", "at", *hashes)
    tested = tested.select("k", "t", "w", "at", *[f"h{n}" for n in lengths], *[F.coalesce(might_contain(every.scalar(), words, F.col(f"h{n}")), F.lit(False)).alias(f"f{n}") for n in lengths])
    passed = F.lit(False)
    for n in lengths:
        passed = passed | F.col(f"f{n}")
    hits = F.array(*[F.when(F.col(f"f{n}"), F.struct(F.lit(n).alias("n"), F.col(f"h{n}").alias("h"))) for n in lengths]) if lengths else F.expr("cast(array() as array<struct<n:int,h:bigint>>)")
    some = tested.where(passed).select("k", digest_of("t").alias("d"), "w", "at", F.explode(hits).alias("x")).where(F.col("x").isNotNull())
    some = stage(some.select("k", "d", "at", "x.n", "x.h", F.slice("w", F.col("at"), F.col("x.n")).alias("gram")), "benchmark-hits")
    places = (some.join(grams.select("h", "gram").distinct(), ["h", "gram"], "left_semi")
              .groupBy("k", "d").agg(F.collect_set(F.struct("at", "n")).alias("places")))
    items = (some.select("k", "d", "h", "gram").distinct().join(grams.select("h", "gram", "item"), ["h", "gram"])
             .groupBy("k", "d").agg(F.collect_set("item").alias("items")))
    return places, items


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Rows (id, n_words, n_hit, items, hit_words, *keep), one per row of ``docs``.

    ``hit_words``: sorted positions of the words inside any occurrence of a window of the benchmark; ``items``: sorted distinct item ids as strings, null
    left out.  See ``found_windows``.

    Null and empty texts have no words; a document shorter than ``window`` words can only hold shorter items; null
    ids and repeated rows are kept as they are; an empty benchmark hits nothing.  ``keep`` names columns to carry.
    """
    places, items = found_windows(docs, benchmark, window, id_col, text_col, item_id_col, item_text_col)
    kept = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(key_of(id_col).alias("k"), digest_of(text_col).alias("d"), F.size(words_of(text_of(text_col))).alias("n_words"),
                       *[F.col(c).alias(a) for c, a in zip(keep, kept)])
    rows = rows.join(places, ["k", "d"], "left").join(items, ["k", "d"], "left")
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("places", F.array()), lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    none = F.array().cast("array<string>")
    return rows.select(id_of(F.col("k")).alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.size(hit).cast("long").alias("n_hit"),
                       F.array_sort(F.coalesce("items", none)).alias("items"), hit.alias("hit_words"), *[F.col(a).alias(c) for c, a in zip(keep, kept)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without what the benchmark holds.  ``documents``: contaminated documents go, the others stay as they
    are, all columns kept; rows are judged by id and text, so others with the same or a null id stay.  Only rows that a
    Bloom filter of the contaminated ones lets through are joined, so clean texts are not shuffled.  ``spans``: rows (id, text) with the hit words left out and the others joined by one space
    (the normalised words), texts without hits unchanged.

    Null and empty texts are clean and stay; repeated rows share their fate; an empty table or benchmark changes
    nothing; no column name of ``docs`` clashes with inner ones."""
    if mode == "spans":
        found = contaminated_words(docs, benchmark, window, id_col, text_col, keep=(text_col,))
        words = words_of(F.coalesce(text_col, F.lit("")))
        left = F.array_join(F.filter(words, lambda w, i: ~F.array_contains("hit_words", i + 1)), " ")
        return found.select(id_col, F.when(F.col("n_hit") > 0, left).otherwise(F.col(text_col)).alias(text_col))
    if mode != "documents":
        raise ValueError("mode is 'documents' or 'spans'")
    bad = stage(found_windows(docs, benchmark, window, id_col, text_col)[0].select("k", "d"), "contaminated")
    bloom, words = bloom_filter(bad.select(F.xxhash64("k", "d").alias("h")), "h")
    rows = keyed(docs, id_col, text_col).withColumn("suspect", might_contain(bloom.scalar(), words, F.xxhash64("k", "d")))
    clean = rows.where(~F.col("suspect")).select("doc")
    judged = rows.where(F.col("suspect")).join(bad, ["k", "d"], "left_anti").select("doc")
    return clean.unionByName(judged).select("doc.*")
