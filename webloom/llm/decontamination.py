"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become lower-cased words (runs of letters and digits). At each position a mask takes some of the next
words and ignores the others; equal hashes of the words taken, in a document and in a benchmark item, are a
hit, which a substitution at an ignored position cannot prevent. Around each hit the stretch of
``stretch`` words (or the whole item, if shorter) is compared word by word: at least ``percent`` percent
equal words confirm it. A document with a confirmed hit is contaminated.

Items of five to nine words take the short masks: four words of five, such that some mask misses any one
substituted word. An item of fewer words is too common to be evidence within a text; it is found only where it is
the whole of a document. If the benchmark's windows, which are counted, are at most ``broadcast_rows``, they are
broadcast and each document is read once. Otherwise both sides' windows are shuffled as hashes with positions,
never with words (hot windows are then split by adaptive execution); the stretches of the distinct places met are
fetched afterwards by document and by item. Documents' windows are not gathered.

Cases: null or empty texts have no windows; null item_ids are ignored; repeated items or rows do not change
a verdict; rows that share a doc_id share the verdict, which is that of any of their texts; a null doc_id is
never contaminated. Empty tables give no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word is hashed; 0: it is ignored.
MASKS = ("1101100111", "1110010111")
#: For items shorter than those: any one word of five or more may differ.
SHORT = ("1111", "11011", "10111", "11101")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; one empty word may stand at either end, and matches nothing."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _runs(mask: str) -> list[tuple[int, int]]:
    """(first, length) of the mask's runs of 1."""
    return [(m.start(), len(m[0])) for m in re.finditer("1+", mask)]


def with_windows(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Adds x: for mask m and word number i, the mask's hash at position m * size(w) + i.

    Hashes of runs of words are built once and shared by all masks; those that reach beyond the last word
    lack values, so they equal no window that fits."""
    longest = max(n for mask in masks for _, n in _runs(mask))
    df = df.withColumn("r1", F.col("w"))
    for n in range(2, longest + 1):
        df = df.withColumn(f"r{n}", F.transform(f"r{n - 1}", _extend(n)))
    made = []
    for number, mask in enumerate(masks):
        (_, head), *rest = _runs(mask)
        made.append(F.transform(f"r{head}", _seed(number, rest)))
    return df.withColumn("x", F.concat(*made)).drop(*[f"r{n}" for n in range(1, longest + 1)])


def _extend(n: int):
    return lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + (n - 1)))


def _seed(number: int, rest: list[tuple[int, int]]):
    return lambda x, i: F.xxhash64(F.lit(number), x, *[F.get(F.col(f"r{n}"), i + at) for at, n in rest])


def hashed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.transform(words(F.col(text).cast("string")), lambda w: F.xxhash64(w)).alias("w"))


def hits(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, short: tuple[str, ...] = SHORT, stretch: int = 13, percent: int = 80, broadcast_rows: int = 250_000
) -> DataFrame:
    """Hits and their comparison: doc_id, item_id, equal and compared words of the stretch, confirmed."""
    span, least = max(map(len, masks)), max(map(len, short))
    real = F.filter(words(F.col("text").cast("string")), lambda w: w != "")
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.transform(real, lambda w: F.xxhash64(w)).alias("w"))
    size = F.size("w")
    used = (*masks, *short)
    lengths = F.array(*[F.lit(len(m)) for m in used])
    fits = ((size >= span) == (F.col("mask") < len(masks))) & (F.col("at") + F.get(lengths, F.col("mask")) <= size)
    seeds = with_windows(items.filter(size >= least), used).select("item_id", "w", F.posexplode_outer("x").alias("k", "h"))
    seeds = seeds.select("item_id", "w", "h", F.floor(F.col("k") / size).cast("int").alias("mask"), (F.col("k") % size).alias("at")).filter(fits)
    first = F.greatest(F.lit(0), F.least(F.col("at") - 2, size - stretch))
    # A benchmark window, the place of the stretch to compare, and its words.
    seeds = seeds.select("h", "mask", "item_id", F.col("at").alias("item_at"), first.alias("from"), F.slice("w", first + 1, F.lit(stretch)).alias("expected")).distinct()
    rows, some_short = seeds.agg(F.count("*"), F.max((F.col("mask") >= len(masks)).cast("int"))).first()
    tiny = items.filter((size > 0) & (size < least)).select("item_id", F.xxhash64("w").alias("h"), size.alias("n")).distinct()
    # Documents take the short masks only where short items ask for them.
    own = hashed(docs, "doc_id").filter("doc_id is not null")
    # The outer form keeps Catalyst from testing the whole expression for emptiness in a filter beforehand.
    wide = lambda df, *keys: with_windows(df, used if some_short else masks).select(*keys, F.posexplode_outer("x").alias("k", "h"))
    shift = F.col("k") % F.size("w") - F.col("item_at") + F.col("from")
    cut = F.slice("w", F.greatest("shift", F.lit(0)) + 1, F.lit(stretch))
    lead = F.greatest(-F.col("shift"), F.lit(0)).alias("lead")
    if rows <= broadcast_rows:
        met = wide(own, "doc_id", "w").join(F.broadcast(seeds), "h").withColumn("shift", shift)
        # Only the stretch leaves the join, so that long texts are never copied to their hits.
        near = met.select("doc_id", "item_id", "expected", lead, cut.alias("got")).distinct()
    else:
        # A document's rows are told apart by their words' hash; its length goes along, its words do not.
        own = own.withColumn("th", F.xxhash64("w"))
        places = wide(own.withColumn("n", size), "doc_id", "th", "n").filter("h is not null")
        stretches = seeds.select("expected").distinct().select(F.xxhash64("expected").alias("eh"), "expected")
        met = places.join(seeds.select("h", "item_id", "item_at", "from", F.xxhash64("expected").alias("eh")), "h")
        met = met.select("doc_id", "th", "item_id", "eh", (F.col("k") % F.col("n") - F.col("item_at") + F.col("from")).alias("shift")).distinct()
        texts = own.groupBy("doc_id", "th").agg(F.first("w").alias("w"))
        near = met.join(texts, ["doc_id", "th"]).select("doc_id", "item_id", "eh", lead, cut.alias("got")).distinct().join(stretches, "eh")
    same = lambda e, i: F.when((i >= F.col("lead")) & (F.get("got", i - F.col("lead")) == e), F.lit(1))
    equal = F.size(F.filter(F.transform("expected", same), lambda v: v.isNotNull()))
    out = near.select("doc_id", "item_id", equal.alias("equal"), F.size("expected").alias("compared")).withColumn("confirmed", F.col("equal") * 100 >= F.lit(percent) * F.col("compared"))
    if tiny.isEmpty():
        return out
    few = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(real, lambda w: F.xxhash64(w)).alias("w")).filter(size.between(1, least - 1))
    whole = few.select("doc_id", F.xxhash64("w").alias("h"), size.alias("n")).join(tiny, ["h", "n"])
    return out.unionByName(whole.select("doc_id", "item_id", F.col("n").alias("equal"), F.col("n").alias("compared"), F.lit(True).alias("confirmed")))


def _found(docs: DataFrame, benchmark: DataFrame, options: dict) -> DataFrame:
    """doc_id, n_items of contaminated documents. A filter on single hits would be pushed into the join and
    keep it from being compiled together with the windows; one on sums is not."""
    return hits(docs, benchmark, **options).groupBy("doc_id").agg(F.count_distinct(F.when(F.col("confirmed"), F.col("item_id"))).alias("n_items")).filter("n_items > 0")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items (benchmark items found) for every row of docs(doc_id, text)."""
    found = _found(docs, benchmark, options)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that no benchmark item was found in, with all their columns."""
    found = _found(docs, benchmark, options).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
