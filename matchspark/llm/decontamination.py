"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on

WINDOW, SHARE, BROADCAST_BYTES = 5, 0.8, 64 << 20
MARK = "\u0001"                  # starts a placeholder token: MARK, its type (n, p or u), its value
UNITS = ("kilometers kilometres kilograms centimeters centimetres meters metres miles inches feet yards grams pounds ounces tons liters "
         "litres gallons seconds minutes hours days weeks months years dollars euros cents percent degrees km kg cm mm mg ml mph kmh lb oz ft")
SPACE = rf"[\s\p{{Z}}{MARK}]"
CANON = (
    (rf"[\s\p{{Z}}{MARK}&&[^ ]]{SPACE}*| {SPACE}+", " "),                               # white space that is not one blank: lines may be wrapped anywhere
    (r"\p{Lu}(?<=[a-z0-9,;:] \p{Lu})\p{Ll}+", rf" {MARK}p$0"),                         # a capital inside a sentence: a name, as long as its word
    (r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,][0-9]+)*+", rf" {MARK}n$0 "),           # a number; possessive, or Java recurses once a part
    (rf"({MARK}n[0-9.,]+) \s*({UNITS.replace(' ', '|')})(?![\p{{L}}\p{{N}}])", rf"$1 {MARK}u$2 "),     # a unit after a number
)
TITLE = r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}"
CLEAN = rf"[^\p{{L}}\p{{N}}.,{MARK}]+|[.,](?![0-9])"


def canonical(text: Column) -> Column:
    """Words of a text, lower case and space-separated; placeholders keep their value behind their mark."""
    t = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), CANON, F.coalesce(text.cast("string"), F.lit("")))
    return F.lower(F.regexp_replace(t, CLEAN, " "))


def worded(text: Column) -> list[Column]:
    """canon, title: the canonical words of a text, and whether it begins with a capitalised word."""
    return [canonical(text).alias("canon"), F.coalesce(F.rlike(text.cast("string"), F.lit(TITLE)), F.lit(False)).alias("title")]


def windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, h, kind, slots: every window of WINDOW words by its hashes, with the values in its placeholders (null: none).

    A window with placeholders has two hashes, of its template (kind 0) and of its words as they stand (1); one without has one,
    the same for both. A capitalised first word may be a name or not: its window also has the hash of the other template (2).
    `rows` has the keys and the columns of `worded`. Texts of fewer words have no window.
    """
    split = rows.select(*keys, "title", F.array_remove(F.split("canon", " "), "").alias("tokens"), F.contains("canon", F.lit(MARK)).alias("marked"))
    typed = F.transform("tokens", lambda t: F.xxhash64(F.when(t.startswith(MARK), F.substring(t, 1, 2)).otherwise(t)))
    words = F.transform("tokens", lambda t: F.xxhash64(F.when(t.startswith(MARK), F.substring(t, 3, 1 << 30)).otherwise(t)))
    hashed = split.select(*keys, "title", "tokens", "marked", F.when(F.col("marked"), typed).otherwise(F.transform("tokens", lambda t: F.xxhash64(t))).alias("hs"),
                          F.when(F.col("marked"), words).alias("ps"))
    last = F.size("hs") - WINDOW

    def over(hashes: str, i: Column, start: int = 0) -> list[Column]:
        return [F.get(hashes, i + k) for k in range(start, WINDOW)]

    def window(i: Column) -> Column:
        slots = F.when(F.col("marked"), F.transform(F.slice("tokens", i + 1, F.lit(WINDOW)), lambda t: F.when(t.startswith(MARK), t)))
        return F.struct(i.alias("at"), F.xxhash64(*over("hs", i)).alias("h"), F.when(F.col("marked"), F.xxhash64(*over("ps", i))).alias("p"), F.lit(0).alias("kind"), slots.alias("slots"))
    first = F.get("tokens", F.lit(0))
    rest = F.transform(F.slice("tokens", 2, WINDOW - 1), lambda t: F.when(t.startswith(MARK), t))
    named = F.struct(F.lit(0).alias("at"), F.xxhash64(F.xxhash64(F.lit(f"{MARK}p")), *over("hs", F.lit(0), 1)).alias("h"), F.lit(None).cast("bigint").alias("p"), F.lit(2).alias("kind"),
                     F.concat(F.array(F.concat(F.lit(f"{MARK}p"), first)), rest).alias("slots"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)
    each = F.when(last >= 0, F.when(F.col("title") & ~first.startswith(MARK), F.concat(each, F.array(named))).otherwise(each))
    # outer, with the filter behind it: a filter before it would be inferred from it and compute all windows twice
    out = hashed.select(*keys, F.explode_outer(each).alias("w")).where(F.col("w").isNotNull()).select(*keys, "w.*")
    both = F.when(F.col("p") != F.col("h"), F.array(F.struct("h", "kind"), F.struct(F.col("p").alias("h"), F.lit(1).alias("kind"))))
    return out.select(*keys, "at", "slots", F.explode(F.coalesce(both, F.array(F.struct("h", "kind")))).alias("k")).select(*keys, "at", "k.*", "slots")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, text_hash, item_id, matched, windows, share: the documents that hold at least `share` of an item's windows.

    A window of an item is matched by its template or, letter case aside, by its plain words; `matched` counts the templates where
    they make up the share, and both where they do not. A run of matches on one diagonal (position in the text minus position in
    the item) is one occurrence; its slots must be consistent: every value of the item stands for one value of the document.
    Windows with slots of an inconsistent occurrence do not count; plain words stand for themselves and take nothing from matched
    templates. Changed numbers, names and units still match; changed words do not. Nulls and texts or items of fewer than WINDOW
    words match nothing; repeated rows are found once per (doc_id, text); other columns are ignored.
    """
    text = F.col("text").cast("string")
    asked = windows(benchmark.where(F.col("item_id").isNotNull()).select("item_id", *worded(text)), ["item_id"])
    item = asked.select("item_id", F.col("at").alias("item_at"), "h", F.col("kind").alias("item_kind"), F.col("slots").alias("item_slots")).distinct()
    sizes = item.groupBy("item_id").agg(F.count_distinct("item_at").alias("windows"))
    found = windows(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *worded(text)), ["doc_id", "text_hash"])
    held = F.lit(64 + 32 * WINDOW) + F.coalesce(F.octet_length(F.array_join("item_slots", "", "")), F.lit(0))
    small = (item.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES      # else the windows of both sides are shuffled by hash
    hits = found.join(F.broadcast(item) if small else item, "h")
    none = F.array().cast("array<string>")
    theirs = F.when(F.col("item_kind") == 1, F.col("item_slots")).otherwise(F.col("slots"))
    pairs = F.filter(F.arrays_zip(F.coalesce("item_slots", none).alias("a"), F.coalesce(theirs, none).alias("b")), lambda p: p["a"].isNotNull())
    typed = (F.col("kind") == 0) & (F.col("item_kind") == 0)
    hits = hits.select("doc_id", "text_hash", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), typed.alias("typed"), pairs.alias("pairs"))
    runs = hits.groupBy("doc_id", "text_hash", "item_id", "diagonal").agg(
        F.collect_set(F.struct("item_at", "typed", (F.size("pairs") > 0).alias("slotted"))).alias("ats"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("typed"), F.col("pairs"))))).alias("own"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("all"))

    def sound(pairs: str) -> Column:
        return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))
    good = F.filter("ats", lambda a: ~a["slotted"] | F.when(a["typed"], sound("own")).otherwise(sound("all")))
    per_item = runs.select("doc_id", "text_hash", "item_id", F.explode(good).alias("a")).groupBy("doc_id", "text_hash", "item_id").agg(
        F.count_distinct(F.when(F.col("a.typed"), F.col("a.item_at"))).alias("own"), F.count_distinct("a.item_at").alias("all"))
    counted = F.when(F.col("own") / F.col("windows") >= share, F.col("own")).otherwise(F.col("all"))
    out = join_on(per_item, sizes, ["item_id"]).withColumn("matched", counted).withColumn("share", F.col("matched") / F.col("windows"))
    return out.where(F.col("share") >= share).select("doc_id", "text_hash", "item_id", "matched", "windows", "share")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that leak no benchmark item, with the columns of `docs`."""
    bad = leaks(docs, benchmark, share).select("doc_id", "text_hash").distinct()
    marked = docs.withColumn("__h", F.xxhash64("text"))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["doc_id"]) & (marked["__h"] == bad["text_hash"]), "left_anti").select(*docs.columns)
