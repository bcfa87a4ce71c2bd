"""Benchmark decontamination by template windows.

Texts become templates: lower-case words without punctuation, in which names, numbers and units of measure are typed
placeholders. Windows of WINDOW template words are joined by hash with those of the benchmark items, so a copied
question is found as well as one with other numbers or names. Windows on one diagonal (same shift between document and
item) must fill the slots consistently: one value of the item always stands for one value of the document. An item is
found in a document if enough of its windows are.

A name is a capitalised word after a lower-case letter, digit, comma or semicolon and a space; so the first word of a
sentence is none, and in a text all in capitals none is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import keys, stage, whole

WINDOW = 8  # words; a power of two, as windows are hashed by doubling
BROADCAST_ROWS = 1_000_000  # item windows (24 bytes each) that may be sent to every executor; beyond, a shuffle join

# Units that count as placeholders.
UNITS = [
    "mm", "cm", "dm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "cl", "l", "s", "sec", "min", "h", "hr",
    "hrs", "w", "kw", "mw", "v", "kv", "j", "kj", "cal", "kcal", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "usd", "eur", "gbp",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "foot", "feet", "inch", "inches", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
]

_UNITS_AFTER_NUMBER = ", ".join(f"'{u}'" for u in UNITS)


def template_words(text: str = "text") -> Column:
    """The words of a text with marks: names begin with U+0001, numbers with U+0002; the array is empty without words."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd},;] )(\p{Lu}\p{Ll}+)", "\u0001$1")
    plain = F.regexp_replace(F.lower(named), "[^\\p{L}\\p{M}\\p{Nd}\u0001\\x20\\x09-\\x0D]+", "")
    numbers = F.regexp_replace(plain, r"(\p{Nd}+)", " \u0002$1 ")
    return F.filter(F.split(numbers, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _slots(words: str) -> str:
    """SQL: the placeholder of each word, or the word itself; a unit is one only right after a number."""
    return f"""transform({words}, (w, i) -> case ascii(w) when 1 then '\u0001' when 2 then '\u0002'
        else case when w in ({_UNITS_AFTER_NUMBER}) and i > 0 and ascii({words}[i - 1]) = 2 then '\u0003' else w end end)"""


def _raw(words: str) -> str:
    """SQL: the words without their marks, so it doesn't matter which of them were taken for names."""
    return f"filter(transform({words}, w -> translate(w, '\u0001\u0002', '')), w -> w <> '')"


def _hashed(docs: DataFrame, *carried: str) -> DataFrame:
    """``carried``, ``i`` and ``hash``: a row for each window of the ``words``; texts with fewer words have none.

    The arrays are exploded as "outer" and empty ones dropped afterwards: filters on an array would be evaluated below it,
    which makes it twice.
    """
    at = docs.withColumn("hashes", F.expr(f"transform({_slots('words')}, w -> xxhash64(w))"))
    span = 1
    while span < WINDOW:
        left = f"slice(hashes, 1, greatest(0, size(hashes) - {span}))"
        right = f"slice(hashes, {span + 1}, greatest(0, size(hashes) - {span}))"
        at = at.withColumn("hashes", F.expr(f"zip_with({left}, {right}, (a, b) -> xxhash64(a, b, {span}))"))
        span *= 2
    return at.select(*carried, F.posexplode_outer("hashes").alias("i", "hash")).where("hash is not null")


def _raw_hashed(docs: DataFrame, lengths: list[int], *carried: str) -> DataFrame:
    """``carried``, ``i``, ``length`` and ``hash``: a row for each window of each of ``lengths`` words of the raw ``words``."""
    at = docs.withColumn("raw", F.expr(f"transform({_raw('words')}, w -> xxhash64(w))"))
    window = "transform(sequence(1, greatest(1, size(raw) - {0} + 1)), p -> named_struct('i', p - 1, 'length', {0}, 'hash', case when size(raw) >= {0} then xxhash64({0}, slice(raw, p, {0})) end))"
    at = at.select(*carried, F.explode_outer(F.expr(f"concat({', '.join(window.format(n) for n in lengths)})")).alias("w"))
    return at.select(*carried, "w.*").where("hash is not null")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item``, ``words``, ``slots`` of the distinct items with a word."""
    words = benchmark.select(F.col(item_id).alias("item"), template_words(text).alias("words")).where(F.size("words") > 0).distinct()
    return words.withColumn("slots", F.expr(_slots("words")))


def _word_for_word(worded: DataFrame, items: DataFrame, totals: DataFrame) -> DataFrame | None:
    """What ``find_items`` gives, for the items that have no ``totals``; None if there are none."""
    known = items.select("item", F.xxhash64("words").alias("version"), "words", F.least(F.lit(WINDOW), F.expr(f"size({_raw('words')})")).alias("n")).where("n > 0")
    rest = stage(known.join(totals, (known["item"].eqNullSafe(totals["item"])) & (known["version"] == totals["version"]), "left_anti"), "raw-items")
    lengths = sorted(r["n"] for r in rest.select("n").distinct().collect())  # at most WINDOW of them
    if not lengths:
        return None
    windows = stage(_raw_hashed(rest, lengths, "item", "version", "n").where("n = length").drop("n"), "raw-windows")
    counts = windows.groupBy(F.col("item").alias("of"), F.col("version").alias("v")).agg(F.count("*").alias("n_windows"))
    windows = stage(windows.join(counts, F.col("item").eqNullSafe(F.col("of")) & (F.col("version") == F.col("v"))).drop("of", "v"), "raw-windows")
    places = _raw_hashed(worded, lengths, "id", "k1", "k2").withColumnRenamed("i", "at")
    hits = places.join(F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows, ["length", "hash"])
    # An item of one window is found anywhere; else its windows must follow each other.
    hits = hits.select("id", "k1", "k2", "item", "version", "n_windows", "i", F.when(F.col("n_windows") > 1, F.col("at") - F.col("i")).otherwise(0).alias("shift")).distinct()
    full = hits.groupBy("id", "k1", "k2", "item", "version", "n_windows", "shift").agg(F.count("*").alias("n_matched")).where("n_matched = n_windows")
    return full.select("id", "k1", "k2", "item", "version", "n_windows", "n_matched", F.lit(False).alias("reparameterised")).distinct().drop("version")


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: int = 50) -> DataFrame:
    """A row for each document and item found in it: ``id``, ``k1``, ``k2``, ``item``, ``n_windows`` (of the item),
    ``n_matched`` (of these in the document) and ``reparameterised`` (some slot has another value).

    Found means that at least ``coverage`` per cent of the item's windows match with consistent slots. Windows of which
    half or more are placeholders don't count. An item without any other window, as it is shorter than a window or full of
    placeholders, is found where all of its words follow each other unchanged (in any case, without punctuation); ``n_windows`` counts
    windows of these words then, one for a shorter item. Null texts and items without a word match nothing. Rows that repeat in id and text are one document; items that repeat in id and text one item; an id
    used for several texts stands for each. Null ids are values. Empty tables give an empty result.
    """
    items = stage(_items(benchmark, item_id, item_text), "items")
    sizes = "size(filter(slice(slots, i + 1, {0}), w -> ascii(w) <= 3))".format(WINDOW)
    windows = _hashed(items, "item", "words", "slots")
    windows = windows.where(F.expr(f"2 * {sizes} < {WINDOW}")).select("item", F.xxhash64("words").alias("version"), "i", "hash", F.expr(f"{sizes} > 0").alias("open"))
    windows = stage(windows, "item-windows")
    totals = windows.groupBy("item", "version").agg(F.count("*").alias("n_windows"))

    slim = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    worded = slim.select("id", *keys("id", "text"), template_words().alias("words"))
    places = _hashed(worded, "id", "k1", "k2").withColumnRenamed("i", "at")
    few = windows.count() <= BROADCAST_ROWS
    hits = places.join(F.broadcast(windows) if few else windows, "hash").select("id", "k1", "k2", "item", "version", "i", (F.col("at") - F.col("i")).alias("shift"), "open")
    hits = stage(hits.distinct(), "hits")

    shut = hits.where("not open").select("id", "k1", "k2", "item", "version", "i", F.lit(False).alias("other"))
    opened = stage(hits.where("open").groupBy("id", "k1", "k2", "item", "version", "shift").agg(F.collect_set("i").alias("is")), "open-hits")
    known = items.select("item", F.xxhash64("words").alias("version"), F.col("words").alias("iw"), "slots")
    filled = opened.join(worded.select("k1", "k2", "words").dropDuplicates(["k1", "k2"]), ["k1", "k2"]) if not opened.isEmpty() else opened.withColumn("words", F.lit(None).cast("array<string>"))
    filled = filled.join(known, (filled["item"].eqNullSafe(known["item"])) & (filled["version"] == known["version"])).drop(known["item"]).drop(known["version"])
    spots = f"array_distinct(flatten(transform(is, p -> sequence(p, p + {WINDOW - 1}))))"
    pairs = F.expr(f"array_distinct(transform(filter({spots}, p -> ascii(slots[p]) <= 3), p -> named_struct('i', iw[p], 'd', words[p + shift])))")
    filled = filled.withColumn("pairs", pairs).where("size(array_distinct(pairs.i)) = size(pairs)")
    filled = filled.select("id", "k1", "k2", "item", "version", F.explode("is").alias("i"), F.expr("exists(pairs, p -> p.i <> p.d)").alias("other"))

    # Windows without a slot need no check; they match the same words.
    matched = shut.union(filled).groupBy("id", "k1", "k2", "item", "version").agg(F.count_distinct("i").alias("n_matched"), F.max("other").alias("reparameterised"))
    found = matched.join(totals, (matched["item"].eqNullSafe(totals["item"])) & (matched["version"] == totals["version"])).drop(totals["item"]).drop(totals["version"])
    found = found.where(F.col("n_matched") * 100 >= coverage * F.col("n_windows")).select("id", "k1", "k2", "item", "n_windows", "n_matched", "reparameterised")
    copied = _word_for_word(worded, items, totals)
    return found if copied is None else found.union(copied)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, as they were."""
    found = stage(find_items(docs, benchmark, doc_id, text, **options).select("k1", "k2").distinct(), "contaminated")
    rows = docs.select(whole(docs), F.col(doc_id).alias("id"), F.col(text).alias("text")).select("row", *keys("id", "text"))
    return rows.join(found, ["k1", "k2"], "left_anti").select("row.*")
