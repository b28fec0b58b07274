"""Benchmark decontamination by template windows, with built-in functions only.

Documents and benchmark items are canonicalised in the same way: lower case, words
without punctuation, and typed placeholders for numbers, for units after a number and
for names, that is capitalised words. What is a name depends on letter case, so each
text has two templates, without and with names; a copy in other letter case or with
other line breaks is found by the first of them. Windows of five words of both are
hashed and joined, and keep the words that they are made of. Along one alignment of
document and item, every value of the item must stand for one value of the document
(slot consistency), so that a question with other numbers, names or units is caught and
a chance mixture isn't. At the start of a sentence a word may be no name: where the
document has the item's own word there, it is read as a plain word, and if the values
of such a word differ, only the windows that hold it go. A window with the item's own
values needs no alignment.

A pair is reported if such windows cover 0.8 or more of the item's distinct windows.
If windows with the item's own values alone do, that is all. Else at least half of
the words covered must be literal (each window of the item counts once, by its best
hit): a template of placeholders only says little.

The item side is broadcast only if it has at most ``BROADCAST_WINDOWS`` windows.

Edge cases: a null text or one without words has no window and matches nothing; an item
of three or four words is one window, found anywhere; an item of one or two words is
a phrase of the language and found only in a document of just these words; items with
the same text count as one for the join and are all reported; repeated document rows
count as one document, as do rows that share a doc_id, and rows with a null id; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

WINDOW, COVERAGE = 5, 0.8
BROADCAST_WINDOWS = 1_000_000
#: Units that are placeholders when they follow a number.
UNITS = "mm|cm|dm|m|km|mg|g|kg|t|ml|cl|dl|l|ms|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|feet|ft|inch|inches|yards?|pounds?|lbs?|oz|ounces?|dollars?|euros?|cents?|usd|eur|percent|degrees?|hz|khz|mhz|w|kw|v|kv|j|kj|n|pa|kpa|met(?:er|re)s?|kilomet(?:er|re)s?|grams?|kilograms?|lit(?:er|re)s?"
NUMBER, UNIT, NAME, START = "\u0001", "\u0002", "\u0003", "\u0004"
#: What a decimal sign is while words are cut, so that it cuts none.
POINT = "\u0005"
MARKS = NUMBER + UNIT + NAME + START
#: A capitalised word: a capital and then a small letter.
CAPITALISED = r"\p{Lu}\p{M}*\p{Ll}"
#: Items of fewer words than this are found only in a document of just these words.
PHRASE = 3


def marked_words(text: Column, names: bool = False) -> Column:
    """The words of a text in their own letter case. A number is its mark and its value, a unit likewise; with
    ``names``, capitalised words have their mark before them, one within a sentence and one at its start."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    m = F.regexp_replace(t, f"[{MARKS}{POINT}]", " ")
    if names:
        m = F.regexp_replace(m, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?={CAPITALISED})", START)
        # Within a sentence: white space before it, and before that a small letter or a comma.
        m = F.regexp_replace(m, rf"{START}(?<=[\p{{Ll}},;:][\s\p{{Z}}]{{1,99}}{START})", NAME)
    m = F.regexp_replace(m, r"\d(?:[\d.,]*\d)?", f" {NUMBER}$0 ")
    m = F.regexp_replace(m, rf"({NUMBER}[^ ]*)\s+[{NAME}{START}]?((?iu:{UNITS}))(?![\p{{L}}\p{{M}}\p{{N}}])", f"$1 {UNIT}$2")
    m = F.split(F.regexp_replace(m, r"(?<=\d)[.,](?=\d)", POINT), rf"[^\p{{L}}\p{{M}}\p{{N}}{MARKS}{POINT}]+")
    if not names:  # without digits and marks the words are all there is
        m = F.when(t.rlike(rf"[\d{MARKS}{POINT}]"), m).otherwise(F.split(t, r"[^\p{L}\p{M}\p{N}]+"))
    return F.array_remove(m, "")


def hashed(word: Column) -> Column:
    """A word of the first template: in small letters, a number or unit as its mark."""
    return F.xxhash64(F.when(word < F.lit(NAME), F.substring(word, 1, 1)).otherwise(F.lower(word)))


def windows(df: DataFrame, key: str, *keep: str, shorter: Sequence[int] = ()) -> DataFrame:
    """``key, keep, w, n, pos, h`` from the words ``w`` of each text: for every word the hashes of the window that it
    begins, in the first template and, if that has a name, in the second. Windows at the end of a text have fewer
    words; ``shorter`` asks for windows of so many words everywhere."""
    t = df.select(key, *keep, "w", F.transform("w", hashed).alias("a"))
    # Each word is hashed once; what follows moves numbers only.
    t = t.select(key, *keep, "w", "a", F.zip_with("w", "a", lambda x, h: F.when(x.rlike(f"^{CAPITALISED}"), F.xxhash64(F.lit(NAME))).otherwise(h)).alias("b"))
    shift = lambda c, i: F.slice(c, i + 1, F.greatest(F.size(c) - i, F.lit(0))) if i else F.col(c)
    t = t.select(key, *keep, "w", F.size("w").alias("n"), F.posexplode(F.arrays_zip(*[shift(c, i).alias(f"{c}{i}") for c in "ab" for i in range(WINDOW)])).alias("pos", "z"))
    fields = t.schema["z"].dataType.fieldNames()
    of = lambda c, k: F.xxhash64(*[F.col("z").getField(fields["ab".index(c) * WINDOW + i]) for i in range(k)])
    both = [h for k in (WINDOW, *shorter) for h in (of("a", k), F.when(of("a", k) != of("b", k), of("b", k)))]
    return t.select(key, *keep, "w", "n", "pos", F.explode(F.array(*both)).alias("h")).where("h IS NOT NULL")


def is_slot(word: Column) -> Column:
    return word < F.lit(POINT)


def value(word: Column) -> Column:
    return F.lower(F.translate(word, MARKS, ""))


def item_windows(items: DataFrame) -> DataFrame:
    """``item, item_pos, own, kind, h, slots, size`` of the distinct texts ``item, text``: ``kind`` is the template, ``slots``
    the marked words, ``own`` the window's identity."""
    t = items.select("item", marked_words(F.col("text"), names=True).alias("m"))
    t = t.select("item", "m", F.transform("m", lambda x: F.translate(x, NAME + START, "")).alias("w"))
    t = windows(t, "item", "m").where((F.col("pos") == 0) | (F.col("pos") <= F.col("n") - WINDOW))
    here = F.slice("m", F.col("pos") + 1, F.lit(WINDOW))
    t = t.withColumn("here", here).withColumn("own", F.xxhash64(F.transform("here", lambda x: F.when(x.startswith(NAME), F.lit(NAME)).when(x < F.lit(NAME), F.substring(x, 1, 1)).otherwise(value(x)))))
    first = F.xxhash64(*[F.get(F.transform(F.slice("w", F.col("pos") + 1, F.lit(WINDOW)), hashed), F.lit(i)) for i in range(WINDOW)])
    t = t.withColumn("kind", F.when(F.col("h") == first, 0).otherwise(2))
    slots = F.when(F.col("kind") == 0, F.transform("here", lambda x: F.translate(x, NAME + START, ""))).otherwise(F.col("here"))
    return t.select("item", F.col("pos").alias("item_pos"), "own", "kind", "h", slots.alias("slots"), F.size("here").alias("size"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, windows, item_windows, coverage, reparameterised`` for each pair that matches."""
    docs = pick(docs, "doc_id", "text")
    items = pick(benchmark, "item_id", "text").groupBy("text").agg(F.collect_set("item_id").alias("ids"), F.min("item_id").alias("item"))
    bench = cut(item_windows(items))
    total = bench.groupBy("item").agg(F.countDistinct("own").alias("item_windows"))
    sizes = bench.agg(F.count("*"), F.collect_set(F.when(F.col("size").between(PHRASE, WINDOW - 1), F.col("size")))).first()
    side = F.broadcast if sizes[0] <= BROADCAST_WINDOWS else (lambda x: x)
    # Most windows match nothing; what does is kept, as all later steps read it. Only there are words cut out.
    hits = windows(docs.select("doc_id", marked_words(F.col("text")).alias("w")), "doc_id", shorter=sorted(sizes[1]))
    known = bench.select("item", "item_pos", "own", "kind", "h", "size", F.exists("slots", is_slot).alias("slotted"))
    hits = hits.join(side(known), "h").where((F.col("size") >= PHRASE) | (F.col("size") == F.col("n")))
    hits = cut(hits.select("doc_id", "item", "own", "kind", "pos", "item_pos", "slotted", "size", F.transform(F.slice("w", F.col("pos") + 1, F.col("size")), value).alias("got")))
    found = hits.where("NOT slotted").select("doc_id", "item", "own", F.col("size").alias("literal"), "size", F.lit(True).alias("exact"))
    found = found.unionByName(_consistent(hits.where("slotted"), side(bench.select("item", "item_pos", "kind", "slots"))))
    # Each window of the item once, by its best hit; in an exact one all words are the item's.
    found = found.groupBy("doc_id", "item", "own").agg(F.max("exact").alias("exact"), F.max("literal").alias("literal"), F.max("size").alias("size"))
    literal = F.sum(F.when(F.col("exact"), F.col("size")).otherwise(F.col("literal"))) / F.sum("size")
    found = found.groupBy("doc_id", "item").agg(F.count("*").alias("windows"), F.count_if("exact").alias("exact"), literal.alias("literal"))
    need = coverage * F.col("item_windows")
    found = found.join(side(total), "item").where(F.col("windows") >= need).withColumn("reparameterised", F.col("exact") < need)
    found = found.where((F.col("literal") >= 0.5) | ~F.col("reparameterised"))
    out = found.join(items.select("item", "ids"), "item").select("doc_id", F.explode("ids").alias("item_id"), "windows", "item_windows", "reparameterised")
    return out.withColumn("coverage", F.col("windows") / F.col("item_windows"))


def _consistent(hits: DataFrame, bench: DataFrame) -> DataFrame:
    """The hits with placeholders whose values are the item's own, or else on alignments where each value of
    the item stands for one value."""
    own = hits.withColumn("shift", F.col("pos") - F.col("item_pos")).join(bench, ["item", "item_pos", "kind"])
    pairs = F.filter(F.arrays_zip("slots", "got"), lambda z: is_slot(z["slots"]))
    own = own.withColumn("s", pairs).withColumn("exact", F.forall("s", lambda z: value(z["slots"]) == z["got"]))
    # A sentence's first word that is the item's own is no placeholder: such windows are a template between the two.
    starts = lambda z: z["slots"].startswith(START)
    level = F.when(F.col("kind") == 0, 0).when(F.forall("s", lambda z: ~starts(z) | (value(z["slots"]) == z["got"])), 1).otherwise(2)
    own = own.withColumn("level", level)
    own = own.withColumn("literal", F.col("size") - F.size(F.filter("s", lambda z: (F.col("level") == 2) | ~starts(z))))
    # A template is judged by its own windows and those of the ones before, never by those of later ones.
    s = own.select("doc_id", "item", "shift", "level", F.explode("s").alias("z"))
    upto = lambda v: F.when(F.col("level") <= v, F.col("z.got"))
    s = s.groupBy("doc_id", "item", "shift", F.col("z.slots").alias("value")).agg(*[(F.min(upto(v)) != F.max(upto(v))).alias(f"d{v}") for v in range(3)])
    start = F.col("value").startswith(START)
    clash = [F.coalesce(F.bool_or(F.col(f"d{v}") & ~start), F.lit(False)).alias(f"clash{v}") for v in range(3)]
    align = s.groupBy(F.col("doc_id").alias("_doc"), F.col("item").alias("_item"), F.col("shift").alias("_shift")).agg(*clash, F.collect_set(F.when(F.col("d2") & start, F.col("value"))).alias("starts"))
    fits = F.when(F.col("level") == 0, ~F.col("clash0")).when(F.col("level") == 1, ~F.col("clash1")).otherwise(~F.col("clash2") & ~F.arrays_overlap("slots", "starts"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("item") == F.col("_item")) & (F.col("shift") == F.col("_shift"))
    return own.join(align, same).where(F.col("exact") | fits).select("doc_id", "item", "own", "literal", "size", "exact")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
