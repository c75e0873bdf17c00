"""Benchmark decontamination by templates, in DataFrame operations only.

A text is canonicalised: numbers with their units and names become typed placeholders, the other words lose
case and punctuation. Windows of consecutive template words are hashed, and the windows of documents joined
with those of the benchmark on the hash. Matches on one diagonal (the same shift between document and
question) are one occurrence, and its slots are compared: a value of the question must stand for one value
in the document throughout, and the other way round. So a question with other numbers and names is caught,
while a text that shares sentence forms only is not.

Before the join a document's windows pass a filter of a fixed number of bits made of the benchmark's windows,
so that hardly any but matching ones are shuffled, and the benchmark is never broadcast as a whole.

`matches` takes names by their place and windows of one size. `contaminated`, which the queries use, adds what
that cannot see: `folded_matches` looks neither at case nor at spacing nor at place. There a word is literal if
the benchmark has it in lower case; any other word, in a question or a document, is a slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.sources.sink import stage

#: Units that belong to the number before them.
UNITS = (
    "percent|km|cm|mm|m|kg|g|mg|lbs?|oz|l|ml|s|secs?|seconds?|mins?|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|feet|ft"
    "|inch|inches|met(?:er|re)s?|kilomet(?:er|re)s?|grams?|kilograms?|pounds?|lit(?:er|re)s?|dollars?|euros?|cents?|usd|eur"
)
#: What opens a slot, and what stands for the blank inside it. Texts lose these characters.
OPEN, BLANK = "\u0001", "\u0002"
#: Words of 64 bits in the filter.
FILTER_WORDS = 1 << 14


@dataclass(frozen=True)
class Limits:
    #: Words of a window, and how many of them must be literal.
    window: int = 8
    literal: int = 5
    #: Part of a question's windows, in hundredths, that make a document contaminated, and the number of them
    #: that is enough whatever the part.
    share: int = 40
    enough: int = 24


def _marked(text: Column) -> Column:
    """The text with slots as single words: OPEN, n or p, the value. Punctuation is gone."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    out = F.when(out.contains(OPEN) | out.contains(BLANK), F.translate(out, OPEN + BLANK, "  ")).otherwise(out)
    # a name: a capitalised word that begins neither a sentence nor a line; looking ahead first makes most
    # places fail at once
    out = F.regexp_replace(out, r"(?=\p{Lu})(?<=[\p{L}\p{N},;:)] )(\p{Lu}[\p{L}\p{N}’'-]*)", OPEN + "p$1")
    numbers = F.regexp_replace(
        out,
        rf"(?=[$€£+\-\p{{Nd}}])(?<![\p{{L}}\p{{N}}{OPEN}])([$€£]?[+-]?\p{{Nd}}[\p{{Nd}}.,:/]*)(?: ?((?i:{UNITS})|%)(?![\p{{L}}\p{{N}}]))?",
        f"{OPEN}n$1{BLANK}$2",
    )
    out = F.when(text.cast("string").rlike(r"\p{Nd}"), numbers).otherwise(out)
    return F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{OPEN}{BLANK}\s]+", "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _template(marked: Column) -> Column:
    return F.lower(F.when(marked.contains(OPEN), F.regexp_replace(marked, rf"({OPEN}[np])\S*", "$1")).otherwise(marked))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once per row. As a plain column the optimiser may put its
    expression inside a lambda that uses it, and then it is computed anew for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_windows(df: DataFrame, k: int) -> DataFrame:
    """`df` (marked) with `windows`: the hash of each k consecutive template words, by place."""
    df = _held(df, "hashes", F.transform(_words(_template(F.col("marked"))), lambda w: F.xxhash64(w)))
    count = F.size("hashes") - k + 1
    every = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("hashes", i, k)))
    return _held(df, "windows", F.when(count > 0, every).otherwise(F.array().cast("array<bigint>"))).drop("hashes")


def _passes(h: Column, bits: str = "bits") -> Column:
    """Whether the filter in the column `bits` has the hash."""
    word = F.get(bits, F.shiftright(h.bitwiseAND(64 * FILTER_WORDS - 1), 6).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    return word.bitwiseAND(bit) != 0


def _by_place(df: DataFrame, hashes: str, k: int) -> DataFrame:
    """A row for each place `pos` where k words begin. What is computed of the words at a place is generated code,
    and the arrays beside it are not copied; lambdas over arrays are interpreted and take many times as long."""
    last = F.size(hashes) - k
    return df.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("pos"))


def _slots(words: Column, at: Column, k: int) -> Column:
    """Of the k words from the place `at` (from 0): value of a slot, null of a literal word."""
    return F.transform(F.slice(words, at + 1, k), lambda w: F.when(w.startswith(OPEN), F.lower(w)))


def questions(benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(item_id, at, hash, slots, item_windows) of the windows of `benchmark` with enough literal words."""
    k = limits.window
    marked = _held(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "marked", _marked(F.col("text")))
    rows = _with_windows(marked, k).select("item_id", "marked", F.posexplode("windows").alias("at", "hash"))
    rows = rows.select("item_id", "at", "hash", _slots(_words(F.col("marked")), F.col("at"), k).alias("slots"))
    rows = rows.where(F.size(F.filter("slots", lambda s: s.isNull())) >= limits.literal).distinct()
    count = rows.groupBy("item_id").agg(F.countDistinct("at").alias("item_windows"))
    return rows.join(count, "item_id")


def _filter_bits(windows: DataFrame) -> Column:
    """Scalar array of FILTER_WORDS longs: the bits of the windows' hashes."""
    place = F.col("hash").bitwiseAND(64 * FILTER_WORDS - 1)
    bits = windows.select(
        F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = windows.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word")
    rows = every.join(bits, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    listed = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return rows.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")).scalar()


def matches(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, item_windows, n_slots of each document and question whose
    common windows, slots consistent, reach the limits.

    `docs`: doc_id, text; `benchmark`: item_id, text. Null and empty texts, and questions of fewer words than
    a window, match nothing. A document or question that is there twice counts once. A null doc_id or item_id
    is one like others, as text_hash tells documents apart. No documents or no questions give no rows.
    """
    k = limits.window
    asked = stage(questions(benchmark, limits), "questions")
    bits = _filter_bits(asked)
    text = F.col("text").cast("string")
    prepared = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marked = _held(prepared, "marked", _marked(F.col("text"))).drop("text")
    # split once: a text may have many hits
    hashed = _held(marked, "hashes", F.transform(_words(_template(F.col("marked"))), lambda w: F.xxhash64(w)))
    hashed = _held(hashed, "words", _words(F.col("marked"))).drop("marked")
    # the hash of an array is that of its elements side by side
    window = F.xxhash64(*(F.get("hashes", F.col("pos") + j) for j in range(k)))
    places = _held(_by_place(hashed.withColumn("bits", bits), "hashes", k), "hash", window).where(_passes(F.col("hash")))
    # the part of a hit is cut out while code is generated, before a lambda takes whole rows over
    parts = _held(places, "part", F.slice("words", F.col("pos") + 1, k))
    found = parts.select("doc_id", "text_hash", "pos", "hash", _slots(F.col("part"), F.lit(0), k).alias("own"))
    found = stage(found, "window-hits")  # few rows, read twice below
    paired = found.join(asked, "hash").select(
        "doc_id", "text_hash", "item_id", "item_windows", "at", (F.col("pos") - F.col("at")).alias("shift"),
        F.filter(
            F.zip_with("slots", "own", lambda q, d: F.struct(q.alias("q"), d.alias("d"))), lambda x: x["q"].isNotNull()
        ).alias("pairs"),
    )
    occurrence = ["doc_id", "text_hash", "item_id", "shift"]
    distinct = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: p[name])))
    consistent = (
        paired.withColumn("pair", F.explode_outer("pairs"))
        .groupBy(*occurrence)
        .agg(F.collect_set("pair").alias("pairs"))
        .where((F.size("pairs") == distinct("q")) & (F.size("pairs") == distinct("d")))
        .select(*occurrence, F.size("pairs").alias("n_slots"))
    )
    # null ids must meet, so the key is one struct
    key = F.struct(*occurrence).alias("key")
    return (
        paired.select(key, "at", "item_windows")
        .join(consistent.select(key, "n_slots"), "key")
        .select("key.doc_id", "key.text_hash", "key.item_id", "at", "item_windows", "n_slots")
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(
            F.countDistinct("at").alias("n_windows"),
            F.max("item_windows").alias("item_windows"),
            F.max("n_slots").alias("n_slots"),
        )
        .where(f"100 * n_windows >= {limits.share} * item_windows or n_windows >= {limits.enough}")
    )


#: Template words that stand for the slots of folded texts: a word that is not literal, a number.
WORD, NUMBER = 1, 2


#: Sizes of windows by the words of the question: one changed word leaves the share of the windows in any
#: question of 8 words or more. A question of fewer words is one window.
SHORT = ((13, 3), (21, 5))
#: So many rich windows at least let the slots of a question with such windows vary.
LEAST_RICH = 3


def _window_size(n_words: Column, limits: Limits) -> Column:
    size = F.when(n_words < limits.window, n_words)
    for below, k in SHORT:
        size = size.when(n_words < below, min(k, limits.window))
    return size.otherwise(limits.window)


def _folded_words(text: Column) -> Column:
    """Words without punctuation, in their own case; a number with its unit is one word that begins with OPEN.
    White space of any kind and length parts words, also a number from its unit. A sign of arithmetic between
    two numbers is a word."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), OPEN + BLANK, "  ")
    numbers = F.regexp_replace(
        out,
        rf"(?=[$€£+\-\p{{Nd}}])(?<![\p{{L}}\p{{N}}{OPEN}])([$€£]?[+-]?\p{{Nd}}[\p{{Nd}}.,:/]*)(?:[\s\p{{Z}}]*+((?i:{UNITS})|%)(?![\p{{L}}\p{{N}}]))?",
        f"{OPEN}n$1{BLANK}$2",
    )
    out = F.when(out.rlike(r"\p{Nd}"), numbers).otherwise(out)
    kept = rf"\p{{L}}\p{{N}}{OPEN}{BLANK}\s\p{{Z}}"
    out = F.regexp_replace(out, rf"[^{kept}]++(?<!{BLANK}[\s\p{{Z}}][+*/=×÷^-](?=[\s\p{{Z}}]{OPEN}))", "")
    return F.array_remove(F.split(out, r"[\s\p{Z}]+"), "")


def _folded(df: DataFrame, bits: Column) -> DataFrame:
    """`df` (words, in lower case) with `template`: a number for each word. `bits`: filter of the literal words."""

    def one(w: Column) -> Column:
        h = F.xxhash64(w)
        return F.when(w.startswith(OPEN), F.lit(NUMBER).cast("long")).when(_passes(h), h).otherwise(F.lit(WORD).cast("long"))

    return _held(df.withColumn("bits", bits), "template", F.transform("words", one)).drop("bits")


def _is_slot(t: Column) -> Column:
    return (t == WORD) | (t == NUMBER)


def _key(hash: Column, k: Column, n_literal: Column, words: Column, limits: Limits) -> tuple[Column, Column]:
    """What a window is joined by, and whether it is rich: has the literal words that let its slots vary. Others
    must be the same to the word, so that a short or number-heavy question matches where it is repeated."""
    short = F.when(k.isin([k for _, k in SHORT]), F.round(k * limits.literal / limits.window))
    rich = n_literal >= F.coalesce(short, F.lit(limits.literal))
    return F.when(rich, hash).otherwise(F.xxhash64(hash, words)), rich


def folded_questions(benchmark: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The literal words of `benchmark` (hash), and (item_id, k, at, template_hash, hash, rich, slots,
    item_windows, rich_windows) of all windows of k words of each question."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _folded_words(F.col("text")).alias("words"))
    asked = stage(asked.where(F.size("words") > 0).distinct(), "folded-questions")
    lower = lambda w: (F.lower(w) == w) & ~w.startswith(OPEN)
    literal = F.when(F.exists("words", lower), F.filter("words", lower)).otherwise(F.filter("words", lambda w: ~w.startswith(OPEN)))
    vocabulary = asked.select(F.explode(F.transform(literal, lambda w: F.xxhash64(F.lower(w)))).alias("hash")).distinct()

    words = asked.select("item_id", F.transform("words", lambda w: F.lower(w)).alias("words"))
    rows = _folded(words, _filter_bits(vocabulary)).withColumn("k", _window_size(F.size("words"), limits))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))))
    part = F.slice("template", F.col("at") + 1, F.col("k"))
    own = F.slice("words", F.col("at") + 1, F.col("k"))
    rows = rows.select("item_id", "k", "at", part.alias("part"), own.alias("own"))
    hash, n_literal = F.xxhash64("part"), F.size(F.filter("part", lambda t: ~_is_slot(t)))
    key, rich = _key(hash, F.col("k"), n_literal, F.col("own"), limits)
    slots = F.zip_with("part", "own", lambda t, w: F.when(_is_slot(t), w))
    rows = rows.select("item_id", "k", "at", hash.alias("template_hash"), key.alias("hash"), rich.alias("rich"), slots.alias("slots"))
    count = rows.groupBy("item_id").agg(
        F.countDistinct("at").alias("item_windows"), F.countDistinct(F.when(F.col("rich"), F.col("at"))).alias("rich_windows")
    )
    return vocabulary, rows.distinct().join(count, "item_id")


def folded_matches(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """As `matches`, without regard to case, spacing and the place of names, and for questions of any length. Of an occurrence whose slots are
    not consistent the windows count that are the same to the word. The limit is reached by the share of all
    windows of the question or of its rich ones."""
    vocabulary, asked = folded_questions(benchmark, limits)
    asked = stage(asked, "folded-windows")
    sizes = sorted(r["k"] for r in asked.select("k").distinct().collect())
    text = F.col("text").cast("string")
    prepared = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), _folded_words(F.lower(text)).alias("words")
    )
    held = _held(prepared, "held", F.col("words")).drop("words").withColumnRenamed("held", "words")
    rows = _folded(held, _filter_bits(vocabulary))
    wanted = _filter_bits(asked.select(F.col("template_hash").alias("hash")).distinct())
    places = _by_place(rows.withColumn("bits", wanted), "template", 1)
    word = lambda j: F.get("template", F.col("pos") + j)
    fits = lambda k: F.col("pos") + k <= F.size("template")
    windows = {k: F.when(fits(k), F.xxhash64(*(word(j) for j in range(k)))) for k in sizes}
    kinds = F.posexplode(F.array(*(windows[k] for k in sizes)) if sizes else F.array().cast("array<bigint>"))
    places = places.select("*", kinds.alias("kind", "hash")).where(_passes(F.col("hash")))
    k = F.get(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), F.col("kind"))
    cut = lambda name: F.slice(name, F.col("pos") + 1, k)
    # the parts of a hit are cut out while code is generated, before a lambda takes whole rows over
    parts = places.select("doc_id", "text_hash", "pos", "hash", F.explode(F.array(F.struct(k.alias("k"), cut("template").alias("part"), cut("words").alias("own")))).alias("hit"))
    n_literal = F.size(F.filter("hit.part", lambda t: ~_is_slot(t)))
    found = parts.select("doc_id", "text_hash", "hit.k", "pos", "hash", n_literal.alias("n_literal"), "hit.own")
    key, _ = _key(F.col("hash"), F.col("k"), F.col("n_literal"), F.col("own"), limits)
    found = found.select("doc_id", "text_hash", "k", "pos", "own", key.alias("hash"))
    found = found.withColumn("bits", _filter_bits(asked.select("hash").distinct())).where(_passes(F.col("hash"))).drop("bits")

    pairs = F.filter(F.zip_with("slots", "own", lambda q, d: F.struct(q.alias("q"), d.alias("d"))), lambda x: x["q"].isNotNull())
    question = ["item_id", "k", "item_windows", "rich_windows"]
    occurrence = ["doc_id", "text_hash", *question, "shift"]
    paired = found.join(asked, ["k", "hash"]).select(
        "doc_id", "text_hash", *question, (F.col("pos") - F.col("at")).alias("shift"), "at", "rich", pairs.alias("pairs")
    )
    same = F.forall("pairs", lambda x: x["q"] == x["d"])
    # a whole question of so few words must be the same, too
    paired = paired.where((F.col("item_windows") > 1) | ~F.col("k").isin([k for _, k in SHORT]) | same)
    # an occurrence has no more windows than its question
    held = paired.groupBy(*occurrence).agg(
        F.collect_set(F.struct("at", "rich", same.alias("same"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    distinct = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: p[name])))
    consistent = (F.size("pairs") == distinct("q")) & (F.size("pairs") == distinct("d"))
    kept = F.when(consistent, F.col("places")).otherwise(F.filter("places", lambda x: x["same"]))
    # the windows of all occurrences of a long question count together; short windows are common, so those of
    # two neighbouring diagonals do, which a word put in or left out makes of one
    lanes = F.when(F.col("k") == limits.window, F.array(F.lit(0))).otherwise(F.array("shift", F.col("shift") + 1))
    at = F.collect_set(F.struct("place.at", "place.rich")).alias("at")
    counted = (
        held.select(*occurrence, F.size("pairs").alias("n_slots"), kept.alias("kept"))
        .select("*", F.explode(lanes).alias("lane"))
        .select("*", F.explode("kept").alias("place"))
        .groupBy("doc_id", "text_hash", *question, "lane")
        .agg(at, F.max("n_slots").alias("n_slots"))
        .select("*", F.size("at").alias("n_windows"), F.size(F.filter("at", lambda x: x["rich"])).alias("n_rich"))
    )
    return (
        counted.where(_reached(limits))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct(F.col("n_windows").cast("long").alias("n_windows"), "item_windows", "n_slots")).alias("most"))
        .select("doc_id", "text_hash", "item_id", "most.*")
    )


def _reached(limits: Limits) -> Column:
    """Of three-word windows all but the three that one changed word can take are asked for."""
    least = SHORT[0][1]
    enough = lambda n, every: f"if(k = {least}, {n} >= {every} - {least}, true) and 100 * {n} >= {limits.share} * {every}"
    return F.expr(
        f"({enough('n_windows', 'item_windows')}) or (k = {limits.window} and n_rich >= {limits.enough})"
        f" or (n_rich >= if(k = {limits.window}, 1, {LEAST_RICH}) and {enough('n_rich', 'rich_windows')})"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The columns of `matches` for each document and question that `matches` or `folded_matches` finds, with
    the figures of the one that counts more windows."""
    every = matches(docs, benchmark, limits).unionByName(folded_matches(docs, benchmark, limits))
    most = F.max(F.struct("n_windows", "item_windows", "n_slots")).alias("most")
    return every.groupBy("doc_id", "text_hash", "item_id").agg(most).select("doc_id", "text_hash", "item_id", "most.*")


def clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that hold no question."""
    gone = contaminated(docs, benchmark, limits).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
