"""Benchmark decontamination by templates.

Texts become template words: numbers, units after numbers and capitalised names turn into
typed placeholders, other words are lower-cased. A second, folded form lower-cases names as
well, so that case alone never breaks a window: words agree on either form. Documents that hold too few of an item's
anchors (pairs of neighbouring words) are left out first; of the others, windows of ``WINDOW`` template words are
hash-joined with the benchmark's on either form. On each diagonal (a fixed shift between document and
item) the fillers of matching slots must correspond one to one, which holds for copies and
for questions whose numbers or names were replaced consistently, and not for chance.
Windows short of literal words match on the folded form alone or, short of those too, word by
word. A run of ``RUN`` matching words is reported whatever share of the item it is.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialise, salted_join

WINDOW = 8
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Words of one run that are reported at any coverage, and its windows.
RUN = 13
RUN_WINDOWS = RUN - WINDOW + 1
#: Rows of benchmark windows or anchors, and characters of whole items, that are broadcast; beyond it the
#: joins shuffle.
MOST_BROADCAST, MOST_CHARS = 1_000_000, 8_000_000

#: Units that count as such right after a number.
UNITS = "mm cm m km in inch inches ft feet yd mi mile miles mg g kg lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent mph kmh kph w kw hz khz mhz ghz kb mb gb tb degrees".split()

WORD = r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*"


def raw_words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def one_sigma(text: Column) -> Column:
    """One letter for both small sigmas: which of them a capital becomes depends on what
    follows, so that a word alone and the same word in its text may differ."""
    return F.translate(text, "ς", "σ")


def template(words: Column, names: bool = True) -> Column:
    """Template words of raw words, as an array of the same length; folded ones without ``names``."""
    units = F.array(*[F.lit(u) for u in UNITS])

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        first = F.substring(w, 1, 1)  # words of letters and marks, or numbers of any script
        number = F.when(first < "\x80", (first >= "0") & (first <= "9")).otherwise(w.rlike(r"^\p{N}"))
        # initcap lower-cases the rest, so only the first letter is a capital
        name = (w != low) & (w == F.initcap(w))
        return F.when(number, "\x01").when(name & F.lit(names), "\x02").otherwise(low)

    plain = F.transform(words, one)

    def with_unit(x: Column) -> Column:
        after = lambda w, i: F.when((i > 0) & (F.get(x, i - 1) == "\x01") & F.array_contains(units, w), "\x03").otherwise(w)
        return F.when(F.array_contains(x, "\x01"), F.transform(x, after)).otherwise(x)

    return F.transform(F.array(plain), with_unit)[0]


def windows(words: Column, size: Column | int) -> Column:
    """Hashes of the windows of template words."""
    size = F.lit(size) if isinstance(size, int) else size

    def of(x: Column) -> Column:
        n = F.size(x) - size + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(x, i, size)))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]


def either(words: Column, folded: Column, plain: Column, size: Column | int) -> Column:
    """Of each window, the hashes of its typed, folded and plain form."""
    both = F.zip_with(windows(words, size), windows(folded, size), lambda a, b: F.array(a, b))
    return F.zip_with(both, windows(plain, size), lambda a, b: F.concat(a, F.array(b)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, folded, plain, raw, item_windows, strong, size, at, need, ks, anchor, digits)
    of every benchmark window.

    Items shorter than ``WINDOW`` words are one window of their own length; items of fewer
    than two words, or null, have none. ``need`` is 1 if so many of the window's typed words
    are literal that two of them must be neighbours, 2 if only of its folded words, else 3:
    the least form on which it matches. The longest pair of literal neighbours is its anchor,
    of two words without digits where there is one; ``strong`` counts the windows of need 1.
    """
    items = benchmark.select("item_id", raw_words().alias("raw")).where(F.size("raw") > 1)
    items = items.withColumn("words", template(F.col("raw"))).withColumn("folded", template(F.col("raw"), False)).withColumn("plain", F.transform("raw", F.lower)).withColumn("size", F.least(F.size("raw"), F.lit(WINDOW)))
    items = items.select("*", F.posexplode(either(F.col("words"), F.col("folded"), F.col("plain"), F.col("size"))).alias("at", "ks"))
    part = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    many = lambda c: F.size(F.filter(part(c), lambda w: w >= " ")) > F.floor((F.col("size") + 1) / 2)
    items = items.withColumn("need", F.when(many("words"), 1).when(many("folded"), 2).otherwise(3))
    least = lambda one, two, three: F.when(F.col("need") == 1, one).when(F.col("need") == 2, two).otherwise(three)
    marks = F.zip_with(part("plain"), least(part("words"), part("folded"), part("plain")), lambda w, form: F.struct(w.alias("w"), (form >= " ").alias("ok"), w.rlike(r"^[\p{L}\p{M}]").alias("letters")))

    def pair(a: Column, b: Column) -> Column:
        a, b = (x.withField("w", one_sigma(x["w"])) for x in (a, b))
        letters = a["letters"] & b["letters"]
        pair = F.when(letters, F.xxhash64(a["w"], b["w"])).otherwise(F.xxhash64(F.lit("#"), a["w"], b["w"]))
        return F.when(a["ok"] & b["ok"], F.struct(letters.alias("letters"), (F.length(a["w"]) + F.length(b["w"])).alias("n"), pair.alias("pair")))

    best = F.array_max(F.transform(F.array(marks), lambda m: F.zip_with(F.slice(m, 1, F.col("size") - 1), F.slice(m, 2, F.col("size") - 1), pair))[0])
    ks = least(F.array_distinct(F.slice("ks", 1, 2)), F.slice("ks", 2, 1), F.slice("ks", 3, 1))
    items = items.select("item_id", "raw", "words", "folded", "plain", "size", "at", "need", ks.alias("ks"), best.alias("best"))
    items = items.select("*", F.col("best.pair").alias("anchor"), (~F.col("best.letters")).alias("digits")).drop("best").dropDuplicates(["item_id", "size", "at", "ks"])
    own = Window.partitionBy("item_id")
    return items.withColumn("item_windows", F.count("*").over(own)).withColumn("strong", F.count(F.when(F.col("need") == 1, 1)).over(own))


def _meet(wide: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``wide`` joined with ``few`` on ``key``. ``few`` is broadcast up to MOST_BROADCAST rows,
    those that are sent; beyond it the rows of hot keys are dealt to many tasks."""
    if few.count() <= MOST_BROADCAST:
        return wide.join(F.broadcast(few), key)
    counts = materialise(wide.groupBy(key).agg(F.count("*").alias("n")).join(few.select(key).distinct(), key), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(wide, few, key, hot_keys(counts, key, total))


def _suspects(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """doc_id of the documents that hold enough anchors of an item to hold its windows.

    Exact: ``coverage`` of an item's windows, of those of need 1 or of all, or the windows of
    a run can't be there without the fewest anchors that stand for that many windows. Reads
    each text once and shuffles only the hits.
    """
    shares = items.where("need = 1").select("item_id", F.lit(-1).alias("target"), "anchor", (F.col("strong") * coverage).alias("least"))
    shares = shares.unionByName(items.where("strong < item_windows").select("item_id", F.lit(-2).alias("target"), "anchor", (F.col("item_windows") * coverage).alias("least")))
    runs = items.select("item_id", F.explode(F.sequence(F.col("at") - RUN_WINDOWS + 1, "at")).alias("target"), "anchor", F.lit(float(RUN_WINDOWS)).alias("least")).where("target >= 0")
    each = shares.unionByName(runs).groupBy("item_id", "target", "least", "anchor").agg(F.count("*").alias("n"))
    own = Window.partitionBy("item_id", "target")
    order = own.orderBy(F.desc("n"), "anchor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("reached", F.sum("n").over(order)).withColumn("rank", F.count("*").over(order))
    fewest = F.min(F.when(F.col("reached") >= F.col("least"), F.col("rank"))).over(own)
    anchors = each.select("item_id", "target", "anchor", fewest.alias("fewest")).where("fewest is not null")
    words = F.split(one_sigma(F.lower("text")), r"[^\p{L}\p{M}]+")
    pairs = F.transform(F.array(words), lambda w: F.zip_with(w, F.slice(w, 2, F.lit(1 << 30)), lambda a, b: F.xxhash64(a, b)))[0]
    if items.where("digits").take(1):
        plain = F.transform(raw_words(), lambda w: one_sigma(F.lower(w)))
        pairs = F.concat(pairs, F.transform(F.array(plain), lambda w: F.zip_with(w, F.slice(w, 2, F.lit(1 << 30)), lambda a, b: F.xxhash64(F.lit("#"), a, b)))[0])
    wide = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(pairs).alias("anchor"))
    hits = _meet(wide, materialise(anchors, "anchors"), "anchor")
    held = hits.groupBy("doc_id", "item_id", "target", "fewest").agg(F.countDistinct("anchor").alias("n"))
    return held.where(F.col("n") >= F.col("fewest")).select("doc_id").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, same_fillers) of each document that holds an item.

    Coverage is the share of the item's windows found with consistent slots, of those with
    enough literal words or of all, whichever is more; a run may be reported at a lower one.
    same_fillers tells a copy from a re-parameterised question. Null or empty texts and
    items match nothing; long ones are compared whole. Rows that repeat an id count as one
    document, as do those with a null id. Other columns are not read, whatever their names.
    Empty tables give an empty result.
    """
    docs = docs.select("doc_id", "text")
    items = materialise(item_windows(benchmark), "items")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most WINDOW values
    small = items.count() <= MOST_BROADCAST
    suspects = materialise(_suspects(docs, items, coverage), "suspects")
    few = suspects.count() <= MOST_BROADCAST
    suspects = suspects.withColumnRenamed("doc_id", "_s")
    docs = docs.join(F.broadcast(suspects) if few else suspects, docs["doc_id"].eqNullSafe(suspects["_s"]), "left_semi")
    base = docs.withColumn("words", template(raw_words())).withColumn("folded", template(raw_words(), False)).withColumn("plain", F.transform(raw_words(), F.lower))
    found = docs.sparkSession.createDataFrame([], base.select("doc_id", "text").schema).select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in items.select("item_id", "item_windows", "strong").dtypes], F.lit(0).alias("shift"))
    forms = 3 if items.where("need = 3").take(1) else 2
    for size in sorted(sizes):
        wide = base.select("doc_id", "text", F.posexplode(either(F.col("words"), F.col("folded"), F.col("plain"), size)).alias("pos", "ks"))
        wide = wide.select("doc_id", "text", "pos", F.explode(F.array_distinct(F.slice("ks", 1, forms))).alias("k"))
        side = materialise(items.where(F.col("size") == size).select("item_id", "item_windows", "strong", "at", F.explode("ks").alias("k")), "windows")
        hits = _meet(wide, side, "k")
        found = found.unionByName(hits.select("doc_id", "text", "item_id", "item_windows", "strong", (F.col("pos") - F.col("at")).alias("shift")))
    key = ["doc_id", "item_id", "item_windows", "strong", "shift"]
    one = found.groupBy(*key, F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"))
    sides = items.groupBy("item_id").agg(F.first("words").alias("words"), F.first("folded").alias("folded"), F.first("plain").alias("plain"), F.first("raw").alias("item_raw"), F.first("size").alias("size"), F.sort_array(F.collect_set(F.struct("at", "need"))).alias("tried"))
    chars = sides.agg(F.coalesce(F.sum(F.length(F.array_join("item_raw", " "))), F.lit(0))).first()[0]
    one = one.join(F.broadcast(sides) if small and chars <= MOST_CHARS else sides, "item_id")
    places = F.sequence(F.lit(0), F.size("words") - 1)

    bind = lambda c, use: F.transform(F.array(c), use)[0]
    as_many = lambda pairs, side: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p[side])))) == F.size(pairs)
    ones = lambda pairs: bind(pairs, lambda x: as_many(x, "a") & as_many(x, "b"))

    def judged(doc: Column) -> Column:
        """The diagonal's windows and the slots of the matching stretch, on any form, on the
        typed one alone, and of the runs that hold by themselves; with whether there are any."""
        same = lambda c, i: F.coalesce((i + F.col("shift") >= 0) & (F.get(c, i) == F.get(doc[c], i + F.col("shift"))), F.lit(False))
        # a window of need n matches where each of its words fits as n or more
        fit_any = F.transform(places, lambda i: F.when(same("plain", i), 3).when(same("folded", i), 2).when(same("words", i), 1).otherwise(0))
        fit_typed = F.transform(places, lambda i: same("words", i).cast("int"))
        kind = lambda i: F.when(same("words", i), F.get("words", i)).otherwise(F.get("folded", i))

        def slots(fit: Column, first: Column, last: Column) -> Column:
            """Kind, the item's filler and the document's of the slots in the matching stretch:
            from the first to the last window, and on as far as the words agree."""
            off = F.filter(places, lambda i: F.get(fit, i) == 0)
            low = F.coalesce(F.array_max(F.filter(off, lambda i: i < first)), F.lit(-1))
            high = F.coalesce(F.array_min(F.filter(off, lambda i: i >= last + F.col("size"))), F.size("words"))
            inside = F.filter(places, lambda i: (i > low) & (i < high) & (F.get(fit, i) > 0) & (kind(i) < " "))
            return F.array_distinct(F.transform(inside, lambda i: F.struct(kind(i).alias("kind"), F.lower(F.get("item_raw", i)).alias("a"), F.lower(F.get(doc["raw"], i + F.col("shift"))).alias("b"))))

        def way(fit: Column) -> Column:
            ats = F.array_distinct(F.transform(F.filter("tried", lambda t: F.forall(F.slice(fit, t["at"] + 1, F.col("size")), lambda x: x >= t["need"])), lambda t: t["at"]))
            return bind(ats, lambda a: F.struct(fit.alias("fit"), a.alias("ats"), slots(fit, F.array_min(a), F.array_max(a)).alias("pairs")))

        exact = lambda fit, a: F.forall(F.slice(fit, a + 1, RUN), lambda x: x == 3)

        def runs(whole: Column) -> Column:
            """Where the runs start that are the same word by word or lie in a consistent stretch."""
            starts = F.filter(whole["ats"], lambda a, j: F.get(whole["ats"], j + RUN_WINDOWS - 1) == a + RUN_WINDOWS - 1)
            alone = F.filter(starts, lambda a: exact(whole["fit"], a) | ones(slots(whole["fit"], a, a + RUN_WINDOWS - 1)))
            return F.when(ones(whole["pairs"]), starts).otherwise(alone)

        def chosen(ways: Column, starts: Column) -> Column:
            fit, whole = ways[0]["fit"], F.get(F.filter(ways, lambda v: (F.size(v["ats"]) > 0) & ones(v["pairs"])), F.lit(0))
            ats = F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + RUN_WINDOWS - 1))))
            pairs = F.flatten(F.transform(starts, lambda a: F.when(exact(fit, a), F.slice(ways[0]["pairs"], 1, 0)).otherwise(slots(fit, a, a + RUN_WINDOWS - 1))))
            return bind(whole, lambda w: F.struct(F.coalesce(w["ats"], ats).alias("ats"), F.coalesce(w["pairs"], pairs).alias("pairs"), (F.size(starts) > 0).alias("run")))

        return bind(F.transform(F.array(fit_any, fit_typed), way), lambda ways: bind(runs(ways[0]), lambda starts: chosen(ways, starts)))

    # the document's words are bound once, not taken apart again for each slot
    doc = F.struct(raw_words().alias("raw"), template(raw_words()).alias("words"), template(raw_words(), False).alias("folded"), F.transform(raw_words(), F.lower).alias("plain"))
    one = one.select(*key, F.transform("tried", lambda t: F.when(t["need"] == 1, t["at"])).alias("literal"), bind(doc, judged).alias("way"))
    same = F.forall("way.pairs", lambda p: p["a"] == p["b"])
    held = one.select("doc_id", "item_id", "item_windows", "strong", "literal", F.explode("way.ats").alias("at"), same.alias("same"), F.col("way.run").alias("run"))
    of_strong = F.countDistinct(F.when(F.array_contains(F.array_compact("literal"), F.col("at")), F.col("at"))) / F.nullif(F.col("strong"), F.lit(0))
    share = F.greatest(F.countDistinct("at") / F.col("item_windows"), of_strong)
    whole = held.groupBy("doc_id", "item_id", "item_windows", "strong").agg(share.alias("coverage"), F.every("same").alias("same_fillers"), F.max("run").alias("run"))
    return whole.where((F.col("coverage") >= coverage) | F.col("run")).select("doc_id", "item_id", "coverage", "same_fillers")


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` without a leak, columns unchanged; null ids count as one document,
    null and empty texts stay, rows repeat as given, and empty tables change nothing."""
    leaks = materialise(find_leaks(docs, benchmark, coverage).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    few = leaks.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(leaks) if few else leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]), "left_anti").select(*docs.columns)
