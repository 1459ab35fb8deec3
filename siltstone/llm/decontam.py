"""Benchmark decontamination by canonical templates, with DataFrame functions only.

Numbers (in figures and words), names and units become typed slots that keep their values; a
name is any capitalised word but the function words. Windows of eight tokens, hashed with the
slots' types in place of their values, are joined to the windows of the benchmark items,
which stand there once with names as slots and once as words, for texts in one case only.
Along each alignment of an item with a document each value of the item stands for one value
of the document, the one that it meets most often: a question with other numbers or names put
in consistently is caught whole, and windows that contradict the rest do not count. Windows
with the item's own values count in any case. Windows of which more than half are slots, and
short items, must agree in the values too.

Documents are scanned twice. First their windows' hashes alone, without tokens, meet those of
the benchmark; then the documents that hold some are read again and their tokens compared.
The plan is the same at every size but for the benchmark's windows, which Spark broadcasts
where they are small; the join that brings the texts back shuffles every text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.shared import materialise, require, text_or_empty

#: Tokens a window, and what counts as a leak: this share of an item's windows, or this many tokens in a row.
WINDOW, COVERAGE, RUN = 8, 0.5, 13
#: Items of fewer tokens are found whole and with equal values only.
SHORTEST = 5
#: Capitalised words that are no names, and number words (fixed values).
FUNCTION_WORDS = "a|about|after|all|also|although|am|an|and|any|are|as|at|be|because|been|before|but|by|can|could|did|do|does|each|every|find|for|from|had|has|have|he|her|his|how|i|if|in|is|it|its|let|many|may|more|most|much|my|no|not|now|of|on|or|our|she|should|since|so|some|than|that|the|their|then|there|these|they|this|those|to|was|we|were|what|when|where|which|while|who|why|will|with|would|you|your"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|dozen"
#: Units of measurement (fixed values).
UNITS = "mm|cm|km|kg|mg|ml|m|g|l|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch(?:es)?|yards?|grams?|kilograms?|pounds?|lbs?|oz|ounces?|liters?|litres?|gallons?|dollars?|cents?|euros?|percent|degrees?|mph|kmh"
#: Private letters that open the tokens of slots: number, name, unit.
NUMBER, NAME, UNIT = "", "", ""
_FIGURE = r"\p{Nd}+(?:[.,:]\p{Nd}+)*"


def tokens(text: Column) -> Column:
    """Lower-case words in order; slots are a private letter with the value after it.

    A name is a capitalised word that is no function word, wherever it stands; an apostrophe
    between capitals belongs to it. Words of capitals only are none beside each other. A unit
    stands after a number.
    """
    end, gap = r"(?![\p{L}\p{N}])", r"[^\p{L}\p{N}]{1,4}"
    mixed = rf"\p{{Lu}}(?!\p{{Lu}}*{end})\p{{L}}+{end}"
    capitals = rf"(?<!\p{{Lu}}\p{{Lu}}{gap})\p{{Lu}}+{end}(?!{gap}\p{{Lu}}\p{{Lu}})"
    start = rf"(?<![\p{{L}}\p{{N}}{NUMBER}-{UNIT}])"
    t = F.regexp_replace(text, f"[{NUMBER}-{UNIT}]", " ")
    t = F.regexp_replace(t, r"['’](?<=\p{Lu}.)(?=\p{Lu})", "")
    t = F.regexp_replace(t, rf"{start}(?=\p{{Lu}})(?!(?i:{FUNCTION_WORDS}){end})(?:{mixed}|{capitals})", f"{NAME}$0")

    def figures(x: Column) -> Column:
        x = F.regexp_replace(x, rf"(?i)({_FIGURE})\s?({UNITS}){end}", f"$1 {UNIT}$2 ")
        return F.regexp_replace(F.regexp_replace(x, r"(?<=\p{Nd})[.,:](?=\p{Nd})", ""), rf"{start}\p{{Nd}}+", f"{NUMBER}$0")

    # a lambda's argument is computed once, however often it is used
    t = F.transform(F.array(t), lambda x: F.when(F.rlike(x, F.lit(r"\p{Nd}")), figures(x)).otherwise(x))[0]
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{NUMBER}-{UNIT}]+"), "")


def is_slot(token: Column) -> Column:
    return ((token >= NUMBER) & (token <= f"{UNIT}\U0010ffff")) | token.isin(NUMBER_WORDS.split("|"))


def token_hashes(words: Column, names: bool) -> Column:
    """Hashes of the tokens, by type for slots; ``names`` tells whether names are slots too."""
    kind = lambda x: F.when(x < NUMBER, F.when(x.isin(NUMBER_WORDS.split("|")), NUMBER).otherwise(x)).when(x <= f"{UNIT}\U0010ffff", F.left(x, F.lit(1)) if names else F.when(F.startswith(x, F.lit(NAME)), F.substring(x, 2, 1 << 30)).otherwise(F.left(x, F.lit(1)))).otherwise(x)
    return F.transform(words, lambda x: F.xxhash64(kind(x)))


def window_hashes(hashes: Column, length: int) -> Column:
    """Hash of every run of ``length`` tokens, by doubling; an empty array for shorter texts."""
    out, done = None, 0
    power, span = hashes, 1
    while True:
        if length & span:
            part = power if not done else F.slice(power, done + 1, F.greatest(F.size(power) - done, F.lit(0)))
            out = part if out is None else F.zip_with(out, part, lambda a, b: F.xxhash64(a, b))
            done += span
        if done == length:
            break
        power = F.zip_with(power, F.slice(power, span + 1, F.greatest(F.size(power) - span, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        span *= 2
    return F.slice(out, 1, F.greatest(F.size(hashes) - (length - 1), F.lit(0)))


def windows(rows: DataFrame, lengths: list[int], names: bool = True) -> DataFrame:
    """The columns of ``rows`` but ``toks``, with ``len``, ``pos`` and ``h`` for each window of ``toks``, for each length.

    Hashes are a column before they are opened, so that opening copies no tokens; the outer
    form keeps Spark from computing them again in a filter. ``h`` is null where there is none.
    """
    own = [c for c in rows.columns if c != "toks"]
    hashed = rows.withColumn("_th", token_hashes(F.col("toks"), names))
    hashed = hashed.select(*own, *(window_hashes(F.col("_th"), n).alias(f"_h{n}") for n in lengths))
    if len(lengths) > 1:
        hashed = hashed.select(*own, F.explode(F.array(*(F.struct(F.lit(n).alias("len"), F.col(f"_h{n}").alias("hs")) for n in lengths))).alias("_w"))
        hashed = hashed.select(*own, F.col("_w.len").alias("len"), F.col("_w.hs").alias("hs"))
    else:
        hashed = hashed.select(*own, F.lit(lengths[0]).alias("len"), F.col(f"_h{lengths[0]}").alias("hs"))
    return hashed.select(*own, "len", F.posexplode_outer("hs").alias("pos", "h"))


def slot_pairs(item: Column, doc: Column, start: Column) -> Column:
    """(p, i, d): place in the item and the values at the slots of an item's window and at the same places of the document's."""
    value = lambda x: F.when(F.startswith(x, F.lit(NAME)), F.substring(x, 2, 1 << 30)).otherwise(x)
    both = F.transform(F.arrays_zip(item.alias("i"), doc.alias("d")), lambda x, k: F.struct((k + start).alias("p"), x["i"].alias("i"), x["d"].alias("d")))
    return F.transform(F.filter(both, lambda x: is_slot(x["i"])), lambda x: F.struct(x["p"], value(x["i"]).alias("i"), value(x["d"]).alias("d")))


def majority(pairs: Column) -> Column:
    """(i, d): for each item value of distinct (p, i, d) the value it meets most often; of several the equal one, else that met first."""
    kinds = F.array_distinct(F.transform(pairs, lambda x: F.struct(x["i"], x["d"])))

    def vote(v: Column) -> Column:
        places = F.transform(F.filter(pairs, lambda x: (x["i"] == v["i"]) & (x["d"] == v["d"])), lambda x: x["p"])
        return F.struct(v["i"].alias("i"), F.struct(F.size(places), v["i"] == v["d"], -F.array_min(places)).alias("weight"), v["d"].alias("d"))

    votes = F.transform(kinds, vote)
    best = F.filter(votes, lambda v: ~F.exists(votes, lambda u: (u["i"] == v["i"]) & (u["weight"] > v["weight"])))
    return F.transform(best, lambda v: F.struct(v["i"], v["d"]))


def longest_run(places: Column) -> Column:
    """The most consecutive numbers in an array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, p: Column) -> Column:
        n = F.when(p == a["last"] + 1, a["n"] + 1).otherwise(1)
        return F.struct(p.alias("last"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(F.array_sort(places), start, step, lambda a: a["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """One row for each leak: doc_id, item_id, ``matched`` and ``windows`` (longs), ``coverage``, ``run`` (tokens in a row, long), ``slots`` (distinct ones compared) and ``reparameterised``.

    An item leaks into a document if at least the share ``coverage`` of the item's distinct
    window places, or ``run`` tokens in a row, occur there along an alignment: windows with
    equal values, and those whose values are the ones that the item's values meet most often
    along it. Items of fewer tokens than ``window`` are searched whole, those of fewer than
    ``SHORTEST`` with equal values; null texts are empty and items without a word are not
    searched. Rows with equal doc_id (nulls too) are judged together, items with equal item_id
    too. Very long texts are a row each as any other; extra columns are ignored, whatever
    their names. An empty table on either side gives an empty one.
    """
    require(docs, ["doc_id", "text"])
    require(benchmark, ["item_id", "text"])
    items = benchmark.select("item_id", tokens(text_or_empty()).alias("toks")).withColumn("n", F.size("toks")).where("n > 0")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # fewer than window numbers
    lengths = [*short, window]
    wanted = windows(items.withColumn("all", F.col("toks")), lengths).unionByName(windows(items.withColumn("all", F.col("toks")), lengths, False)).where(F.col("h").isNotNull() & (F.col("len") == F.least("n", F.lit(window))))
    wanted = wanted.select("item_id", "len", F.col("pos").alias("item_pos"), "h", F.greatest(F.col("n") - window + 1, F.lit(1)).alias("windows"), F.slice("all", F.col("pos") + 1, F.col("len")).alias("item_toks")).distinct()
    wanted = materialise(wanted.withColumn("equal", (F.size(F.filter("item_toks", is_slot)) * 2 > F.col("len")) | (F.col("len") < SHORTEST)), "leak-windows")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text"))
    found = windows(rows.select("row", tokens(text_or_empty()).alias("toks")), lengths)
    found = found.join(materialise(wanted.select("len", "h").distinct(), "leak-hashes"), ["len", "h"]).select("row", "len", "pos", "h")
    held = materialise(found.groupBy("row").agg(F.collect_set(F.struct("len", "pos", "h")).alias("hits")), "leak-hits")
    # by sort and merge at every size, so that cost grows in proportion
    again = rows.join(held.hint("merge"), "row").select("doc_id", tokens(text_or_empty()).alias("toks"), "hits")
    # tokens are cut before hits are opened, so that opening copies none
    cuts = F.transform("hits", lambda x: F.struct(x["len"].alias("len"), x["h"].alias("h"), x["pos"].alias("pos"), F.slice("toks", x["pos"] + 1, x["len"]).alias("toks")))
    opened = again.select("doc_id", F.explode(cuts).alias("x")).select("doc_id", F.col("x.len").alias("len"), F.col("x.h").alias("h"), F.col("x.pos").alias("pos"), F.col("x.toks").alias("doc_toks"))
    hits = opened.join(wanted, ["len", "h"]).select("doc_id", "item_id", "windows", "len", "item_pos", "equal", (F.col("pos") - F.col("item_pos")).alias("shift"), slot_pairs(F.col("item_toks"), F.col("doc_toks"), F.col("item_pos")).alias("pairs"))
    differ = lambda x: x["i"] != x["d"]
    hits = hits.where(~(F.col("equal") & F.exists("pairs", differ)))
    lines = hits.groupBy("doc_id", "item_id", "windows", "len", "shift").agg(F.collect_set(F.struct("item_pos", "pairs")).alias("found"))
    lines = lines.withColumn("votes", majority(F.array_distinct(F.flatten(F.transform("found", lambda w: w["pairs"])))))
    agrees = lambda x: ~differ(x) | F.array_contains("votes", F.struct(x["i"], x["d"]))
    kept = F.filter("found", lambda w: ~F.exists(w["pairs"], differ) | F.forall(w["pairs"], agrees))
    lines = lines.withColumn("found", kept).where(F.size("found") > 0)
    judged = lines.select("doc_id", "item_id", "windows", "len", F.transform("found", lambda w: w["item_pos"]).alias("places"), F.array_distinct(F.flatten(F.transform("found", lambda w: F.transform(w["pairs"], lambda x: F.struct(x["i"], x["d"]))))).alias("pairs"))
    leaks = judged.groupBy("doc_id", "item_id").agg(
        F.max("windows").cast("long").alias("windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"),
        F.max(longest_run(F.array_distinct(F.col("places"))) + F.col("len") - 1).cast("long").alias("run"),
        F.max(F.size("pairs")).cast("long").alias("slots"),
        F.max(F.exists("pairs", differ)).alias("reparameterised"),
    )
    share = F.col("matched") / F.col("windows")
    return leaks.where((share >= coverage) | (F.col("run") >= run)).select("doc_id", "item_id", "matched", "windows", share.alias("coverage"), "run", "slots", "reparameterised")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks; all columns stay. Spark chooses the join by the size of the leaks."""
    leaks = materialise(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")
