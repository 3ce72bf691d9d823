"""Benchmark decontamination by winnowed fingerprints.

Words are runs of the letters and digits of :data:`WORD` in the text with A-Z lower-cased. A
window is ``window`` consecutive words of a benchmark item; an item with fewer words is one
window. Of every run of consecutive k-word hashes that a window spans, training and benchmark
texts keep the smallest, so that two equal windows keep the same hash at the same place. Kept hashes
meet in an equality join; around each hit the words of every window that holds the hash are
held against the distinct benchmark windows, and covered positions are counted. Items too
short for a window are looked up by a hash of all their words.

Only built-in functions are used. Fingerprints of training texts are made and dropped in
one pass unless the benchmark knows them.

Cases: null or empty texts have no words and hold nothing; an item without words has no window;
repeated items are separate items, items with the same or without an id count once or not at
all; repeated documents are examined once and each keeps its row; no documents give no rows, no items
leave all clean; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.llm import common
from areaspark.session import keep as keep_table

#: Fixed value: a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a hashed run.
RUN = 5
#: Benchmark fingerprints up to this number (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_PRINTS = 2_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(common.ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1; none if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, run: int) -> Column:
    """A hash of each ``run`` consecutive words; its last three bits are 0."""
    some = lambda w: F.transform(
        _upto(F.size(w) - (run - 1)), lambda i: F.xxhash64(F.slice(w, i + 1, run)).bitwiseAND(F.lit(-8).cast("long"))
    )
    return common.let(words, some)


def _places(hashes: Column, span: int) -> Column:
    """Where the hashes stand that are smallest in some ``span`` (up to 8) consecutive ones.

    The free bits of a hash take its place modulo 8, which tells the places of a stretch apart.
    """
    placed = F.transform(hashes, lambda h, i: h.bitwiseOR(i.bitwiseAND(7).cast("long")))
    least = lambda all: F.transform(_upto(F.size(all) - (span - 1)), lambda i: F.array_min(F.slice(all, i + 1, span)))
    place = lambda m, i: i + F.pmod(m.bitwiseAND(7).cast("int") - i, F.lit(8))
    return F.array_distinct(F.transform(common.let(placed, least), place))


def _prints(words: Column, window: int, short: Sequence[int]) -> Column:
    """All fingerprints of a text: ``n`` words of the window they stand for, hash, place."""
    whole = lambda runs: F.transform(
        _places(runs, window - RUN + 1), lambda at: F.struct(F.lit(window).alias("n"), runs[at].alias("h"), at.alias("at"))
    )
    found = common.let(_runs(words, RUN), whole)
    for n in short:
        some = F.transform(_runs(words, n), lambda h, i: F.struct(F.lit(n).alias("n"), h.alias("h"), i.alias("at")))
        found = F.concat(found, some)
    return found


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The kept columns, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``contaminated``."""
    if not RUN < window <= RUN + 7:
        raise ValueError(f"a window needs {RUN + 1} to {RUN + 7} words")
    common.needs(docs, [text, *keep])
    common.needs(benchmark, [item, item_text])

    # windows of the benchmark
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    at = F.explode(_upto(F.size("words") - length + 1))
    windows = items.select("item", "words", length.alias("n"), at.alias("at")).select(
        "item", "n", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("n"))).alias("said")
    )
    windows = keep_table(windows, "windows")
    # fewer than ``window`` different numbers
    short = sorted(r["n"] for r in windows.where(F.col("n") < window).select("n").distinct().collect())
    said = F.split("said", " ")
    known = windows.select("n", "said").distinct()
    whole = known.where(F.col("n") == window).select("n", F.array_min(_runs(said, RUN)).alias("h"))
    part = known.where(F.col("n") < window).select("n", F.xxhash64(said).bitwiseAND(F.lit(-8).cast("long")).alias("h"))
    prints = keep_table(whole.union(part).distinct(), "prints")

    # one pass over the documents: a row for each, and the words around fingerprints the benchmark knows
    base = docs.select(*keep, F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("digest"), words_of(docs[text]).alias("words"))
    row = F.array(F.struct(F.lit(0).alias("n"), F.xxhash64("digest").alias("h"), F.lit(0).alias("at")))
    spread = base.select(*keep, "digest", "words", F.explode(F.concat(row, _prints(F.col("words"), window, short))).alias("p"))
    spread = spread.select(*keep, "digest", "words", "p.n", "p.h", "p.at")
    reach = window - RUN
    first = F.when(F.col("n") == window, F.greatest(F.col("at") - reach, F.lit(0))).otherwise(F.col("at"))
    around = F.slice("words", first + 1, F.when(F.col("n") == window, F.col("at") + window - first).otherwise(F.col("n")))

    def cut(frame: DataFrame) -> DataFrame:
        n_words = F.when(F.col("n") == 0, F.size("words").cast("long")).alias("n_words")
        passed = [c for c in ("met",) if c in frame.columns]
        return frame.select(*keep, "digest", "n", "h", *passed, n_words, first.alias("first"), F.when(F.col("n") > 0, around).alias("around"))

    n_prints = prints.count()
    met = common.checked_broadcast(prints.select("n", "h", F.lit(True).alias("met")), n_prints, BROADCAST_PRINTS)
    if n_prints <= BROADCAST_PRINTS:  # nothing moves, so the words are cut out only where there is a hit
        spread = cut(spread.join(met, ["n", "h"], "left").where((F.col("n") == 0) | F.col("met")))
    else:
        spread = cut(spread).join(met, ["n", "h"], "left").where((F.col("n") == 0) | F.col("met"))
    spread = keep_table(spread.drop("h", "met"), "spread")

    # exact windows around the hits
    near = spread.where("n > 0").select("digest", "n", "first", "around").distinct()
    near = near.select("digest", "n", "first", "around", F.explode(_upto(F.size("around") - F.col("n") + 1)).alias("i"))
    near = near.select("digest", "n", (F.col("first") + F.col("i")).alias("at"), F.concat_ws(" ", F.slice("around", F.col("i") + 1, F.col("n"))).alias("said"))
    hits = keep_table(near.distinct().join(known, ["n", "said"]), "hits")
    covered = hits.select("digest", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("word"))
    covered = covered.distinct().groupBy("digest").agg(F.count("*").alias("n_hit"))
    named = hits.select("digest", "n", "said").distinct().join(windows.where("item IS NOT NULL").distinct(), ["n", "said"])
    named = named.select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = covered.join(named, "digest", "left")

    rows = spread.where("n = 0").select(*keep, "digest", "n_words")
    return rows.join(found, "digest", "left").select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
