"""Groups of documents whose sets of word shingles nearly agree, by one-permutation hashing.

One hash of each shingle deals it to one of ``BINS`` bins, where the smallest value stays. An empty bin borrows from the
first occupied bin of its own fixed random order of bins, so two sets agree in a borrowed bin as often as in any other. Runs of
``ROWS`` bins are the keys of ``BANDS`` inverted indexes. A pair at similarity 0.8 misses all of them with probability
(1 - 0.8 ** 6) ** 48 = 5e-7.

Candidates are star-shaped: the members of a bucket meet its smallest member only, so a bucket of n texts gives n - 1 pairs.
The first bands go first; in the others only members that aren't connected with the centre yet meet it. Buckets that still hold
several groups are then searched: every member outside the largest group is held against all others, in blocks of bounded
size, first by the bytes of the bins (which agree ``SLACK`` deviations below the limit at least), then by short hashes of the full sets. Every pair is confirmed on
its full sets before it links: the text of a centre travels once for ``TOGETHER`` pairs.

Cases: a text of fewer words than a shingle is one shingle; null, empty and wordless texts have an empty set and are linked with
nothing, not even with each other; repeated rows share a component; a null id never becomes the id of a component unless all ids of it are
null; no rows give no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaspark.llm import common, graph
from areaspark.session import keep as keep_table

WORDS, PERCENT = 4, 80
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Bands whose stars come first.
EARLY = 12
#: Pairs that share one copy of their centre's text.
TOGETHER = 64
#: Members outside the largest group, and members of a bucket, that a search block holds about.
BLOCK, CHUNK = 512, 2_048
#: Standard deviations of the share of equal bins.
SLACK = 4.5
#: Per cent by which short hashes, which may collide inside a set, stay below the limit.
SHORT = 1

_RANDOM = np.random.default_rng(13)
#: Row i: rank of every bin in the order in which an empty bin i looks for a donor.
_DONOR = _RANDOM.permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return np.array([hash_of(joined)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.fromiter((hash_of(joined[s:e]) for s, e in cuts), np.uint64, len(parts) - words + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One 32-bit value for each bin of a set that isn't empty."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    bins = (hashes % np.uint64(BINS)).astype(np.int64)
    least = np.full(BINS, 1 << 32, np.uint64)
    np.minimum.at(least, bins, mixed & np.uint64(0xFFFFFFFF))
    full = least < 1 << 32
    empty, used = np.flatnonzero(~full), np.flatnonzero(full)
    if len(empty):
        least[empty] = least[used[_DONOR[np.ix_(empty, used)].argmin(1)]]
    return least.astype("<u4")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked; whole numbers only."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(rows: DataFrame, words: int) -> DataFrame:
    """``id``, ``node``, number of shingles, band keys and low bytes of the bins (null for an empty set) of every row.

    A key is a hash of a band's bins, whose last six bits are the number of the band.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, keys, bins = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None)
                    bins.append(None)
                    continue
                sign = signature(found)
                raw = sign.tobytes()
                hashes = np.array([xxhash.xxh64_intdigest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)]) for k in range(BANDS)], np.uint64)
                keys.append((hashes & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                bins.append((sign & 0xFF).astype(np.uint8).tobytes())
            cols = [batch.column("id"), batch.column("node"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "n", "keys", "bins"])

    added = [T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bins", T.BinaryType())]
    return rows.mapInArrow(task, T.StructType([rows.schema["id"], rows.schema["node"], *added]))


def _index(signed: DataFrame) -> DataFrame:
    """``key`` and ``node`` of the buckets with several rows; most rows have none and go no further."""
    entries = signed.where("keys IS NOT NULL").select("node", F.explode("keys").alias("key"))
    busy = keep_table(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "busy")
    return keep_table(entries.join(busy, "key").select("key", "node").distinct(), "index")


def _stars(index: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Pairs of a bucket's smallest node and each other one; with ``roots``, each one of another group."""
    hub = index.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    pairs = index.join(hub, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    if roots is None:
        return pairs
    return _rooted(pairs, roots).where("root_a <> root_b").select("a", "b")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs with ``root_a`` and ``root_b``; a node without a root is its own."""
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        pairs = pairs.withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs


def _near_roots(found: DataFrame) -> DataFrame:
    """``root`` of each linked node: the smallest node that it reaches over two of the links to smaller nodes; most stars are no deeper."""
    up = found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    once = keep_table(up, "up")
    twice = once.join(once.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
    return keep_table(twice.select("node", F.coalesce("further", "root").alias("root")), "roots")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, at = np.zeros(0, np.uint64), None
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            good = []
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                if b[k] is None:  # comes first of its part
                    hub, at = shingles(text.as_py(), words), (a[k], part[k])
                    good.append(False)
                else:
                    good.append((a[k], part[k]) == at and alike(hub, shingles(text.as_py(), words), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = keep_table(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part")
    members = pairs.join(parts, "a").select("a", part, "b").join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "part", "b", "text")
    hubs = parts.join(texts.select(F.col("node").alias("a"), "text"), "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "text")
    met = members.union(hubs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return keep_table(met.mapInArrow(task, "a binary, b binary"), "links")


def _short_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node`` and its shingles as sorted hashes of 32 bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(t, words).astype("<u4")).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "short"])

    return texts.select("node", "text").mapInArrow(task, "node binary, short binary")


def _searched(members: DataFrame, bins: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of different groups of a bucket that nearly agree; ``members`` has key, node and root, ``bins`` node and bins."""
    share = percent / 100
    enough = int(BINS * (share - SLACK * (share * (1 - share) / BINS) ** 0.5))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | np.ndarray = []
        sets: list[np.ndarray] = []
        nodes: list[bytes] = []
        roots: list[bytes] = []
        at = None
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                if row["block"] != at:
                    held, sets, nodes, roots, at = [], [], [], [], row["block"]
                own = np.frombuffer(row["short"], "<u4")
                if row["outside"]:  # come first of their block
                    held.append(np.frombuffer(row["bins"], np.uint8))
                    sets.append(own)
                    nodes.append(row["node"])
                    roots.append(row["root"])
                    continue
                if isinstance(held, list):
                    held = np.array(held, np.uint8).reshape(-1, BINS)
                same = held == np.frombuffer(row["bins"], np.uint8)
                for k in np.flatnonzero(same.sum(1) >= enough).tolist():
                    # a pair goes on from the first band that it shares, and once of its two orders
                    if roots[k] == row["root"] or row["rest"] and nodes[k] >= row["node"] or same[k].reshape(BANDS, ROWS).all(1).argmax() != row["band"]:
                        continue
                    if alike(sets[k], own, percent - SHORT):
                        a.append(nodes[k])
                        b.append(row["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    groups = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = groups.groupBy("key").agg(F.max(F.struct("n", "root")).alias("large"), F.sum("n").alias("members"), F.count("*").alias("groups"))
    open_ = largest.where("groups > 1").select(
        "key", F.col("large.root").alias("large"), F.ceil((F.col("members") - F.col("large.n")) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"),
    )
    rows = keep_table(members.join(open_, "key"), "open")  # the bins of a node follow only where it is in an open bucket
    wanted = rows.select("node").distinct()
    known = bins.join(wanted, "node", "left_semi").dropDuplicates(["node"]).join(_short_sets(texts.join(wanted, "node", "left_semi"), words), "node")
    rows = rows.join(keep_table(known, "known"), "node").withColumn("band", F.col("key").bitwiseAND(63).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int")
    kept = ["band", "node", "root", "bins", "short"]
    outside = rows.where("root <> large").select("key", *kept, dealt("blocks").alias("x"), upto("chunks").alias("y"), F.lit(True).alias("outside"), F.lit(True).alias("rest"))
    every = rows.select("key", *kept, upto("blocks").alias("x"), dealt("chunks").alias("y"), F.lit(False).alias("outside"), (F.col("root") != F.col("large")).alias("rest"))
    both = outside.union(every).select(*kept, "outside", "rest", F.struct("key", "x", "y").alias("block"))
    both = both.repartition("block").sortWithinPartitions("block", F.desc("outside"))
    return both.mapInArrow(task, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(signed: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node that is linked."""
    index = _index(signed)
    met = index.select("node").distinct()
    texts = keep_table(texts.join(met, "node", "left_semi").dropDuplicates(["node"]), "texts")
    early = F.col("key").bitwiseAND(63) < EARLY
    found = _confirmed(_stars(index.where(early)), texts, words, percent)
    found = found.union(_confirmed(_stars(index.where(~early), _near_roots(found)), texts, words, percent))
    roots = keep_table(graph.components(found), "roots")
    members = index.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    searched = _searched(keep_table(members, "members"), signed.select("node", "bins"), texts, words, percent)
    more = keep_table(_rooted(_confirmed(searched, texts, words, percent), roots), "more")
    # groups that the search has joined, as links between their roots
    higher = keep_table(graph.components(more, "root_a", "root_b"), "higher")
    ends = roots.select("node", "root").union(more.select("a", "root_a")).union(more.select("b", "root_b")).distinct()
    return ends.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def groups(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (the smallest id reachable over links) and ``kept`` (whether that is the id)."""
    common.needs(df, [text, id])
    node = F.unhex(F.md5(F.coalesce(df[text], F.lit("")).cast("binary")))
    rows = df.select(df[id].alias("id"), df[text].alias("text"), node.alias("node"))
    signed = keep_table(_signed(rows, words), "signed")
    nodes = signed.groupBy("node").agg(F.min("id").alias("least"))
    roots = keep_table(components(signed, rows.select("node", "text"), words, percent), "roots")
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("component"))
    of_node = placed.join(first, "root").select("node", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    found = signed.select("id", "node", "n").join(of_node, "node").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
