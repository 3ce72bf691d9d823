"""SimHash fingerprints and groups of documents whose fingerprints nearly agree.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles.
Two fingerprints that differ in at most ``bits`` places share at least ``8 - bits`` of their
eight bytes at the same positions. So every distinct fingerprint is entered, once for each
choice of that many positions, in an inverted index keyed by the positions and their bytes;
pairs are met only inside an index entry, the positional bytes a pair shares are tallied, pairs below the
guaranteed number are dropped, and the rest are verified bit by bit. An entry emits only
the links that keep its members connected, never all its pairs.

Cases: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; repeated rows share a fingerprint and therefore a component; a null id never becomes
the id of a component unless all ids of it are null; no rows give no rows; other columns are
ignored. Very long texts are hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaspark.llm import common, graph
from areaspark.session import keep as keep_table

#: Hashes whose bits are counted at a time.
AT_ONCE = 65_536
#: Index entries up to this size are compared pair by pair, larger ones spread from seeds.
PAIRWISE = 12


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    hash_of = xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = len(parts) - words + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, m, AT_ONCE):
        to = min(m, at + AT_ONCE)
        cuts = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())
        hashes = np.array([hash_of(joined[s:e], seed) for s, e in cuts], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), words: int = 4) -> DataFrame:
    """The kept columns and ``fingerprint`` as a signed 64-bit integer."""
    common.needs(df, [text, *keep])
    schema = common.schema_of(df, keep, fingerprint=T.LongType())
    df = df.select(*keep, df[text].alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column("_text")], np.uint64)
            cols = [batch.column(c) for c in keep] + [pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "fingerprint"])

    return df.mapInArrow(task, schema)


def _byte_table(positions: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each mask of shared byte positions: how many, and the first choice of positions in it."""
    choices = list(combinations(range(8), positions))
    first = np.full(256, -1, np.int64)
    for mask in range(256):
        on = [i for i in range(8) if mask >> i & 1]
        if len(on) >= positions:
            first[mask] = choices.index(tuple(on[:positions]))
    return np.array([bin(m).count("1") for m in range(256)]), first


def _spread(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join whatever in a large entry is within ``bits`` of each other, at most one per member."""
    left = np.arange(len(values))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= bits
            if near.any():
                out += [(at, x) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
    return out


def _entry_links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside index entries; rows come sorted by key."""
    positions = 8 - bits
    tally, first = _byte_table(positions)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    for at, n in zip(start[size > PAIRWISE], size[size > PAIRWISE]):
        values = fp[at : at + n]
        links = np.array(_spread(values, bits), np.int64).reshape(-1, 2)
        a.append(values[links[:, 0]])
        b.append(values[links[:, 1]])
    in_small = np.repeat(size <= PAIRWISE, size)
    for lag in range(1, PAIRWISE):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & in_small[lag:]) if lag < len(key) else np.zeros(0, np.int64)
        if not len(i):
            break
        x, y = fp[i], fp[i + lag]
        diff = x ^ y
        same = (diff.view(np.uint8).reshape(-1, 8) == 0) @ (1 << np.arange(8))
        # the tally of shared positional bytes; a pair counts in the first entry it shares
        good = (tally[same] >= positions) & (first[same] == key[i] >> 32) & (np.bitwise_count(diff) <= bits)
        a.append(x[good])
        b.append(y[good])
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints within ``bits`` of each other.

    Connected members stay connected; a pair inside a group may be left out.
    """
    if not 0 < bits < 8:
        raise ValueError("the byte index needs 1 to 7 differing bits")
    fp = F.col("fingerprint")
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(0xFF) for i in range(8)]
    keys = []
    for n, chosen in enumerate(combinations(range(8), 8 - bits)):
        if len(chosen) <= 4:
            key = sum((F.shiftleft(byte[i], 8 * k) for k, i in enumerate(chosen)), F.lit(0).cast("long"))
        else:
            key = F.xxhash64(*[byte[i] for i in chosen]).bitwiseAND(0xFFFFFFFF)
        keys.append(key + F.lit(n << 32).cast("long"))
    index = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    index = index.repartition(F.col("key")).sortWithinPartitions("key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def result(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _entry_links(key, fp, bits) if len(key) else (held_fp[:0], held_fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = np.concatenate((held_key, batch.column("key").to_numpy()))
            fp = np.concatenate((held_fp, batch.column("fingerprint").to_numpy().view(np.uint64)))
            if not len(key):
                continue
            whole = np.searchsorted(key, key[-1])  # the last entry may go on in the next batch
            held_key, held_fp = key[whole:], fp[whole:]
            if whole:
                yield result(key[:whole], fp[:whole])
        yield result(held_key, held_fp)

    return index.mapInArrow(task, "a long, b long")


def groups(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 4, bits: int = 4) -> DataFrame:
    """``id``, ``fingerprint`` (signed) and ``component_id``, the smallest id reachable over links."""
    prints = keep_table(fingerprints(df, text, (id,), words), "fingerprints")
    distinct = keep_table(prints.groupBy("fingerprint").agg(F.min(id).alias("least")), "distinct")
    roots = keep_table(graph.components(links(distinct.select("fingerprint"), bits)), "roots")
    placed = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(least, "root").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select(id, "fingerprint", "component_id")


def hex_digits(fingerprint):
    """A signed fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
