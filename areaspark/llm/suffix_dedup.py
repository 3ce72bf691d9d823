"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that starts at another place too, in any
document, the same one included. The work is dealt out by content, so that a suffix array never
has to hold more than the few contexts that can be equal:

1. Equal texts become one. In each text the start of every window of ``length`` bytes is given to an
   anchor, the place of the smallest hash in the window's first :data:`SPREAD` places; equal
   windows have their anchors at the same place. All windows of an anchor share a core.
2. Hashes of the core and of the full context of an anchor meet by core. Equal full
   contexts settle all their windows; anchors with an unknown core hold no repeat. What is left are
   anchors at the borders of repeats.
3. Their windows, in classes of :data:`CLASS` neighbouring starts, meet by the bytes that all
   windows of a class share. In a group the shared bytes become one symbol, and the suffix array of the
   short remaining strings tells, from neighbouring suffixes, which windows are repeated.

The suffix array is built in linear time by grouping: suffixes are first grouped by their
Lyndon prefixes, in descending order of groups, each handing on its rank to the previous
smaller suffix; one pass in ascending order then emits every group's order. No renaming, no recursion.

Groups beyond :data:`LARGE` contexts are not held in a task: their windows are counted singly.
Exact copies, common passages and their anchors are combined before they are shuffled.

Cases: null and empty texts and texts shorter than ``length`` lose nothing; all copies of a
repeated text are emptied if it is long enough; a text may repeat itself; no rows give no rows; other
columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark.llm import common
from areaspark.session import keep as keep_table
from areaspark.session import work_folder

LENGTH = 400
#: Places that compete for an anchor, and bytes of a place's hash.
SPREAD, GRAM = 96, 16
#: Neighbouring starts whose windows meet together.
CLASS = 16
#: Contexts of a group that a suffix array may hold.
LARGE = 4_000
#: Distinct contexts of a core that one piece of work hands on for counting.
HANDED = 8

_ANCHOR = np.dtype([("core", "<u8"), ("full", "<u8"), ("num", "<i8"), ("lo", "<u4"), ("span", "u1"), ("back", "u1"), ("done", "u1")])
_PLACE = np.dtype([("lo", "<u4"), ("span", "u1"), ("back", "u1")])


# Suffix array


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of a list of numbers whose last is 0 and the only 0."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    at, head, size = [0] * n, [0] * n, [0] * n  # place in the order; start of the own group; size by start
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        at[s], head[s] = i, start
        size[start] += 1
    before = list(range(-1, n - 1))
    # first phase: descending groups hand on to the previous smaller suffix
    end = n
    while end > 0:
        start = head[order[end - 1]]
        times: dict[int, int] = {}
        for s in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            p = before[s]
            while p >= 0 and head[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        for t in sorted(set(times.values()), reverse=True) if len(times) > 1 else times.values():
            split: dict[int, list[int]] = {}
            for p, k in times.items():
                if k == t:
                    split.setdefault(head[p], []).append(p)
            for group, members in split.items():
                last = group + size[group]
                new = last - len(members)
                if new == group:
                    continue
                for k, p in enumerate(members, new):  # to the end of their group, as a group of their own
                    q, i = order[k], at[p]
                    order[i], at[q] = q, i
                    order[k], at[p] = p, k
                for p in members:
                    head[p] = new
                size[new], size[group] = len(members), new - group
        end = start
    # second phase: ascending suffixes let those that end before them take the next place of their group
    out, placed = [0] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    free = {}
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            group = head[s]
            k = free.get(group, group)
            out[k], free[group], placed[s] = s, k + 1, True
            s = before[s]
    return out


def repeated(contexts: list[tuple[bytes, bytes]], width: int = CLASS) -> list[list[int]]:
    """Of distinct (bytes before, bytes after) a shared core: the starts of windows of ``width`` symbols that occur again.

    The core is one symbol; a start counts from the first byte before.
    """
    text: list[int] = []
    owner: list[int] = []
    begin = []
    for n, (left, right) in enumerate(contexts):
        begin.append(len(text))
        text += [b + 2 for b in left]
        text.append(300)
        text += [b + 2 for b in right]
        text.append(1)
        owner += [n] * (len(text) - len(owner))
    text.append(0)
    found: list[list[int]] = [[] for _ in contexts]
    order = suffix_array(text)
    windows = [len(left) + len(right) + 2 - width for left, right in contexts]
    last, last_counted = None, True
    for s in order[1:]:
        if s >= len(owner):
            continue
        n = owner[s]
        if s - begin[n] >= windows[n]:
            continue
        # windows in the order of the suffix array: equal ones are neighbours
        if last is not None and text[s : s + width] == text[last : last + width]:
            found[n].append(s - begin[n])
            if not last_counted:
                m = owner[last]
                found[m].append(last - begin[m])
            last_counted = True
        else:
            last_counted = False
        last = s
    return found


# Anchors

_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(texts: list[bytes], nums: list[int], length: int = LENGTH) -> np.ndarray:
    """Anchors of texts of at least ``length`` bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    inverse = np.cumprod(np.full(n, _BACK, np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * power, out=total[1:])
    value = _mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    where = np.arange(len(value), dtype=np.int32)
    width = 1
    while width < SPREAD:  # smallest of ever wider stretches, the last of equals
        step = min(width, SPREAD - width)
        later = value[step:] <= value[:-step]
        value, where = np.where(later, value[step:], value[:-step]), np.where(later, where[step:], where[:-step])
        width += step
    found = []
    begin = 0
    for text, num in zip(texts, nums):
        windows = len(text) - length + 1
        own = where[begin : begin + windows]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        lo = first + begin
        hi = np.concatenate((first[1:], [windows])) - 1 + begin
        at = own[first]
        rows = np.zeros(len(first), _ANCHOR)
        core = length - SPREAD + 1
        rows["core"] = _mixed((total[at + core] - total[at]) * inverse[at])
        rows["full"] = _mixed((total[hi + length] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _BACK + (at - lo).astype(np.uint64))
        rows["num"], rows["lo"], rows["span"], rows["back"] = num, first, hi - lo, at - lo
        found.append(rows)
        begin += len(text)
    return np.concatenate(found) if found else np.zeros(0, _ANCHOR)


def _new(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted table's keys change."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def combine(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in the order of core and context; one of each context; number of contexts of its core."""
    rows = rows[np.lexsort((rows["full"], rows["core"]))]
    if not len(rows):
        return rows, rows, np.zeros(0, np.int64)
    new = _new(rows["core"], rows["full"])
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(rows)])))
    many = np.repeat(size > 1, size)
    covered = rows[many & (rows["done"] == 0)]
    one = rows[start]
    one["done"] |= size > 1
    core = np.flatnonzero(_new(one["core"]))
    contexts = np.diff(np.concatenate((core, [len(one)])))
    return covered, one, np.repeat(contexts, contexts)


def _told(kind: str, rows: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
    """(number of the text, kind, places) of anchors."""
    rows = rows[np.argsort(rows["num"], kind="stable")]
    start = np.flatnonzero(_new(rows["num"])) if len(rows) else []
    places = np.zeros(len(rows), _PLACE)
    for f in _PLACE.names:
        places[f] = rows[f]
    for a, b in zip(start, [*start[1:], len(rows)]):
        yield int(rows["num"][a]), kind, places[a:b].tobytes()


def _columns(rows: np.ndarray) -> bytes:
    """Anchors column by column, which packs better."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _ANCHOR.names)


def _rows(raw: bytes) -> np.ndarray:
    n, at = len(raw) // _ANCHOR.itemsize, 0
    rows = np.zeros(n, _ANCHOR)
    for f in _ANCHOR.names:
        kind = _ANCHOR[f]
        rows[f] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return rows


_FOUND = ["num", "kind", "data", "bucket"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_FOUND)


def _met(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """``num``, ``kind`` (covered: every window repeated; border: undecided or a partner) and places."""

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, "text", 2_000_000):
                raw = [t.encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]
                covered, one, contexts = combine(anchors(raw, piece.column("num").to_pylist(), length))
                # of a core with very many contexts here, a few go on to be counted; that it is shared is known
                turn = np.arange(len(one)) - np.repeat(np.flatnonzero(_new(one["core"])), np.diff(np.append(np.flatnonzero(_new(one["core"])), len(one)))) if len(one) else contexts
                extra = one[turn >= HANDED]
                out = [(*x, int(x[0] % buckets)) for kind, r in (("covered", covered), ("border", extra)) for x in _told(kind, r)]
                one = one[turn < HANDED]
                bucket = (one["core"] % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((one["num"], bucket))
                one, bucket = one[order], bucket[order]
                start = np.flatnonzero(_new(bucket)) if len(one) else []
                out += [(None, "anchors", _columns(one[a:b]), int(bucket[a])) for a, b in zip(start, [*start[1:], len(one)])]
                yield _batch(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            through = []
            for num, kind, data, bucket in zip(*(batch.column(c).to_pylist() for c in _FOUND)):
                if kind == "anchors":
                    held.append(_rows(data))
                else:
                    through.append((num, kind, data, bucket))
            if through:
                yield _batch(through)
        if held:
            covered, one, contexts = combine(np.concatenate(held))
            held.clear()
            border = one[contexts > 1]
            out = [(*x, 0) for kind, r in (("covered", covered), ("border", border)) for x in _told(kind, r)]
            for at in range(0, len(out), 20_000):
                yield _batch(out[at : at + 20_000])

    schema = "num long, kind string, data binary, bucket int"
    dealt = texts.select("num", "text").mapInArrow(hand_on, schema).repartition(buckets, "bucket")
    return dealt.mapInArrow(meet, schema).drop("bucket")


def _classes(bordering: DataFrame, length: int) -> DataFrame:
    """Windows of border anchors in classes: ``key`` of what a class shares, bytes before and after, text, first start."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for piece in common.pieces(batch, "text", 2_000_000):
                keys, lefts, rights, nums, starts = [], [], [], [], []
                for num, text, data in zip(*(piece.column(c).to_pylist() for c in ("num", "text", "data"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    for lo, span, back in np.unique(np.frombuffer(b"".join(data), _PLACE)).tolist():
                        at, hi = lo + back, lo + span
                        for c in range((at - hi) // CLASS, back // CLASS + 1):
                            low, high = max(lo, at - CLASS * c - CLASS + 1), min(hi, at - CLASS * c)
                            core, end = at - CLASS * c, at - CLASS * c - CLASS + 1 + length
                            keys.append(xxhash.xxh3_128_digest(raw[core:end], c))
                            lefts.append(raw[low:core])
                            rights.append(raw[end : high + length])
                            nums.append(num)
                            starts.append(low)
                        if len(keys) > 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(nums), pa.array(starts)], names=names)
                            keys, lefts, rights, nums, starts = [], [], [], [], []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(nums, pa.int64()), pa.array(starts, pa.int64())], names=names
                )

    names = ["key", "before", "after", "num", "start"]
    return bordering.mapInArrow(task, "key binary, before binary, after binary, num long, start long")


def _exact(classes: DataFrame, most: int) -> DataFrame:
    """``num``, ``start`` of repeated windows; with ``said`` (a digest of the window) those of large groups, still to be counted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        key, group, large = None, [], False

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["num", "start", "said"])

        def singly(rows: list[tuple]) -> list[tuple]:
            out = []
            for before, after, num, start in rows:
                for i in range(len(before) + len(after) + 2 - CLASS):
                    n = len(before) - i
                    digest = xxhash.xxh3_128_digest(key + bytes([n]) + before[i:] + after[: CLASS - 1 - n])
                    out.append((num, start + i, digest))
            return out

        def settle(rows: list[tuple]) -> list[tuple]:
            if len(rows) < 2:
                return []
            distinct: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
            for before, after, num, start in rows:
                distinct.setdefault((before, after), []).append((num, start))
            contexts = list(distinct)
            hits = repeated(contexts) if len(contexts) > 1 else [[]]
            out = []
            for context, starts in zip(contexts, hits):
                places = distinct[context]
                if len(places) > 1:
                    starts = range(len(context[0]) + len(context[1]) + 2 - CLASS)
                out += [(num, start + i, None) for num, start in places for i in starts]
            return out

        for batch in batches:
            found: list[tuple] = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "before", "after", "num", "start"))):
                if k != key:
                    found += singly(group) if large else settle(group)
                    key, group, large = k, [], False
                group.append(tuple(row))
                if len(group) > most:
                    found += singly(group)
                    group, large = [], True
            if found:
                yield batch_of(found)
        found = singly(group) if large else settle(group)
        if found:
            yield batch_of(found)

    dealt = classes.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(task, "num long, start long, said binary")


def spans(df: DataFrame, text: str = "text", length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """Of every distinct text of at least ``length`` bytes: ``digest`` (MD5), ``n_bytes``, removed ``spans`` (start, end), ``kept`` bytes."""
    if length < SPREAD + GRAM + CLASS:
        raise ValueError(f"the length must be {SPREAD + GRAM + CLASS} or more")
    common.needs(df, [text])
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = df.where(F.octet_length(df[text]) >= length).select(F.md5(df[text].cast("binary")).alias("digest"), df[text].alias("text"))
    texts = long.groupBy("digest").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    # bucketed by digest: later joins leave the texts where they are
    table = f"texts_{uuid.uuid4().hex}"
    texts = texts.withColumn("num", F.monotonically_increasing_id()).repartition(buckets, "digest")
    texts.write.bucketBy(buckets, "digest").option("path", work_folder(spark, "texts")).saveAsTable(table)
    texts = spark.table(table)

    met = keep_table(_met(texts, length, buckets), "met")
    names = texts.select("num", "digest")

    def by_text(frame: DataFrame) -> DataFrame:
        return frame.groupBy("num").agg(F.collect_list("data").alias("data")).join(names, "num").drop("num")

    border = by_text(met.where("kind = 'border'"))
    exact = keep_table(_exact(_classes(texts.join(border, "digest").select("num", "text", "data"), length), large), "exact")
    singly = exact.where("said IS NOT NULL")
    again = singly.groupBy("said").agg(F.count("*").alias("n")).where("n > 1").select("said")
    starts = exact.where("said IS NULL").select("num", "start").unionByName(singly.join(again, "said", "left_semi").select("num", "start"))
    starts = starts.distinct().groupBy("num").agg(F.collect_list("start").alias("starts"))
    covered = by_text(met.where("kind = 'covered'"))
    known = starts.join(names, "num").drop("num").join(covered, "digest", "full")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, "text"):
                out = []
                for digest, text, copies, starts, data in zip(*(piece.column(c).to_pylist() for c in ("digest", "text", "copies", "starts", "data"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    change = np.zeros(len(raw) + 1, np.int64)
                    if copies > 1:
                        change[[0, len(raw)]] += (1, -1)
                    if starts:
                        np.add.at(change, np.array(starts), 1)
                        np.add.at(change, np.array(starts) + length, -1)
                    if data:
                        places = np.frombuffer(b"".join(data), _PLACE)
                        lo = places["lo"].astype(np.int64)
                        np.add.at(change, lo, 1)
                        np.add.at(change, lo + places["span"] + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                    runs = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                    out.append((digest, len(raw), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
                kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["digest", "n_bytes", "spans", "kept"])

    joined = texts.join(known, "digest", "left").select("digest", "text", "copies", "starts", "data")
    return joined.mapInArrow(apply, "digest string, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
