"""Periodic runs of words in documents, by maximal pairs of an LCP-interval tree.

A run is a stretch of words with smallest period q, of at least ``least`` words and 2 * q, that no
neighbouring word extends with that period. Two places whose left words differ and whose common words end
after l words are a maximal pair; with distance q <= l they are the ends of a stretch of q + l words of period q that
can't grow, so those pairs are exactly the runs (a multiple of the smallest period names the same stretch again and is
dropped).

Suffixes are ordered by doubled windows, their common prefixes follow from the ranks of the windows. The tree of LCP
intervals is walked bottom-up: an interval keeps its places in lists by left word, the smaller of two merged ones
looks for partners in the other lists of the larger. Of a list only the nearest place on either side is taken: between
the two first places of a run's shortest period the repeated words don't start, else the period would be
shorter. An interval with many left words therefore looks at its nearest places of all lists at once.

Documents are worked off by tasks, many at a time; one without a repeated stretch of ``least`` / 2 words ends early.

Cases: a null, empty or wordless text has no words, no run and an empty collapsed text. Rows that repeat, ties and null ids are
rows like others; no rows give no rows; other columns may have any names but those of the results. Texts are read whole, at any
length: time grows as n log n, and memory as that (eight bytes a word and doubling).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from areaspark.llm import common

#: Words of the shortest run.
LEAST = 12
#: An interval with more left words than this also keeps one list of all its places.
MANY = 8

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def suffix_order(codes: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places in the order of what follows them, and ranks by windows of ``width``, twice that and so on.

    ``codes`` end with a separator that occurs once, as does every separator between documents. A ``width`` of 3 needs
    codes below 2 ** 21.
    """
    n = len(codes)
    key = codes.astype(np.int64)
    if width == 3:
        tail = np.concatenate((key, [0, 0]))
        key = (tail[:-2] << 42) | (tail[1:-1] << 21) | tail[2:]
    order = np.argsort(key, kind="stable")
    slot, key = np.arange(n), key[order]
    rank, levels = np.zeros(n, np.int32), []
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = slot[new]
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(slot)])))
        rank = rank.copy()
        rank[order[slot]] = np.repeat(first, size)
        levels.append((width, rank))
        slot = slot[np.repeat(size > 1, size)]
        if not len(slot):
            return order, levels
        place = order[slot]  # windows that occur again hold no separator, so a further window starts in the text
        key = rank[place].astype(np.int64) * n + rank[place + width]
        by = np.argsort(key, kind="stable")
        order[slot], key = place[by], key[by]
        width *= 2


def common_words(codes: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of words that are the same from places ``i`` and ``j`` on."""
    n = np.zeros(len(i), np.int64)
    for width, rank in reversed(levels):
        n += width * (rank[i + n] == rank[j + n])
    for _ in range(levels[0][0] - 1):
        n += codes[i + n] == codes[j + n]
    return n


class Interval:
    """Places of one LCP interval, in sorted lists by left word; with many left words also in one list."""

    __slots__ = ("lists", "places", "size")

    def __init__(self, place: int, left: int):
        self.lists, self.places, self.size = {left: [place]}, None, 1

    def near(self, place: int, left: int) -> Iterator[int]:
        """The places nearest to one, before and after it, of other left words."""
        lists = [ys for word, ys in self.lists.items() if word != left] if self.places is None else [self.places]
        for ys in lists:
            k = bisect_left(ys, place)
            if k:
                yield ys[k - 1]
            if k < len(ys):
                yield ys[k]

    def take(self, other: Interval) -> None:
        for left, xs in other.lists.items():
            ys = self.lists.setdefault(left, xs)
            if ys is not xs:
                for x in xs:
                    insort(ys, x)
        self.size += other.size
        if self.places is not None:
            for xs in other.lists.values():
                for x in xs:
                    insort(self.places, x)
        elif len(self.lists) > MANY:
            self.places = sorted(x for xs in self.lists.values() for x in xs)


def _walk(places: list[int], lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and period of the maximal pairs of one stretch of the order; ``lcp[k]`` is of places k and k + 1."""
    found: list[tuple[int, int, int]] = []

    def merged(a: Interval, b: Interval, n: int) -> Interval:
        if a.size < b.size:
            a, b = b, a
        if len(a.lists) > 1 or a.lists.keys() != b.lists.keys():
            for word, xs in b.lists.items():
                for x in xs:
                    for y in a.near(x, word):
                        period = abs(x - y)
                        if period <= n and period + n >= least and left[x] != left[y]:
                            found.append((min(x, y), period + n, period))
        a.take(b)
        return a

    stack: list[tuple[int, Interval]] = []
    now = Interval(places[0], left[places[0]])
    for place, n in zip(places[1:], lcp):
        while stack and stack[-1][0] > n:
            top, older = stack.pop()
            now = merged(older, now, top)
        if stack and stack[-1][0] == n:
            _, older = stack.pop()
            now = merged(older, now, n)
        stack.append((n, now))
        now = Interval(place, left[place])
    while stack:
        top, older = stack.pop()
        now = merged(older, now, top)
    return iter(found)


def _repeated(codes: np.ndarray, width: int) -> np.ndarray:
    """Places whose next ``width`` words occur again; by a hash, so rarely one more."""
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ codes[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    some = np.sort(h)
    again = some[1:][some[1:] == some[:-1]]
    return np.flatnonzero(np.isin(h, np.unique(again))) if len(again) else np.zeros(0, np.int64)


def _joined(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of some documents, none shared between two, each document ended by a separator; their first places."""
    parts, starts, code, at = [], [], 0, 0
    for some in words:
        number = {w: code + k for k, w in enumerate(dict.fromkeys(some))}
        code += len(number)
        parts += [np.fromiter(map(number.__getitem__, some), np.int32, len(some)), np.array([code], np.int32)]
        code += 1
        starts.append(at)
        at += len(some) + 1
    return np.concatenate(parts), np.array(starts)


def runs(words: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of each document, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    shortest = max(1, -(-least // 2))  # common words of a run's pair
    long = [k for k, some in enumerate(words) if len(some) >= max(2, least)]
    if not long:
        return out
    codes, starts = _joined([words[k] for k in long])
    held = np.unique(np.searchsorted(starts, _repeated(codes, shortest), "right") - 1).tolist()
    if not held:
        return out
    long = [long[k] for k in held]
    codes, starts = _joined([words[k] for k in long])
    order, levels = suffix_order(codes, 3 if shortest >= 3 and codes.max() < 1 << 21 else 1)
    first = max((level for level in levels if level[0] <= shortest), key=lambda level: level[0])[1]
    pair = np.flatnonzero(first[order[:-1]] == first[order[1:]])
    lcp = common_words(codes, levels, order[pair], order[pair + 1])
    pair, lcp = pair[lcp >= shortest], lcp[lcp >= shortest]
    left = np.concatenate(([-1], codes[:-1]))
    new = np.flatnonzero(np.diff(pair, prepend=-2) != 1)
    size = np.diff(np.concatenate((new, [len(pair)])))
    # an interval of two places is its pair
    alone = new[size == 1]
    x, y, n = order[pair[alone]], order[pair[alone] + 1], lcp[alone]
    period = np.abs(x - y)
    good = (period <= n) & (period + n >= least) & (left[x] != left[y])
    found = list(zip(np.minimum(x, y)[good].tolist(), (period + n)[good].tolist(), period[good].tolist()))
    lefts = left.tolist() if (size > 1).any() else []
    for at, m in zip(new[size > 1].tolist(), size[size > 1].tolist()):
        found += _walk(order[pair[at] : pair[at] + m + 1].tolist(), lcp[at : at + m].tolist(), lefts, least)
    shortest_period: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        shortest_period[start, length] = min(period, shortest_period.get((start, length), period))
    for (start, length), period in sorted(shortest_period.items(), key=lambda r: (r[0][0], r[1])):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[long[k]].append((start - int(starts[k]), length, period))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def detect(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The kept columns, ``runs`` (start, length and period in words, by start and period) and ``collapsed``.

    Words are what ASCII white space divides. ``collapsed`` is the text without what runs repeat.
    """
    common.needs(df, [text, *keep])
    schema = common.schema_of(df, keep, runs=RUNS, collapsed=T.StringType())
    names = [f"_{k}" for k in range(len(keep))]
    df = df.select(*[df[c].alias(n) for c, n in zip(keep, names)], df[text].alias("_text"))
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUNS.elementType]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, "_text"):
                words = [(t or b"").split() for t in piece.column("_text").cast(pa.binary()).to_pylist()]
                found = runs(words, least)
                left = pa.array([collapsed(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string(), safe=False)
                told = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], kind)
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [told, left], names=[*keep, "runs", "collapsed"])

    return df.mapInArrow(task, schema)
