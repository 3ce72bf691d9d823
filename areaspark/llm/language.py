"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (one to three letters, word ends count) of
a language in order of frequency. A text's own list is held against each profile: an n-gram's
distance is the difference of its two ranks, or the length of the profile where it is missing
there. The language with the smallest sum is predicted; the score is one minus that sum's
share of the largest possible sum.

Cases: a text that is null or has no letters gets ``und`` and score 0; ties between n-grams go
by the letters' codes, ties between languages to the first name; rows without id or language
are never learned from; without any labelled row everything is ``und``; repeated rows get the
same result; other columns are ignored. Very long texts are counted in segments cut at spaces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaspark.llm import common

LENGTH = 300
#: At most so many labelled rows of a language are learned from.
ROWS_PER_LANGUAGE = 2_000
NONE = "und"
#: Characters and texts counted together.
SEGMENT, TEXTS = 500_000, 4_000
_BITS, _CODE = 17, 21
EDGE = 1  # stands for everything between words


@cache
def _letters() -> np.ndarray:
    """Of each code point: itself if a letter, else EDGE."""
    table = np.full(sys.maxunicode + 1, EDGE, np.int32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            table[c] = c
    return table


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where they start."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], start


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram code and count of at most TEXTS short texts."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    points = _letters()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in lowered])
    edge = points == EDGE
    again = np.zeros(len(points), bool)
    again[1:] = edge[1:] & edge[:-1] & (owner[1:] == owner[:-1])
    points, owner, edge = points[~again], owner[~again], edge[~again]
    present = np.zeros(sys.maxunicode + 1, bool)
    present[points] = True
    alphabet = np.flatnonzero(present)
    number = np.zeros(sys.maxunicode + 1, np.int64)
    number[alphabet] = np.minimum(np.arange(1, len(alphabet) + 1), (1 << _BITS) - 1)
    small, who = number[points], owner << (3 * _BITS)
    keys = [(who | small)[~edge]]
    two = ~(edge[1:] & edge[:-1])
    keys.append((who[1:] | small[:-1] << _BITS | small[1:])[two])
    if len(points) > 2:
        three = ~edge[1:-1]
        keys.append((who[1:-1] | small[:-2] << 2 * _BITS | small[1:-1] << _BITS | small[2:])[three])
    key = np.sort(np.concatenate(keys))
    value, start = _runs(key)
    count = np.diff(np.concatenate((start, [len(key)])))
    mask, letter = (1 << _BITS) - 1, np.concatenate(([0], alphabet)).astype(np.int64)
    code = sum(letter[value >> k * _BITS & mask] << k * _CODE for k in range(3))
    return value >> 3 * _BITS, code, count


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, cut at spaces where they are long, in lots of at most SEGMENT characters."""
    owners: list[int] = []
    lot: list[str] = []
    size = 0
    for n, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            to = at + SEGMENT
            if to < len(text):
                cut = text.rfind(" ", at + 1, to)
                to = cut if cut > 0 else to
            part = text[at:to]
            if lot and (size + len(part) > SEGMENT or len(lot) >= TEXTS):
                yield owners, lot
                owners, lot, size = [], [], 0
            owners.append(n)
            lot.append(part)
            size += len(part)
            at = max(to, at + 1)
    if lot:
        yield owners, lot


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram code and count of whole texts, sorted by text and code."""
    found = []
    for owners, lot in _segments(texts):
        who, code, n = _count(lot)
        found.append((np.array(owners, np.int64)[who], code, n))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    who, code, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((code, who))
    who, code, n = who[order], code[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (code[1:] != code[:-1]))))
    return who[new], code[new], np.add.reduceat(n, new)


class Profiles:
    """Ranked n-grams of each language, ready for comparison."""

    def __init__(self, ranked: dict[str, list[int]], length: int = LENGTH):
        self.names, self.length = sorted(ranked), length
        self.codes = np.array(sorted({c for codes in ranked.values() for c in codes[:length]}), np.int64)
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            codes = np.array(ranked[name][:length], np.int64)
            self.rank[k, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [NONE] * len(texts), [0.0] * len(texts)
        who, code, n = counts(texts)
        if not len(who) or not len(self.codes):
            return names, scores
        order = np.lexsort((code, -n, who))
        who, code = who[order], code[order]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.concatenate((first, [len(who)]))))
        top = rank < self.length
        who, code, rank = who[top], code[top], rank[top]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == code, at, len(self.codes))
        total = np.stack([
            np.add.reduceat(np.where(r[at] < 0, self.length, np.abs(r[at] - rank)), first) for r in self.rank
        ])
        best = total.argmin(0)
        most = self.length * np.diff(np.concatenate((first, [len(who)])))
        for text, k, d, m in zip(who[first].tolist(), best.tolist(), total.min(0).tolist(), most.tolist()):
            names[text], scores[text] = self.names[k], 1 - d / m
        return names, scores


def remainder(id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(id.cast("string").cast("binary")) % 5


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", length: int = LENGTH, rows: int = ROWS_PER_LANGUAGE) -> Profiles:
    """Profiles from at most ``rows`` labelled rows of each language, chosen by a hash of the id."""
    common.needs(df, [text, lang, id])
    known = df.where(df[lang].isNotNull() & df[id].isNotNull()).select(
        df[lang].alias("lang"), F.xxhash64(df[id].cast("string")).alias("at"), df[text].alias("_text")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles({}, length)
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1_000_000, 1_000_000 * rows // n + 1)).otherwise(share)
    chosen = known.where(F.pmod("at", F.lit(1_000_000)) < share)
    order = Window.partitionBy("lang").orderBy("at", F.xxhash64("_text"))
    chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("lang", "_text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, "_text"):
                who, code, n = counts(piece.column("_text").to_pylist())
                names = np.array(piece.column("lang").to_pylist(), object)[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.tolist(), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "code", "n"]
                )

    grams = chosen.mapInArrow(task, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranked: dict[str, list[int]] = {}
    for r in grams.withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, length)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` (0 to 1)."""
    common.needs(df, [text, *keep])
    schema = common.schema_of(df, keep, lang_pred=T.StringType(), score=T.DoubleType())
    own = [c for c in keep if c != text]
    df = df.select(*own, df[text].alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, "_text"):
                names, scores = profiles.predict(piece.column("_text").to_pylist())
                cols = [piece.column("_text" if c == text else c) for c in keep]
                cols += [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    return df.mapInArrow(task, schema)
