"""Byte-level BPE encoding and decoding from a published vocabulary file.

Encoding of a word holds the parts that are left and the ranks of adjacent pairs in two
flat arrays, looks for the smallest rank, drops the boundary there and refreshes the two
ranks beside it; the arrays are rows of a matrix, so that many words take each step
together. Words beyond ``SHORT`` bytes, where repeated scans cost too much, keep the ranks
in a heap. A task remembers the ids of the words it met, within a bound.

Cases: null text counts as empty; empty text has no ids and decodes to empty text; repeated
rows give repeated results; no rows give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from areaspark.llm import common

SHORT = 128
#: Words a task remembers from one piece of work to the next; beyond it, it starts anew.
REMEMBERED = 150_000
#: Bytes of text in a piece of work, about.
PIECE = 500_000
NONE = 2**31 - 1

#: The word pattern of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_SPACE_RUN = re.compile(r" [\s\u001c-\u001f\u0085 ]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes with a visible
    Latin-1 letter stand for themselves, the others follow from U+0100 on in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder over one vocabulary file (model, merges, added tokens)."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab.get(letters[b]) for b in range(256)]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for n, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), n)
            self.made.append(vocab[a + b])
        added = spec.get("added_tokens") or []
        self.added = {t["content"]: t["id"] for t in added}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.first_ids = np.array([-1 if i is None else i for i in self.first], np.int32)
        self.made_ids = np.array(self.made, np.int32)
        keys = sorted((a << 32 | b, n) for (a, b), n in self.rank.items())
        self.pair_keys = np.array([k for k, _ in keys], np.int64)
        self.pair_rank = np.array([n for _, n in keys], np.int32)
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, bytes] = {}
        self.small: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; NONE where they never merge."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], np.int32(NONE))

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Merge words of at most SHORT bytes, many at a time.

        Each row of a matrix is the rank array of one word. A round finds the smallest rank
        of every row (the leftmost of equals), deletes that boundary and refreshes the two
        ranks beside it; finished rows leave the matrix.
        """
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in zip((0, 8, 16, 32, 64), (8, 16, 32, 64, SHORT)):
            left = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(left):
                continue
            joined = b"".join(words[i].ljust(high + 1, b"\0") for i in left)
            parts = self.first_ids[np.frombuffer(joined, np.uint8).reshape(len(left), high + 1)]
            n = sizes[left]
            column = np.arange(high + 1)
            parts[column[None, :] >= n[:, None]] = -1
            ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
            while len(left):
                best_at = ranks.argmin(1)
                row = np.arange(len(left))
                best = ranks[row, best_at]
                done = best == NONE
                if done.any():
                    raw, wide = parts[done].astype("<u4").tobytes(), 4 * (high + 1)
                    for k, (at, size) in enumerate(zip(left[done].tolist(), n[done].tolist())):
                        out[at] = raw[k * wide : k * wide + 4 * size]
                    go = ~done
                    left, parts, ranks, n, best, best_at = left[go], parts[go], ranks[go], n[go], best[go], best_at[go]
                    if not len(left):
                        break
                    row = np.arange(len(left))
                moved = np.minimum(column[None, :] + (column[None, :] > best_at[:, None]), high)
                parts = np.take_along_axis(parts, moved, 1)
                ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], high - 1), 1)
                n = n - 1
                parts[row, best_at] = self.made_ids[best]
                parts[row, n] = -1
                ranks[row, np.minimum(n, high - 1)] = NONE
                ranks[row, best_at] = self.pair_ranks(parts[row, best_at], parts[row, best_at + 1])
                before = np.maximum(best_at - 1, 0)
                again = self.pair_ranks(parts[row, before], parts[row, before + 1])
                ranks[row, before] = np.where(best_at > 0, again, ranks[row, before])
        return out

    def merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (q := rank((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (q, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def learn(self, units: set[str]) -> None:
        """Work out the ids of stretches of text that aren't remembered yet."""
        split: dict[str, list[str]] = {}
        for u in units:
            if u.isalpha() or u[0] == " " and u[1:].isalpha():
                split[u] = [u]
            elif u[-1] in ".," and (u[:-1].isalpha() or u[0] == " " and u[1:-1].isalpha()):
                split[u] = [u[:-1], u[-1]]
            else:
                split[u] = self.words(u)
        new = list({w for words in split.values() for w in words} - self.small.keys())
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        self.small.update(zip([new[i] for i in short], self.merge_short([raw[i] for i in short])))
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                self.small[new[i]] = np.array(self.merge_long([self.first[b] for b in w]), "<u4").tobytes()
        get = self.small.__getitem__
        for u, words in split.items():
            self.known[u] = b"".join(map(get, words))

    @staticmethod
    def units(text: str) -> list[str]:
        """A plain text cut into stretches whose ids don't depend on each other: a word of
        the pattern never goes on over a single space between two visible characters."""
        if not text:
            return []
        if _SPACE_RUN.search(text) or text[-1] == " ":
            return [text]
        head, *rest = text.split(" ")
        return ([head] if head else []) + list(map(" ".__add__, rest))

    def encode_many(self, texts: list[str | None], special: bool = True) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Without ``special``, the names of added tokens in a text are text like any other.
        """
        for known in (self.known, self.small):
            if len(known) >= REMEMBERED:  # short words come again sooner
                again = {w: ids for w, ids in known.items() if len(w) <= 9}
                known.clear()
                known.update(again if len(again) < REMEMBERED // 2 else {})
        plans: list[list] = []
        for text in texts:
            parts = [text or ""]
            if special and text and self.split_added is not None and self.split_added.search(text):
                parts = self.split_added.split(text)
            plans.append([self.added[p] if special and p in self.added else self.units(p) for p in parts])
        self.learn({u for plan in plans for p in plan if isinstance(p, list) for u in p} - self.known.keys())
        get = self.known.__getitem__
        return [
            b"".join(b"".join(map(get, p)) if isinstance(p, list) else np.array([p], "<u4").tobytes() for p in plan)
            for plan in plans
        ]

    def forget(self) -> None:
        """Idle workers hold the vocabulary only."""
        self.known, self.small = {}, {}

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes | None) -> str:
        """Text of ids; unknown ids are skipped, broken UTF-8 becomes U+FFFD."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, read once by each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _mapped(df: DataFrame, source: str, keep: Sequence[str], path: str | None, results: dict[str, T.DataType]) -> DataFrame:
    """The kept columns and those of ids, n_tokens and decoded that ``results`` names."""
    path = path or default_path()
    common.needs(df, [source, *keep])
    schema = common.schema_of(df, keep, **results)
    own = [c for c in keep if c != source]
    df = df.select(*own, df[source].alias("_source"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for piece in common.pieces(batch, "_source", PIECE):
                ids = piece.column("_source").to_pylist()
                if "ids" in results:
                    ids = coder.encode_many(ids)
                made = {
                    "ids": lambda: pa.array(ids, pa.binary()),
                    "n_tokens": lambda: pa.array([len(x or b"") // 4 for x in ids], pa.int64()),
                    "decoded": lambda: pa.array([coder.decode(x) for x in ids], pa.string()),
                }
                cols = [piece.column("_source" if c == source else c) for c in keep] + [made[c]() for c in results]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *results])
        coder.forget()

    return df.mapInArrow(task, schema)


_IDS = {"ids": T.BinaryType(), "n_tokens": T.LongType()}
_TEXT = {"decoded": T.StringType()}


def encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``."""
    return _mapped(df, text, keep, path, _IDS)


def decode(df: DataFrame, ids: str = "ids", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns and ``decoded``, the text of the ids; null ids decode to empty text."""
    return _mapped(df, ids, keep, path, _TEXT)


def round_trip(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Encode and decode in one task: the kept columns, ``ids``, ``n_tokens`` and ``decoded``."""
    return _mapped(df, text, keep, path, _IDS | _TEXT)
