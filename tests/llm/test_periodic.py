"""Periodic runs against a search over all periods and starts."""

import hashlib
import random
import zlib

import pytest

from areaspark.llm import periodic


def plain_runs(words, least=12):
    """Every maximal stretch of every period, under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = None
        for i in range(q, n + 1):
            same = i < n and words[i] == words[i - q]
            if same and start is None:
                start = i - q
            elif not same and start is not None:
                found.setdefault((start, i - start), q)
                start = None
    return sorted(((s, length, q) for (s, length), q in found.items() if length >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def word_lists(rng):
    k = rng.choice([1, 2, 2, 3, 5, 40])
    words = [rng.choice("abcdefghij"[: min(k, 10)]) + (str(rng.randint(0, k)) if k > 10 else "") for _ in range(rng.randint(0, 60))]
    for _ in range(rng.choice([0, 1, 2])):
        if words:
            at, p = rng.randrange(len(words)), rng.randint(1, 8)
            words[at:at] = words[at : at + p] * rng.randint(2, 6)
    return words


@pytest.mark.parametrize("least", [12, 4, 1])
def test_runs_against_all_periods(least):
    rng = random.Random(least)
    for _ in range(300):
        docs = [word_lists(rng) for _ in range(rng.randint(1, 6))]
        got = periodic.runs([[w.encode() for w in d] for d in docs], least)
        assert got == [plain_runs(d, least) for d in docs]


def test_many_left_words(monkeypatch):
    """A phrase after many different words, near and far, and nested repeats; with and without one list of all places."""
    rng = random.Random(4)
    phrase = [f"p{k}" for k in range(7)]
    doc = []
    for k in range(60):
        doc += [f"w{rng.randint(0, 40)}"] * rng.choice([0, 1, 1, 3]) + phrase * rng.choice([1, 1, 2])
    doc += doc[-90:] * 3
    want = plain_runs(doc)
    assert want
    for many in (0, 2, 8, 1000):
        monkeypatch.setattr(periodic, "MANY", many)
        assert periodic.runs([[w.encode() for w in doc]]) == [want]


def test_very_long_texts():
    words = [b"a"] * 50_000
    assert periodic.runs([words]) == [[(0, 50_000, 1)]]
    assert periodic.collapsed(words, [(0, 50_000, 1)]) == b"a"
    line = [b"w%d" % k for k in range(5_000)]
    assert periodic.runs([line * 7 + [b"x"], [b"y"] * 11]) == [[(0, 35_000, 5_000)], []]


def test_rows_of_any_kind(table):
    text = "x a b a b  a b\ta b a b a b y a b"
    rows = [(1, text, 7, "s"), (1, text, 7, "s"), (2, None, 7, "s"), (3, "", 8, None), (None, " \n ", 8, "s"), (4, "a " * 11, 8, "s"), (5, "é é " * 12, 9, "s")]
    df = table(rows, "doc_id long, text string, start long, period string")
    got = sorted(((r["doc_id"], r["start"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.detect(df, keep=("doc_id", "start")).collect()), key=str)
    want = [(i, k, plain_runs((t or "").encode().split()), plain_collapsed((t or "").encode().decode("latin-1").split(), []) if 0 else None) for i, t, k, _ in rows]
    assert [(g[0], g[1], g[2]) for g in got] == sorted([(w[0], w[1], w[2]) for w in want], key=str)
    assert {g[3] for g in got} == {"x a b y a b", "", " ".join(["a"] * 11), "é é"}
    assert periodic.detect(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.detect(df.withColumnRenamed("period", "runs"), keep=("doc_id", "runs"))


def test_the_query_on_whole_documents(spark):
    """Every document of the smallest table, changed as the query's rule says."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r.asDict() for r in entry.queries()["op11_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(found),
            "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
            "collapsed_sha256": sha(plain_collapsed(words, found)),
        }
