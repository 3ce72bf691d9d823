"""MinHash near-duplicate groups against all pairs of full sets."""

import random

import numpy as np
import pytest

from areaspark.llm import minhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_groups(rows):
    """(id, size, smallest id reachable, kept) of every row, all pairs compared."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), r in zip(rows, root) if r == root[i] and d is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def say(rng, n):
    return ["".join(rng.choices("abdeghilnorst", k=rng.randint(2, 8))) for _ in range(n)]


def family(rng, size, changes, words=300):
    """Copies of one text, each with some words changed."""
    base, out = say(rng, words), []
    for _ in range(size):
        copy = list(base)
        for i in rng.sample(range(words), changes(rng) if callable(changes) else changes):
            copy[i] = say(rng, 1)[0]
        out.append(" ".join(copy))
    return out


def found(table, rows):
    df = table([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, node string")
    return sorted((tuple(r) for r in minhash.groups(df).collect()), key=str)


@pytest.mark.parametrize("early,block", [(minhash.EARLY, minhash.BLOCK), (4, 7)])
def test_groups_against_all_pairs(table, monkeypatch, early, block):
    monkeypatch.setattr(minhash, "EARLY", early)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CHUNK", 2 * block)
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        texts += family(rng, 4, lambda r: r.choice([0, 1, 3, 5, 7, 8, 9]))
    texts += family(rng, 60, lambda r: r.randint(2, 12), 120)  # like some others only
    walk = say(rng, 300)
    for _ in range(40):
        for i in rng.sample(range(300), 5):
            walk[i] = say(rng, 1)[0]
        texts.append(" ".join(walk))
    for n in range(1, 12):  # short texts, in which one shingle weighs much
        short = say(rng, n)
        texts += [" ".join(short), " ".join(short + say(rng, 1)), "  ".join(short).upper(), " ".join(short[1:])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert found(table, rows) == plain_groups(rows)


def test_rows_of_any_kind(table):
    rng = random.Random(3)
    text = " ".join(say(rng, 50))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (9, None), (8, ""), (7, " \n"), (None, None), (None, "lone words here"), (1, "two words"), (2, "Two  WORDS"), (4, "two")]
    rows += [(11, "a " * 5_000), (12, "a a a a a"), (13, "é É é É"), (14, "É é é é")]
    assert found(table, rows) == plain_groups(rows)
    assert found(table, []) == []


def test_pairs_of_a_family_stay_in_proportion(table, spark):
    """A template whose copies all lie below the limit: stars give as many pairs as there are texts and bands at most."""
    rng, made = random.Random(2), []
    for size in (40, 80, 160):
        texts = family(rng, size, 5, 300)
        df = table(list(enumerate(texts)), "doc_id long, text string")
        rows = df.selectExpr("doc_id AS id", "text", "unhex(md5(text)) AS node")
        made.append(minhash._stars(minhash._index(minhash._signed(rows, 4))).count())
        assert made[-1] <= size * minhash.BANDS
    assert made[2] <= 3 * made[1]


def test_borrowed_bins_agree_as_often_as_others():
    """Small sets: the share of equal bins estimates the similarity although most bins are empty."""
    rng = np.random.default_rng(7)
    for n in (1, 3, 10, 60, 2_000):
        gaps = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 5 * n, dtype=np.uint64)
            a, b = minhash.signature(both[: 4 * n]), minhash.signature(both[n:])
            gaps.append((a == b).mean() - 3 / 5)
        assert abs(np.mean(gaps)) < 0.06
