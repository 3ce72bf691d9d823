"""Suffix arrays, SimHash groups, nearest neighbours, chat and the pipeline against plain versions."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from areaspark import session
from areaspark.llm import ann, chat, graph, queries, simhash, suffix_dedup

# Suffix dedup


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(3000):
        k = rng.choice([1, 2, 3, 5, 200])
        text = [rng.randint(1, k) for _ in range(rng.randint(0, 24))] * rng.choice([1, 1, 1, 3]) + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain_spans(texts, length):
    count = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False]))))
        out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def check_spans(table, texts, length=400, **more):
    df = table([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r["digest"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.spans(df, length=length, **more).collect()}
    for text, want in zip(texts, plain_spans(texts, length)):
        b = (text or "").encode()
        if len(b) < length:
            assert not want[0]
        else:
            assert got[hashlib.md5(b).hexdigest()] == want


def test_repeated_strings(table):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passages = [say(rng.choice([380, 395, 399, 400, 401, 410, 500, 900])) for _ in range(8)]
    texts = []
    for _ in range(50):
        texts.append(say(rng.randint(0, 300)) + "".join(rng.choice(passages) + say(rng.randint(0, 60)) for _ in range(rng.randint(0, 3))))
    for _ in range(12):
        b, k = rng.choice(texts), rng.randint(0, 200)
        texts.append(b[:k] + say(rng.choice([0, 1, 3])) + b[k:])
    texts += ["a" * 3000, "ab" * 900, "a" * 399, "a" * 401, None, "", texts[0], texts[0]]
    check_spans(table, texts)


def test_repeats_of_large_groups(table):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    common = say(392)
    check_spans(table, [say(5) + common + say(15) for _ in range(80)] + [say(8) + "x" * 400 + say(8) for _ in range(40)], large=20)


def test_no_texts_to_dedup(table):
    df = table([(1, None), (2, "")], "doc_id long, text string")
    assert suffix_dedup.spans(df).count() == 0
    assert suffix_dedup.spans(df.limit(0)).count() == 0


def test_query_of_planted_passages(spark, table, tmp_path):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(n))
    texts, passages = [say(rng.randint(20, 250)) for _ in range(80)], [say(rng.randint(51, 90)) for _ in range(20)]
    for i, passage in enumerate(passages * 2):
        texts[i] += " " + passage + " " + say(rng.randint(0, 9))
    texts += [None, "", say(4), texts[0], texts[70]]
    table(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:5] for r in queries.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    want = {}
    for i, (text, (spans, kept)) in enumerate(zip(texts, plain_spans(texts, 400))):
        n = len((text or "").encode())
        want[i] = (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert got == want
    # passages of 400 bytes with their two spaces go from both documents; shorter ones stay, and documents without one lose nothing
    reach = [len(p.encode()) + 2 >= 400 for p in passages]
    assert set(reach[1:]) == {True, False}
    for i in range(1, 20):
        assert {got[k][1] > 0 for k in (i, i + 20)} == {reach[i]}
    assert not any(got[k][1] for k in range(40, 80) if k != 70)


def test_query_returns_what_is_left(spark, table, tmp_path):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passage = say(500)
    texts = [say(90) + passage + say(30), say(40) + passage, passage + say(700), say(600), "x" * 900, say(20) + passage, say(20), None, ""]
    # é and ũ share their second byte, é and è their first: the repeats take half of each
    texts += [say(50) + "é" + passage[::-1] + "n", say(50) + "ũ" + passage[::-1], say(350)]
    texts += ["n" + passage[100:] + passage[:50] + "é", "m" + passage[100:] + passage[:50] + "è"]
    texts += [texts[3], texts[6], say(20) + "\ufffd"]
    table(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    kept = [k for _, k in plain_spans(texts, 400)]
    assert [rows[i]["text"] for i in range(len(texts))] == [k.decode(errors="replace") for k in kept]
    assert [rows[i]["kept_sha256"] for i in range(len(texts))] == [hashlib.sha256(k).hexdigest() for k in kept]
    assert passage not in "".join(r["text"] for r in rows.values())
    assert rows[6]["text"] == texts[6] and rows[7]["text"] == "" and rows[3]["text"] == ""
    assert rows[9]["text"].endswith("\ufffdn") and rows[10]["text"].endswith("\ufffd") and rows[12]["text"] == "n\ufffd" and rows[16]["text"] == texts[16]


# SimHash


def plain_print(text, words=4):
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, linked):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    rng = random.Random(8)
    for text in [None, "", " \t\n", "one", "One two three", "a b c d", "É é A a"] + [" ".join(rng.choices("abcdeÄ", k=rng.randint(4, 40))) for _ in range(60)]:
        assert simhash.fingerprint(text) == plain_print(text)


def test_fingerprints_of_long_texts(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_links_connect_near_prints(table, bits):
    rng = random.Random(bits)
    values = []
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            v = center
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = graph.components(simhash.links(table([(v,) for v in signed], "fingerprint long"), bits))
    got = {r["node"] & (1 << 64) - 1: r["root"] for r in roots.collect()}
    want = plain_components(values, lambda a, b: bin(a ^ b).count("1") <= bits)
    groups = collections.defaultdict(set)
    for v, w in zip(values, want):
        groups[w].add(got.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_groups_of_documents(table):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(5, base), (3, base), (9, base + " end"), (7, None), (2, ""), (None, base), (None, "alone " * 9), (4, "quite another text of a few words"), (5, base)]
    df = table([(i, t, "x") for i, t in texts], "doc_id long, text string, fingerprint string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.groups(df).collect())
    near = bin(plain_print(base) ^ plain_print(base + " end")).count("1") <= 4
    assert got == sorted([(5, 3), (3, 3), (9, 3 if near else 9), (7, 2), (2, 2), (-1, 3), (-1, -1), (4, 4), (5, 3)])
    assert simhash.groups(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(table):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(table(links, "a long, b long")).collect()}
    nodes = sorted({x for a, b in links if a is not None and a != b for x in (a, b)})
    edges = {frozenset(x) for x in links}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in edges)
    assert got == {n: nodes[w] for n, w in zip(nodes, want)}


# Nearest neighbours


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(rows, F.col("id") % 50 == 0).collect()
    pairs = rows.select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in pairs])
    m = np.array([r["embedding"] for r in pairs], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = collections.defaultdict(dict)
    for r in found:
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = n = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = m @ m[i]
        score[i] = -9
        best = {int(x) for x in ids[np.lexsort((ids, -score))[:5]]}
        mine = got[int(ids[i])]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, s in mine.values())
        hits, n = hits + len(best & {v for v, _ in mine.values()}), n + 5
    assert hits / n >= 0.9


def test_vectors_that_take_no_part(table):
    nan = float("nan")
    rows = [(i, [1.0, float(i), 0.5]) for i in range(8)] + [(50, [1.0, 1.0, 0.5]), (51, None), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 1.0]), (54, [nan, 1.0, 1.0])]
    rows += [(None, [1.0, 2.0, 3.0]), (100, [float("inf"), 1.0, 1.0]), (60, [1.0, 2.0]), (1, [1.0, 1.0, 0.5])]
    df = table([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(n, v) for q, n, v, _ in got if q == 50] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert {q for q, *_ in got} == {0, 50} and all(-1 <= s <= 1.0000001 for *_, s in got)
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(df, F.col("id") < 0).count() == 0


def test_equal_vectors_go_by_id(table):
    df = table([(i, [1.0, 2.0]) for i in range(1, 200)], "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in ann.nearest(df, F.col("id").isin(3, 150)).orderBy("query_id", "rank").collect()]
    assert got == [(3, k + 1, v) for k, v in enumerate([1, 2, 4, 5, 6])] + [(150, k + 1, v) for k, v in enumerate([1, 2, 3, 4, 5])]


# Chat


def talks(n, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(2, 9)):
            role = ["user", "assistant"][t % 2]
            lines = [" ".join(["word"] * rng.randint(3, 8)) + "?"] if role == "user" else [" ".join(["answer"] * rng.randint(20, 60)) + "." for _ in range(rng.randint(1, 3))]
            out.append((c, t, role, "\n".join(lines)))
    return out


def test_roles_are_recovered(table):
    seen, new = table(talks(60, 1), "conv_id long, turn long, role string, text string"), talks(40, 2)
    found = chat.parse(table(new, "conv_id long, turn long, role string, text string"), chat.fit(seen))
    want = {(c, t): r for c, t, r, _ in new}
    got = {(r["conv_id"], r["turn"]): r for r in found.collect()}
    assert len(got) == len(new)
    right = sum(got[k]["role"] == r for k, r in want.items())
    assert right / len(want) > 0.95
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") for r in got.values() if r["n_turns"])


def test_markers_in_one_row(table):
    text = "User: how are you?\nAssistant: fine.\nthanks.\n\nHuman: good"
    found = chat.parse(table([(1, 0, text)], "conv_id long, turn long, text string"), chat.Model(["assistant", "user"], []))
    row = found.first()
    assert row["rendered"] == "<|user|>\nhow are you?\n<|assistant|>\nfine.\nthanks.\n<|user|>\ngood" and row["n_turns"] == 3


def test_cut_transcripts_get_the_best_path(spark):
    """One long transcript over many tasks has the states that a single pass over it finds."""
    rows = [(0, n, t) for n, (_, _, _, t) in enumerate(talks(120, 3))] + [(1, 0, "alone"), (None, 0, None), (None, 1, "x")]
    model = chat.Model(["assistant", "user"], [[(r, t) for c, _, r, t in talks(60, 4) if c == k] for k in range(60)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows)
    lines = [chat.lines_of(t) for c, _, t in rows if c == 0]
    states = model.states([x for some in lines for x in some])
    got = {r["turn"]: r for r in found if r["conv_id"] == 0}
    for n, some in enumerate(lines):
        mine, states = states[: len(some)], states[len(some) :]
        assert got[n]["rendered"] == model.render(some, mine)
    empty = next(r for r in found if r["conv_id"] is None and r["turn"] == 0)
    assert (empty["role"], empty["n_turns"], empty["rendered"]) == (None, 0, "")


def test_no_transcripts(table):
    df = table(talks(2, 1), "conv_id long, turn long, role string, text string").limit(0)
    assert chat.parse(df, chat.fit(df)).count() == 0


# Pipeline


def test_stages_on_odd_rows(spark, table, tmp_path):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choices("abdeghilnorst", k=rng.randint(2, 8))) for _ in range(n))
    plain = [(i, say(60), "en" if i % 3 else None, "s", 1, "x") for i in range(40)]
    item = say(12)
    copies = [(90, plain[3][1], "en", "s", 1, "x"), (3, plain[3][1], "en", "s", 1, "x"), (None, plain[4][1], "en", "s", 1, "x")]
    odd = [(91, None, "en", "s", 1, "x"), (92, "", "en", "s", 1, "x"), (93, "123", None, "s", 1, "x"), (94, say(20) + " " + item + " " + say(20), "en", None, 1, "x"), (95, say(30) + " a.b@c.de", "en", "s", 1, "x")]
    docs = table(plain + copies + odd, "doc_id long, text string, lang string, source string, n_chars long, digest string")
    table([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.keep(stage(spark, before, str(tmp_path)), name)
        seen[name] = after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            before = after
    ids = {n: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in f.collect()) for n, f in seen.items()}
    everyone = sorted([*range(40), -1, 3, 90, 94, 95])
    assert ids["language"] == everyone
    assert ids["near_duplicates"] == sorted([*range(40), 94, 95])
    assert ids["decontamination"] == ids["personal_data"] == ids["encoding"] == sorted([*range(40), 95])
    assert "a.b@c.de" not in {r["doc_id"]: r["text"] for r in seen["personal_data"].collect()}[95]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_leaves_its_result_only(spark, monkeypatch):
    made, real = [], session.work_folder
    spy = lambda spark, name: made.append(real(spark, name)) or made[-1]
    monkeypatch.setattr(session, "work_folder", spy)
    monkeypatch.setattr(corpus_pipeline, "work_folder", spy)
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [os.path.basename(p).split("-")[0] for p in made if os.path.isdir(p)]
    rows = found.select("n_tokens", F.octet_length("ids").alias("bytes"), "ids_sha256", F.sha2("ids", 256).alias("again")).collect()
    assert len(made) > 10 and left == ["encoding"]
    assert rows and all(r["bytes"] == 4 * r["n_tokens"] and r["ids_sha256"] == r["again"] for r in rows)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("key", ["op4_url_rules", "op7_decontaminate", "op12_centroids", "op13_minhash"])
def test_reference_sql(spark, key):
    import compare

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    assert compare.differences(entry.queries()[key](spark, folder), compare.connect(folder), entry.oracle_sql()[key]) == []
