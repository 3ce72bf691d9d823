"""Token counts, BPE, language, URL rules, surrogates and decontamination against plain versions."""

import collections
import hashlib
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaspark.llm import bpe, decontaminate, language, pii, token_counts, url_rules

ODD = [" ", "  ", "\n", "\t", "\u00a0", "\x1c", "\x85", "a", "é", "ß", "1", "²", "Ⅷ", "五", "'s", "'ll", "<|endoftext|>", "!", "%", "\u200b", "\U0001f600", "x" * 140, "İ", "\x00"]


# BPE


def test_bpe_agrees_with_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    other, own = Tokenizer.from_file(path), bpe.codec(path)
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 10))) for _ in range(4000)] + ["ab" * 400 + " x", "a" * 127, "a" * 128, "a" * 129, "Hello world. It's 42!"]
    for text, ids in zip(texts, own.encode_many(texts)):
        want = other.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == other.decode(want, skip_special_tokens=False)


def test_bpe_short_and_long_words_agree():
    own = bpe.codec(bpe.default_path())
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choices("thenraé", k=rng.randint(1, 60))).encode()
        if len(word) > bpe.SHORT:
            continue
        slow = own.merge_long([own.first[b] for b in word])
        assert np.frombuffer(own.merge_short([word])[0], "<u4").tolist() == slow


def test_bpe_odd_rows(table):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", None), (2, "a b", "x"), (2, "a b", "x"), (3, "w" * 50_000, "x")]
    df = table(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df), keep=("doc_id", "n_tokens"))
    got = sorted((r["doc_id"] or -1, r["decoded"]) for r in back.collect())
    assert got == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert bpe.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, keep=("doc_id", "ids"))


# Token counts


def test_separators_across_blocks(spark):
    folder, rng, want = tempfile.mkdtemp(prefix="run-"), np.random.default_rng(0), {}
    for f in range(4):
        lengths = [] if f == 3 else rng.choice([0, 0, 1, 3, 50, 700], size=60).tolist()
        ids = []
        for i, n in enumerate(lengths):
            ids += [1 + i % 7] * n + [9]
            want[f"f{f}.bin", i, True] = n
        if f == 1:
            ids += [3] * 17
            want["f1.bin", 60, False] = 17
        np.array(ids, "<u2").tofile(f"{folder}/f{f}.bin")
    found = token_counts.count(token_counts.files_in(spark, folder), 9, 2, block=64)
    assert {(r["file"].rsplit("/", 1)[1], r["number"], r["ended"]): r["n_tokens"] for r in found.collect()} == want


def test_broken_file_is_refused(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/a.bin", "wb") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        token_counts.count(token_counts.files_in(spark, folder), 9, 2).collect()


def test_written_files_hold_every_document(spark, table):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "<|endoftext|> inside"), (None, "x"), (1, "one two")]
    written = token_counts.write_files(table(rows, "doc_id long, text string"), tempfile.mkdtemp(prefix="run-")).cache()
    files = written.groupBy("file").agg(F.max("size").alias("size"))
    path = bpe.default_path()
    found = written.join(token_counts.count(files, token_counts.separator_of(path), token_counts.width_of(path)), ["file", "number"])
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in found.collect())
    sizes = [len(x) // 4 for x in bpe.codec(path).encode_many([t for _, t in rows], special=False)]
    assert got == sorted((i or -1, n) for (i, _), n in zip(rows, sizes))


# Language


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    out = collections.Counter()
    for w in words:
        padded = f"\x01{w}\x01"
        for n in (1, 2, 3):
            out.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip("\x01"))
    return out


def test_ngram_counts():
    texts = ["The cat, the  cat!", "", None, "é1É x", "Ünïcode wörds; ärger" * 30]
    who, code, n = language.counts(texts)
    for k, text in enumerate(texts):
        got = {}
        for c, m in zip(code[who == k].tolist(), n[who == k].tolist()):
            letters = [c >> 42, c >> 21 & (1 << 21) - 1, c & (1 << 21) - 1]
            got["".join(chr(x) for x in letters if x)] = m
        assert got == dict(plain_grams(text or "")), text


def test_long_texts_are_counted_in_segments(monkeypatch):
    text = "some words of a text " * 200
    whole = [x.tolist() for x in language.counts([text, "b"])]
    monkeypatch.setattr(language, "SEGMENT", 100)
    assert [x.tolist() for x in language.counts([text, "b"])] == whole


def test_language_odd_rows(table):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 20)]
    rows += [(100, None, "en"), (101, "123 !!", "de"), (None, "the end", None), (102, "", None)]
    df = table(rows, "doc_id long, text string, lang string")
    profiles = language.fit(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, profiles).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[None][0] == "en"
    assert got[100] == got[101] == got[102] == (language.NONE, 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(df, empty).collect()} == {language.NONE}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.fit(docs.where(language.remainder(F.col("doc_id")) != 0))
    held = docs.where(language.remainder(F.col("doc_id")) == 0)
    found = language.predict(held, profiles).join(held.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n >= 0.98


# URL rules


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules(table):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/e", "block"), ("org", "", "block"), ("org", "", "allow"), ("é.fr", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?q#f", "x://a.example.net/en/", "x://net", "x://net/", "x://anet/", "x://b..net/a", "x://org?x/", "x://É.fr/x", "x://é.fr/xy", "a://b://net/"]
    rng = random.Random(5)
    urls += ["h://" + ".".join(rng.choices(["a", "net", "example", "org", ""], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/e", "?/en/"]) for _ in range(300)]
    pages = table([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, host string")
    got = url_rules.judge(pages, table(rules, "host string, path string, action string")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(urls[r["page_id"]], rules)
    none = table(rules, "host string, path string, action string").limit(0)
    assert {r["verdict"] for r in url_rules.judge(pages, none).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_rules.judge(pages, table([("a", None, "block")], "host string, path string, action string"))
    assert url_rules.judge(pages.limit(0), table(rules, "host string, path string, action string")).count() == 0


# Surrogates


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d * 2 > 9)
    return total % 10


def test_surrogates_keep_their_kind(table):
    texts = {
        1: "Write to Ann.B@Mail.example.com or ann.b@mail.example.com; call +1 (017) 555-7713.",
        2: "4111 1111 1111 1111 and 4111-1111-1111-1111, from 10.1.2.3!",
        3: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
        4: "Mrs. Anna Smith met Mr Smith, Herr Müller and господин Иванов.",
        5: "Version 2.0. of 1.2.3 in 2024, page 12, 555 times.",
        6: "a@b.co",
        7: "",
    }
    rows = [(i, t, i) for i, t in texts.items()] + [(8, None, 8), (1, texts[1], 1)]
    df = table(rows, "doc_id long, text string, row long")
    found = pii.replace(df, count="n_entities")
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    assert found.count() == len(rows) and found.columns == ["doc_id", "text", "row", "n_entities"]
    assert got[8] is None and got[7] == "" and got[5] == texts[5]
    mails = re.findall(r"\S+@[\w.]+\w", got[1])
    assert mails[0].lower() == mails[1].lower() and "ann.b" not in got[1].lower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", got[1]) and "7713" not in got[1]
    cards = re.match(r"(\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4}), from (\d+\.\d+\.\d+\.\d+)!", got[2])
    digits = [re.sub(r"\D", "", c) for c in cards.groups()[:2]]
    assert digits[0] == digits[1] != "4111111111111111" and luhn(digits[0]) == luhn("4111111111111111")
    assert all(0 <= int(x) <= 255 for x in cards[3].split(".")) and cards[3] != "10.1.2.3"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[3]) and got[3] != texts[3]
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+), Herr (\w+) and господин ([А-Яа-я]+)\.", got[4])
    assert names[1] in pii.GIVEN["f"] and names[2] == names[3] != names[4] and "Smith" not in got[4] and "Иванов" not in got[4]
    assert got[6] != "a@b.co" and re.fullmatch(r"\w@\w{8}\.example\.org", got[6])
    assert pii.replace(df.limit(0)).count() == 0


def test_surrogates_of_different_entities_differ(table):
    """Four-letter surnames of few letters collide; the redraw tells them apart."""
    rng = random.Random(6)
    names = sorted({"".join(rng.choices("ABC", k=1)) + "".join(rng.choices("abcdefg", k=5)) for _ in range(900)})
    df = table([(i, f"Mr {n}") for i, n in enumerate(names)], "doc_id long, text string")
    one = {r["doc_id"]: r["text"] for r in pii.replace(df).collect()}
    assert len(set(one.values())) == len(names) and not set(one.values()) & {f"Mr {n}" for n in names}
    assert one == {r["doc_id"]: r["text"] for r in pii.replace(df).collect()}
    assert one != {r["doc_id"]: r["text"] for r in pii.replace(df, key="another").collect()}


def test_more_names_than_first_surrogates(table, monkeypatch):
    """Two given names and 16 surnames at first: each redraw must widen the choice, or it never ends."""
    monkeypatch.setattr(pii, "GIVEN", {"m": ["Adam"], "f": ["Alma"]})
    monkeypatch.setattr(pii, "SYLLABLES", ["ba", "do"])
    words = [f"{a}{b}{c}" for a in "QXZ" for b in "aeiou" for c in "bcdfg"]
    entities = table([(k, w.lower(), w) for k in ("given_m", "surname") for w in words], "kind string, norm string, raw string")
    now = pii._surrogate("k", F.col("kind"), F.col("norm"), F.col("attempt"))
    got = [tuple(r) for r in pii._resolved(entities, "k").select("kind", now).collect()]
    assert len(got) == len(set(got)) == 2 * len(words)
    # beyond the pool that one redraw gave, whatever its size: 16 x 27 given names
    assert {len(s.split()) for k, s in got if k == "given_m"} >= {1, 2, 3}


def test_a_phone_number_in_several_layouts(table):
    rows = [(1, "+1 (663) 555-6869"), (2, "+16635556869"), (3, "+1-663-555-6869"), (4, "+49 30 123456"), (5, "+4930123456"), (6, "(663) 555-6869")]
    got = {r["doc_id"]: r["text"] for r in pii.replace(table(rows, "doc_id long, text string")).collect()}
    digits = {i: re.sub(r"\D", "", t) for i, t in got.items()}
    assert digits[1] == digits[2] == digits[3] != "16635556869" and digits[4] == digits[5] != "4930123456"
    assert digits[1][0] == "1" and digits[4][:2] == "49" and digits[6] != "6635556869"
    assert {i: re.sub(r"\d", "0", t) for i, t in got.items()} == {i: re.sub(r"\d", "0", t) for i, t in rows}


def test_long_secrets_and_phone_numbers_in_pairs(table):
    rng = random.Random(8)
    tokens = ["".join(rng.choices("0123456789abcdef", k=n)) for n in (32, 128, 129, 160, 5000)]
    tokens += ["sk-" + "".join(rng.choices("abcXYZ0189", k=n)) for n in (128, 129, 400)] + ["AB" * 200]
    phones = ["+33 6 12 34 56 78", "+33.6.12.34.56.78", "06 12 34 56 78", "+41 44 668 18 00"]
    rows = [(i, f"x {t}, y") for i, t in enumerate(tokens + phones)]
    got = {r["doc_id"]: r["text"] for r in pii.replace(table(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(tokens):
        new = got[i][2:-3]
        assert len(new) == len(t) and new != t and (new[:3] == "sk-") == (t[:3] == "sk-") and got[i][:2] + got[i][-3:] == "x , y"
        assert t[4:40] not in got[i] and t[-20:] not in got[i]
    for i, t in enumerate(phones, len(tokens)):
        assert re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", rows[i][1]) and t[-8:] not in got[i]
    # the stream of a long token does not come round again
    assert got[4][2 : 2 + 128] != got[4][130 : 130 + 128] != got[4][258 : 258 + 128]


def test_whole_names(table):
    texts = [
        "Mr John Fitzgerald Kennedy left.", "Mr Kennedy came.", "Herr Ludwig van Beethoven, Frau von Trapp", "Mrs. J. Smith met Ms Smith's dog.",
        "Mr J.R.R. Tolkien and Mr. J.Tolkien", "Herr Dr. Müller und Frau Prof. Dr. Anna-Lena Müller", "Mr Brown Mrs Green", "Mr K went", "Mme d'Artois", "господин А. Иванов", "Mr and Mrs Olsen", "MR SMITH",
    ]
    df = table(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace(df).collect()}
    for word in ["John", "Fitzgerald", "Kennedy", "Ludwig", "Beethoven", "Trapp", "Smith", "Tolkien", "Müller", "Lena", "Brown", "Green", "Artois", "Иванов", "Olsen"]:
        assert not any(word in got[i] for i in range(len(texts))), (word, got)
    first = re.fullmatch(r"Mr (\w+) (\w+) (\w+) left\.", got[0])
    assert got[1] == f"Mr {first[3]} came." and len({*first.groups()}) == 3
    assert re.fullmatch(r"Herr \w+(?: [A-Z]\.)* van \w+, Frau von \w+", got[2])
    smith = re.fullmatch(r"Mrs\. ([A-Z])\. (\w+) met Ms (\w+)'s dog\.", got[3])
    assert smith[1] != "J" and smith[2] == smith[3]
    tolkien = re.fullmatch(r"Mr ([A-Z])\.([A-Z])\.([A-Z])\. (\w+) and Mr\. ([A-Z])\.(\w+)", got[4])
    assert tolkien[1] == tolkien[5] == smith[1] != tolkien[2] == tolkien[3] != "R" and tolkien[4] == tolkien[6]
    doctor = re.fullmatch(r"Herr Dr\. (\w+) und Frau Prof\. Dr\. (\w+)(?: [A-Z]\.)* (\w+)", got[5])
    assert doctor[1] == doctor[3]
    assert re.fullmatch(r"Mr \w+ Mrs \w+", got[6]) and re.fullmatch(r"Mr [A-JL-Z] went", got[7]) and re.fullmatch(r"господин [Б-Я]\. \w+", got[9]) and got[10].startswith("Mr and Mrs ")


def test_surrogates_are_drawn_anew_on_collision(spark, table, monkeypatch):
    monkeypatch.setattr(pii, "_surrogate", lambda key, kind, norm, attempt: F.concat(F.lit("s"), F.length(norm).cast("string"), F.lit("-"), attempt.cast("string")))
    entities = table([("surname", n, n) for n in ["aaaa", "bbbb", "cccc", "dd", "s2-0"]], "kind string, norm string, raw string")
    got = {r["norm"]: r["attempt"] for r in pii._resolved(entities, "k").collect()}
    taken = [f"s{len(n)}-{a}" for n, a in got.items()]
    assert len(set(taken)) == 5 and not set(taken) & set(got)


# Decontamination


def plain_mark(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for text in texts:
        w, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_decontamination(table, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_PRINTS", bound)
    rng = random.Random(7)
    say = lambda n, k=4: " ".join(rng.choices(["a", "B", "cé", "d1", "e", "É"][:k], k=n))
    items = [(i, say(rng.choice([1, 3, 5, 6, 9, 10, 11, 15, 30]), 6)) for i in range(25)] + [(100, None), (101, "..."), (None, say(12, 6)), (3, say(12, 6))]
    texts = [say(rng.randint(0, 60), 3) for _ in range(60)]
    texts += [f"{say(5)} {t}; {say(7)}" for _, t in items if t] + [None, "", "!!", "a " * 40, texts[0]]
    docs = table([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in decontaminate.mark(docs, table(items, "item_id long, text string")).collect()}
    for i, want in enumerate(plain_mark(texts, items)):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == want, texts[i]
        assert got[i]["contaminated"] == (want[1] > 0)
    clean = decontaminate.mark(docs, table(items, "item_id long, text string").limit(0))
    assert clean.where("contaminated OR n_hit > 0").count() == 0 and clean.count() == len(texts)
    assert decontaminate.mark(docs.limit(0), table(items, "item_id long, text string")).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
