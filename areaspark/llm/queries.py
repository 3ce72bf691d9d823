"""The registered queries of this subpackage, and reference SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaspark.llm import ann, bpe, centroids, chat, common, decontaminate, language, minhash, periodic, pii, simhash, suffix_dedup, token_counts, url_rules
from areaspark.session import keep, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Digest columns of a frame with ``ids`` and ``decoded``, and ``more`` of its own."""
    return encoded.select(
        "doc_id", "n_tokens", *more, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat files of two-byte ids that are written first."""
    path = bpe.default_path()
    written = keep(token_counts.write_files(_table(spark, folder, "documents"), work_folder(spark, "tokens")), "written")
    files = written.groupBy("file").agg(F.max("size").alias("size"))
    found = token_counts.count(files, token_counts.separator_of(path), token_counts.width_of(path))
    return written.join(found, ["file", "number"]).select("doc_id", "n_tokens")


@_query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document and decode the ids again."""
    return digests(bpe.round_trip(_table(spark, folder, "documents")))


@_query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    docs = _table(spark, folder, "documents")
    profiles = language.fit(docs.where(language.remainder(F.col("doc_id")) != 0))
    held_out = F.coalesce(language.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return language.predict(docs, profiles).select("doc_id", held_out, "lang_pred", "score")


#: Rules of the query: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge(_table(spark, folder, "pages"), rules)


ORACLE["op4_url_rules"] = """
WITH parts AS (
    SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), cut AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), named AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM cut
), rules(h, p, action) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
    SELECT page_id, host, path, h || p AS rule, action,
        row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, action DESC) AS place
    FROM named LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE place = 1
"""


@_query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return pii.replace(docs, count="n_entities")


@_query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document outside strings of 400 bytes that occur again.

    ``text`` is these bytes as UTF-8, with U+FFFD where characters cut in two leave no valid one; ``kept_sha256`` is of the bytes.
    """
    docs = _table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = suffix_dedup.spans(docs).select(
        "digest", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept",
    )
    short = F.when(F.octet_length("text") < suffix_dedup.LENGTH, F.col("text").cast("binary"))
    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("digest"), short.alias("whole"))
    return docs.join(found, "digest", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", F.sha2("whole", 256)).alias("kept_sha256"),
        F.make_valid_utf8(F.coalesce("kept", "whole").cast("string")).alias("text"),
    )


@_query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that benchmark items hold too."""
    found = decontaminate.mark(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


#: On words as rows: benchmark windows meet document windows of the same number of words.
ORACLE["op7_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS said
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS said
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, n, i, said FROM dw SEMI JOIN bw USING (n, said)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM hits JOIN bw USING (n, said) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@_query
def op8_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@_query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.groups(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


@_query
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of every conversation's rows, recovered without looking at them, and canonical turns."""
    talks = _table(spark, folder, "conversations")
    return chat.parse(talks, chat.fit(talks))


#: Fixed value: words of the run query.
RUN_WORD = r"[^\x20\x09-\x0D]+"


def _with_runs(doc_id: Column, text: Column) -> Column:
    """The texts, but for those whose id has a CRC-32 that 10 divides: from a word on, these repeat the next few words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(words[a + (i - a) % p]))

    changed = F.array_join(common.let(F.regexp_extract_all(text, F.lit(RUN_WORD), F.lit(0)), repeat), " ")
    return F.when((h % 10 == 0) & text.rlike(RUN_WORD), changed).otherwise(text)


@_query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words of every document, a tenth of which get a long run first."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.detect(docs.select("doc_id", _with_runs(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@_query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector of 64 components, after three rounds over 16 centroids."""
    found, last = centroids.cluster(_table(spark, folder, "embeddings"))
    digest = F.element_at(F.array(*[F.lit(centroids.digest(c)) for c in last or [[]]]), F.col("cluster") + 1)
    return found.select("*", digest.alias("centroid_sha256"))


def _centroid_sql(rounds: int) -> str:
    """Every vector against every centroid, round by round."""
    nearest = """
a{t} AS (
    SELECT r, vec_id, v, c, d FROM (
        SELECT r, vec_id, v, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
            SELECT r, vec_id, v, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS BIGINT) AS d
            FROM whole, c{t}
        )
    ) WHERE place = 1
)"""
    moved = """
m{t} AS (
    SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS w
    FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) AS places(i) GROUP BY c, i) GROUP BY c
), c{u} AS (SELECT c, coalesce(m{t}.w, c{t}.w) AS w FROM c{t} LEFT JOIN m{t} USING (c))"""
    parts = ["""
whole AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS w FROM whole WHERE vec_id IS NOT NULL
    ORDER BY sha256('1:' || vec_id), v LIMIT 16
)"""]
    for t in range(rounds):
        parts += [nearest.format(t=t), moved.format(t=t, u=t + 1)]
    parts.append(nearest.format(t=rounds))
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


ORACLE["op12_centroids"] = _centroid_sql(3)


@_query
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group of every document: shingles of four words, similarity 0.8."""
    return minhash.groups(_table(spark, folder, "documents"))


#: All pairs of rows that share a shingle, counted; every row then reaches what its links reach.
ORACLE["op13_minhash"] = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS s
    FROM w WHERE len(w) > 0
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), common AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s AS a JOIN s AS b USING (s) WHERE a.r <> b.r GROUP BY a.r, b.r
), links AS (SELECT x, y FROM common JOIN n AS a ON a.r = x JOIN n AS b ON b.r = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), reach AS (
    SELECT r AS x, r AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN least USING (r) LEFT JOIN n USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
