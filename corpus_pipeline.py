"""A corpus pipeline over the operators of ``areaspark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a frame; :func:`run` writes every stage's
result as Parquet to the shared folder, reads it back for the next one and deletes what the stage
worked on. All stages but the last return the columns of the documents.

Stages hold for null or empty texts, null ids, repeated rows, empty tables and further columns of any
name: decisions are joined to the rows by digests of the texts (null counts as empty), never by ids alone, and
columns go by their position while a stage works on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaspark.llm import bpe, common, decontaminate, language, pii, simhash
from areaspark.llm.queries import digests
from areaspark.session import discard, keep, scratch, work_folder

#: Texts less like any learned language than this are no text in one of them.
LEAST_SCORE = 0.1
#: Words of a shingle and largest number of differing fingerprint bits of near duplicates.
WORDS, BITS = 4, 4
#: Digests of contaminated texts (16 bytes each) up to this number are broadcast; beyond it the join shuffles.
BROADCAST_DIGESTS = 1_000_000


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with columns named by position, and these names."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language, whose name becomes ``lang`` where there was none.

    Texts without letters and texts that share next to nothing with every profile go.
    """
    numbered, names = _numbered(docs)
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    found = language.predict(numbered, language.fit(docs), text=text, keep=names)
    found = found.where((F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn(lang, F.coalesce(lang, "lang_pred")).select(names).toDF(*docs.columns)


def _identity(id: Column, text: Column) -> Column:
    """Rows in the order of their ids, unknown ones last, then texts."""
    return F.struct(id.isNull().alias("unknown"), id.alias("id"), _digest(text).alias("digest"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id, then digest.

    Near duplicates have SimHash fingerprints that differ in :data:`BITS` bits at most.
    """
    numbered, names = _numbered(docs)
    id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = numbered.withColumn("row_id", _identity(F.col(id), F.col(text)))
    groups = simhash.groups(rows.select("row_id", F.col(text).alias("text")), id="row_id", words=WORDS, bits=BITS)
    first = groups.where(F.col("row_id") == F.col("component_id")).select("row_id").distinct()
    # of rows with the same id and text, one stays
    kept = rows.join(first, "row_id", "left_semi").dropDuplicates(["row_id"])
    return kept.select(names).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of the benchmark.

    Texts stay where they are: only digests of contaminated texts reach the rows.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    numbered, names = _numbered(docs)
    text = names[docs.columns.index("text")]
    rows = numbered.withColumn("text_digest", F.unhex(_digest(F.col(text))))
    marked = decontaminate.mark(rows.select("text_digest", F.col(text).alias("text")), benchmark, keep=("text_digest",))
    bad = keep(marked.where("contaminated").select("text_digest").distinct(), "contaminated")
    bad = common.checked_broadcast(bad, bad.count(), BROADCAST_DIGESTS)
    return rows.join(bad, "text_digest", "left_anti").select(names).toDF(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data and secrets replaced by surrogates."""
    return pii.replace(docs)


def encode_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text they decode to; one row per document."""
    return digests(bpe.round_trip(docs), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("encoding", encode_round_trip),
]

#: Language profiles, surrogates and encoding are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_folder(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
