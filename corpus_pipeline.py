"""The corpus pipeline: toxicity, exact dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of their input. A runner may write each stage's result and read it again
as the next one's ``docs``; ``run`` chains them over the documents table and stages
what each of them returns in the shared folder.

Edge cases are those of the operators. Near duplicates are told by their words and not by
ids, so exactly one row of each class stays also where ids are null or repeated; a document of which the mix takes nothing goes,
one taken several times is repeated, and one cut by its source's budget keeps its
first words and gets a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm import toxicity
from rankloom.llm.common import SPACE_CLASS, carried, fold, drop_tables, restored, staged, staging, table, tables_mark, tables_since
from rankloom.llm.exact_dedup import exact_duplicates
from rankloom.llm.minhash_forest import near_duplicates, text_hash
from rankloom.llm.mixing import mix_sources
from rankloom.llm.packing import pack_documents
from rankloom.llm.queries import vocabulary

TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    columns = docs.columns
    scored = toxicity.score(docs, model, {f"_d{i}": F.col(f"`{c}`") for i, c in enumerate(columns)})
    kept = scored.where(F.col("score") < TOXIC_SCORE)
    return kept.select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(columns)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_duplicates(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    elected = near_duplicates(docs).where("stays").select(F.col("text_hash").alias("_elected")).distinct()
    hashed = docs.select(*carried(columns), text_hash(F.col("text")).alias("_hash"))
    # Rows of one elected text (few: exact copies are gone) are told apart by id, then by what else they hold.
    id_at = F.col(f"_own{columns.index('doc_id')}")
    order = Window.partitionBy("_hash").orderBy(id_at.asc_nulls_last(), *(f"_own{i}" for i in range(len(columns))))
    one = hashed.join(elected, F.col("_hash") == F.col("_elected"), "left_semi").withColumn("_rank", F.row_number().over(order))
    return one.where("_rank = 1").select(*restored(columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    mixed = mix_sources(docs).where("taken > 0")
    full, rest = F.expr("taken div size"), F.expr("taken % size")
    copies = mixed.withColumn("_rest", rest).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), full + F.when(rest > 0, 1).otherwise(0))))
    is_cut = (F.col("_copy") == F.expr("taken div size") + 1) & (F.col("_rest") > 0)
    # Pieces are a word with the white space after it; leading white space is a piece of its own.
    pieces = F.split("text", f"(?<=[{SPACE_CLASS}])(?=[^{SPACE_CLASS}])")
    count = (F.col("_rest") + F.when(F.col("text").rlike(f"^[{SPACE_CLASS}]"), 1).otherwise(0)).cast("int")
    cut = copies.withColumn("text", F.when(is_cut, F.array_join(F.slice(pieces, F.lit(1), count), "")).otherwise(F.col("text")))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.when(is_cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained scores, min-hashes and token ids have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        mark = tables_mark()
        with staging(spark):  # what a stage's operator staged goes once its result is written
            result = stage(spark, docs, sf_dir)
            docs = staged(result, f"pipeline-{name}", lasting=True)
        written = tables_since(mark)
        drop_tables(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
