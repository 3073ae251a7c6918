"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. Stages keep the
columns of documents; ``n_chars`` follows the text. The last adds the token ids.

1. toxicity: documents predicted toxic go.
2. line dedup: lines found in ten documents or more go; a document which loses all its lines stays, empty.
3. Jaccard join: of each group of near copies the document with the smallest id stays; documents without words are in no group.
4. decontamination: documents which hold ten consecutive words of a benchmark item go.
5. SentencePiece: token ids and their number, and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewise.llm.catalog import PIECES, table, toxicity_model
from sitewise.llm.common import row_key
from sitewise.llm.decontaminate import contamination
from sitewise.llm.jaccard_join import jaccard_classes
from sitewise.llm.line_dedup import drop_frequent_lines
from sitewise.llm.sentencepiece import Pieces, with_round_trip
from sitewise.llm.toxicity import score_toxicity
from sitewise.sources.scratch import stored


def toxicity(spark, docs, sf_dir):
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir), threshold=0.7)
    return scored.where("predicted = 0").select(*docs.columns)


def line_dedup(spark, docs, sf_dir):
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def jaccard_join(spark, docs, sf_dir):
    classes = jaccard_classes(docs, percent=75, size=5)
    # The smallest id of each group; of repeated rows with that id, one.
    first = classes.where((F.col("n_shingles") > 0) & F.col("component_id").isNotNull()).groupBy("component_id").agg(
        F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(True)), "k1", "k2")).alias("f")
    ).select("f.k1", "f.k2")
    outside = classes.where((F.col("n_shingles") == 0) | F.col("component_id").isNull()).select("k1", "k2")
    keyed = docs.select("*", *row_key(F.col("doc_id"), F.col("text")))
    kept = keyed.join(first.unionByName(outside).distinct().hint("merge"), ["k1", "k2"], "left_semi")
    # Repeated rows share a key.
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc_id")))
    return one.where((F.col("nth") == 1) | (F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$"))).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    hit = contamination(docs, table(spark, sf_dir, "benchmark"), window=10).where("contaminated").select("k1", "k2").distinct()
    keyed = docs.select("*", *row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(hit, ["k1", "k2"], "left_anti").select(*docs.columns)


def sentencepiece(spark, docs, sf_dir):
    return with_round_trip(docs, Pieces.load(PIECES))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]
#: The model of the first stage can't be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "pipeline")
    return docs
