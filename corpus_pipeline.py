"""From raw documents to token ids: five stages over whole tables.

Each stage takes all rows that the one before it kept, as a table of documents that was
written and read again, and returns the same columns; the last one adds the token ids.
Rejected documents, lines and copies are gone for every later stage, and documents of
domains below their target appear more than once after mixing.
"""

from wardflow.llm import lines, mixing, pieces, quality, simhash
from wardflow.llm.stages import stored


def quality_rules(spark, docs, sf_dir):
    """Documents that pass their own rules and whose host passes."""
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Documents without lines that are near an earlier one; empty ones go."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: that with the smallest id."""
    return simhash.keep_one(docs, n=3, seed=42, radius=3)


def mixing_to_targets(spark, docs, sf_dir):
    """Documents as often as their rates say."""
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_ids(spark, docs, sf_dir):
    """All columns, the ids of the text, and whether decoding gives the text back."""
    return pieces.encode(docs, "text", "ids", check="round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing_to_targets),
    ("SentencePiece", token_ids),
]

#: SQL has no MinHash components, fitted classifiers or tokenizer; tests/llm holds brute-force
#: versions of the stages against run().
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents of a folder; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
