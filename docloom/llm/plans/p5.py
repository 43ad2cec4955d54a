"""p5: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.blocks import blocks
from docloom.llm.pages import furniture, learn, noisy_documents, paragraphs, repaired
from docloom.runtime import materialize, small


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(blocks(spark, sf_dir, "document_id", "block_no", "page_idx", "block_type", "text_level", "text", "image_caption"))
    lines = materialize(furniture(rows))
    noisy = materialize(noisy_documents(rows, lines))
    clean = rows.join(small(noisy), "document_id", "left_anti")
    captions = clean.select(F.explode("image_caption").alias("text"))
    sample = clean.select("text").unionByName(captions)
    if clean.isEmpty():  # nothing is free of scan marks: learn from all, noise is the rarer reading
        sample = rows.select("text").unionByName(rows.select(F.explode("image_caption").alias("text")))
    dirty = rows.join(small(noisy), "document_id", "left_semi")
    model = learn(sample, dirty.select("text"))
    work = rows.join(lines.select("block_id", "furniture"), "block_id", "left")
    done = repaired(work, model)
    return materialize(work.select("block_id", "document_id", "block_no", "page_idx", F.col("text_level").isNotNull().alias("leveled"), "block_type").join(done, "block_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("block_id", F.explode("kinds").alias("kind")).distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_repaired(spark, sf_dir).where("block_type = 'text'"))


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
SQL: dict[str, str] = {}
