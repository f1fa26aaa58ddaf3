"""Token counts with a digest cache (operator 9).

Content is normalised only as far as the count cannot change: a null text is
the empty text.  Its SHA-256 and the tokenizer file's SHA-256 name an entry
of the cache, a Parquet table in a folder that outlives the run.  Counts
found there are joined; distinct misses are encoded once and appended.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bound_batches, exists, shared_path, written
from chronoweave.llm.encoder import encoder, file_digest

HOT_SHARE = 1000  # a text on more than one in so many rows gets its count by broadcast


def _once_per_task(batches):
    """Drop rows whose digest this task has already passed on."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for d in b.column("digest").to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(keep, pa.bool_()))


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows and null
    ids stay rows of their own; other columns are ignored, whatever their
    names.  ``cache_path`` is any folder that Spark can read and write; a
    folder not there yet is an empty cache, None makes a new one under the
    shared checkpoint folder.  Entries that two runs appended twice are read
    once.  A task passes each text on once before the shuffle, so a text that
    a third of all rows repeat reaches its task at most once per input task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    version = file_digest(tokenizer)
    cache_path = cache_path or shared_path(spark, "token-cache")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text", F.unhex(F.sha2("_text", 256)).alias("digest"))

    def read() -> DataFrame:
        return (spark.read.schema("tokenizer string, digest binary, n_tokens long").parquet(cache_path)
                .where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))

    misses = rows.select("digest", "_text")
    if exists(spark, cache_path):
        misses = misses.join(read(), "digest", "left_anti")

    def count(batches):
        e = encoder(tokenizer)
        for b in _once_per_task(batches):
            n = [len(x) // 4 for x in e.encode(b.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), b.column("digest"),
                                              pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    (misses.mapInArrow(_once_per_task, "digest binary, _text string").repartition("digest")
     .mapInArrow(count, "tokenizer string, digest binary, n_tokens long")
     .write.mode("append").parquet(cache_path))
    rows = written(rows.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "token-rows")
    often = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > rows.count())
    hot = F.broadcast(written(read().join(F.broadcast(often.select("digest")), "digest", "left_semi"), "token-hot"))
    found = (rows.join(hot, "digest")
             .unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(read(), "digest")))
    return found.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
