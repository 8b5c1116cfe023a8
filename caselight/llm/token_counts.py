"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes one signed delta per group: an
insert adds a document and its tokens, a delete takes them away, a revision adds the difference
of the counts. A batch is written beside the others and then committed by one rename to a
folder named after its id, which fails where that is there already; so a retry, a replay or a
second writer of the same batch changes nothing. Totals are the sums over committed batches.

Defined cases: null source, language or text are groups and empty texts of their own right; a
change whose kind is unknown or null adds nothing; a null count is zero; a group whose
documents have all gone stays with zeros; an empty batch can be committed.
"""

from __future__ import annotations

import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import BPE_RANKS, WORD

#: The byte-level BPE vocabulary of op5 as a tokenizer version.
BPE_50K = "bpe-50k"
#: Versions that a pattern counts: words between white space, and words and signs apart.
TOKENIZERS = {"words-1": rf"({WORD})", "words-2": r"([A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D])"}
GROUP = ("source", "lang", "tokenizer")


def _bpe_counts(texts: pd.Series) -> pd.Series:
    encode = bpe.load(BPE_RANKS).encode_bytes
    return pd.Series([len(encode(x)) // 4 for x in texts], dtype="int64")


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a tokenizer version; a null text has none."""
    if tokenizer == BPE_50K:
        return F.pandas_udf(_bpe_counts, "long")(F.coalesce(text, F.lit("")))
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("long")


def inserts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Changes that add every row of a table of documents."""
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit("insert").alias("kind"), count_tokens(F.col("text"), tokenizer).alias("tokens"), F.lit(0).cast("long").alias("tokens_before"))


def estimates(docs: DataFrame, tokenizer: str, chars_a_token: int = 6) -> DataFrame:
    """Inserts with counts guessed from lengths, to be revised later."""
    guess = F.ceil(F.length(F.coalesce(F.col("text"), F.lit(""))) / chars_a_token).cast("long")
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit("insert").alias("kind"), guess.alias("tokens"), F.lit(0).cast("long").alias("tokens_before"))


def revisions(docs: DataFrame, tokenizer: str, chars_a_token: int = 6) -> DataFrame:
    """Changes that put exact counts in place of guessed ones."""
    guess = F.ceil(F.length(F.coalesce(F.col("text"), F.lit(""))) / chars_a_token).cast("long")
    return docs.select(
        "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit("revise").alias("kind"), count_tokens(F.col("text"), tokenizer).alias("tokens"), guess.alias("tokens_before")
    )


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take back inserted rows."""
    return counted.withColumn("kind", F.lit("delete"))


def deltas(changes: DataFrame) -> DataFrame:
    """One signed row per group; partial sums form before the shuffle."""
    tokens, was = F.coalesce("tokens", F.lit(0)), F.coalesce("tokens_before", F.lit(0))
    n = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    change = F.when(F.col("kind") == "insert", tokens).when(F.col("kind") == "delete", -tokens).when(F.col("kind") == "revise", tokens - was).otherwise(0)
    return changes.groupBy(*GROUP).agg(F.sum(n).cast("long").alias("n_docs"), F.sum(change).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a shared folder, changed by idempotent batches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.folder).getFileSystem(self._conf)
        self._renames = hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._no_options = spark._sc._gateway.new_array(hadoop.Options.Rename, 0)

    def _batch(self, batch_id: str) -> str:
        return f"{self.folder}/batch={batch_id}"

    def is_committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(self._batch(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch once; False if it was committed before, here or by another writer meanwhile."""
        if self.is_committed(batch_id):
            return False
        own = f"{self.folder}/_open-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(own)
        try:
            self._renames.rename(self._path(own), self._path(self._batch(batch_id)), self._no_options)
        except Py4JJavaError as error:
            self._fs.delete(self._path(own), True)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over the committed batches."""
        found = [x.getPath().toString() for x in self._fs.listStatus(self._path(self.folder))] if self._fs.exists(self._path(self.folder)) else []
        committed = sorted(x for x in found if x.rsplit("/", 1)[-1].startswith("batch="))
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*committed) if committed else self.spark.createDataFrame([], schema)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


#: What op7 leaves under the two patterns: every document under words-2, and those of other
#: languages than English under words-1 as well, whose English rows were inserted and taken back.
PATTERN_SQL = r"""
WITH counted AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS n,
         CASE WHEN lang = 'en' THEN 0 ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS tokens
  FROM documents
  UNION ALL
  SELECT source, lang, 'words-2', 1, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))
  FROM documents
)
SELECT source, lang, tokenizer, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, tokenizer
"""
