"""Token counts kept by deltas: signed rows are added to totals, a batch counts only once.

Totals are sums of documents and tokens per source, language and tokenizer version. A change
feed has rows with a sign: an insert adds a document's counts, a delete takes them away, a
revision takes the old away and adds the new. A batch is summed by key before it is written, so
what is stored and read back is a few rows per batch, whatever its size.

A batch is committed by writing its sums under its id and then a mark. A batch with a mark is
ignored when it comes again; one without a mark (a job that ended half-way) is not counted and
is written anew. Sums do not depend on the order of batches.

Defined results: null sources, languages and texts form keys and counts of their own (a null
text has no tokens); repeated rows count as often as they occur; keys whose documents and
tokens are all taken away again stay with zeros; no batches give an empty table. Very long texts
are counted whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_batches, words_of
from .packing import word_ids

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def count_words(_path: str) -> Callable[[bytes | None], int]:
    return lambda text: len(words_of(text))


def count_ids(path: str) -> Callable[[bytes | None], int]:
    known = word_ids(path)
    return lambda text: len(known.of(text)) // 4


#: Tokenizer version -> maker of its counter, from the path of its vocabulary.
TOKENIZERS = {"words-1": count_words, "word-bpe-49k-1": count_ids}


def token_counts(docs: DataFrame, versions: dict[str, str], id: str = "doc_id",
                 text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per document and tokenizer version, with the digest of the text."""
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, source, "string").alias("source"),
                       column(docs, lang, "string").alias("lang"),
                       F.sha2(column(docs, text, "binary"), 256).alias("digest"),
                       column(docs, text, "binary").alias("body"))
    counters: dict[str, Callable] = {}

    def work(ids, sources, langs, digests, texts):
        for version, path in versions.items():
            if version not in counters:
                counters[version] = TOKENIZERS[version](path)
            n = [counters[version](t) for t in texts]
            yield [ids, sources, langs, digests, [version] * len(ids), n]

    return map_batches(base, work, "doc_id long, source string, lang string, digest string, "
                       "tokenizer string, tokens long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Counted documents as inserts (sign 1) or deletes (sign -1)."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("documents"),
                       (F.col("tokens") * sign).alias("tokens"))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def committed(self) -> list[str]:
        """Ids of the batches that count; a row per batch."""
        marks = self._read(f"{self.folder}/marks/*")
        return sorted(r["batch"] for r in marks.distinct().collect()) if marks else []

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False, and no change, if its id is committed already."""
        if not batch.replace("-", "").isalnum():
            raise ValueError(f"not usable as a batch id: {batch!r}")
        if self._read(f"{self.folder}/marks/{batch}") is not None:
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"),
                                          F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/{batch}")
        mark = self.spark.range(1).select(F.lit(batch).alias("batch"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{batch}")
        return True

    def totals(self) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(
            *(f"{self.folder}/sums/{batch}" for batch in done))
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"),
                                       F.sum("tokens").alias("tokens"))
