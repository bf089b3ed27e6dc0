"""The registered queries of this folder; SQL counterparts are in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import stage, stage_path

from . import arc_convert, bwt_repeats, decontaminate, embedding_dedup, html_blocks
from . import line_frequency, merkle_manifest, packing, pseudonyms, size_aware_join
from . import token_alignment, token_rollup, url_lists
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: For the queries only: whoever runs the operator on real documents passes a secret key.
QUERY_KEY = b"key of the registered queries"


def op1_block_lstm(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(table(spark, folder, "pages"))


def op2_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with pseudonyms in place of personal data."""
    return pseudonyms.pseudonymise(table(spark, folder, "documents"), QUERY_KEY)


def op3_size_aware_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets overlap by 90 %."""
    return size_aware_join.join_classes(table(spark, folder, "documents"))


def op4_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a legacy archive record, converted, written and read back."""
    pages = table(spark, folder, "pages").withColumn(
        "fetch_date", F.date_format(F.timestamp_seconds(
            F.lit(1_104_537_600) + F.coalesce("page_id", F.lit(0))), "yyyyMMddHHmmss"))
    back = arc_convert.read_back(arc_convert.convert(arc_convert.to_arc(pages)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    packed = packing.pack_documents(table(spark, folder, "documents"), vocabulary(),
                                    with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                         "offset")


def op6_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, and whether base rules and line frequency let it stay."""
    return line_frequency.judge(table(spark, folder, "documents")).drop("text")


def op7_temporal_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against lists whose entries are dated; days and entries come from the rows."""
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.date_add(
        F.lit("2024-01-01"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("day"))
    host = url_lists.host_of(F.col("url"))
    names = pages.select(F.explode(F.array(
        host, F.regexp_replace(host, r"^[^.]+\.", ""))).alias("pattern"))
    names = names.where("pattern is not null").groupBy("pattern").agg(F.lit(1).alias("one"))
    # Two entries in each of two lists: the days and the choice follow from the name's digest.
    pick = [F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1 + 4 * k, 4), 16, 10)
            .cast("int") for k in range(6)]
    entry = [F.struct(F.lit(c).alias("category"), F.date_add(
        F.lit("2023-10-01"), F.pmod(pick[k], F.lit(450))).alias("day"), F.lit(a).alias("action"),
        (F.pmod(pick[4 + (c == "spam")], F.lit(8)) < 3).alias("used"))
        for k, (c, a) in enumerate((("adult", "add"), ("adult", "remove"), ("spam", "add"),
                                    ("spam", "remove")))]
    entries = (names.select("pattern", F.explode(F.array(*entry)).alias("e"))
               .where("e.used").select("pattern", "e.category", "e.day", "e.action"))
    return url_lists.judge_captures(captures, entries)


def op8_cgk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item found in it within a fifth of its words."""
    return decontaminate.contaminated(table(spark, folder, "documents"),
                                      table(spark, folder, "benchmark"))


def op9_bwt_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes under 50-byte strings of an earlier document."""
    return bwt_repeats.digests(bwt_repeats.remove_repeats(table(spark, folder, "documents")))


def op10_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after: all documents in, copies out, the rest counted by another tokenizer, and
    two of these batches sent again."""
    docs = table(spark, folder, "documents")
    counts = stage(token_rollup.token_counts(
        docs, {"words-1": "", "word-bpe-49k-1": vocabulary()}), "counts")
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = (counts.join(first.where("n > 2"), "digest")  # two rows a document
              .where("doc_id > first").select(*counts.columns))
    kept = counts.join(copies.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_anti")
    old, new = F.col("tokenizer") == "words-1", F.col("tokenizer") == "word-bpe-49k-1"
    insert = token_rollup.signed(counts.where(old), 1)
    delete = token_rollup.signed(copies.where(old), -1)
    revise = token_rollup.signed(kept.where(old), -1).unionByName(
        token_rollup.signed(kept.where(new), 1))
    rollup = token_rollup.Rollup(spark, stage_path(spark, "rollup"))
    for batch, changes in (("1-insert", insert), ("2-delete", delete), ("1-insert", insert),
                           ("3-revise", revise), ("2-delete", delete)):
        rollup.commit(batch, changes)
    return rollup.totals()


def op11_merkle_descent(spark: SparkSession, folder: str) -> DataFrame:
    """Every document proven by descent of the manifest, tampered ones found out."""
    return merkle_manifest.audit(merkle_manifest.build(table(spark, folder, "documents")))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents, weighed by the corpus."""
    return token_alignment.align_documents(
        table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"),
        vocabulary("piece_bpe_32k.model")).drop("pairs", "times")


def op13_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.9 or more."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_block_lstm, op2_feistel_pseudonyms, op3_size_aware_join, op4_arc_to_warc, op5_best_two_fit, op6_line_frequency, op7_temporal_lists,
    op8_cgk_decontamination, op9_bwt_repeats, op10_token_rollup, op11_merkle_descent,
    op12_token_alignment, op13_cross_polytope)}
