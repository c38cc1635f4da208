"""Registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.bpe import count_tokens, decode_ids, encode_texts
from lathework.llm.packing import Capacity, fill_contexts
from lathework.llm.provenance import verdicts
from lathework.llm.quality import judged
from lathework.llm.secrets import find_credentials, redact_credentials
from lathework.llm.splitting import cut_items, review_items
from lathework.plans.spread import spread
from lathework.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _pieces(spark: SparkSession, directory: str, with_text: bool) -> DataFrame:
    chunks = table(spark, directory, "chunks").select("id", "chunk_type", "file_path", "start_line", "content")
    states = table(spark, directory, "review_state").select("review_id", "pr_diff")
    return cut_items(review_items(chunks, states), table(spark, directory, "size_limits"), with_text)


@query(
    "p2_found",
    """SELECT DISTINCT 'chunk' AS item_kind, id AS item_id FROM chunks
         LEFT JOIN size_limits s ON s.item_kind = chunk_type AND s.unit = 'chars'
         WHERE length(content) > coalesce(s.max_size, (SELECT max_size FROM size_limits WHERE item_kind = 'default'))
       UNION ALL
       SELECT DISTINCT 'pr_diff', review_id FROM review_state WHERE length(pr_diff) > (SELECT max_size FROM size_limits WHERE item_kind = 'pr_diff')""",
)
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Items that had to be cut: those with a second piece."""
    return _pieces(spark, directory, with_text=False).filter("piece_no = 1").select("item_kind", "item_id")


@query("p2_pieces")
def p2_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of all oversized chunks and diffs."""
    return _pieces(spark, directory, with_text=True)


@query("p6_ids")
def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(spread(table(spark, directory, "documents").select("doc_id", "text")))


@query("p6_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """The texts that the ids of p6_ids decode to."""
    return decode_ids(p6_ids(spark, directory))


#: Kinds of text that answer something, whose tokens bear loss in instruction data; the others are what is answered.
ANSWERS = ("chat_reply", "issue_comment", "review_comment", "review_summary", "commit_message")


@query("p7_contexts")
def p7_contexts(spark: SparkSession, directory: str) -> DataFrame:
    """A context for every document: at most its size in tokens, 64 segments, and three quarters of its tokens bearing loss."""
    documents = table(spark, directory, "documents").select("doc_id", "text", "source")
    sized = count_tokens(spread(documents), keep=["source"])
    # one row of a table of fixed size
    size = table(spark, directory, "size_limits").filter("item_kind = 'context_window' AND unit = 'tokens'").select("max_size").first().max_size
    return fill_contexts(sized, Capacity(tokens=size, segments=64, loss_tokens=size * 3 // 4), bears_loss=F.col("source").isin(*ANSWERS))


def _judged(spark: SparkSession, directory: str) -> DataFrame:
    documents = spread(table(spark, directory, "documents").select("doc_id", "lang", "text"))
    return judged(documents, table(spark, directory, "common_words"))


@query("p8_found")
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that are not prose."""
    return _judged(spark, directory).filter(~F.col("is_prose")).select("doc_id")


@query("p8_statistics")
def p8_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """Statistics, outlier score and verdict of every document."""
    return _judged(spark, directory)


def _patches(spark: SparkSession, directory: str) -> DataFrame:
    files = spread(table(spark, directory, "pr_files").select("file_id", "patch"))
    samples = spread(table(spark, directory, "samples").select("sample_id", "diff"))
    return files.select(F.lit("pr_files").alias("table_name"), F.col("file_id").alias("row_id"), F.col("patch").alias("text")).unionAll(
        samples.select(F.lit("samples"), "sample_id", "diff")
    )


@query("p3_found")
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Lines on which the value of a credential begins."""
    return find_credentials(_patches(spark, directory))


@query("p3_redacted")
def p3_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """Every patch and diff with its credential values masked."""
    return redact_credentials(_patches(spark, directory))


def _files(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "pr_files")


@query("p5_found")
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Files nobody wrote by hand in this project."""
    files = spread(_files(spark, directory).select("file_id", "repo_full_name", "filename", "patch"))
    return verdicts(files).filter("verdict > 0").select("file_id")


@query("p5_kept")
def p5_kept(spark: SparkSession, directory: str) -> DataFrame:
    """pr_files without them; every row of a file that stays."""
    files = _files(spark, directory)
    foreign = verdicts(spread(files.select("file_id", "repo_full_name", "filename", "patch"))).filter("verdict > 0").select("file_id")
    return files.join(foreign, "file_id", "left_anti")
