"""Unified diffs as line tables.

A patch is one row; its lines are exploded once and numbered by windows over the
file.  Files come deduplicated by ``file_id``, which hash partitions them on it,
and every window below is partitioned by a key that starts with ``file_id``, so
no further shuffle follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A hunk header and the first line of the new side.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)"

#: The order in which statuses come in a combined diff.
STATUS_ORDER = ["modified", "added", "renamed", "removed"]

#: Marks in a summary of changed files.
STATUS_MARK = {"added": "[NEW]", "modified": "[MOD]", "removed": "[DEL]", "renamed": "[REN]"}

#: Language of an extension in diff statistics.
EXTENSION_LANGUAGE = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".go": "Go", ".java": "Java", ".sql": "SQL", ".css": "CSS", ".sh": "Shell", ".md": "Markdown"}

FILE = ["file_id", "repo_full_name", "pr_number", "head_sha", "file_ord", "filename", "status"]


def distinct_files(pr_files: DataFrame) -> DataFrame:
    """One row per ``file_id``; rows that occur twice are equal."""
    return pr_files.dropDuplicates(["file_id"])


def raw_lines(files: DataFrame, keys: list[str], text: str = "patch") -> DataFrame:
    """``keys, pos, line`` with pos from 1; null and empty texts have no lines."""
    return files.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, F.posexplode(F.split(text, "\n")).alias("pos0", "line")).select(
        *keys, (F.col("pos0") + 1).alias("pos"), "line"
    )


def _kind(line: Column) -> Column:
    return (
        F.when(line.rlike(HUNK), "hunk")
        .when(line.startswith("+") & ~line.startswith("+++"), "added")
        .when(line.startswith("-") & ~line.startswith("---"), "removed")
        .when(line.startswith("\\"), "note")
        .otherwise("context")
    )


def new_side(files: DataFrame) -> DataFrame:
    """Lines of the new side: ``line_no, text, position, kind, first_position``.

    Added and context lines count, headers before the first hunk too (numbered
    from 0), removed lines and notes do not; of lines with the same number the
    last one stays.  ``position`` counts the lines of the patch from 1, hunk
    headers included; ``first_position`` is where the number occurred first.
    """
    kinds = raw_lines(files, FILE).withColumn("kind", _kind(F.col("line")))
    by_file = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_hunk = F.col("kind") == "hunk"
    start = F.when(is_hunk, F.regexp_extract("line", HUNK, 1).cast("int"))
    counted = kinds.withColumns({"upto": F.sum(F.when(F.col("kind").isin("added", "context"), 1).otherwise(0)).over(by_file), "start": F.last(start, ignorenulls=True).over(by_file)})
    before = F.coalesce(F.last(F.when(is_hunk, F.col("upto")), ignorenulls=True).over(by_file), F.lit(0))
    numbered = counted.withColumn("line_no", (F.coalesce("start", F.lit(0)) + F.col("upto") - before - 1).cast("int"))
    text = F.when((F.col("kind") == "added") | F.col("line").startswith(" "), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    shown = numbered.filter("kind IN ('added', 'context')").select(*FILE, "line_no", text.alias("text"), F.col("pos").alias("position"), "kind")
    same = Window.partitionBy("file_id", "line_no").orderBy(F.desc("position"))
    return (
        shown.withColumn("first_position", F.min("position").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("newest", F.row_number().over(same))
        .filter("newest = 1")
        .drop("newest")
    )


def both_sides(files: DataFrame) -> DataFrame:
    """Removed and added lines with numbers of their own side: ``side, line_no, text``.

    Numbers start one below the hunk's and are raised before use; every line that
    is neither added nor removed, notes included, raises both.
    """
    lines = raw_lines(files, FILE)
    line = F.col("line")
    kind = (
        F.when(line.startswith("@@"), "hunk")
        .when(line.startswith("-") & ~line.startswith("---"), "removed")
        .when(line.startswith("+") & ~line.startswith("+++"), "added")
        .otherwise("other")
    )
    by_file = Window.partitionBy("file_id").orderBy("pos")
    hunks = lines.withColumn("kind", kind).withColumn("hunk", F.sum(F.when(F.col("kind") == "hunk", 1).otherwise(0)).over(by_file))
    in_hunk = Window.partitionBy("file_id", "hunk")
    header = lambda pattern: F.coalesce(F.max(F.when(F.col("kind") == "hunk", F.regexp_extract("line", pattern, 1).try_cast("int"))).over(in_hunk) - 1, F.lit(0))
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0)).over(in_hunk.orderBy("pos"))
    numbered = hunks.withColumns(
        {"old_no": header(r"@@ -(\d+)") + count("removed", "other"), "new_no": header(r"\+(\d+)") + count("added", "other")}
    )
    sides = numbered.filter("kind IN ('removed', 'added')").select(
        *FILE, F.col("kind").alias("side"), F.when(F.col("kind") == "removed", F.col("old_no")).otherwise(F.col("new_no")).cast("int").alias("line_no"), F.expr("substring(line, 2)").alias("text"), "pos"
    )
    newest = Window.partitionBy("file_id", "side", "line_no").orderBy(F.desc("pos"))
    return sides.withColumn("newest", F.row_number().over(newest)).filter("newest = 1").drop("newest")


def split_files(diffs: DataFrame, key: str, text: str, from_hunk: bool = False) -> DataFrame:
    """A multi-file diff cut at its file headers: ``key, path, patch``.

    The path is what follows the first `` b/`` of the header; a later block of the
    same path replaces an earlier one.  With ``from_hunk`` a block starts at its
    first hunk and blocks without hunk are left out; otherwise the header is kept.
    """
    lines = raw_lines(diffs, [key], text)
    header = F.col("line").startswith("diff --git")
    by_diff = Window.partitionBy(key).orderBy("pos")
    blocks = lines.withColumn("block", F.sum(F.when(header, 1).otherwise(0)).over(by_diff)).filter("block > 0")
    in_block = Window.partitionBy(key, "block")
    path = F.max(F.when(header & F.contains("line", F.lit(" b/")), F.regexp_extract("line", r"(?s)^.*? b/(.*)$", 1))).over(in_block)
    named = blocks.withColumn("path", path).filter("path IS NOT NULL AND path <> ''")
    if from_hunk:
        seen = F.max(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(in_block.orderBy("pos"))
        named = named.filter(~header).withColumn("seen", seen).filter("seen = 1")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    texts = named.groupBy(key, "path", "block").agg(joined.alias("patch"))
    last = Window.partitionBy(key, "path").orderBy(F.desc("block"))
    return texts.withColumn("newest", F.row_number().over(last)).filter("newest = 1").select(key, "path", "patch")


def added_identifiers(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, identifier``: what added lines define, each once per diff."""
    added = raw_lines(diffs, [key], text).filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    python = F.regexp_extract("line", r"^\+\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)
    script = F.regexp_extract("line", r"^\+\s*(?:export\s+)?(?:function|const|let|var)\s+(\w+)", 1)
    return added.select(key, F.explode(F.array(python, script)).alias("identifier")).filter("identifier <> ''").distinct()


PR = ["repo_full_name", "pr_number", "head_sha"]


def combined_diff(files: DataFrame, max_size: int = 30_000, least_rest: int = 200) -> DataFrame:
    """One text per pull request: patches by status and order, up to ``max_size`` characters.

    The counter takes the parts' own lengths; the part that does not fit is cut
    when more than ``least_rest`` characters are left, and a last line says how
    many files are missing.  A null patch counts as empty.
    """
    status = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), F.lit(0))
    rank = F.when(status == 0, len(STATUS_ORDER)).otherwise(status - 1)
    part = F.concat(F.lit("--- a/"), F.col("filename"), F.lit("\n+++ b/"), F.col("filename"), F.lit("\n"), F.coalesce("patch", F.lit("")))
    parts = files.select(*PR, "file_ord", "file_id", rank.alias("rank"), part.alias("part"))
    order = Window.partitionBy(*PR).orderBy("rank", "file_ord", "file_id")
    sized = parts.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= max_size
    first_over = F.min(F.when(~fits, F.col("nth"))).over(Window.partitionBy(*PR))
    rest = F.lit(max_size) - (F.col("upto") - F.length("part"))
    kept = sized.withColumn("over", first_over).withColumn(
        "shown", F.when(fits, F.col("part")).when((F.col("nth") == F.col("over")) & (rest > least_rest), F.concat(F.expr(f"left(part, {max_size} - int(upto - length(part)))"), F.lit("\n... (truncated)")))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("nth", "shown")))), lambda x: x["shown"]), "\n\n")
    texts = kept.groupBy(*PR).agg(joined.alias("text"), F.count("shown").alias("n_parts"), F.count(F.lit(1)).alias("n_files"), F.max("over").isNotNull().alias("cut"))
    more = F.concat(F.when(F.col("n_parts") > 0, "\n\n").otherwise(""), F.lit("\n... and "), (F.col("n_files") - F.col("n_parts")).cast("string"), F.lit(" more files (truncated due to size)"))
    return texts.select(*PR, F.when(F.col("cut"), F.concat("text", more)).otherwise(F.col("text")).alias("text"), "n_parts")


def files_summary(files: DataFrame) -> DataFrame:
    """One line per changed file, in order, per pull request."""
    mark = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_MARK.items() for x in kv]), F.col("status")), F.lit("[FILE]"))
    line = F.concat(F.lit("- "), mark, F.lit(" `"), F.col("filename"), F.lit("` (+"), F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(")"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "file_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return files.groupBy(*PR).agg(ordered.alias("summary"))


def diff_stats(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals per pull request over ``kept``, the number of all ``files``, and the languages as a sorted list."""
    extension = F.lower(F.when(F.contains("filename", F.lit(".")), F.concat(F.lit("."), F.substring_index("filename", ".", -1))))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv]), extension)
    of_kept = kept.groupBy(*PR).agg(
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("kept_files"), F.array_join(F.sort_array(F.collect_set(language)), ",").alias("languages")
    )
    everything = files.groupBy(*PR).agg(F.count(F.lit(1)).alias("total_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return everything.join(of_kept, PR, "left").select(
        *PR, "total_files", zero("kept_files"), zero("additions"), zero("deletions"), F.coalesce("languages", F.lit("")).alias("languages"), (F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0)) > 500).alias("is_large")
    )
