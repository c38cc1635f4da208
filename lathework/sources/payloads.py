"""Change sets as the code hosts deliver them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_rows(payloads: DataFrame, key: str, pages: str) -> DataFrame:
    """Rows of a paginated array column, with their place; null pages give none."""
    return payloads.select(key, F.posexplode(pages).alias("pos0", "item")).select(key, (F.col("pos0") + 1).alias("nth"), "item.*")


def change_status(new_file: Column, deleted_file: Column, renamed_file: Column) -> Column:
    """A status from the three flags of a merge request."""
    return F.when(new_file, "added").when(deleted_file, "removed").when(renamed_file, "renamed").otherwise("modified")


def counted_lines(diff: Column, sign: str) -> Column:
    """Lines that begin with the sign, as a host counts them: those after a line end, headers of files taken off, never below 0.

    A sign on the first line has no line end before it and does not count.
    """
    mark = "\\" + sign
    return F.greatest(F.regexp_count(diff, F.lit(f"\n{mark}")) - F.regexp_count(diff, F.lit(f"\n{mark}{mark}{mark}")), F.lit(0))


def with_patches(stats: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Changed files with their patch, empty where there is none: ``stats`` has ``key, filename``, ``patches`` has ``key, path, patch``."""
    return stats.join(patches.withColumnRenamed("path", "filename"), [key, "filename"], "left").withColumn("patch", F.coalesce("patch", F.lit("")))


def assembled(files: DataFrame, keys: list[str]) -> DataFrame:
    """One diff per group from its files with a non-empty patch, each under its header, in order."""
    part = F.concat(F.lit("diff --git a/"), F.col("filename"), F.lit(" b/"), F.col("filename"), F.lit("\n"), F.col("patch"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "file_id", part.alias("part")))), lambda x: x["part"]), "\n")
    return files.filter("patch <> ''").groupBy(*keys).agg(ordered.alias("diff"))


def parsed_numstat(lines: DataFrame, column: str) -> DataFrame:
    """``additions, deletions, filename`` of numstat lines; a dash is 0, lines without exactly three fields are left out."""
    fields = F.split(column, "\t")
    number = lambda i: F.when(fields[i] == "-", 0).otherwise(fields[i].try_cast("int"))
    return lines.filter(F.size(fields) == 3).select(*[c for c in lines.columns if c != column], number(0).alias("additions"), number(1).alias("deletions"), fields[2].alias("filename"))


#: What a walk over a repository leaves out.
SKIPPED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "vendor", "target"]
MOST_BYTES = 1_000_000


def repository_files(spark, root: str, suffixes: dict[str, str]) -> DataFrame:
    """``path, language, text`` of the source files below a folder: known suffixes, no skipped folder, at most a million bytes.

    Size and path are tested on the listing, before a file is read; bytes that
    are no UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    skipped = "|".join(d.replace(".", "\\.") for d in SKIPPED_DIRS)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv]), suffix)
    kept = files.filter((F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(f"/(?:{skipped})/")).withColumn("language", language).filter("language IS NOT NULL")
    return kept.select("path", "language", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def golden_set(reviews: DataFrame, comments: DataFrame, diffs: DataFrame, most: int = 50_000) -> DataFrame:
    """``review_id, comments, diff`` of reviews with at least one comment by a person; diffs cut to ``most`` characters."""
    people = comments.filter(~F.coalesce(F.col("author").endswith("[bot]"), F.lit(False)) & (F.col("text") != "")).groupBy("repo_full_name", "pr_number").agg(F.count(F.lit(1)).alias("comments"))
    return reviews.join(people, ["repo_full_name", "pr_number"]).join(diffs, "review_id").select("review_id", "comments", F.substring("pr_diff", 1, most).alias("diff"))
