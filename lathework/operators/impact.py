"""Joins between change sets, packages, owners and threads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.globs import matches_owner_rule, path_regex
from lathework.operators.diff import PR
from lathework.plans.lineage import cut


def overlapping_changes(current: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the current pull requests that other ones of the repository change too, with the volume of both changes."""
    mine = current.select("repo_full_name", "filename", F.col("pr_number").alias("pr_a"), (F.col("additions") + F.col("deletions")).alias("changes_a"))
    other = files.select("repo_full_name", "filename", F.col("pr_number").alias("pr_b"), (F.col("additions") + F.col("deletions")).alias("changes_b"))
    volume = F.col("changes_a") + F.col("changes_b")
    risk = F.when(volume > 100, "high").when(volume > 30, "medium").otherwise("low")
    grouped = mine.join(other, ["repo_full_name", "filename"]).filter("pr_a <> pr_b").groupBy("repo_full_name", "filename", "pr_a", "pr_b")
    return grouped.agg(F.max("changes_a").alias("changes_a"), F.max("changes_b").alias("changes_b")).withColumn("volume", volume).withColumn("risk", risk).drop("changes_a", "changes_b")


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Each file with the first package whose path is a directory above it; null when none is.

    ``packages``: ``ord, package, path``, a configuration table.  Every directory
    above a file is looked up by equality, which also serves long package lists.
    """
    parts = F.split("filename", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    tried = files.select("file_id", F.explode(above).alias("path"))
    found = tried.join(packages, "path").groupBy("file_id").agg(F.min_by("package", "ord").alias("package"))
    return files.select("file_id").join(found, "file_id", "left")


def reachable(edges: DataFrame) -> DataFrame:
    """``start, node`` for every node that can be reached over ``src, dst``, the start excluded; cycles are fine.

    Semi-naive until nothing is found any more: what the last round found is
    extended by all that is known, so that reach doubles and a path of n steps
    needs about log n rounds, each written to the shared folder.
    """
    known = cut(edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).filter("start <> node").distinct())
    fresh = known
    while True:
        on = known.select(F.col("start").alias("mid"), F.col("node").alias("dst"))
        last = fresh.select(F.col("start").alias("mid"), F.col("node").alias("dst"))
        longer = fresh.join(on.withColumnRenamed("mid", "node"), "node").select("start", "dst").unionAll(known.join(last.withColumnRenamed("mid", "node"), "node").select("start", "dst"))
        fresh = cut(longer.filter("start <> dst").withColumnRenamed("dst", "node").distinct().join(known, ["start", "node"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionAll(fresh))


def glob_impacts(files: DataFrame, dependencies: Sequence[tuple[str, str]]) -> DataFrame:
    """Dependent repositories and the patterns and files that touch them; ``dependencies`` is configuration of (repository, pattern)."""
    hits = [F.when(F.col("filename").rlike(path_regex(p)), F.struct(F.lit(r).alias("dependent"), F.lit(p).alias("pattern"))) for r, p in dependencies]
    touched = files.select(*PR, "filename", F.explode(F.array_compact(F.array(*hits))).alias("d")).select(*PR, "filename", "d.*")
    return touched.groupBy(*PR, "dependent").agg(F.array_join(F.sort_array(F.collect_set("pattern")), ",").alias("patterns"), F.count_distinct("filename").alias("files"))


def parse_owners(lines: DataFrame) -> DataFrame:
    """``ord, pattern, owners`` of an ownership file given as ``ord, line``: comments, blanks and rules without owner are left out."""
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != "")
    owners = F.transform(F.filter(F.slice(words, 2, 1000), lambda w: w.startswith("@") | w.contains("/")), lambda w: F.regexp_replace(w, "^@+", ""))
    return lines.filter("trim(line) <> '' AND NOT trim(line) LIKE '#%'").select("ord", words[0].alias("pattern"), owners.alias("owners")).filter("size(owners) > 0")


def owner_scores(files: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], most: int = 5) -> DataFrame:
    """Reviewers per pull request by ownership: the last matching rule of a file gives its owners 10 points.

    An owner of files below a top directory gets 3 more per file of that
    directory; at most ``most`` per pull request, ties by name, scores up to 100.
    """
    rule = F.lit(None)
    for pattern, owners in rules:
        rule = F.when(matches_owner_rule(F.col("filename"), pattern), F.array(*map(F.lit, owners))).otherwise(rule)
    owned = files.select(*PR, "filename", F.when(F.contains("filename", F.lit("/")), F.substring_index("filename", "/", 1)).alias("top"), rule.alias("owners"))
    by_rule = owned.select(*PR, "filename", "top", F.explode("owners").alias("owner"))
    direct = by_rule.groupBy(*PR, "owner").agg((F.count(F.lit(1)) * 10).alias("points"))
    tops = by_rule.filter("top IS NOT NULL").select(*PR, "owner", "top").distinct()
    sizes = owned.filter("top IS NOT NULL").groupBy(*PR, "top").agg(F.count(F.lit(1)).alias("n"))
    known = tops.join(sizes, [*PR, "top"]).groupBy(*PR, "owner").agg((F.sum("n") * 3).alias("points"))
    scores = direct.unionByName(known).groupBy(*PR, "owner").agg(F.least(F.sum("points"), F.lit(100)).alias("score"), F.sum("points").alias("raw"))
    order = Window.partitionBy(*PR).orderBy(F.desc("raw"), "owner")
    return scores.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select(*PR, "owner", "score")


#: Words by which a reply disagrees, found anywhere in it.
DISAGREES = r"(?i)(?:disagree|false positive|not an issue|won't fix|wontfix|intentional|by design|nit|incorrect|wrong)"


def reply_outcomes(messages: DataFrame) -> DataFrame:
    """Per thread: number of messages, whether one disagrees, and the id of the last one."""
    return messages.groupBy("repo_full_name", "pr_number").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("text").rlike(DISAGREES), F.lit(False))).alias("disagrees"), F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("last_doc")
    )


def comment_overlaps(comments: DataFrame, lines: int = 3, similarity: float = 0.3) -> DataFrame:
    """Pairs of comments on one path at most ``lines`` apart whose words are similar: ``key, a, b``.

    Lines are put in bands of ``lines + 1``; a comment is compared with its own
    and the next band, so a path with many comments does not compare all.
    """
    width = lines + 1
    words = F.array_distinct(F.filter(F.split(F.lower("body"), r"\s+"), lambda w: w != ""))
    ready = comments.select("key", "comment_id", "line", words.alias("words"), F.floor(F.col("line") / width).alias("band"))
    left = ready.select("key", F.col("comment_id").alias("a"), F.col("line").alias("la"), F.col("words").alias("wa"), "band")
    right = ready.select("key", F.col("comment_id").alias("b"), F.col("line").alias("lb"), F.col("words").alias("wb"), F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") + 1)).alias("band"))
    both = F.size(F.array_intersect("wa", "wb"))
    union = F.size(F.array_union("wa", "wb"))
    return left.join(right, ["key", "band"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= lines) & (both > similarity * F.greatest(union, F.lit(1)))).select("key", "a", "b").distinct()


#: Severities from the worst on; any other is milder.
SEVERITIES = ("critical", "warning", "suggestion", "info")


def first_fit(overlaps: DataFrame, comments: DataFrame) -> DataFrame:
    """``key, comment_id, first_id``: the group each comment joins when comments are taken in the order of their ids.

    A comment joins the earliest group that has a member it overlaps with, else
    it founds one; a group is known by its founder.  Hence the founder is the
    least comment that can be reached over earlier and earlier overlaps, which is
    found in rounds, each of which also follows what was found before, so that
    long chains need few; no group is gathered in a task.
    """
    steps = cut(overlaps.select("key", F.col("b").alias("later"), F.col("a").alias("earlier")).distinct())
    known = cut(comments.select("key", "comment_id").distinct().withColumn("first_id", F.col("comment_id")))
    while True:
        least = known.select("key", F.col("comment_id").alias("earlier"), F.col("first_id").alias("via"))
        near = steps.join(least, ["key", "earlier"]).select("key", F.col("later").alias("comment_id"), "via")
        far = known.join(least.withColumnRenamed("earlier", "first_id"), ["key", "first_id"]).select("key", "comment_id", "via")
        best = near.unionAll(far).groupBy("key", "comment_id").agg(F.min("via").alias("via"))
        after = known.join(best, ["key", "comment_id"], "left").select("key", "comment_id", F.least("first_id", "via").alias("first_id"), (F.col("via") < F.col("first_id")).alias("moved"))
        after = cut(after)
        moved = after.filter("moved").limit(1).count()
        known = after.drop("moved")
        if not moved:
            return known


def merge_comments(comments: DataFrame, lines: int = 3, similarity: float = 0.3, models: int = 2, least: int = 2) -> DataFrame:
    """Comments of several models, merged: ``key, first_id, members, comment_id, severity, confidence, in_majority, in_all``.

    ``comments``: ``key, comment_id`` (in input order) ``, line, body, severity``.
    A group keeps its longest body (``comment_id``, the earlier of equal ones)
    and its worst severity, the earlier of equal ones.  Confidence is the number
    of members for each of the ``models``; in_majority says whether ``least``
    comments agree, in_all whether as many as there are models: what the
    strategies majority and intersection keep, while union keeps every group.
    """
    groups = first_fit(comment_overlaps(comments, lines, similarity), comments)
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.coalesce("severity", F.lit("")))
    rank = F.when(place > 0, place).otherwise(len(SEVERITIES) + 1)
    rows = comments.select("key", "comment_id", "severity", F.coalesce(F.length("body"), F.lit(0)).alias("size"), rank.alias("rank"))
    merged = rows.join(groups, ["key", "comment_id"]).groupBy("key", "first_id").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("comment_id", F.struct(-F.col("size"), F.col("comment_id"))).alias("comment_id"), F.min_by("severity", F.struct("rank", "comment_id")).alias("severity")
    )
    return merged.select("*", F.round(F.col("members") / models, 6).alias("confidence"), (F.col("members") >= least).alias("in_majority"), (F.col("members") >= models).alias("in_all"))
