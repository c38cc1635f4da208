"""Search over indexed chunks and vectors, rank fusion, and incremental indexing."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that meet in one task at most, about: the sides of a tile.
ROWS_OF_TILE, QUERIES_OF_TILE = 262_144, 4096


def _best(rows: pa.Table, asked: pa.Table, most: int) -> pa.Table:
    """The ``most`` nearest of ``rows`` for each of ``asked``."""

    def matrix(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
        held = [(i, v) for i, v in zip(table.column(key).to_pylist(), table.column("embedding").to_pylist()) if v and i is not None]
        if not held:
            return np.empty(0, np.int64), np.empty((0, 0))
        data = np.nan_to_num(np.array([v for _, v in held], np.float64))
        size = np.linalg.norm(data, axis=1)
        usable = size > 0
        return np.array([i for i, _ in held], np.int64)[usable], data[usable] / size[usable][:, None]

    names, questions = matrix(asked, "query_id")
    ids, data = matrix(rows, "vec_id")
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // max(len(ids), 1))
    for i in range(0, len(names) if len(ids) else 0, step):
        scores = np.round(questions[i : i + step] @ data.T, 6)
        # a stable sort of scores over rising ids settles ties by id
        best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        found.append((np.repeat(names[i : i + step], best.shape[1]), ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel()))
    columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(3)]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """``query_id, vec_id, score, nth``: the ``most`` rows of largest cosine similarity for each query, ties by id.

    ``vectors``: ``vec_id, embedding``; ``queries``: ``query_id, embedding``.  The
    search is exact.  Both sides are cut into shards by a hash of their id, and
    every shard of rows meets every shard of queries in a tile, a task of its own
    with bounded sides; a tile keeps ``most`` rows per query, so what is ranked
    at last is small.  Null vectors, those of length 0 and rows without id match
    nothing; an id that occurs twice is two rows; a null number in a vector counts
    as 0.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_rows, n_queries = vectors.count(), queries.count()
    row_shards = max(1, -(-n_rows // ROWS_OF_TILE), min(cores, -(-n_rows // QUERIES_OF_TILE)))
    query_shards = max(1, -(-n_queries // QUERIES_OF_TILE))

    def placed(side: DataFrame, key: str, own: str, shards: int, other: str, times: int) -> DataFrame:
        return side.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    rows = placed(vectors, "vec_id", "r", row_shards, "q", query_shards).groupBy("r", "q")
    asked = placed(queries, "query_id", "q", query_shards, "r", row_shards).groupBy("r", "q")
    found = rows.cogroup(asked).applyInArrow(lambda left, right: _best(left, right, most), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def trigrams(column: Column) -> Column:
    """Distinct trigrams of a name: words in lower case, two blanks before and one after each."""
    words = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams among all."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def named_chunks(chunks: DataFrame, names: Sequence[str], most: int = 5, least: float = 0.3) -> DataFrame:
    """``name, id, score, nth`` of the chunks whose identifier is similar to a name or whose content has it; names are a query of a few words."""
    own = chunks.select("id", "content", "identifier", trigrams(F.coalesce("identifier", F.lit(""))).alias("own"))
    hits = []
    for name in names:
        score = F.round(similarity(F.col("own"), trigrams(F.lit(name))), 6)
        hits.append(F.when((score > least) | F.lower("content").contains(name.lower()), F.struct(F.lit(name).alias("name"), score.alias("score"))))
    found = own.select("id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.name", "id", "h.score").distinct()
    order = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def neighbourhood(chunks: DataFrame, paths: Sequence[str], most: int = 30) -> DataFrame:
    """``id, nth``: chunks of the given files or of their directories, by path and line; at most ``most``."""
    folders = sorted({p.rpartition("/")[0] for p in paths if "/" in p})[:10]
    test = F.col("file_path").isin(*paths[:20])
    for folder in folders:
        test = test | F.col("file_path").startswith(folder + "/")
    ordered = chunks.filter(test).select("id", "file_path", "start_line").distinct().orderBy("file_path", "start_line", "id").limit(most)
    return ordered.withColumn("nth", F.row_number().over(Window.orderBy("file_path", "start_line", "id"))).select("id", "nth")


def fused(arms: Sequence[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``keys, nth`` from 1): the sum of 1 / (k + nth)."""
    union = arms[0].select(*keys, "nth")
    for arm in arms[1:]:
        union = union.unionAll(arm.select(*keys, "nth"))
    return union.groupBy(*keys).agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("nth"))), 9).alias("score"))


def best_chunks(chunks: DataFrame, scores: DataFrame, most: int = 20) -> DataFrame:
    """``id, nth``: the chunks with the largest score of their vector; ``chunks``: ``id, vec_id``; ``scores``: ``vec_id, score``, a few rows."""
    ordered = chunks.join(F.broadcast(scores), "vec_id").select("id", "score").distinct().orderBy(F.desc("score"), "id").limit(most)
    return ordered.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "nth")


def fetched(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of a short list of ``id, score``, once each, with their place ``nth`` in it."""
    ranked = best.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return chunks.join(F.broadcast(ranked), "id").dropDuplicates(["id"])


def file_texts(chunks: DataFrame) -> DataFrame:
    """Files put together again from their chunks in line order: ``repository_id, file_path, text, lines``."""
    rows = chunks.select("repository_id", "file_path", "start_line", "id", "content").dropDuplicates(["id"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "content"))), lambda x: x["content"])
    return rows.groupBy("repository_id", "file_path").agg(F.array_join(ordered, "\n").alias("text")).withColumn("lines", F.size(F.split("text", "\n")))


def section_chunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown sections: ``key, start_line, end_line, identifier, level, content``.

    A section runs from a heading of level 1 to 3 to the line before the next;
    what comes before the first heading has no identifier; sections that are
    blank are left out and contents are stripped.
    """
    heading = r"(?d)^(#{1,3})\s+(.+)$"
    lines = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos0", "line"))
    is_head = F.col("line").rlike(heading)
    by_text = Window.partitionBy(key).orderBy("pos0")
    blocks = lines.withColumn("section", F.sum(F.when(is_head, 1).otherwise(0)).over(by_text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos0", "line"))), lambda x: x["line"]), "\n")
    grouped = blocks.groupBy(key, "section").agg(F.regexp_replace(joined, r"^\s+|\s+$", "").alias("content"), (F.min("pos0") + 1).alias("start_line"), (F.max("pos0") + 1).alias("end_line"), F.min_by("line", "pos0").alias("head"))
    name = F.when(F.col("section") > 0, F.regexp_replace(F.regexp_extract("head", heading, 2), r"^\s+|\s+$", ""))
    level = F.when(F.col("section") > 0, F.length(F.regexp_extract("head", heading, 1))).otherwise(0)
    return grouped.filter("content <> ''").select(key, "start_line", "end_line", name.alias("identifier"), level.alias("level"), "content")


class _Source:
    """The lines of a Python file and the line intervals of what its syntax tree holds; lines count from 1, ends are included."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.tree = ast.parse(text)

    @staticmethod
    def interval(node: ast.stmt, decorated: bool = True) -> tuple[int, int]:
        above = [d.lineno for d in getattr(node, "decorator_list", [])] if decorated else []
        return min([node.lineno, *above]), node.end_lineno or node.lineno

    def text(self, *intervals: tuple[int, int]) -> str:
        return "\n".join(x for a, b in intervals for x in self.lines[a - 1 : b])

    @staticmethod
    def gaps(outer: tuple[int, int], holes: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """What the holes leave of ``outer``."""
        left, at = [], outer[0]
        for a, b in sorted(holes):
            if a > at:
                left.append((at, a - 1))
            at = max(at, b + 1)
        return [*left, (at, outer[1])] if at <= outer[1] else left


def _python_pieces(path: str, content: str) -> list[tuple]:
    """Imports as one span, functions, classes without their methods, methods, and the span of all that remains."""
    try:
        source = _Source(content)
    except (SyntaxError, ValueError, RecursionError):
        return [(path, "module_top_level", None, 1, content.count("\n") + 1, content)]
    routine = (ast.FunctionDef, ast.AsyncFunctionDef)
    pieces: list[tuple] = []
    taken: list[tuple[int, int]] = []  # decorators of functions and classes are not counted as taken

    def emit(kind: str, name: str | None, lines: tuple[int, int], *shown: tuple[int, int]) -> None:
        pieces.append((path, kind, name, *lines, source.text(*(shown or [lines]))))

    of_kind: dict[bool, list[tuple[int, int]]] = {True: [], False: []}
    for node in source.tree.body:
        imported = isinstance(node, (ast.Import, ast.ImportFrom))
        if imported or isinstance(node, (*routine, ast.ClassDef)):
            of_kind[imported].append(source.interval(node, decorated=False))
    taken = of_kind[True] + of_kind[False]
    if of_kind[True]:
        emit("module_imports", None, (min(a for a, _ in of_kind[True]), max(b for _, b in of_kind[True])))
    for node in source.tree.body:
        if isinstance(node, routine):
            emit("function", node.name, source.interval(node))
        elif isinstance(node, ast.ClassDef):
            methods = [(m.name, source.interval(m)) for m in node.body if isinstance(m, routine)]
            whole = source.interval(node)
            emit("class", node.name, whole, *source.gaps(whole, [lines for _, lines in methods]) or [(1, 0)])
            for name, lines in methods:
                emit("method", f"{node.name}.{name}", lines)
    free = [i for a, b in source.gaps((1, len(source.lines)), taken) for i in range(a, b + 1)]
    told = [i for i in free if not source.lines[i - 1].lstrip().startswith("#") and source.lines[i - 1].strip()]
    if told:
        emit("module_top_level", None, (told[0], told[-1]))
    return pieces


def code_chunks(files: DataFrame) -> DataFrame:
    """``file_path, chunk_type, identifier, start_line, end_line, content`` of source files given as ``file_path, text``.

    Python files are cut at imports, functions, classes and methods; a file that
    does not parse, or of another language, is one piece.  A null text has none.
    """
    schema = "file_path string, chunk_type string, identifier string, start_line int, end_line int, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    continue
                rows += _python_pieces(path, text) if (path or "").endswith(".py") else [(path, "whole_file", None, 1, text.count("\n") + 1, text)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return files.select("file_path", "text").mapInArrow(run, schema)


INDEX_KEY = ["repository_id", "file_path", "identifier_coalesce", "start_line"]


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an incremental index run has to do: ``key columns, change`` in unchanged, changed, added, deleted, by content hash."""
    a = old.select(*INDEX_KEY, F.col("content_hash").alias("old_hash")).dropDuplicates(INDEX_KEY)
    b = new.select(*INDEX_KEY, F.col("content_hash").alias("new_hash")).dropDuplicates(INDEX_KEY)
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, INDEX_KEY, "full_outer").select(*INDEX_KEY, change.alias("change"))


def next_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index after an incremental run, with the columns of ``old``: unchanged rows as they were, changed and added ones from ``new``; deleted ones are gone.

    ``old`` and ``new`` have the key and ``content_hash``; of rows that occur
    twice one stays.
    """
    columns = old.columns
    kept = old.dropDuplicates(INDEX_KEY).join(new.select(*INDEX_KEY, "content_hash").distinct(), [*INDEX_KEY, "content_hash"], "left_semi")
    fresh = new.dropDuplicates(INDEX_KEY).join(kept.select(*INDEX_KEY), INDEX_KEY, "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))


def patch_key(patch: Column) -> Column:
    """The cache key of a patch: the first 16 digits of its hash; a null patch counts as empty."""
    return F.left(F.sha2(F.coalesce(patch, F.lit("")), 256), F.lit(16))


def cached_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with ``is_changed``: whether the cache (``repo_full_name, filename, key``) lacks their patch."""
    known = cache.select("repo_full_name", "filename", "key").distinct().withColumn("known", F.lit(True))
    keyed = files.withColumn("key", patch_key(F.col("patch")))
    return keyed.join(known, ["repo_full_name", "filename", "key"], "left").withColumn("is_changed", F.col("known").isNull()).drop("known")
