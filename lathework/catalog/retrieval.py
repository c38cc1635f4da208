"""Queries of search and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.catalog.diffs import FILES, pr_files
from lathework.catalog.registry import query
from lathework.operators import retrieval as R
from lathework.plans.tables import table

_NEAREST = """nearest AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM nearest QUALIFY nth <= 20)"""


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "embeddings")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("j1_vector_search", f"WITH {_NEAREST} SELECT query_id, vec_id, score, nth FROM ranked")
def j1_vector_search(spark: SparkSession, directory: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows; exact."""
    vectors = _vectors(spark, directory)
    return R.nearest(vectors, _queries(vectors))


@query("j6_vector_search_of_a_kind", f"WITH {_NEAREST.replace('embeddings v WHERE', 'embeddings v WHERE v.label IN (1, 2) AND').replace('nth <= 20', 'nth <= 5')} SELECT query_id, vec_id, score FROM ranked")
def j6_vector_search_of_a_kind(spark: SparkSession, directory: str) -> DataFrame:
    """Search among rows of given kinds only."""
    vectors = _vectors(spark, directory)
    return R.nearest(vectors.filter("label IN (1, 2)"), _queries(vectors), most=5).select("query_id", "vec_id", "score")


@query(
    "j4_rank_fusion",
    f"""WITH {_NEAREST}, second AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS nth FROM ranked WHERE vec_id % 3 = 0)
        SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + nth)), 9) AS score FROM (SELECT query_id, vec_id, nth FROM ranked UNION ALL SELECT query_id, vec_id, nth FROM second) GROUP BY 1, 2""",
)
def j4_rank_fusion(spark: SparkSession, directory: str) -> DataFrame:
    vectors = _vectors(spark, directory)
    first = R.nearest(vectors, _queries(vectors)).select("query_id", "vec_id", "nth")
    second = first.filter("vec_id % 3 = 0").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")))
    return R.fused([first, second], ["query_id", "vec_id"])


NAMES = ["validate_schedule", "flushRecord", "loader"]

_TRIGRAM = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_NAMED = f"""own AS (SELECT id, content, {_TRIGRAM.format("coalesce(identifier, '')")} AS own FROM chunks),
  asked AS (SELECT name, {_TRIGRAM.format('name')} AS grams FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) AS n(name)),
  scored AS (SELECT DISTINCT name, id, round(coalesce(len(list_intersect(own, grams)) / nullif(len(own) + len(grams) - len(list_intersect(own, grams)), 0), 0), 6) AS score, contains(lower(content), lower(name)) AS inside FROM own, asked),
  named AS (SELECT name, id, max(score) AS score, row_number() OVER (PARTITION BY name ORDER BY max(score) DESC, id) AS nth FROM scored WHERE score > 0.3 OR inside GROUP BY name, id QUALIFY nth <= 5)"""


@query("j2_identifier_search", f"WITH {_NAMED} SELECT name, id, score, nth FROM named")
def j2_identifier_search(spark: SparkSession, directory: str) -> DataFrame:
    return R.named_chunks(table(spark, directory, "chunks"), NAMES)


PATHS = ["dune/ember/mesa_forge.py", "docs/guide.md", "harbor/flint/x.py"]
_NEAR = """near AS (SELECT id, row_number() OVER (ORDER BY file_path, start_line, id) AS nth FROM (SELECT DISTINCT id, file_path, start_line FROM chunks
   WHERE file_path IN ('dune/ember/mesa_forge.py', 'docs/guide.md', 'harbor/flint/x.py') OR starts_with(file_path, 'dune/ember/') OR starts_with(file_path, 'docs/') OR starts_with(file_path, 'harbor/flint/')) QUALIFY nth <= 30)"""


@query("j3_file_neighbourhood", f"WITH {_NEAR} SELECT id, nth FROM near")
def j3_file_neighbourhood(spark: SparkSession, directory: str) -> DataFrame:
    return R.neighbourhood(table(spark, directory, "chunks"), PATHS)


#: The index stores no vectors here: a chunk's is the one whose id is its start line modulo 500, the question's is the first.
_MEANT = """meant AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS nth FROM (SELECT DISTINCT c.id, v.score FROM chunks c JOIN
    (SELECT v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id = 0) v ON v.vec_id = c.start_line % 500) QUALIFY nth <= 20)"""


@query(
    "j5_hybrid_search",
    f"""WITH {_NAMED}, {_NEAR}, {_MEANT}, fused AS (SELECT id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + nth)), 9) AS score FROM (SELECT id, nth FROM named UNION ALL SELECT id, nth FROM near UNION ALL SELECT id, nth FROM meant) GROUP BY 1 ORDER BY score DESC, id LIMIT 10)
        SELECT row_number() OVER (ORDER BY score DESC, id) AS nth, id, score, file_path, start_line FROM fused JOIN (SELECT DISTINCT id, file_path, start_line FROM chunks) USING (id)""",
)
def j5_hybrid_search(spark: SparkSession, directory: str) -> DataFrame:
    """The ten best chunks over a vector arm, an arm per identifier and the neighbourhood of files, fetched in fused order."""
    chunks = table(spark, directory, "chunks")
    vectors = _vectors(spark, directory)
    question = vectors.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    # vectors that chunks can have: fewer than 500
    scores = R.nearest(vectors.filter("vec_id < 500"), question, most=500).select("vec_id", "score")
    named = R.named_chunks(chunks, NAMES)
    arms = [named.filter(F.col("name") == n).select("id", "nth") for n in NAMES]
    meant = R.best_chunks(chunks.select("id", (F.col("start_line") % 500).cast("bigint").alias("vec_id")), scores)
    best = R.fused([meant, *arms, R.neighbourhood(chunks, PATHS)], ["id"]).orderBy(F.desc("score"), "id").limit(10)
    return R.fetched(best, chunks).select("nth", "id", "score", "file_path", "start_line")


@query(
    "j7_usages",
    "SELECT DISTINCT id, file_path, start_line, substr(content, 1, 200) AS snippet FROM chunks WHERE identifier = 'validate_schedule' OR contains(content, 'validate_schedule')",
)
def j7_usages(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "chunks").filter((F.col("identifier") == "validate_schedule") | F.col("content").contains("validate_schedule"))
    return rows.select("id", "file_path", "start_line", F.substring("content", 1, 200).alias("snippet")).distinct()


@query(
    "j8_test_lookup",
    """SELECT DISTINCT pattern, file_path FROM (SELECT DISTINCT file_path FROM chunks), (VALUES ('%test\\_%'), ('%\\_test.%'), ('%.test.%'), ('%forge%')) AS p(pattern) WHERE lower(file_path) LIKE pattern ESCAPE '\\'
       QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY file_path) <= 10""",
)
def j8_test_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """At most 10 paths for each name pattern."""
    patterns = ["%test\\_%", "%\\_test.%", "%.test.%", "%forge%"]
    paths = table(spark, directory, "chunks").select("file_path").distinct()
    hits = F.array_compact(F.array(*[F.when(F.lower("file_path").like(p), F.lit(p)) for p in patterns]))
    order = Window.partitionBy("pattern").orderBy("file_path")
    return paths.withColumn("pattern", F.explode(hits)).withColumn("nth", F.row_number().over(order)).filter("nth <= 10").select("pattern", "file_path")


@query(
    "j10_file_texts",
    "SELECT repository_id, file_path, md5(string_agg(content, chr(10) ORDER BY start_line, id)) AS text_md5 FROM (SELECT DISTINCT ON (id) repository_id, file_path, start_line, id, content FROM chunks) GROUP BY 1, 2",
)
def j10_file_texts(spark: SparkSession, directory: str) -> DataFrame:
    return R.file_texts(table(spark, directory, "chunks")).select("repository_id", "file_path", F.md5("text").alias("text_md5"))


@query("k1_code_chunks")
def k1_code_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Files of the index cut again by syntax (K1, K2)."""
    files = R.file_texts(table(spark, directory, "chunks"))
    return R.code_chunks(files).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("characters"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(
    "k3_sections",
    f"""WITH lines AS (SELECT doc_id, u.pos, u.line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE text IS NOT NULL),
        blocks AS (SELECT *, sum(regexp_matches(line, '^(#{{1,3}})\\s+(.+)$')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines),
        grouped AS (SELECT doc_id, section, {_STRIP.format("string_agg(line, chr(10) ORDER BY pos)")} AS content, min(pos)::INT AS start_line, max(pos)::INT AS end_line, min_by(line, pos) AS head FROM blocks GROUP BY 1, 2)
        SELECT doc_id, start_line, end_line, CASE WHEN section > 0 THEN {_STRIP.format("regexp_extract(head, '^(#{1,3})\\s+(.+)$', 2)")} END AS identifier,
          CASE WHEN section > 0 THEN length(regexp_extract(head, '^(#{{1,3}})\\s+(.+)$', 1)) ELSE 0 END::INT AS level, md5(content) AS content_md5 FROM grouped WHERE content <> ''""",
)
def k3_sections(spark: SparkSession, directory: str) -> DataFrame:
    sections = R.section_chunks(table(spark, directory, "documents").select("doc_id", "text"), "doc_id", "text")
    return sections.select("doc_id", "start_line", "end_line", "identifier", "level", F.md5("content").alias("content_md5"))


@query(
    "k4_index_changes",
    """WITH latest AS (SELECT DISTINCT repository_id, file_path, identifier_coalesce, start_line, content_hash FROM chunks),
         old AS (SELECT * REPLACE (CASE WHEN start_line % 5 = 0 THEN md5(content_hash) ELSE content_hash END AS content_hash) FROM latest WHERE start_line % 7 <> 0), new AS (SELECT * FROM latest WHERE start_line % 11 <> 0)
       SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.content_hash IS NULL THEN 'added' WHEN n.content_hash IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS change
         FROM old o FULL JOIN new n USING (repository_id, file_path, identifier_coalesce, start_line)) GROUP BY 1""",
)
def k4_index_changes(spark: SparkSession, directory: str) -> DataFrame:
    """An earlier snapshot (some rows missing, some with other contents) against a later one."""
    chunks = table(spark, directory, "chunks").select(*R.INDEX_KEY, "content_hash")
    old = chunks.filter("start_line % 7 <> 0").withColumn("content_hash", F.when(F.col("start_line") % 5 == 0, F.md5("content_hash")).otherwise(F.col("content_hash")))
    return R.index_changes(old, chunks.filter("start_line % 11 <> 0")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k4_next_snapshot",
    """WITH latest AS (SELECT DISTINCT repository_id, file_path, identifier_coalesce, start_line, content_hash FROM chunks),
         old AS (SELECT * REPLACE (CASE WHEN start_line % 5 = 0 THEN md5(content_hash) ELSE content_hash END AS content_hash) FROM latest WHERE start_line % 7 <> 0), new AS (SELECT * FROM latest WHERE start_line % 11 <> 0)
       SELECT n.repository_id, n.file_path, n.identifier_coalesce, n.start_line, n.content_hash, CASE WHEN o.content_hash = n.content_hash THEN 1 ELSE 2 END AS run FROM new n LEFT JOIN old o USING (repository_id, file_path, identifier_coalesce, start_line)""",
)
def k4_next_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """The snapshot that the incremental run writes, with the run that indexed each row."""
    chunks = table(spark, directory, "chunks").select(*R.INDEX_KEY, "content_hash")
    old = chunks.filter("start_line % 7 <> 0").withColumn("content_hash", F.when(F.col("start_line") % 5 == 0, F.md5("content_hash")).otherwise(F.col("content_hash")))
    return R.next_snapshot(old.withColumn("run", F.lit(1)), chunks.filter("start_line % 11 <> 0").withColumn("run", F.lit(2)))


@query(
    "k5_review_cache",
    f"""WITH f AS (SELECT file_id, repo_full_name, filename, status, substr(sha256(coalesce(patch, '')), 1, 16) AS key FROM {FILES}),
          cache AS (SELECT DISTINCT repo_full_name, filename, key FROM f WHERE status = 'added')
        SELECT file_id, key, c.key IS NULL AS is_changed FROM f LEFT JOIN cache c USING (repo_full_name, filename, key)""",
)
def k5_review_cache(spark: SparkSession, directory: str) -> DataFrame:
    """The cache knows the patches of added files."""
    files = pr_files(spark, directory)
    cache = files.filter("status = 'added'").withColumn("key", R.patch_key(F.col("patch")))
    return R.cached_files(files, cache).select("file_id", "key", "is_changed")
