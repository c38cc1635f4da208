"""Queries of the aggregations, ordered scans and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.catalog.registry import query
from lathework.operators import analytics as A
from lathework.operators import scan as S
from lathework.functions.rules import SECURITY
from lathework.operators import diff as D
from lathework.plans.ordinal import numbered
from lathework.plans.tables import table

#: Reviews once per id in SQL.
REVIEWS = "(SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY id ORDER BY completed_at IS NOT NULL DESC, status <> 'queued' DESC, coalesce(completed_at, created_at) DESC, status DESC, total_cost_usd DESC, total_input_tokens DESC) = 1)"

SINCE = "2025-09-01"


def reviews(spark: SparkSession, directory: str) -> DataFrame:
    return A.latest_reviews(table(spark, directory, "reviews"))


@query(
    "g1_repository_stats",
    f"""SELECT repository_id, count(*) AS posted, (sum(total_cost_usd) * 1000000)::BIGINT // count(*) AS avg_cost_micros, round(quantile_cont(duration_ms, 0.5), 3) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 3) AS p95_ms
        FROM {REVIEWS} WHERE status = 'posted' AND created_at >= TIMESTAMP '{SINCE}' AND repository_id IS NOT NULL GROUP BY 1""",
)
def g1_repository_stats(spark: SparkSession, directory: str) -> DataFrame:
    return A.repository_stats(reviews(spark, directory), F.lit(SINCE).cast("timestamp"))


@query(
    "g2_log_totals",
    f"""SELECT count(*) AS reviews, sum(total_cost_usd)::DECIMAL(20,6) AS cost, round(avg(duration_ms), 6) AS avg_duration_ms, sum(total_input_tokens::BIGINT + total_output_tokens)::BIGINT AS tokens FROM {REVIEWS}""",
)
def g2_log_totals(spark: SparkSession, directory: str) -> DataFrame:
    return A.log_totals(reviews(spark, directory))


@query("g3_cost_by_day", f"SELECT created_at::DATE AS day, round(sum(total_cost_usd), 4)::DECIMAL(20,4) AS cost FROM {REVIEWS} GROUP BY 1")
def g3_cost_by_day(spark: SparkSession, directory: str) -> DataFrame:
    return A.per_day(reviews(spark, directory), "created_at").select("day", F.round("cost", 4).cast("decimal(20,4)").alias("cost"))


@query("g4_reviews_by_day", f"SELECT created_at::DATE AS day, count(*) AS n FROM {REVIEWS} GROUP BY 1")
def g4_reviews_by_day(spark: SparkSession, directory: str) -> DataFrame:
    return A.per_day(reviews(spark, directory), "created_at").select("day", "n")


@query(
    "g5_severity_totals",
    "SELECT f.severity AS key, count(*) AS total FROM (SELECT DISTINCT sample_id, expected_findings FROM samples), unnest(expected_findings) AS u(f) GROUP BY 1",
)
def g5_severity_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Counter maps per sample, summed by key."""
    samples = table(spark, directory, "samples").dropDuplicates(["sample_id"])
    severities = F.transform("expected_findings", lambda f: f["severity"])
    counters = F.map_from_entries(F.transform(F.array_distinct(severities), lambda s: F.struct(s, F.size(F.filter(severities, lambda x: x == s)))))
    return A.map_totals(samples.filter("size(expected_findings) > 0").select(counters.alias("counts")), "counts")


@query(
    "g6_distributions",
    f"SELECT 'risk' AS field, coalesce(risk_level, '') AS value, count(*) AS n FROM {REVIEWS} GROUP BY 1, 2 UNION ALL SELECT 'category', coalesce(pr_classification, ''), count(*) FROM {REVIEWS} GROUP BY 1, 2",
)
def g6_distributions(spark: SparkSession, directory: str) -> DataFrame:
    rows = reviews(spark, directory)
    return A.distribution(rows, "risk_level").select(F.lit("risk").alias("field"), "value", "n").unionByName(A.distribution(rows, "pr_classification").select(F.lit("category").alias("field"), "value", "n"))


def _listed(value: str, most: int) -> str:
    """The most frequent values with their counts, ties by value, as one text."""
    return f"(SELECT coalesce(string_agg(v || ':' || n, ',' ORDER BY n DESC, v), '') FROM (SELECT coalesce({value}, '') AS v, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, v LIMIT {most}))"


def _top(rows: DataFrame, column: str, most: int, name: str) -> DataFrame:
    """One row with a column ``name``: the ``most`` frequent values with their counts; a top-k report."""
    counted = A.distribution(rows, column).orderBy(F.desc("n"), "value").limit(most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value")))
    return counted.agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["value"], (-x["less"]).cast("string"))), ",").alias(name))


@query(
    "g7_digest",
    f"""WITH r AS {REVIEWS} SELECT count(*) AS reviews, count(DISTINCT (repository_id, pr_number)) FILTER (repository_id IS NOT NULL) AS prs, sum(total_cost_usd)::DECIMAL(20,6) AS cost, round(sum(duration_ms) / count(*), 6) AS avg_duration_ms,
          count(*) FILTER (risk_level = 'high') AS high_risk, {_listed('pr_classification', 5)} AS top_categories, {_listed('repository_id', 10)} AS top_repositories, {_listed('risk_level', 99)} AS risks, {_listed('status', 99)} AS states,
          array_to_string(list_filter([CASE WHEN high_risk > 0 THEN high_risk || ' high-risk' END, CASE WHEN cost > 1 THEN 'cost ' || round(cost, 2)::DECIMAL(20,2) END], lambda x: x IS NOT NULL), '; ') AS highlights FROM r""",
)
def g7_digest(spark: SparkSession, directory: str) -> DataFrame:
    """One row: totals, distributions, the most frequent categories and repositories, and what stands out."""
    rows = reviews(spark, directory)
    totals = rows.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_distinct(F.when(F.col("repository_id").isNotNull(), F.struct("repository_id", "pr_number"))).alias("prs"),
        F.sum("total_cost_usd").cast("decimal(20,6)").alias("cost"),
        F.round(F.sum("duration_ms") / F.count(F.lit(1)), 6).alias("avg_duration_ms"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"),
    )
    said = F.array_compact(F.array(F.when(F.col("high_risk") > 0, F.concat(F.col("high_risk").cast("string"), F.lit(" high-risk"))), F.when(F.col("cost") > 1, F.concat(F.lit("cost "), F.col("cost").cast("decimal(20,2)").cast("string")))))
    totals = totals.withColumn("highlights", F.array_join(said, "; "))
    # every side is one row
    for column, most, name in (("pr_classification", 5, "top_categories"), ("repository_id", 10, "top_repositories"), ("risk_level", 99, "risks"), ("status", 99, "states")):
        totals = totals.withColumn("one", F.lit(1)).join(F.broadcast(_top(rows, column, most, name).withColumn("one", F.lit(1))), "one").drop("one")
    return totals


_HEALTH = "least((40 * (1 - high / reviews))::DOUBLE // 1 + CASE WHEN tokens <= 2000 THEN 30 WHEN tokens <= 5000 THEN 20 WHEN tokens <= 10000 THEN 10 ELSE 0 END + CASE WHEN reviews >= 20 THEN 30 WHEN reviews >= 10 THEN 20 WHEN reviews >= 5 THEN 10 ELSE 5 END, 100)::INT"


@query(
    "g8_report_card",
    f"""SELECT days, reviews, cost, avg_duration_ms, high, {_HEALTH} AS health, risks FROM (
        SELECT days, count(*) AS reviews, sum(total_cost_usd)::DECIMAL(20,6) AS cost, sum(duration_ms)::BIGINT // greatest(count(*), 1) AS avg_duration_ms, count(*) FILTER (risk_level = 'high') AS high, sum(total_output_tokens) / count(*) AS tokens,
          array_to_string(list_transform(['high', 'low', 'medium'], lambda x: x || ':' || len(list_filter(list(risk_level), lambda y: y = x))), ',') AS risks
        FROM {REVIEWS}, (VALUES (7, '2025-10-18'), (30, '2025-09-25')) AS p(days, since) WHERE strftime(created_at, '%Y-%m-%dT%H:%M:%S') >= since GROUP BY 1)""",
)
def g8_report_card(spark: SparkSession, directory: str) -> DataFrame:
    """The last 7 and 30 days, dates compared as text, as logs store them; a health score from risk, output per review (for comments) and volume."""
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    periods = F.array_compact(F.array(*[F.when(stamp >= since, F.lit(days)) for days, since in ((7, "2025-10-18"), (30, "2025-09-25"))]))
    rows = reviews(spark, directory).withColumn("days", F.explode(periods))
    n, level = F.count(F.lit(1)), F.col("risk_level")
    card = rows.groupBy("days").agg(
        n.alias("reviews"), F.sum("total_cost_usd").cast("decimal(20,6)").alias("cost"), F.floor(F.sum("duration_ms") / F.greatest(n, F.lit(1))).alias("avg_duration_ms"),
        F.count_if(level == "high").alias("high"), F.count_if(level == "low").alias("low"), F.count_if(level == "medium").alias("medium"), (F.sum("total_output_tokens") / n).alias("tokens"),
    )
    steps = lambda column, bounds, last: F.coalesce(*[F.when(test(F.col(column)), points) for test, points in bounds], F.lit(last))
    quality = steps("tokens", [(lambda c, b=b: c <= b, p) for b, p in ((2000, 30), (5000, 20), (10000, 10))], 0)
    volume = steps("reviews", [(lambda c, b=b: c >= b, p) for b, p in ((20, 30), (10, 20), (5, 10))], 5)
    health = F.least(F.floor(40 * (1 - F.col("high") / F.col("reviews"))) + quality + volume, F.lit(100)).cast("int")
    risks = F.concat_ws(",", *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ("high", "low", "medium")])
    return card.select("days", "reviews", "cost", "avg_duration_ms", "high", health.alias("health"), risks.alias("risks"))


@query("g1_cost_by_day", f"SELECT repository_id, created_at::DATE AS day, sum(total_cost_usd)::DECIMAL(20,6) AS cost FROM {REVIEWS} WHERE status = 'posted' AND created_at >= TIMESTAMP '{SINCE}' AND repository_id IS NOT NULL GROUP BY 1, 2")
def g1_cost_by_day(spark: SparkSession, directory: str) -> DataFrame:
    """Cost of each repository's posted reviews by day."""
    posted = reviews(spark, directory).filter((F.col("status") == "posted") & (F.col("created_at") >= F.lit(SINCE).cast("timestamp")) & F.col("repository_id").isNotNull())
    return posted.groupBy("repository_id", F.to_date("created_at").alias("day")).agg(F.sum("total_cost_usd").cast("decimal(20,6)").alias("cost"))


@query(
    "g9_cost_trend",
    f"SELECT repository_id, md5(string_agg(total_cost_usd::VARCHAR, ',' ORDER BY created_at, id)) AS trend, count(*) AS n FROM {REVIEWS} WHERE repository_id IS NOT NULL AND risk_level = 'high' GROUP BY 1",
)
def g9_cost_trend(spark: SparkSession, directory: str) -> DataFrame:
    """Costs of each repository's risky reviews in order of time."""
    rows = reviews(spark, directory).filter("repository_id IS NOT NULL AND risk_level = 'high'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", F.col("total_cost_usd").cast("string").alias("cost")))), lambda x: x["cost"])
    return rows.groupBy("repository_id").agg(F.md5(F.array_join(ordered, ",")).alias("trend"), F.count(F.lit(1)).alias("n"))


@query(
    "g10_batch_summary",
    f"SELECT count(*) FILTER (status = 'posted') AS reviewed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running')) AS open, sum(total_cost_usd) FILTER (status = 'posted')::DECIMAL(20,6) AS cost FROM {REVIEWS}",
)
def g10_batch_summary(spark: SparkSession, directory: str) -> DataFrame:
    status = F.col("status")
    return reviews(spark, directory).agg(
        F.count_if(status == "posted").alias("reviewed"), F.count_if(status == "failed").alias("failed"), F.count_if(status.isin("queued", "running")).alias("open"), F.sum(F.when(status == "posted", F.col("total_cost_usd"))).cast("decimal(20,6)").alias("cost")
    )


@query(
    "g15_bands",
    "SELECT event_type, count(*) FILTER (value >= 80) AS high, count(*) FILTER (value >= 50 AND value < 80) AS medium, count(*) FILTER (value < 50) AS low FROM events GROUP BY 1",
)
def g15_bands(spark: SparkSession, directory: str) -> DataFrame:
    value = F.col("value")
    return table(spark, directory, "events").groupBy("event_type").agg(F.count_if(value >= 80).alias("high"), F.count_if((value >= 50) & (value < 80)).alias("medium"), F.count_if(value < 50).alias("low"))


@query("g16_scanner_benchmark")
def g16_scanner_benchmark(spark: SparkSession, directory: str) -> DataFrame:
    """The security rules against the golden diffs."""
    samples = table(spark, directory, "samples").dropDuplicates(["sample_id"])
    name = F.coalesce(F.nullif(F.regexp_extract("diff", r"(?m)^\+\+\+ b/([^\r\n]*)", 1), F.lit("")), F.lit("unknown.py"))
    files = samples.select(
        F.col("sample_id").alias("file_id"), F.lit("").alias("repo_full_name"), F.lit(0).alias("pr_number"), F.lit("").alias("head_sha"), F.lit(0).alias("file_ord"), name.alias("filename"), F.lit("modified").alias("status"), F.col("diff").alias("patch")
    )
    found = S.security_findings(D.new_side(files), SECURITY).select(F.col("file_id").alias("sample_id"), F.concat_ws(" ", "rule_id", "category").alias("words"))
    expected = F.coalesce(F.transform("expected_findings", lambda f: F.coalesce(f["type"], F.lit(""))), F.array().cast("array<string>"))
    return A.benchmark(samples.select("sample_id", expected.alias("expected")), found)


@query(
    "g17_counters_and_window",
    """SELECT user_id, count(*) AS all_time, count(*) FILTER (nth <= 20) AS kept, round(sum(value) FILTER (nth <= 20), 6) AS recent_value
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) GROUP BY 1""",
)
def g17_counters_and_window(spark: SparkSession, directory: str) -> DataFrame:
    """All-time counters beside the newest 20 rows of each key, null among them."""
    events = table(spark, directory, "events").select("user_id", "ts", "event_id", "value")
    kept = A.newest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("value"), 6).alias("recent_value"))
    counted = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("all_time"))
    # a null user is one of its own, as in a group
    return counted.alias("c").join(kept.alias("k"), F.col("c.user_id").eqNullSafe(F.col("k.user_id"))).select("c.user_id", "all_time", "kept", "recent_value")


@query("h6_newest_rows", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def h6_newest_rows(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events").select("user_id", "ts", "event_id")
    return A.newest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query(
    "h9_first_and_last",
    "SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1",
)
def h9_first_and_last(spark: SparkSession, directory: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, directory, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("i1_top_authors", "SELECT author, n FROM (SELECT author, count(*) AS n, min((created_at, doc_id)) AS first FROM documents WHERE author IS NOT NULL GROUP BY 1 ORDER BY n DESC, first, author LIMIT 10)")
def i1_top_authors(spark: SparkSession, directory: str) -> DataFrame:
    """A top-k report (I1, I2): ties by first appearance."""
    return A.top_counts(table(spark, directory, "documents").select("author", "created_at", "doc_id"), "author", F.struct("created_at", "doc_id"), 10)


@query("i5_newest_repositories", "SELECT id, github_full_name FROM repositories ORDER BY created_at DESC, id LIMIT 20")
def i5_newest_repositories(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "repositories").orderBy(F.desc("created_at"), "id").limit(20).select("id", "github_full_name")


@query(
    "i8_word_sets",
    "SELECT doc_id, len(a) AS n_a, len(list_intersect(a, b)) AS shared FROM (SELECT doc_id, list_distinct(string_split(lower(split_part(text, chr(10), 1)), ' ')) AS a, list_distinct(string_split(lower(source), '_')) AS b FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)",
)
def i8_word_sets(spark: SparkSession, directory: str) -> DataFrame:
    a = F.array_distinct(F.split(F.lower(F.substring_index("text", "\n", 1)), " "))
    b = F.array_distinct(F.split(F.lower("source"), "_"))
    return table(spark, directory, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", F.size(a).alias("n_a"), F.size(F.array_intersect(a, b)).alias("shared"))


@query("i11_ordered_references", "SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS refs FROM (SELECT doc_id, list_reduce(list_transform(regexp_extract_all(text, '#[0-9]+'), lambda x: [x]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_ordered FROM documents WHERE regexp_matches(text, '#[0-9]+'))")
def i11_ordered_references(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct references of a text in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("(#[0-9]+)"), F.lit(1)))
    return table(spark, directory, "documents").filter(F.size(found) > 0).select("doc_id", F.array_join(found, ",").alias("refs"))


@query(
    "j11_batches",
    "SELECT batch, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM (SELECT (row_number() OVER (ORDER BY id, start_line, content_hash) - 1) // 100 AS batch, length(content) // 4 AS tokens FROM chunks) GROUP BY 1",
)
def j11_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks in batches of 100 with their estimated tokens; rows that occur twice count twice."""
    chunks = table(spark, directory, "chunks").select("id", "start_line", "content_hash", F.floor(F.length("content") / 4).alias("tokens"))
    nth = numbered(chunks, [F.col("id"), F.col("start_line"), F.col("content_hash")])
    return nth.groupBy(F.floor((F.col("nth") - 1) / 100).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


# TPC-H style aggregates over the star tables: the relational core the others stand on


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def q1_pricing_summary(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(
    "q5_region_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""",
)
def q5_region_revenue(spark: SparkSession, directory: str) -> DataFrame:
    t = {n: table(spark, directory, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    joined = (
        t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.filter("r_name = 'ASIA'").groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("h1_running_totals", "SELECT event_id, count(*) OVER w AS nth, round(sum(value) OVER w, 6) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def h1_running_totals(spark: SparkSession, directory: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, directory, "events").select("event_id", F.count(F.lit(1)).over(w).alias("nth"), F.round(F.sum("value").over(w), 6).alias("running"))
