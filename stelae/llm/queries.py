"""Queries of the training-text operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.llm import encoding, mixing, quantiles, splitting, text_quality
from stelae.session import Scratch
from stelae.sources.tables import table

_METRICS = ["wait_nanos", "cost_micros"]
_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every call once: its model, day and metrics."""
    rows = table(spark, folder, "call_records").select(
        "call_id", "model", F.to_date("called_at").alias("day"), *_METRICS, "loaded_at"
    )
    return quantiles.once_each(rows, "call_id", ["model", "day", *_METRICS], "loaded_at")


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return Scratch(spark, "quantiles").keep(
        quantiles.sketched(_calls(spark, folder), ["model", "day"], _METRICS), "daily"
    )


def _answers(daily: DataFrame) -> DataFrame:
    days = quantiles.percentiles(daily, ["model", "day"], _PERCENTILES)
    whole = quantiles.percentiles(quantiles.merged(daily, ["model"]), ["model"], _PERCENTILES)
    return (
        days.withColumn("period", F.coalesce(F.col("day").cast("string"), F.lit("undated")))
        .drop("day")
        .unionByName(whole.withColumn("period", F.lit("all")))
    )


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per model and day, and per model over all days by merging the days."""
    return _answers(_daily(spark, folder))


def p1_within_error(spark: SparkSession, folder: str) -> DataFrame:
    """Exact counts beside the sketches: is every answered rank within its bound?"""
    asked = (
        _answers(_daily(spark, folder))
        .select("model", "period", "metric", "n", "low", "high", "rank_error", *_PERCENTILES)
        .unpivot(
            ["model", "period", "metric", "n", "low", "high", "rank_error"], list(_PERCENTILES), "percentile", "answer"
        )
    )
    day = F.coalesce(F.col("day").cast("string"), F.lit("undated"))
    values = (
        _calls(spark, folder)
        .select("model", F.explode(F.array(day, F.lit("all"))).alias("period"), *_METRICS)
        .unpivot(["model", "period"], _METRICS, "metric", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("model", "period", "metric", "value")
        .agg(F.count("*").alias("held"))
    )
    a, v = asked.alias("a"), values.alias("v")
    same = (
        F.col("a.model").eqNullSafe(F.col("v.model"))
        & (F.col("a.period") == F.col("v.period"))
        & (F.col("a.metric") == F.col("v.metric"))
    )
    ranks = (
        a.join(v, same)
        .groupBy("a.model", "a.period", "a.metric", "a.percentile", "a.answer", "a.n", "a.low", "a.high", "a.rank_error")
        .agg(
            F.sum(F.when(F.col("v.value") < F.col("a.answer"), F.col("v.held")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("v.value") <= F.col("a.answer"), F.col("v.held")).otherwise(0)).alias("up_to"),
        )
    )
    wanted = F.ceil(
        F.create_map(*(F.lit(x) for item in _PERCENTILES.items() for x in item))[F.col("percentile")] * F.col("n") - F.lit(1e-9)
    )
    off = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("up_to"), F.lit(0))
    return ranks.groupBy("model", "period", "metric", "n", "low", "high").agg(
        F.min(off <= F.col("rank_error") * F.col("n") + 1).alias("within")
    )


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "sources"), "document", "content")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).select("document").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).withColumn("octets", F.octet_length("content")).drop("content")


def p3_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every long content put together again from its pieces, and whether the pieces keep the limits."""
    fresh = F.expr("substring(content, overlap + 1)")
    return (
        _pieces(spark, folder)
        .groupBy("document", "content_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("piece", fresh.alias("fresh")))).alias("parts"),
            F.max(F.octet_length("content")).alias("longest"),
            F.max("overlap").alias("shared"),
        )
        .select(
            "document",
            F.sha2(F.aggregate("parts", F.lit(b""), lambda joined, p: F.concat(joined, p["fresh"])), 256).alias("digest"),
            ((F.col("longest") <= splitting.LIMIT) & (F.col("shared") <= splitting.OVERLAP)).alias("kept_limits"),
        )
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, those with empty and null text included."""
    return encoding.encoded(table(spark, folder, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every document, decoded from its ids, by digest."""
    ids = Scratch(spark, "encoding").keep(encoding.encoded(table(spark, folder, "documents"), "doc_id", "text"), "ids")
    return encoding.decoded(ids, "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.struct("doc_id", "source").alias("document"), "text")
    sized = encoding.token_counts(documents, "document", "text").select("document.*", "tokens")
    return Scratch(spark, "mixing").keep(sized, "sized")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What every source was to give and really gave."""
    return _mixed(spark, folder)[1]


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents and how often each is taken."""
    return _mixed(spark, folder)[0]


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Does every source keep its cap and its budget, and is no document left that would still
    fit: is what the budget lacks less than the shortest document without its copy more?"""
    sized = _sized(spark, folder)
    selection, report = mixing.mixed(sized, table(spark, folder, "mix_targets"))
    whole = F.when(F.col("tokens_held") > 0, F.floor(F.col("budget") / F.col("tokens_held"))).otherwise(0)
    copies = sized.filter("tokens > 0").join(selection.select("doc_id", "copies"), "doc_id", "left").na.fill(0, ["copies"])
    left = (
        copies.join(report.select("source", whole.alias("whole")), "source")
        .filter(F.col("copies") <= F.col("whole"))
        .groupBy("source")
        .agg(F.min("tokens").alias("shortest"))
    )
    lacking = F.col("budget") - F.col("tokens_taken")
    # A budget of as many whole repeats as the cap allows leaves no copy to be taken.
    full = F.col("tokens_taken") >= F.col("max_repeats") * F.col("tokens_held")
    kept = (F.col("most_copies") <= F.col("max_repeats")) & (lacking >= 0) & (full | F.col("shortest").isNull() | (lacking < F.col("shortest")))
    return report.join(left, "source", "left").select(
        "source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats"), "documents_held", kept.alias("kept")
    )


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.statistics(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """By layout alone; the count of common words, which decides nothing, is left to ``p8_statistics``."""
    return text_quality.not_prose(text_quality.layouts(table(spark, folder, "documents"), "doc_id", "text")).select("doc_id")


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_within_error": p1_within_error,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_rejoined": p3_rejoined,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_shares": p7_shares,
    "p7_selection": p7_selection,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}

ORACLE = {
    "p1_within_error": """
WITH calls AS (SELECT call_id, any_value(model) AS model, any_value(wait_nanos) AS wait_nanos,
                      any_value(cost_micros) AS cost_micros, any_value(called_at) AS called_at
               FROM call_records GROUP BY call_id),
long AS (SELECT model, called_at, 'wait_nanos' AS metric, wait_nanos AS v FROM calls
         UNION ALL SELECT model, called_at, 'cost_micros', cost_micros FROM calls),
per AS (SELECT model, 'all' AS period, metric, v FROM long
        UNION ALL SELECT model, coalesce(strftime(called_at, '%Y-%m-%d'), 'undated'), metric, v FROM long)
SELECT model, period, metric, count(*) AS n, min(v) AS low, max(v) AS high, true AS within
FROM per WHERE v IS NOT NULL GROUP BY ALL""",
    "p3_found": "SELECT DISTINCT document FROM sources WHERE octet_length(content) > 4000",
    "p3_rejoined": """SELECT DISTINCT document, sha256(content) AS digest, true AS kept_limits
FROM sources WHERE octet_length(content) > 4000""",
    "p7_kept": """SELECT t.source, t.target_share, t.max_repeats::BIGINT AS max_repeats, count(d.doc_id) AS documents_held, true AS kept
FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY ALL""",
    "p6_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
}
