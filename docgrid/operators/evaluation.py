"""Trace statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import clamped, latency_ms, lenient_json, truthy

def with_defaults(records: DataFrame, *keep: str) -> DataFrame:
    """Trace records (name, model, latencyMs, usage) with defaults for what is missing; ``keep`` are further columns."""
    zero = F.lit(0)
    return records.select(
        *keep,
        F.coalesce("name", F.lit("llm-call")).alias("name"), F.coalesce("model", F.lit("?")).alias("model"), F.coalesce("latencyMs", zero).alias("latency_ms"),
        F.coalesce("usage.input", zero).alias("tok_in"), F.coalesce("usage.output", zero).alias("tok_out"),
    )


def usage_of(body: Column) -> Column:
    """Input and output tokens of a model's JSON answer in either of two dialects; the body is parsed once."""
    v = F.try_parse_json(body)
    get = lambda k: F.try_variant_get(v, f"$.usage.{k}", "long")
    return F.struct(
        F.coalesce(get("prompt_tokens"), get("input_tokens")).alias("input"), F.coalesce(get("completion_tokens"), get("output_tokens")).alias("output"), get("total_tokens").alias("total")
    )


def trace_input(system: Column, messages: Column) -> Column:
    """What a trace keeps of a request: the system text with the messages, if there is one."""
    return F.when(system.isNotNull(), F.struct(system.alias("system"), messages.alias("messages")))


def trace_stats(traces: DataFrame) -> DataFrame:
    """(name, is_total, n, p50, p95, max_ms, tok_in, tok_out) by step, and one row over all; percentiles are nearest-rank."""
    return traces.sparkSession.sql(
        """
        SELECT name, grouping(name) = 1 AS is_total, count(*) AS n,
               CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p50,
               CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p95,
               max(latency_ms) AS max_ms, sum(tok_in) AS tok_in, sum(tok_out) AS tok_out
        FROM {traces} GROUP BY GROUPING SETS ((name), ())
        """,
        traces=traces,
    )


def trace_rollup(traces: DataFrame) -> DataFrame:
    """(trace_id, calls, errors, wall_ms, tok_in, tok_out) of all calls of a trace."""
    return traces.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("errors"), latency_ms(F.min("start_time"), F.max("end_time")).alias("wall_ms"),
        F.sum("tok_in").alias("tok_in"), F.sum("tok_out").alias("tok_out"),
    )


def verdicts(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Judge answers as groundedness (0 to 1), citation_ok, answered and reason (300 characters); answers without JSON, or whose JSON is null, false, 0 or empty, are left out."""
    rows = raw.withColumn("_v", lenient_json(F.col(text_col))).filter(truthy(F.col("_v")))
    get = lambda k: F.try_variant_get(F.col("_v"), f"$.{k}", "variant")
    reason = F.coalesce(F.try_variant_get(F.col("_v"), "$.reason", "string"), F.lit(""))
    return rows.select(
        *[c for c in raw.columns if c != text_col], clamped(get("groundedness")).alias("groundedness"), truthy(get("citation_ok")).alias("citation_ok"),
        truthy(get("answered")).alias("answered"), F.substring(reason, 1, 300).alias("reason"),
    )


def eval_summary(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(n, groundedness, citation_accuracy, answered_rate, passed) over all verdicts."""
    g = F.avg("groundedness")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(g, 9).alias("groundedness"), F.round(F.avg(F.col("citation_ok").cast("int")), 9).alias("citation_accuracy"),
        F.round(F.avg(F.col("answered").cast("int")), 9).alias("answered_rate"), (g >= config.pass_mark).alias("passed"),
    )


def eval_contexts(rows: DataFrame, chunks: DataFrame, adversarial: bool = False, config: Config = DEFAULT) -> DataFrame:
    """(query_id, query, context) of rows (query_id, query, positive_id, candidate_ids): the positive chunk first, then others, three in all.

    Chunks are named by ``key``. Names without a chunk are dropped. Adversarial contexts leave the positive chunk out.
    """
    others = F.filter("candidate_ids", lambda c: c != F.col("positive_id"))
    ids = others if adversarial else F.concat(F.array("positive_id"), others)
    named = rows.select("query_id", "query", F.posexplode(F.slice(ids, 1, config.eval_context)).alias("i", "key"))
    found = named.hint("merge").join(chunks.select("key", "page", "section", "text"), "key")
    text = F.concat(F.lit("[trang "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" | "), F.coalesce("section", F.lit("không rõ mục")), F.lit("]\n"), F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"])  # three at most
    made = found.groupBy("query_id").agg(F.array_join(listed, "\n\n---\n\n").alias("context"))
    return rows.select("query_id", "query").hint("merge").join(made, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def evaluate(rows: DataFrame, chunks: DataFrame, answer, judge, adversarial: bool = False, config: Config = DEFAULT) -> DataFrame:
    """Verdicts of rows: ``answer(context, query)`` and ``judge(context, query, answer)`` are model functions of columns; failed rows are null and left out."""
    c = eval_contexts(rows, chunks, adversarial, config).withColumn("answer", answer(F.col("context"), F.col("query")))
    return verdicts(c.withColumn("raw", judge(F.col("context"), F.col("query"), F.col("answer"))).select("query_id", "raw"))


def first_rows(rows: DataFrame, n: int, by: str = "query_id") -> DataFrame:
    return rows.orderBy(by).limit(n)
