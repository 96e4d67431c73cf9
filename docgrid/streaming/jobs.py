"""Streaming jobs: continuous ingest, document status, trace statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrid.operators import history, models
from docgrid.plans.ingest import accept, ingest
from docgrid.shared import written
from docgrid.sources.files import RAW, TRACE_SCHEMA, described

#: Steps of a document, in order; the last two end them.
STATES = ("pending", "parsing", "embedding", "ready", "failed")
DOCUMENT_FIELDS = ("document_id", "user_id", "filename", "size_bytes", "uploaded_at", "content_hash", "doc_type", "status", "error", "page_count", "kept_id", "blob_key")
#: What is remembered of documents for later batches.
KNOWN = "user_id string, content_hash string, uploaded_at timestamp, document_id string, status string"


def ingest_stream(spark: SparkSession, source: str, target: str, user_id: str | None = None, pattern: str = "*.{pdf,docx}", files_per_batch: int | None = None, prep: bool = False, computers: dict = models.COMPUTERS, packed: bool = False, **options):
    """A query that ingests new files of a folder once each; call ``.start()`` on a trigger of your choice.

    Each batch writes its rows under its own number, so a batch that is repeated replaces itself. Documents are there as
    ``pending`` before any of them is read, and ``status`` holds an event for each step that they take (document_id, seq, status).
    Equal content of an owner in an earlier batch is found in the history of ready documents, of which only buckets that may hold a
    hash of the batch are read. The bytes of new files are kept once. ``files_per_batch`` bounds a batch.
    With ``packed`` the folder holds packs of files (see ``write_packs``), which are what ``files_per_batch`` counts.
    With ``prep`` the prep packs of new documents are computed after they are stored, and ``prep`` holds a row (document_id, kind, value,
    error) for each kind of each; their failure leaves the ingest, and other documents, as they are.
    """
    schema = "document_id string, user_id string, filename string, size_bytes long, uploaded_at timestamp, content_hash string, doc_type string, status string, error string, page_count int, kept_id string, blob_key string"

    kinds = [tuple(x.split()) for x in schema.split(", ")]

    def batch(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        rows = files.withColumn("user_id", F.lit(user_id).cast("string"))
        existing = history.recall(rows.select("content_hash"), f"{target}/history", KNOWN, number)
        accepted = written(accept(rows, existing, **{k: v for k, v in options.items() if k == "config"}))

        def store(documents: DataFrame) -> None:
            shown = [F.col(c) if c in documents.columns else F.lit(None).cast(dict(kinds)[c]).alias(c) for c in DOCUMENT_FIELDS]
            documents.select(*shown).write.mode("overwrite").parquet(f"{target}/documents/batch={number}")

        def tell(status: str, ids: DataFrame) -> None:
            seq = STATES.index(status)
            ids.select("document_id", F.lit(seq).alias("seq"), F.lit(status).alias("status")).write.mode("overwrite").parquet(f"{target}/status/batch={number}/step={seq}")

        store(accepted)
        tell("pending", accepted.filter("not reused"))
        documents, chunks = ingest(rows, existing, accepted=accepted, on_status=tell, blobs=f"{target}/blobs", batch=number, **options)
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        documents = written(documents)
        store(documents)
        history.remember(documents.filter(F.col("status") == "ready").select(*[x.split()[0] for x in KNOWN.split(", ")]), f"{target}/history", number)
        for status in ("ready", "failed"):
            tell(status, documents.filter(F.col("status") == status))
        if prep:
            # every kind and every document by itself: what fails is told beside what was made, and the ingest stays as it is
            ready = documents.filter(F.col("status") == "ready").select("document_id", "filename")
            none = ready.limit(0).select("document_id", *[F.lit(None).cast("string").alias(k) for k in models.KINDS])
            try:
                made = written(models.prep_results(ready, session.read.parquet(f"{target}/chunks/batch={number}"), none, computers))
                made.write.mode("overwrite").parquet(f"{target}/prep/batch={number}")
            except Exception as e:  # of what is not a computer's
                print(f"prep packs of batch {number} failed: {str(e)[:200]}")

    reader = spark.readStream.schema(RAW)
    reader = reader.format("parquet") if packed else reader.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)
    return described(stream).writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/_checkpoint")


def status_stream(events: DataFrame) -> DataFrame:
    """The latest status of each document of a stream of status events, for update mode."""
    last = events.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))
    return last.withColumn("terminal", F.col("status").isin("ready", "failed"))


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """Statistics by step of a growing folder of traces; percentiles are approximate, as exact ones need all rows."""
    rows = spark.readStream.schema(TRACE_SCHEMA).json(path)
    return rows.groupBy(F.coalesce("name", F.lit("llm-call")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_percentile("latencyMs", 0.5).alias("p50"),
        F.approx_percentile("latencyMs", 0.95).alias("p95"),
        F.max("latencyMs").alias("max_ms"),
        F.sum("usage.input").alias("tok_in"),
        F.sum("usage.output").alias("tok_out"),
    )


def status_machine(events: DataFrame, lateness: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """(document_id, seq, before, status, kind) of a stream of status events (document_id, seq, status, at), for update mode.

    A ``status`` row is the latest status of a document that a batch had events of, an ``illegal`` row a step that no
    document takes, a ``late`` row an event that comes after one with a greater or equal seq; late events change
    nothing. What is kept of a document is its last seq and status, and once the watermark (``lateness`` behind the latest ``at``) is ``keep_ms`` past its end, nothing.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(events.dtypes)["document_id"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, before = state.get if state.exists else (None, None)
        out, latest = [], 0
        for row in pd.concat(list(parts)).sort_values(["seq", "status"]).itertuples(index=False):  # of one document in one batch
            latest = max(latest, int(row.ms))
            if seq is not None and row.seq <= seq:
                out.append((row.seq, before, row.status, "late"))
                continue
            if before is not None and not legal_step(before, row.status):
                out.append((row.seq, before, row.status, "illegal"))
            seq, before = row.seq, row.status
        out.append((seq, None, before, "status"))
        state.update((int(seq), before))
        if before in STATES[-2:]:
            state.setTimeoutTimestamp(max(latest + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"document_id": [key[0]] * len(out), **{c: [o[k] for o in out] for k, c in enumerate(("seq", "before", "status", "kind"))}})

    rows = events.withWatermark("at", lateness).select("document_id", F.col("seq").cast("long").alias("seq"), "status", "at", F.unix_millis("at").alias("ms"))
    rows = rows.filter("document_id is not null and seq is not null and status is not null and at is not null")
    return rows.groupBy("document_id").applyInPandasWithState(
        step, f"document_id {kind}, seq long, before string, status string, kind string", "seq long, status string", "update", GroupStateTimeout.EventTimeTimeout
    )


def legal_step(before: str, after: str) -> bool:
    """Whether a document goes from one state to the other: to the next one, or from any that has not ended to failed."""
    return before not in STATES[-2:] if after == STATES[-1] else STATES.index(after) == STATES.index(before) + 1


#: Quotient of the bounds of a cell of latencies; an estimate differs from the exact percentile by one part in a hundred at most.
CELL = 1.02


def latency_cells(traces: DataFrame, *by: Column | str) -> DataFrame:
    """(``by``, cell, n, max_ms, tok_in, tok_out): traces (latency_ms, tok_in, tok_out) counted by cells of latencies; sums of such rows are sketches, too.

    Cell c holds latencies over CELL^(c-1) and up to CELL^c; a null cell those of 0 and less.
    """
    cell = F.when(F.col("latency_ms") > 0, F.ceil(F.round(F.log(F.col("latency_ms").cast("double")) / math.log(CELL), 9)))
    sums = [F.sum(c).cast("long").alias(c) for c in ("tok_in", "tok_out")]
    return traces.groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("max_ms"), *sums)


def sketch_stats(cells: DataFrame, *by: str) -> DataFrame:
    """(``by``, n, p50, p95, max_ms, tok_in, tok_out) of sketches, merged; percentiles are nearest-rank, by the middle of their cell."""
    merged = cells.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.max("max_ms").alias("max_ms"), F.sum("tok_in").alias("tok_in"), F.sum("tok_out").alias("tok_out"))
    w = Window.partitionBy(*by)
    along = w.orderBy(F.asc_nulls_first("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = merged.withColumn("_to", F.sum("n").over(along)).withColumn("_all", F.sum("n").over(w))
    value = F.coalesce(F.round(F.lit(2 / (1 + CELL)) * F.pow(F.lit(CELL), F.col("cell")), 6), F.lit(0.0))
    at = lambda p: F.min(F.when(F.col("_to") >= F.ceil(F.lit(p) * F.col("_all")), value))
    sums = [F.sum(c).cast("long").alias(c) for c in ("tok_in", "tok_out")]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("max_ms").alias("max_ms"), *sums)


def window_sketches(traces: DataFrame, target: str, width: str = "1 hour", lateness: str = "10 minutes"):
    """A query that keeps sketches (start, name, cell, ...) of a stream of traces (start_time, name, latency_ms, tok_in, tok_out) by windows of event time.

    A batch writes the sums that it has changed under its number; ``read_sketches`` takes the last ones. Windows that ended ``lateness`` before the latest
    trace leave the state; traces that come later than that are left out, and the query's progress counts them.
    """
    timed = traces.withWatermark("start_time", lateness)
    cells = latency_cells(timed, F.window("start_time", width).alias("w"), "name")
    flat = cells.select(F.col("w.start").alias("start"), "name", "cell", "n", "max_ms", "tok_in", "tok_out")

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/sketches/batch={number}")

    return flat.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{target}/_checkpoint")


def read_sketches(spark: SparkSession, target: str) -> DataFrame:
    """The sketches that a stream has written: of each cell of a window the last sums."""
    rows = spark.read.parquet(f"{target}/sketches")
    last = F.struct("n", "max_ms", "tok_in", "tok_out")
    return rows.groupBy("start", "name", "cell").agg(F.max_by(last, "batch").alias("x")).select("start", "name", "cell", "x.*")
