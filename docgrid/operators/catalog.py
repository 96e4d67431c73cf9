"""Catalog tables: listing, access, dedup, upserts, deletes, constraints.

Upserts and deletes are functions from the current table and a batch to the new table; the caller
writes the result to a new path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import doc_type_label, is_ready, iso_time, status_kind, status_label, suffix_of
from docgrid.shared import few


def admission(uploads: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``uploads`` (filename, size_bytes, ...) with ``doc_type`` and ``reject_reason`` (null: admitted)."""
    suffix = suffix_of(F.col("filename"))
    known = suffix.isin(*config.doc_types)
    reason = F.when(~known, "unsupported type").when(F.col("size_bytes") > config.max_upload_bytes, "too large")
    return uploads.withColumn("doc_type", F.when(known, suffix)).withColumn("reject_reason", reason)


def list_documents(documents: DataFrame, chunk_counts: DataFrame, user_id=None, doc_type=None, date_from=None, date_to=None, keyword=None) -> DataFrame:
    """The documents of an owner, newest first, with their number of chunks; each filter is off when it is null.

    The keyword is matched anywhere in the file name, in either case, with ``%`` and ``_`` as wildcards.
    """
    conditions = [F.col("user_id") == F.lit(user_id)]
    if doc_type not in (None, "", "all"):
        conditions.append(F.col("doc_type") == doc_type)
    if date_from:
        conditions.append(F.col("uploaded_at") >= F.lit(date_from).cast("date"))
    if date_to:
        conditions.append(F.col("uploaded_at") < F.date_add(F.lit(date_to).cast("date"), 1))
    if keyword:
        conditions.append(F.col("filename").ilike(f"%{keyword}%"))
    own = documents.filter(reduce(lambda a, b: a & b, conditions))
    rows = with_counts(own, chunk_counts)
    return rows.select(
        "document_id", "filename", "doc_type", "status", "n_chunks", iso_time(F.col("uploaded_at")).alias("uploaded_at"),
        status_label(F.col("status")).alias("status_label"), status_kind(F.col("status")).alias("status_kind"),
        is_ready(F.col("status")).alias("ready"), doc_type_label(F.col("doc_type")).alias("type_label"),
    ).orderBy(F.desc("uploaded_at"), "document_id")


def with_counts(documents: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Documents with ``n_chunks``, 0 where there are none."""
    return documents.hint("merge").join(chunk_counts, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def ingest_report(chunks: DataFrame) -> DataFrame:
    """Chunks, chunks with a page and chunks with a section of each document."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("page").alias("n_pages"), F.count("section").alias("n_sections"))


def full_documents(chunks: DataFrame) -> DataFrame:
    """All chunks in reading order without vectors."""
    return chunks.select("document_id", "chunk_id", "position", "page", "section", "text").orderBy("document_id", "position")


def document_status(documents: DataFrame, counts: DataFrame) -> DataFrame:
    return with_counts(documents.select("document_id", "filename", "doc_type", "status"), counts)


def owners(documents: DataFrame) -> DataFrame:
    """(document_id, user_id): a missing row and a null owner stay different."""
    return documents.select("document_id", "user_id")


def access(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests`` (session_user, document_id) with ``code``: 401 without a session, 404 for a document that is missing, unowned or someone else's, else 200."""
    owned = owners(documents).withColumn("_there", F.lit(True))
    rows = requests.join(owned, "document_id", "left")
    code = F.when(F.col("session_user").isNull(), 401).when(F.col("_there").isNull() | F.col("user_id").isNull() | (F.col("user_id") != F.col("session_user")), 404)
    return rows.select(*requests.columns, code.otherwise(200).alias("code"))


def file_lookup(requests: DataFrame, documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """``requests`` (document_id) with file name, media type and ``state``: no such document, file not stored, or stored."""
    media = F.when(F.col("doc_type") == "pdf", "application/pdf").when(
        F.col("doc_type") == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    ).otherwise("application/octet-stream")
    docs = documents.select("document_id", "filename", "doc_type", "blob_key", F.lit(True).alias("_doc"))
    rows = requests.join(docs, "document_id", "left").join(blobs.select("blob_key", F.lit(True).alias("_blob")), "blob_key", "left")
    state = F.when(F.col("_doc").isNull(), "no such document").when(F.col("_blob").isNull(), "file not stored").otherwise("stored")
    return rows.select("document_id", "filename", F.when(F.col("_doc"), media).alias("media_type"), state.alias("state"))


def blob_table(uploads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(blob_key, content_hash, size_bytes, document_id): new blobs, one for equal bytes and extension; the first upload wins, stored ones stay."""
    keyed = uploads.withColumn("blob_key", F.concat_ws(".", "content_hash", suffix_of(F.col("filename"))))
    first = keyed.groupBy("blob_key").agg(F.min_by(F.struct("content_hash", "size_bytes", "document_id"), F.struct("uploaded_at", "document_id")).alias("x"))
    new = first.select("blob_key", "x.*")
    return new if stored is None else new.join(stored.select("blob_key"), "blob_key", "left_anti")


def dedup(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``batch`` with ``kept_id`` and ``reused``: for each owner (null is one) and content the earliest document that has not failed.

    A failed row never stands for others and is never replaced. Rows without a hash stay themselves.
    """
    live = batch.filter("status <> 'failed' and content_hash is not null").select("user_id", "content_hash", "uploaded_at", "document_id", F.lit(1).alias("_age"))
    if existing is not None:
        old = existing.filter("status <> 'failed' and content_hash is not null")
        old = old.join(few(live.select("content_hash").distinct()), "content_hash", "left_semi")  # what the batch may repeat
        live = live.unionByName(old.select("user_id", "content_hash", "uploaded_at", "document_id", F.lit(0).alias("_age")))
    first = live.groupBy("user_id", "content_hash").agg(F.min_by("document_id", F.struct("_age", "uploaded_at", "document_id")).alias("_first"))
    on = F.col("b.user_id").eqNullSafe(F.col("f.user_id")) & (F.col("b.content_hash") == F.col("f.content_hash"))
    rows = batch.alias("b").join(first.alias("f"), on, "left").select("b.*", "f._first")
    kept = F.when(F.col("status") == "failed", F.col("document_id")).otherwise(F.coalesce("_first", "document_id"))
    return rows.withColumn("kept_id", kept).withColumn("reused", F.col("kept_id") != F.col("document_id")).drop("_first")


def upsert_users(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The users table after logins (github_id, username, name, avatar_url, at): the newest login of a batch wins; first seen times stay."""
    new = updates.groupBy("github_id").agg(F.max_by(F.struct("username", "name", "avatar_url", "at"), "at").alias("n"))
    rows = current.alias("c").join(new.alias("u"), F.col("c.github_id") == F.col("u.github_id"), "full_outer")
    pick = lambda c: F.when(F.col("u.github_id").isNotNull(), F.col(f"u.n.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    return rows.select(
        F.coalesce("c.github_id", "u.github_id").alias("github_id"),
        pick("username"),
        pick("name"),
        pick("avatar_url"),
        F.coalesce("c.created_at", "u.n.at").alias("created_at"),
        F.coalesce("u.n.at", "c.last_login_at").alias("last_login_at"),
    )


def cascade_delete(tables: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given documents and what hangs on them (documents, chunks, prep, sessions, messages)."""
    out = {k: v.hint("merge").join(document_ids.select("document_id"), "document_id", "left_anti") for k, v in tables.items() if k != "messages"}
    if "messages" in tables:
        out["messages"] = tables["messages"].hint("merge").join(out["sessions"].select("session_id"), "session_id", "left_semi")
    return out


def delete_users(users: DataFrame, tables: dict[str, DataFrame], user_ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Users and tables without the given users, their documents and what hangs on these."""
    gone = tables["documents"].join(user_ids.select("user_id"), "user_id", "left_semi")
    return users.join(user_ids.select("user_id"), "user_id", "left_anti"), cascade_delete(tables, gone)


def constraint_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, violations) of the declared keys, enumerations, required columns and references."""
    one = lambda rule, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    live = documents.filter("status <> 'failed' and content_hash is not null and user_id is not null")
    parts = [
        one("doc_type", documents.filter("doc_type is null or doc_type not in ('pdf', 'docx')")),
        one("status", documents.filter("status not in ('pending', 'parsing', 'embedding', 'ready', 'failed')")),
        one("owner_content_unique", live.groupBy("user_id", "content_hash").count().filter("count > 1")),
        one("position_unique", chunks.groupBy("document_id", "position").count().filter("count > 1")),
        one("chunk_text", chunks.filter("text is null")),
        one("chunk_document", chunks.hint("merge").join(documents.select("document_id"), "document_id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, parts)


def schema_report(df: DataFrame, expected: dict[str, str], vector: str | None = None, dim: int = DEFAULT.embedding_dim) -> DataFrame:
    """(column, expected, found, ok) of declared columns, and one row for the vector's size."""
    found = dict(df.dtypes)
    rows = [(c, t, found.get(c), found.get(c) == t) for c, t in expected.items()]
    out = df.sparkSession.createDataFrame(rows, "column string, expected string, found string, ok boolean")
    if vector is None:
        return out
    bad = df.agg(F.count(F.when(~F.coalesce(F.size(vector) == dim, F.lit(False)), 1)).alias("n"))
    return out.unionByName(bad.select(F.lit(f"size({vector})").alias("column"), F.lit(str(dim)).alias("expected"), F.concat("n", F.lit(" others")).alias("found"), (F.col("n") == 0).alias("ok")))


def latest_status(events: DataFrame) -> DataFrame:
    """(document_id, status, terminal) from status events (document_id, seq, status)."""
    last = events.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))
    return last.withColumn("terminal", F.col("status").isin("ready", "failed"))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events whose status does not come after the one before it in pending, parsing, embedding, ready; failed may follow any that is not final."""
    place = lambda c: F.element_at(F.create_map(*[x for k, s in enumerate(("pending", "parsing", "embedding", "ready", "failed")) for x in (F.lit(s), F.lit(k))]), c)
    before = F.lag("status").over(Window.partitionBy("document_id").orderBy("seq"))
    rows = events.withColumn("before", before).filter("before is not null")
    legal = F.when(F.col("status") == "failed", ~F.col("before").isin("ready", "failed")).otherwise((place(F.col("status")) == place(F.col("before")) + 1) & (F.col("before") != "failed"))
    return rows.filter(~F.coalesce(legal, F.lit(False))).select("document_id", "seq", "before", "status")
