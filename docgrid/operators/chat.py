"""Chat sessions, messages, history and context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import citation_label, citation_parts, message_text
from docgrid.shared import cut, few

#: Fixed value: the instruction that precedes the context of a question.
SYSTEM_PROMPT = (
    "Bạn là trợ lý giúp cán bộ hiểu tài liệu chuẩn bị họp. Trả lời bằng tiếng Việt, ngắn gọn, chính xác, CHỈ dựa trên phần <context> được cung cấp. "
    "Nếu context không đủ để trả lời, hãy nói rõ là không tìm thấy trong tài liệu. LUÔN trích dẫn nguồn theo trang/Điều trong ngoặc ngay sau ý liên quan, "
    "ví dụ: (trang 3, Điều 1)."
)


def get_or_create_sessions(sessions: DataFrame, document_ids: DataFrame, at: Column) -> DataFrame:
    """Sessions (session_id, document_id, created_at, updated_at) with one for each given document; those that exist are touched."""
    asked = document_ids.select("document_id").distinct().withColumn("_asked", F.lit(True))
    rows = sessions.join(asked, "document_id", "full_outer")
    fresh = F.sha2(F.concat(F.lit("session:"), F.col("document_id").cast("string")), 256)
    return rows.select(
        F.coalesce("session_id", fresh).alias("session_id"), "document_id", F.coalesce("created_at", at).alias("created_at"),
        F.when(F.col("_asked"), F.greatest("updated_at", at)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def append_messages(messages: DataFrame, batch: DataFrame) -> DataFrame:
    """Messages (id, session_id, role, parts, metadata, sort_order) with a batch (the same and ``seq`` instead of sort_order) added.

    An id that is there already, or twice in the batch, is added once. New messages of a session go on
    after its last sort_order, in the order of ``seq``.
    """
    w = Window.partitionBy("id").orderBy("seq")
    new = batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(messages.select("id"), "id", "left_anti")
    last = messages.groupBy("session_id").agg(F.max("sort_order").alias("_last"))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "id"))
    new = new.withColumn("_o", order).join(last, "session_id", "left").withColumn("sort_order", (F.coalesce("_last", F.lit(-1)) + F.col("_o")).cast("int"))
    return messages.unionByName(new.select(*messages.columns))


def turn_rows(answers: DataFrame) -> DataFrame:
    """A batch for ``append_messages`` of answered questions (session_id, turn, question, answer, finished, metadata): the user's message, then the answer; unfinished ones are left out."""
    done = answers.filter("finished")
    part = lambda c: F.array(F.struct(F.lit("text").alias("type"), F.col(c).alias("text")))
    row = lambda role, k, meta: done.select(
        F.concat_ws("-", "session_id", "turn", F.lit(role)).alias("id"), "session_id", F.lit(role).alias("role"),
        part("question" if role == "user" else "answer").alias("parts"), meta.alias("metadata"), (F.col("turn") * 2 + k).cast("long").alias("seq"),
    )
    return row("user", 0, F.lit(None).cast("string")).unionByName(row("assistant", 1, F.col("metadata").cast("string")))


def document_messages(messages: DataFrame, sessions: DataFrame, on: list[str]) -> DataFrame:
    """All messages with the document of their session, in no order."""
    return messages.join(sessions.select(*on, "document_id"), on).select("document_id", "id", "role", "parts", "metadata", "sort_order")


def chat_history(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """All messages with their document, in order."""
    return document_messages(messages, sessions, ["session_id"]).orderBy("document_id", "sort_order")


def latest_questions(messages: DataFrame) -> DataFrame:
    """(session_id, sort_order, question): the last user message of each session."""
    last = messages.filter("role = 'user'").groupBy("session_id").agg(F.max_by(F.struct("sort_order", "parts"), "sort_order").alias("m"))
    return last.select("session_id", "m.sort_order", message_text(F.col("m.parts")).alias("question"))


def history(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(session_id, sort_order, role, content): the last turns with text of each session, without its latest question."""
    q = latest_questions(messages).select("session_id", F.col("sort_order").alias("_q"))
    rows = messages.join(q, "session_id").filter("sort_order <> _q and role in ('user', 'assistant')")
    rows = rows.withColumn("content", message_text(F.col("parts"))).filter("content <> ''")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("sort_order")))
    return rows.withColumn("_n", n).filter(F.col("_n") <= config.history_turns).select("session_id", "sort_order", "role", "content")


def recent_messages(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("sort_order")))
    return messages.withColumn("_n", n).filter(F.col("_n") <= config.recent_messages).drop("_n")


def context_texts(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, context): the results of a question as numbered texts with their place, in order."""
    rows = chunks.select("chunk_id", "page", "section", "text").join(few(cut(results.select("question_id", "chunk_id", "ord"))), "chunk_id")
    cite = citation_parts(F.col("page"), F.col("section"))
    rows = rows.withColumn("_c", F.when(cite != "", F.concat(F.lit(" ("), cite, F.lit(")"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("ord", "_c", "text")))  # bounded by the results of one question
    shown = F.transform(listed, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), x["_c"], F.lit("\n"), x["text"]))
    return rows.groupBy("question_id").agg(F.array_join(shown, "\n\n---\n\n").alias("context"))


def system_prompts(contexts: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    return contexts.withColumn("system", F.concat(F.lit(prompt + "\n\n<context>\n"), F.col("context"), F.lit("\n</context>")))


def distinct_sources(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, label, chunk_id, ord): for each question the first result of each citation label, in order."""
    rows = chunks.select("chunk_id", "page", "section").join(few(cut(results.select("question_id", "chunk_id", "ord"))), "chunk_id")
    rows = rows.withColumn("label", citation_label(F.col("page"), F.col("section")))
    first = rows.groupBy("question_id", "label").agg(F.min_by(F.struct("chunk_id", "ord"), "ord").alias("x"))
    return first.select("question_id", "label", "x.chunk_id", "x.ord")


def plan_prompts(questions: DataFrame, turns: DataFrame, instruction: str = "") -> DataFrame:
    """(session_id, prompt): the instruction, earlier turns and the question of each session."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    before = turns.groupBy("session_id").agg(F.array_join(told, "\n").alias("_t"))  # a few turns of one session
    rows = questions.join(before, "session_id", "left")
    head = F.when(F.col("_t").isNotNull(), F.concat(F.lit("# HỘI THOẠI\n"), F.col("_t"), F.lit("\n\n"))).otherwise("")
    return rows.select("session_id", F.concat(F.lit(instruction), head, F.lit("# CÂU HỎI\n"), F.col("question")).alias("prompt"))
