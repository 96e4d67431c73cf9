"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(v: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def query_terms(question: Column, config: Config = DEFAULT) -> Column:
    """Distinct lower-case tokens of two characters and more without stop words, in order; null if none is left."""
    tokens = F.transform(F.regexp_extract_all(question, F.lit("([0-9A-Za-zÀ-ỹ]+)"), 1), lambda t: F.lower(t))
    stop = F.array(*[F.lit(w) for w in config.stop_words])
    kept = F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))
    return F.when(F.size(kept) > 0, kept)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def iso_time(ts: Column) -> Column:
    """Time with seconds and the offset in hours, as ``2024-01-01T00:00:00+00``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssx")


def uploaded_label(iso: Column, now: Column) -> Column:
    """Today, yesterday or the date, with hour and minute, of a time stated as ISO text."""
    day, clock = F.substring(iso, 1, 10), F.substring(iso, 12, 5)
    on = lambda d: F.date_format(d, "yyyy-MM-dd")
    dated = F.concat_ws("/", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4))
    head = F.when(day == on(now), F.lit("Hôm nay")).when(day == on(now - F.expr("INTERVAL 24 HOURS")), F.lit("Hôm qua")).otherwise(dated)
    return F.concat(head, F.lit(", "), clock)


def status_label(status: Column) -> Column:
    return F.when(status == "ready", "Sẵn sàng").when(status == "failed", "Lỗi xử lý").otherwise("Đang xử lý")


def status_kind(status: Column) -> Column:
    return F.when(status == "ready", "ok").when(status == "failed", "err").otherwise("warn")


def is_ready(status: Column) -> Column:
    return F.coalesce(status == "ready", F.lit(False))


def doc_type_label(doc_type: Column) -> Column:
    return F.when(doc_type == "docx", "Word").otherwise("PDF")


def strip_enumeration(text: Column) -> Column:
    """A text without a leading ``1.`` or ``2)``."""
    return F.regexp_replace(text, r"^\s*\d+[.)]\s*", "")


def citation_parts(page: Column, section: Column) -> Column:
    """Page and section, whichever are there, separated by a comma; empty if neither is."""
    named = F.when(F.length(section) > 0, section)
    return F.concat_ws(", ", F.concat(F.lit("trang "), page.cast("string")), named)


def citation_label(page: Column, section: Column) -> Column:
    parts = citation_parts(page, section)
    return F.when(parts == "", "nguồn").otherwise(parts)


def suffix_of(filename: Column) -> Column:
    """Lower-case extension, empty if there is none."""
    return F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))


def lenient_json(text: Column) -> Column:
    """The text parsed as JSON, else the part from its first to its last brace, else null; a variant."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    """Whether a variant counts as true: but for false, null, zero and the empty text all do, empty lists and objects, too."""
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    held = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "VOID", False)
    return F.coalesce(held.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), (number != 0) & ~F.isnan(number)).otherwise(v.isNotNull()), F.lit(False))


def clamped(v: Column) -> Column:
    """A variant as a number held between 0 and 1: numbers, texts of numbers, and booleans as 0 and 1; anything else is 0."""
    kind = _kind(v)
    number = F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
    number = F.coalesce(number.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double")), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(number), 0.0).otherwise(number)))


def document_id_of(line: Column) -> Column:
    """The id after ``document_id=`` in a log line; null if there is none."""
    found = F.regexp_extract(line, r"document_id=([0-9a-fA-F-]{36})", 1)
    return F.when(found != "", found)


def latency_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def message_text(parts: Column) -> Column:
    """All text parts of a message (array of struct<type, text>), in order; empty if there is none."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def word_count(text: Column) -> Column:
    """The default token counter: white-space separated words."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+"))).cast("int")
