"""Parameters with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # fixed values: admission and ingest
    max_upload_bytes: int = 25 * 1024 * 1024
    doc_types: tuple[str, ...] = ("pdf", "docx")
    chunk_max_tokens: int = 400
    chunk_overlap_tokens: int = 60
    chunk_min_chars: int = 40
    passage_prefix: str = "passage: "
    query_prefix: str = "query: "
    embedding_dim: int = 64
    # fixed values: retrieval
    top_k: int = 10
    over_fetch: int = 6
    rrf_k: int = 60
    min_chunk_chars: int = 30
    neighbor_radius: int = 1
    expand_top: int = 5
    rerank_candidates: int = 30
    ask_top_k: int = 6
    ask_max_chunks: int = 12
    most_subqueries: int = 5
    rewrite_max_chars: int = 160
    # fixed values: documents as a whole
    map_group_chars: int = 30_000
    pass_mark: float = 0.75
    history_turns: int = 6
    recent_messages: int = 20
    eval_context: int = 3
    # fixed values: the section header and the stop words of the lexical query
    header: str = r"(?iU)^\s*(Điều\s+\d+)"
    stop_words: tuple[str, ...] = field(
        default=(
            "của", "này", "là", "và", "các", "những", "một", "có", "cho", "được", "gì", "ở", "với", "để", "về", "theo",
            "trong", "khi", "như", "đã", "sẽ", "bị", "gồm", "nào", "ra", "đến", "hay", "thì", "mà", "cũng", "vào",
        )
    )


DEFAULT = Config()
