"""Invariants of retrieval, catalog, chat, models and evaluation on small tables."""

import dataclasses
import math
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from docgrid.functions import columns as C
from docgrid.operators import catalog, chat, evaluation, models, retrieval, spans


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_query_terms(spark):
    f = lambda t: one(spark, t, "string", C.query_terms)
    assert f("Quan điểm của quan ĐIỂM là gì a") == ["quan", "điểm"]
    assert f("là gì của") is None and f("") is None and f(None) is None


@pytest.fixture(scope="module")
def small(spark):
    unit = lambda a: [1 / math.hypot(1, a), a / math.hypot(1, a)]
    rows = [(0, "d", 0, 1, "s", "the needle keyword stands in this long enough chunk", unit(50.0)), (1, "d", 1, 1, None, "the closest chunk of all by its vector alone", unit(0.0)), (2, "d", 2, None, "s", "tiny", unit(0.0))]
    rows += [(i, "d", i, 2, "s", f"distractor number {i} with enough characters in it", unit(float(i))) for i in range(3, 13)]
    rows += [(99, "other", 0, 1, "s", "the needle keyword of a foreign document, long enough", unit(0.0))]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, position int, page int, section string, text string, embedding array<double>")
    return chunks, spark.createDataFrame([(1, "d", "needle", [1.0, 0.0]), (2, "none", "needle", [1.0, 0.0])], "question_id long, document_id string, question string, embedding array<double>")


def test_hybrid_retrieval(small):
    chunks, questions = small
    found = retrieval.hybrid_retrieval(questions, chunks, 3).orderBy("ord").collect()
    assert {r.question_id for r in found} == {1}
    assert found[0].position == 0  # both arms
    ids = [r.position for r in found]
    assert 2 not in ids and 1 in ids and len(ids) == len(set(ids))
    scores = [r.score for r in found]
    assert scores == sorted(scores, reverse=True) and scores[-1] == 0.0
    after = [r.position for r in found if r.score == 0]
    assert after == sorted(after)


def test_rrf_and_merge(spark):
    ranked = spark.createDataFrame([(1, i, r) for ids in ("abc", "bxa") for r, i in enumerate(ids)], "q int, id string, rank int")
    s = {r.id: r.score for r in retrieval.rrf(ranked, ["q", "id"]).collect()}
    assert s["b"] > s["a"] > s["x"] > s["c"] and s["b"] == pytest.approx(1 / 62 + 1 / 61)
    rows = [(1, 0, 0, 5, 50), (1, 0, 1, 6, 60), (1, 1, 0, 7, 70), (1, 1, 1, 6, 61), (1, 1, 2, 8, 80)]
    results = spark.createDataFrame(rows, "question_id int, sq_index int, rank int, position int, chunk_id int")
    got = retrieval.merge_subqueries(results, 3).orderBy("ord").collect()
    assert [r.position for r in got] == [6, 5, 7] and got[0].chunk_id == 60


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "q", "a", 0), (1, "q", "b", 1), (1, "q", "c", 2), (2, "q", "x", 0), (2, "q", "c", 1)], "question_id int, question string, text string, ord int")
    scorer = lambda q, t: F.when(t == "a", 0.1).when(t == "b", 0.9).when(t == "c", 0.5)
    got = [(r.question_id, r.text) for r in retrieval.rerank(rows, scorer, 2).orderBy("question_id", "ord").collect()]
    assert got == [(1, "b"), (1, "c"), (2, "x"), (2, "c")]  # a failing pair leaves its question as it was


def uploads(spark, rows):
    return spark.createDataFrame(rows, "document_id string, user_id string, filename string, size_bytes long, content_hash string, status string, uploaded_at int")


def test_dedup(spark):
    rows = [("1", "u", "a.pdf", 1, "h", "failed", 0), ("2", "u", "a.pdf", 1, "h", "ready", 1), ("3", "u", "b.pdf", 1, "h", "pending", 2), ("4", "v", "a.pdf", 1, "h", "pending", 3), ("5", None, "a.pdf", 1, "h", "pending", 4), ("6", None, "a.pdf", 1, "h", "pending", 5)]
    got = {r.document_id: r.kept_id for r in catalog.dedup(uploads(spark, rows)).collect()}
    assert got == {"1": "1", "2": "2", "3": "2", "4": "4", "5": "5", "6": "5"}
    old = uploads(spark, [("0", "v", "z.pdf", 1, "h", "ready", 9)])
    assert {r.document_id: r.kept_id for r in catalog.dedup(uploads(spark, rows), old).collect()}["4"] == "0"


def test_admission(spark):
    mb = 1024 * 1024
    rows = [("1", "u", "a.PDF", 25 * mb, "h", "p", 0), ("2", "u", "a.docx", 25 * mb + 1, "h", "p", 0), ("3", "u", "a.txt", 1, "h", "p", 0), ("4", "u", "noext", 1, "h", "p", 0)]
    got = {r.document_id: (r.doc_type, r.reject_reason) for r in catalog.admission(uploads(spark, rows)).collect()}
    assert got == {"1": ("pdf", None), "2": ("docx", "too large"), "3": (None, "unsupported type"), "4": (None, "unsupported type")}


def test_access(spark):
    docs = spark.createDataFrame([("a", "u"), ("b", None)], "document_id string, user_id string")
    asked = spark.createDataFrame([("u", "a"), (None, "a"), ("v", "a"), ("u", "b"), ("u", "zz")], "session_user string, document_id string")
    assert [r.code for r in catalog.access(asked, docs).orderBy("document_id", F.asc_nulls_first("session_user")).collect()] == [401, 200, 404, 404, 404]


def test_blobs_keep_the_first(spark):
    u = uploads(spark, [("1", "u", "a.pdf", 1, "h", "r", 2), ("2", "v", "b.PDF", 1, "h", "r", 1), ("3", "v", "b.docx", 1, "h", "r", 3)])
    got = catalog.blob_table(u)
    assert {(r.blob_key, r.document_id) for r in got.collect()} == {("h.pdf", "2"), ("h.docx", "3")}
    assert catalog.blob_table(u, got.filter("blob_key = 'h.pdf'")).count() == 1


def test_users_and_cascade(spark):
    users = spark.createDataFrame([(1, "a")], "user_id int, username string")
    docs = spark.createDataFrame([("d", 1), ("e", 2)], "document_id string, user_id int")
    sessions = spark.createDataFrame([("s", "d"), ("t", "e")], "session_id string, document_id string")
    messages = spark.createDataFrame([("m", "s"), ("n", "t")], "id string, session_id string")
    left, tables = catalog.delete_users(users, {"documents": docs, "sessions": sessions, "messages": messages}, users.select("user_id"))
    assert left.count() == 0
    assert [r.document_id for r in tables["documents"].collect()] == ["e"] and [r.id for r in tables["messages"].collect()] == ["n"]


def test_schema_report(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    rows = {r.column: r.ok for r in catalog.schema_report(df, {"embedding": "array<double>", "gone": "int"}, "embedding", 2).collect()}
    assert rows == {"embedding": True, "gone": False, "size(embedding)": False}


MESSAGE = "id string, session_id string, role string, parts array<struct<type:string,text:string>>, metadata string, sort_order int"


def message(i, session, role, text, order):
    return (i, session, role, [("text", text), ("image", "no"), ("text", "!")] if text else [], None, order)


def test_chat(spark):
    rows = [message(f"m{k}", "s", "assistant" if k % 2 else "user", f"t{k}", k) for k in range(9)] + [message("x", "s", "system", "sys", 100), message("y", "s", "assistant", "", 101)]
    m = spark.createDataFrame(rows, MESSAGE)
    assert [(r.sort_order, r.question) for r in chat.latest_questions(m).collect()] == [(8, "t8!")]
    assert [r.content for r in chat.history(m).orderBy("sort_order").collect()] == [f"t{k}!" for k in range(2, 8)]
    batch = spark.createDataFrame([("m3", "s", "user", [], None, 1), ("new", "s", "user", [], None, 2), ("new", "s", "user", [], None, 3), ("first", "z", "user", [], None, 1)], MESSAGE.replace("sort_order int", "seq long"))
    got = {r.id: r.sort_order for r in chat.append_messages(m, batch).collect()}
    assert got["new"] == 102 and got["first"] == 0 and got["m3"] == 3 and len(got) == len(rows) + 2


def test_labels(spark):
    rows = [(3, "Điều 1", "trang 3, Điều 1"), (None, "Điều 5", "Điều 5"), (3, None, "trang 3"), (None, None, "nguồn"), (2, "", "trang 2")]
    df = spark.createDataFrame(rows, "p int, s string, want string").withColumn("got", C.citation_label(F.col("p"), F.col("s")))
    assert df.filter("not got <=> want").count() == 0
    now = F.lit("2024-05-02 08:00:00").cast("timestamp")
    f = lambda t: one(spark, t, "string", lambda x: C.uploaded_label(x, now))
    assert f("2024-05-02T07:15:00+00") == "Hôm nay, 07:15" and f("2024-05-01T23:59:00+00") == "Hôm qua, 23:59" and f("2023-12-31T01:02:00+00") == "31/12/2023, 01:02"
    g = lambda t: one(spark, t, "string", C.strip_enumeration)
    assert [g("1. a"), g(" 12) b"), g("no 1. c"), g("2024 d")] == ["a", "b", "no 1. c", "2024 d"]
    assert one(spark, "INFO document_id=123e4567-e89b-12d3-a456-426614174000 ok", "string", C.document_id_of) == "123e4567-e89b-12d3-a456-426614174000"
    assert one(spark, b"hello", "binary", C.content_hash) == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_rewrites_and_plans(spark):
    rows = [("q", " better "), ("q", "a\nb"), ("q", "x" * 161), ("q", None), ("q", " ")]
    df = spark.createDataFrame(rows, "q string, r string")
    assert [r.y for r in df.select(models.accept_rewrite(F.col("q"), F.col("r")).alias("y")).collect()] == ["better", "q", "q", "q", "q"]
    q = spark.createDataFrame([(1, "d", "ask")], "question_id int, document_id string, question string")
    six = lambda c: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(F.concat(c, i.cast("string")).alias("query"), F.lit("f").alias("focus")))
    assert [r.query for r in models.plan(q, six).collect()] == [f"ask{k}" for k in range(1, 6)]
    assert [r.query for r in models.plan(q).collect()] == ["ask"]


@pytest.mark.parametrize("lengths,most,want", [((400, 400, 400), 1000, [0, 0, 1]), ((5000,), 1000, [0]), ((300,) * 4, 700, [0, 0, 1, 1]), ((10, 5000, 10), 1000, [0, 1, 2])])
def test_groups(spark, lengths, most, want):
    df = spark.createDataFrame([("d", k, "x" * n) for k, n in enumerate(lengths)], "document_id string, position int, text string")
    assert [r.grp for r in models.chunk_groups(df, most).orderBy("position").collect()] == want


def test_map_reduce_keeps_order(spark):
    df = spark.createDataFrame([("d", k, c * 4) for k, c in enumerate("ABCDEFGHIJKL")], "document_id string, position int, text string")
    got = models.map_reduce(df, lambda t: F.lower(t), lambda t: t, "|", 4).first().value
    assert got == "|".join(c * 4 for c in "abcdefghijkl")


def test_groups_of_a_long_document(spark):
    """Streamed in batches, beside a small document; a repeated position is not multiplied and no list of a document is built."""
    lengths = [k * 7919 % 97 for k in range(5000)]
    want, size, g = [], 0, 0
    for n in lengths:
        if size > 0 and size + n > 300:
            size, g = 0, g + 1
        size += n
        want.append(g)
    rows = [("d", k, "x" * n) for k, n in enumerate(lengths)] + [("e", 0, "y"), ("e", 0, "z"), ("e", 1, None)]
    df = spark.createDataFrame(rows, "document_id string, position int, text string").repartition(5)
    got = models.chunk_groups(df, 300)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    found = got.collect()
    assert [r.grp for r in sorted((r for r in found if r.document_id == "d"), key=lambda r: r.position)] == want
    assert sorted((r.position, r.text or "", r.grp) for r in found if r.document_id == "e") == [(0, "y", 0), (0, "z", 0), (1, "", 0)]


def test_summary_of_many_groups(spark, monkeypatch):
    """Joined few at a time, level by level, the summary is that of all condensed texts in one row."""
    monkeypatch.setattr(models, "FAN", 3)
    texts = {"a": [f"First {k}. Second {k}! Third {k}." for k in range(40)], "b": [f"open {k}" if k % 3 else f"Closed {k}. and" for k in range(40)], "c": ["one"], "d": [" ", "x. y"]}
    df = spark.createDataFrame([(d, k, t) for d, ts in texts.items() for k, t in enumerate(ts)], "document_id string, position int, text string").repartition(3)
    config = dataclasses.replace(models.DEFAULT, map_group_chars=10)
    got = sorted(models.summarize(df, config).collect())
    monkeypatch.setattr(models, "LEVELS", 0)
    want = sorted(models.summarize(df, config).collect())
    assert got == want and len(got) == 4
    monkeypatch.setattr(models, "LEVELS", 2)
    seen = models.map_reduce(df, models.first_sentences, F.length, max_chars=10, combine=lambda t: F.substring(t, 1, 5)).collect()
    assert max(r.value for r in seen) <= 5 * 5 + 4 * 7  # 40 groups: 14 runs, 5 runs


def test_prep(spark):
    docs = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf")], "document_id string, filename string")
    prep = spark.createDataFrame([("a", "s", "[]", None)], "document_id string, summary string, terms string, questions string")
    assert {tuple(r) for r in models.prep_pending(docs, prep).collect()} == {("a", "questions"), ("b", "summary"), ("b", "terms"), ("b", "questions")}
    new = spark.createDataFrame([("a", "questions", "q")], "document_id string, kind string, value string")
    assert tuple(models.upsert_prep(prep, new).first()) == ("a", "s", "[]", "q")
    with pytest.raises(ValueError):
        models.upsert_prep(prep, new.withColumn("kind", F.lit("other")))
    chunks = spark.createDataFrame([("a", 0, "Alpha beta gamma. Second sentence here."), ("b", 0, "Delta words. More.")], "document_id string, position int, text string")
    done = {r.document_id: r for r in models.generate_prep(docs, chunks, prep).collect()}
    assert done["a"].summary == "s" and done["a"].questions and done["b"].summary and done["b"].terms


def test_verdicts(spark):
    rows = [(1, '{"groundedness": 1.7, "citation_ok": true, "answered": false, "reason": "r"}'), (2, 'So: {"groundedness": "x", "citation_ok": 1} ok'), (3, "nothing"), (4, "{broken"), (5, None)]
    got = {r.query_id: (r.groundedness, r.citation_ok, r.answered) for r in evaluation.verdicts(spark.createDataFrame(rows, "query_id int, raw string")).collect()}
    assert got == {1: (1.0, True, False), 2: (0.0, True, False)}


def test_adversarial_context_leaves_the_answer_out(spark):
    chunks = spark.createDataFrame([(f"d::{k}", 1, None, f"text{k}") for k in range(5)], "key string, page int, section string, text string")
    rows = spark.createDataFrame([(1, "q", "d::0", ["d::1", "d::0", "gone", "d::2"])], "query_id int, query string, positive_id string, candidate_ids array<string>")
    assert evaluation.eval_contexts(rows, chunks).first().context == "[trang 1 | không rõ mục]\ntext0\n\n---\n\n[trang 1 | không rõ mục]\ntext1"
    bad = evaluation.eval_contexts(rows, chunks, adversarial=True).first().context
    assert "text0" not in bad and "text1" in bad and "text2" in bad
    answer, judge = lambda c, q: F.lit("a"), lambda c, q, a: F.when(c.contains("text0"), '{"groundedness": 1}').otherwise('{"groundedness": 0.2}')
    score = lambda adv: evaluation.evaluate(rows, chunks, answer, judge, adv).first().groundedness
    assert score(True) < score(False)


def test_highlight(spark):
    rows = [("một đoạn văn bản dài", "đoạn văn bản", True), ("một đoạn", "unrelated words", False), ("abcd", "abcd", False), ("Café au lait", "CAFÉ AU", True), (None, "abcdef", False), ("", "abcdef", False)]
    for text, span, want in rows:
        c = spark.createDataFrame([("d", 1, 1, text)], "document_id string, page int, chunk_id int, text string")
        s = spark.createDataFrame([("d", 1, 1, span)], "document_id string, page int, span_id int, span_text string")
        assert (spans.highlight_spans(c, s).count() == 1) is want


def longest_common(a, b):
    """By a table of all pairs of places."""
    most, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        most = max(most, *row)
    return most


def test_automaton():
    r = random.Random(3)
    for letters in ("ab", "abcdé", "a"):
        for _ in range(200):
            a, b = ("".join(r.choice(letters) for _ in range(r.randrange(0, 30))) for _ in range(2))
            assert spans.Automaton(a).longest(b) == longest_common(a, b)
    began = time.time()
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    automaton = spans.Automaton(long)
    assert automaton.longest(long[1000:40_000]) == 39_000 and automaton.longest("#" * 10_000 + long[7:20] + "#") == 13
    assert len(automaton.link) <= 2 * len(long) and time.time() - began < 10


def test_stretches_of_common_letters(monkeypatch):
    """As all pairs of places; what is found whole, with other letters around it, needs no automaton."""
    r = random.Random(8)
    for letters in ("ab", "abcdé#", "a"):
        for _ in range(300):
            a, b = ("".join(r.choice(letters) for _ in range(r.randrange(0, 25))) for _ in range(2))
            assert spans.Chunk(a).longest(b) == longest_common(a, b)
            want = longest_common(a, b) / min(len(a), len(b)) if a and b else 0.0
            assert spans.common_ratio(a, b) == spans.common_ratio(b, a) == want
    monkeypatch.setattr(spans, "Automaton", None)
    text = "lorem ipsum dolor " * 50_000
    assert spans.Chunk(text).longest("\a" * 9 + text[7:600_000] + "\a") == 599_993
    assert spans.common_ratio(text, "\a" * 10**6 + text[40:50_000] + "\a") == 49_960 / len(text)


@pytest.mark.parametrize("most_spans", [10_000, 3])
def test_span_ratios(spark, most_spans):
    """All pairs of a page, pages dealt over tasks or not; null ids, texts, pages, pages without chunks, equal rows."""
    r = random.Random(most_spans)
    text = lambda n: "".join(r.choice("abÉe\u0301 ") for _ in range(r.randrange(n)))
    chunks = [(r.choice("xyz"), r.randrange(3), k, text(60)) for k in range(25)] + [("x", None, 90, "abab"), (None, 1, 91, "abab"), ("x", 1, None, None)]
    lines = [(r.choice("xyzw"), r.randrange(4), k, text(30)) for k in range(120)] + [("x", 1, None, "ababab"), ("x", 1, 7, None), ("x", None, 8, "ababab")]
    lines += lines[:3]
    fold = lambda t: unicodedata.normalize("NFC", t or "").lower()
    want = []
    for d, p, c, t in chunks:
        for d2, p2, s, u in lines:
            if d and (d, p) == (d2, p2) and p is not None and u and len(u.strip(" ")) > 4:
                short = min(len(fold(t)), len(fold(u)))
                want.append((d, p, c, s, round(longest_common(fold(t), fold(u)) / short, 9) if short else 0.0))
    cited = spark.createDataFrame(chunks, "document_id string, page int, chunk_id long, text string").repartition(3)
    shown = spark.createDataFrame(lines, "document_id string, page int, span_id int, span_text string").repartition(3)
    got = [(x.document_id, x.page, x.chunk_id, x.span_id, round(x.ratio, 9)) for x in spans.span_ratios(cited, shown, most_spans).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({x[4] for x in want}) > 5


def test_traces(spark):
    rows = [("t", "a", 10, 1, 2, None), ("t", "a", 20, 1, 2, "e"), ("u", "b", 30, 3, 4, None)]
    df = spark.createDataFrame(rows, "trace_id string, name string, latency_ms long, tok_in long, tok_out long, error string")
    got = {(r.name, r.is_total): (r.n, r.p50, r.p95, r.max_ms) for r in evaluation.trace_stats(df).collect()}
    assert got == {("a", False): (2, 10, 20, 20), ("b", False): (1, 30, 30, 30), (None, True): (3, 20, 30, 30)}


def test_key_terms_join_only_open_terms(spark):
    """Whatever number of frequent terms is sent to the tasks, the terms are those of all counts, with ties and a null document."""
    r = random.Random(11)
    rows = [(r.choice([f"d{k}" for k in range(12)] + [None]), i, " ".join(f"word{min(int(r.expovariate(0.05)), 150)}" for _ in range(r.randrange(60)))) for i in range(60)]
    texts = spark.createDataFrame(rows, "document_id string, position int, text string")
    found = lambda **k: sorted(map(str, models.key_terms(texts, 4, **k).collect()))
    assert found(most=1) == found(most=7) == found(most=40) == found() and len(found()) == 13 * 4
    plan = models.explained_terms(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in plan and plan.count("Generate explode(filter") == 1


def test_results_come_to_texts(spark):
    """Texts, pages and sections of few results are fetched where they lie: no chunk is sorted or shuffled for them."""
    chunks = spark.createDataFrame([(i, i, "s", f"text {i}") for i in range(50)], "chunk_id int, page int, section string, text string").repartition(3)
    results = spark.createDataFrame([(q, q * 7 + o, o) for q in range(3) for o in range(4)], "question_id int, chunk_id int, ord int")
    texts, sources, cited = chat.context_texts(results, chunks), chat.distinct_sources(results, chunks), retrieval.citations_only(results, chunks)
    for df in (texts, sources, cited):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {x.question_id: x.context for x in texts.collect()}[1].split("\n\n---\n\n") == [f"[{o + 1}] (trang {7 + o}, s)\ntext {7 + o}" for o in range(4)]
    assert {(x.question_id, x.chunk_id, x.ord) for x in sources.collect()} == {(q, q * 7 + o, o) for q in range(3) for o in range(4)}
    assert {x.question_id: [y.page for y in x.citations] for x in cited.collect()}[2] == [14, 15, 16, 17]
