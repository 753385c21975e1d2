"""Truth tables, sources, models, streams and the service, which the queries' SQL doesn't reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstack import config
from loamstack.functions import models, prompts, scores, text, vectors
from loamstack.operators import chunking, ingestion, querylog, rerank, response, search, sinks, validation
from loamstack.service import Engine, healthy
from loamstack.sources import readers
from loamstack.streaming import streams


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("risk,level", [(0.1, "low"), (0.3, "medium"), (0.6, "high"), (0.9, "critical"), (0.25, "medium"), (0.5, "high"), (0.75, "critical")])
def test_risk_levels(spark, risk, level):
    assert config.ValidationConfig().level(risk) == level
    assert one(spark, x=scores.risk_level(F.lit(risk)))["x"] == level


@pytest.mark.parametrize("bad", [{"low": -0.1}, {"high": 1.2}, {"low": 0.6}, {"medium": 0.8}, {"retries": -1}, {"least_context": 9000}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        config.ValidationConfig(**bad)


def test_settings_from_the_environment():
    got = config.from_env({"LOAMSTACK_LOW": "0.1", "LOAMSTACK_RETRIES": "5", "LOAMSTACK_CACHE": "off", "LOAMSTACK_MODEL": "m", "OTHER": "x"}, retries=2, model=None)
    assert (got.low, got.retries, got.cache, got.model) == (0.1, 2, False, "m")
    assert got.as_dict()["medium"] == 0.5 and got.takes("x" * 50) and not got.takes("x" * 49) and not got.takes(None)
    with pytest.raises(ValueError):
        config.from_env({"LOAMSTACK_CACHE": "perhaps"})


def test_validation_rules(spark):
    long = "word " * 200
    rows = [("a question of words", "Short.", long), ("q", None, long), ("q", "An answer. " * 20, "tiny"), ("q", "x" * 4000, "y" * 60), ("words", "One. Two. " + "words " * 30, None)]
    out = validation.validate(spark.createDataFrame(rows, "question string, answer string, context string")).collect()
    assert [r["level"] for r in out] == ["low", "high", "high", "critical", "high"]
    assert out[3]["risk"] == 0.9 and out[3]["is_hallucination"] and not out[3]["valid"] and not out[3]["served"]
    assert out[1]["risk"] == 0.5 and out[1]["detector_confidence"] == 0 and "Manual review recommended" in out[1]["recommendations"]
    assert "No sources found for answer" in out[4]["warnings"]


@pytest.mark.parametrize("level,quality,confidence,valid", [("low", 0.8, 0.8, True), ("critical", 0.8, 0.8, False), ("low", 0.2, 0.8, False), ("low", 0.8, 0.2, False)])
def test_validity(spark, level, quality, confidence, valid):
    assert one(spark, x=validation.is_valid(F.lit(level), F.lit(quality), F.lit(confidence)))["x"] == valid


@pytest.mark.parametrize("valid,level,confidence,served", [(True, "low", 0.8, True), (True, "critical", 0.8, False), (False, "low", 0.8, False), (True, "high", 0.29, False)])
def test_served(spark, valid, level, confidence, served):
    assert one(spark, x=validation.is_served(F.lit(valid), F.lit(level), F.lit(confidence)))["x"] == served


def test_detection_and_notes(spark):
    raw = F.lit('{"risk_score": 0.8, "hallucination_detected": true, "issues": [{"type": "made up"}], "suggestions": ["look"]}')
    got = one(spark, d=response.parsed_detection(raw), e=response.parsed_detection(F.lit("{}")), off=response.parsed_detection(raw, config.ValidationConfig(issues=False, suggestions=False)))
    assert got["d"]["risk_level"] == "critical" and got["d"]["issues"][0]["type"] == "made up" and got["d"]["suggestions"] == ["look"]
    assert (got["e"]["risk_score"], got["e"]["confidence"], got["e"]["is_hallucination"]) == (0.5, 0.5, False)
    assert got["off"]["issues"] == got["off"]["suggestions"] == []
    note = one(spark, a=response.quality_note(F.lit("low"), F.lit(True)), b=response.quality_note(F.lit("low"), F.lit(False)), c=response.quality_note(F.lit("high"), F.lit(True)))
    assert note["a"] is None and note["b"]["risk_level"] == "low" and note["c"]["message"] == response.NOTES["high"]
    lost = one(spark, f=response.failed(F.lit("broken")), u=response.unvalidated())
    assert lost["f"]["warnings"] == ["Validation failed: broken"] and not lost["f"]["valid"] and lost["u"]["valid"]


def test_braces_in_passages_and_questions_stay(spark):
    got = one(spark, m=prompts.user_message(F.lit("what {context} is"), F.lit("a passage with {query} in it")), s=prompts.messages(F.lit("q"), F.lit("c"), F.lit("more")))
    assert "a passage with {query} in it" in got["m"] and "what {context} is" in got["m"]
    assert [m["role"] for m in got["s"]] == ["system", "user"] and "Additional context:\nmore" in got["s"][1]["content"]
    mine = prompts.with_template("mine", "sys", "Q {query} C {context}")
    assert one(spark, m=prompts.user_message(F.lit("q"), F.lit("c"), F.lit("mine"), mine))["m"] == "Q q C c"
    assert one(spark, m=prompts.user_message(F.lit("q"), F.lit("c"), F.lit("unknown")))["m"].startswith("Passages:")
    with pytest.raises(ValueError):
        prompts.with_template("bad", "s", "no places")


def test_terms_of_any_script(spark):
    assert one(spark, t=text.terms(F.lit("Große Straße, naïve_1 漢字! don't")))["t"] == ["große", "straße", "naïve_1", "漢字", "don", "t"]


def test_vectors(spark):
    got = one(
        spark, s=vectors.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), u=vectors.unit(F.array(F.lit(3.0), F.lit(4.0))), z=vectors.unit(F.array(F.lit(0.0))),
        d=vectors.dense(F.create_map(F.lit(4), F.lit(2.0), F.lit(0), F.lit(1.0)), 6), e=vectors.dense(F.create_map().cast("map<int,double>"), 2),
    )
    assert np.allclose(got["s"], np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum())
    assert got["u"] == [0.6, 0.8] and got["z"] == [0.0]
    assert got["d"] == [1.0, 0.0, 0.0, 0.0, 2.0, 0.0] and got["e"] == [0.0, 0.0]


def brute_titles(t, titles, least):
    out, pos = [], 0
    for i, title in enumerate(titles):
        start = t.find(title, pos)
        if start < 0:
            continue
        end = t.find(titles[i + 1], start + len(title)) if i + 1 < len(titles) else len(t)
        end = len(t) if end < 0 else end
        if len(t[start:end].strip()) > least:
            out.append((title, t[start:end].strip()))
        pos = end
    return out


def test_sections_by_titles(spark):
    body = "some words of a section. " * 8
    t = f"Intro {body} Methods {body} Short x Results {body}"
    cases = [["Intro", "Methods", "Short", "Results"], ["Methods", "Intro"], ["Absent"], [], ["Results"]]
    rows = spark.createDataFrame([(i, t, c) for i, c in enumerate(cases)], "doc_id int, text string, titles array<string>")
    got = {r["doc_id"]: [(s["title"], s["text"]) for s in r["s"]] for r in rows.select("doc_id", chunking.titled_sections("text", "titles").alias("s")).collect()}
    assert got == {i: brute_titles(t, c, 100) for i, c in enumerate(cases)}
    whole = chunking.paper_sections(rows, "titles").where("doc_id = 2").collect()
    assert [(r["title"], r["text"]) for r in whole] == [("Full Document", t)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_fine_name.txt").write_text("text of a file")
    (tmp_path / "in" / "good.pdf").write_bytes(b"one|two||")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"bad")

    def parse(data: bytes) -> list[str]:
        if data == b"bad":
            raise ValueError("damaged")
        return data.decode().split("|")

    rows = {r["title"]: r for r in readers.directory(spark, str(tmp_path / "in"), parse).collect()}
    assert rows["A Fine Name"]["text"] == "text of a file"
    assert rows["Good"]["text"] == "one\ntwo" and rows["Good"]["page_count"] == 2
    assert rows["Bad"]["text"] is None and "damaged" in rows["Bad"]["error"]
    (tmp_path / "m.json").write_text(json.dumps(["plain", "42", "true", '{"not": "an object"}', 42, True, None, ["x"], {"title": "T", "text": "t"}, {"other": 1}]))
    got = [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()]
    assert got == [("Text Document", x) for x in ("plain", "42", "true", '{"not": "an object"}')] + [("T", "t"), ("Unknown", "")]
    inline = readers.inline(spark.createDataFrame([("x y",), ("http://a",), ("arxiv:1",), (None,)], "x string")).collect()
    assert [r["error"] is None for r in inline] == [True, False, False, False]
    assert readers.listing_stub(spark, "q", 25).count() == 10 and readers.listing_stub(spark, "q", 3).count() == 3
    images = readers.page_images(spark, str(tmp_path / "in" / "good.pdf"), lambda data: data.split(b"|"), 1, 2).collect()
    assert [(r["page"], bytes(r["image"])) for r in images] == [(1, b"two"), (2, b"")]


def test_ingestion_and_deletion(spark, tmp_path):
    docs = spark.createDataFrame([(i, "many words of a good document " * 12 if i else "short") for i in range(5)], "doc_id bigint, text string")
    seen = []
    paths = ingestion.ingest(docs, str(tmp_path), seen.append)
    tables = {name: spark.read.parquet(p) for name, p in paths.items()}
    assert seen == ["documents", "parents", "children", "relations"]
    assert ingestion.summary(tables["documents"]).first().asDict() == {"n": 5, "n_success": 4, "n_error": 1, "n_partial": 0}
    left = ingestion.delete_document(tables, spark.createDataFrame([(1,), (2,)], "doc_id bigint"))
    assert {name: rows.count() for name, rows in left.items()} == {"documents": 3, "parents": 2, "children": 2, "relations": 2}


def test_sinks(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in sinks.upsert(store, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    wide = sinks.add_columns(sinks.add_columns(store, {"w": "double"}), {"w": "double"})
    assert wide.columns == ["k", "v", "w"]
    v = sinks.vector_rows(spark.createDataFrame([("c", [[1.0], [2.0]])], "chunk_id string, vectors array<array<double>>")).collect()
    assert [(r["id"], r["embedding"]) for r in v] == [("c_vec_0", [1.0]), ("c_vec_1", [2.0])]


def test_models(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "")], "doc_id bigint, text string")
    w = {(r["doc_id"], r["term"]): r["weight"] for r in models.term_weights(docs).collect()}
    assert w[1, "a"] == 1.0 and 0 < w[1, "b"] < 1 and len(w) == 2
    assert models.term_weights(docs, lambda: lambda t: {"n": len(t)}).count() == 2

    class Failing:
        def __call__(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no answer")
            return [p.upper() for p in prompts]

    asked = spark.createDataFrame([(1, "x"), (2, "bad")], "prompt_id bigint, prompt string").coalesce(1)
    got = {r["prompt_id"]: r for r in models.generate(asked, Failing, attempts=2, delay=0.0, batch=1).collect()}
    assert got["1"]["answer"] == "X" and got["1"]["tries"] == 1
    assert got["2"]["answer"] is None and got["2"]["tries"] == 2 and "no answer" in got["2"]["error"]
    lists = spark.createDataFrame([(1, "q", f"c{i}", "t" * i, i) for i in range(1, 4)] + [(2, "fail", "d", "t", 1)], "query_id bigint, query string, chunk_id string, text string, place int")

    def make():
        def rank(query, texts):
            if query == "fail":
                raise RuntimeError
            return [2, 0, 9]

        return rank

    out = {(r["query_id"], r["chunk_id"]): (r["rank"], r["confidence"]) for r in models.rank_lists(lists, make).collect()}
    assert out == {(1, "c3"): (1, 0.6), (1, "c1"): (2, 0.6), (1, "c2"): (3, 0.6), (2, "d"): (1, 0.5)}
    assert {(r["chunk_id"], r["rank"]) for r in rerank.ranker("unknown")(lists.where("query_id = 1")).collect()} == {("c1", 1), ("c2", 2), ("c3", 3)}
    pair = spark.createDataFrame([("a b c", "b c d e"), ("", "x"), ("x", None)], "q string, t string")
    rows = pair.select(models.pair_score(F.col("q"), F.col("t")).alias("a"), scores.word_cosine(F.col("q"), F.col("t")).alias("b")).collect()
    assert all(abs(r["a"] - (r["b"] or 0)) < 1e-12 for r in rows)
    assert models.about(models.HashingEncoder()) == [{"model": "HashingEncoder", "width": 64, "marker": "[D]"}]


def test_pages(spark):
    pages = spark.createDataFrame([("a", b"x" * 100), ("b", b""), ("c", None)], "page_id string, image binary")
    got = models.encode_pages(pages).collect()
    assert {(r["page_id"], len(r["e"])) for r in got} == {("a", 128), ("b", 128)}
    assert sum(r["page_id"] == "a" for r in got) == 25
    assert all(abs(np.linalg.norm(r["e"]) - 1) < 1e-9 for r in got)


def test_migrations(spark):
    rows, log = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([], sinks.MIGRATIONS)
    columns = {"risk": "double", "level": "string"}
    for _ in range(2):
        rows, log = sinks.migrate(rows, log, "first", columns)
        assert rows.columns == ["id", "risk", "level"] and log.count() == 1
    for _ in range(2):
        rows, log = sinks.revert(rows, log, "first", columns)
        assert rows.columns == ["id"] and log.count() == 0


def test_reasons(spark):
    rows = spark.createDataFrame([(1, 1, '{"reasoning": {"1": "fits"}}'), (1, 2, '{"reasoning": {"1": "fits"}}'), (2, 1, "none")], "query_id int, rank int, response string")
    assert [r["reason"] for r in rerank.reasons(rows).collect()] == ["fits", "Ranked at position 2", "Ranked at position 1"]


@pytest.mark.parametrize("ties", [1, 50, 3000])
def test_eviction_without_a_sort(spark, ties):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.timestamp_micros(F.floor((F.col("id") * 7919 % 3000) / ties).cast("bigint") * 1000).alias("ts"))
    want = {r["key"] for r in sorted(rows.collect(), key=lambda r: (r["ts"], r["key"]))[300:]}
    assert {r["key"] for r in querylog.evict_oldest(rows, "ts", "key").collect()} == want
    assert querylog.evict_oldest(rows.limit(1000), "ts", "key").count() == 1000


def test_empty_log(spark):
    log = spark.createDataFrame([], "hallucination_score double, quality_score double, total_time_ms double, rating int, level string")
    assert tuple(querylog.stats_or_zero(log).first()) == (0, 0.0, 0.0)
    assert querylog.shares(log, x=F.col("rating") > 1).first()["x"] == 0


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, "many words of a good document " * 12) for i in range(4)], "doc_id bigint, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = streams.stream_table(spark, f"{tmp_path}/in", f"{tmp_path}/in", 1)
    streams.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/children").count() == chunking.children(chunking.parents(docs)).count()
    e = spark.createDataFrame([(1, "k", "2024-01-01 00:00:00"), (2, "k", "2024-01-01 00:10:00"), (3, "l", "2024-01-01 00:11:00")], "id int, k string, t string").select("id", "k", F.to_timestamp("t").alias("ts"))
    e.write.parquet(f"{tmp_path}/events")
    once = streams.first_within(streams.stream_table(spark, f"{tmp_path}/events", f"{tmp_path}/events"), ["k"])
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"] for r in spark.table("once").collect()} == {"k", "l"} and spark.table("once").count() == 2


def test_search_of_many_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "chunk_id int, e array<double>")
    q = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "query_id int, q_id int, qe array<double>")
    assert {(r["chunk_id"], round(r["score"], 6)) for r in search.maxsim_many(v, q).collect()} == {(1, 1.0), (2, 0.7)}


def test_engine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    asked = spark.createDataFrame([(1, docs.orderBy("doc_id").first()["text"][:60]), (2, "zzzz qqqq")], "query_id bigint, query string")
    got = {r["query_id"]: json.loads(r["response"]) for r in Engine(docs).answer(asked).collect()}
    assert set(got) == {1, 2} and got[1]["token_usage"]["total_tokens"] > 0 and "validation" in got[1]
    log = spark.createDataFrame([(5, 0.1)], "id int, hallucination_score double")
    assert Engine.logged(log, 5).count() == 1
    with pytest.raises(LookupError):
        Engine.logged(log, 6)
    with pytest.raises(ValueError):
        Engine.stats(log, 0)
    assert healthy(spark, "/nowhere") == {"session": True, "/nowhere": False}
