"""Text to graph without a network."""

import json

from spokes.plans import pipeline, render
from spokes.plans.config import Config, load_config
from spokes.sources.extractors import HttpChatExtractor, RecordedExtractor, RuleExtractor, prompt_hash
from spokes.sources.files import export_json, json_path, read_text, read_triples
from spokes.sources.seeds import sample_triples

TEXT = "James Watt invented the engine. The engine led to factories. James Watt lives in Scotland.\nNothing here"


def test_rules_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    docs = read_text(spark, f"file://{tmp_path}/in")
    out = pipeline.run(docs, RuleExtractor(), Config(model_for_entities=False, model_for_inference=False))
    got = {(r.subject, r.predicate, r.object, r.inferred) for r in out.triples.collect()}
    assert ("james watt", "invented", "the engine", False) in got
    assert {(r.phase, r.metric): r.value for r in out.report.collect()}["extract", "triples"] == 3
    report = {(r.phase, r.metric): r.value for r in out.report.collect()}
    assert report["extract", "dropped: not a triple"] == 0 and report["extract", "failed requests"] == out.failures.count()
    assert report["infer", "components"] == 1 and report["infer", "before: invented"] == 1 and any(m.startswith("after: ") for _, m in report)
    assert out.answers.where("kind = 'array'").count() > 0
    html, js = str(tmp_path / "g.html"), json_path(str(tmp_path / "g.html"))
    assert js.endswith("g.json") and export_json(out.triples, js) == len(got)
    back = read_triples(spark, f"file://{js}")
    assert {(r.subject, r.predicate, r.object, r.inferred) for r in back.collect()} == got
    stats = render.render(back, html)
    assert f"{stats['nodes']} Nodes, {stats['edges']} Relationships" in open(html).read()


def test_recorded_answers_and_failures(spark):
    from pyspark.sql import functions as F
    from spokes.plans import prompts

    pieces = spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (2, 1, "three")], "doc_id long, chunk int, text string")
    user = {r.text: r.u for r in pieces.select("text", prompts.extract(F.col("text")).alias("u")).collect()}
    answer = json.dumps([{"subject": "a", "predicate": "is one of the many", "object": "b"}, {"subject": "c"}])
    table = spark.createDataFrame([(prompt_hash(prompts.EXTRACT_SYSTEM, user["one"]), answer), (prompt_hash(prompts.EXTRACT_SYSTEM, user["two"]), "no")], "hash string, response string")
    rows, failed = pipeline.extract(pieces, RecordedExtractor(table))
    assert [(r.subject, r.predicate, r.chunk) for r in rows.collect()] == [("a", "is one of", 1)] or [r.predicate for r in rows.collect()] == ["is one"]
    dropped = pipeline.extract_counted(pieces, RecordedExtractor(table))[2]
    assert [(r.doc_id, r.chunk, r.pos) for r in dropped.collect()] == [(1, 1, 1)]
    assert {r.request: r.error for r in failed.collect()} == {"1:2": "no triples in the answer", "2:1": "no recording"}


class Echo(RuleExtractor):
    """Answers every kind of request with fixed JSON."""

    def answer(self, system, user):
        if "Group the names" in user:
            return '{"watt": ["james watt"]}'
        if "Two groups" in user or "pairs below" in user:
            return '[{"subject": "watt", "predicate": "is linked with", "object": "york"}, {"subject": "x", "predicate": "p", "object": "x"}, 3]'
        return super().answer(system, user)


def test_model_steps(spark):
    docs = spark.createDataFrame([(1, TEXT + ". York uses coal.")], "doc_id long, text string")
    got = [(r.subject, r.predicate, r.object, r.inferred) for r in pipeline.run(docs, Echo(), Config()).triples.collect()]
    assert ("watt", "lives in", "scotland", False) in got and ("watt", "is linked with", "york", True) in got
    assert not [g for g in got if g[0] == g[2]]


def test_requests_are_bounded(spark):
    from spokes.operators.infer import saved_components

    t = sample_triples(spark)
    assert pipeline.between_requests(t, saved_components(t)).count() == 0  # one component


def test_payload_and_config(tmp_path):
    p = HttpChatExtractor("http://localhost:1", "m", "k").payload("s", "u")
    assert p["messages"][1]["content"] == [{"type": "text", "text": "u"}] and p["messages"][0]["role"] == "system"
    assert load_config(str(tmp_path / "none.toml")) is None
    (tmp_path / "bad.toml").write_bytes(b"[llm]\nmodel = \"\xff\"")
    (tmp_path / "odd.toml").write_text("llm = 3")
    assert load_config(str(tmp_path / "bad.toml")) is None and load_config(str(tmp_path / "odd.toml")) is None
    f = tmp_path / "c.toml"
    f.write_text("[chunking]\nchunk_size = 50\n[inference]\nenabled = false\n")
    c = load_config(str(f))
    assert (c.chunk_size, c.overlap, c.infer) == (50, 20, False) and not c.without(standardize=True).standardize


def test_options():
    assert render.options("false")["edges"]["smooth"] is False
    assert render.options("dynamic")["edges"]["smooth"] == {"type": "dynamic"}
    assert render.options(True)["edges"]["smooth"] == {"type": "continuous"}
    assert render.options(False)["edges"]["smooth"] is False
    from spokes.sources.files import template

    page = template()  # reads every group of options
    assert all(f"o.{k}" in page for k in render.options()) and "arrows" in page and "e.label" in page


def test_command_line_views_the_sample_and_debugs(spark, tmp_path, capsys):
    from spokes.plans import cli

    (tmp_path / "c.toml").write_text("[standardization]\nuse_llm_for_entities = false\n[inference]\nuse_llm_for_inference = false\n")
    (tmp_path / "a.txt").write_text(TEXT)
    config = ["--config", str(tmp_path / "c.toml"), "--output", str(tmp_path / "g.html")]
    assert sample_triples(spark).count() == 21
    assert cli.main([*config, "--test"]) == 0 and (tmp_path / "g.html").exists()
    assert cli.main([*config, "--rules", "--debug", "--input", f"file://{tmp_path}/a.txt"]) == 0
    said = capsys.readouterr().out
    assert "=== [" in said and "dropped: not a triple" in said
    assert cli.main(["--config", str(tmp_path / "none.toml")]) == 0 and "none.toml" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    from spokes.streaming.ingest import stream_triples

    src = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(src)
    docs = spark.readStream.schema("doc_id long, text string").parquet(src)
    stream_triples(docs, RuleExtractor(), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out/triples").count() == 3
