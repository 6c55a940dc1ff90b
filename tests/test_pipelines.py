from __future__ import annotations

import asyncio
import dataclasses
import io
import json
import pickle

import pytest
from pyspark.sql import functions as F

from quillspark import environment, report, session
from quillspark.functions import chat, json_repair
from quillspark.model import Metadata
from quillspark.operators import profile, stats
from quillspark.plans import agents, config, pipeline, runs
from quillspark.sources import fake, ingest
from quillspark.sources.store import StoreTable
from quillspark.streaming import incremental


@dataclasses.dataclass
class Point:
    x: int
    y: int


@dataclasses.dataclass
class Company:
    ticker: str
    cik: int | None = None


def test_text_and_pickle(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("héllo".encode("utf-16"))
    assert ingest.TextIngestor(spark, str(tmp_path / "a.txt")).text() == "héllo\nworld"
    assert ingest.TextIngestor(spark, str(tmp_path / "b.txt"), "UTF-16").text() == "héllo"
    (tmp_path / "p.pkl").write_bytes(pickle.dumps({"k": [1, 2]}))
    assert ingest.PickleIngestor(spark, str(tmp_path / "p.pkl"), trusted=True).ingest() == {"k": [1, 2]}
    with pytest.raises(PermissionError):
        ingest.PickleIngestor(spark, str(tmp_path / "p.pkl")).ingest()
    for one in (ingest.TextIngestor(spark, str(tmp_path / "no")), ingest.PickleIngestor(spark, str(tmp_path / "no"), trusted=True)):
        with pytest.raises(FileNotFoundError):
            one.ingest()


def test_dataclasses(spark, tmp_path):
    path = str(tmp_path / "points.json")
    ingest.save_dataclasses(spark, [Point(1, 2), Point(3, 4)], path)
    assert json.loads((tmp_path / "points.json").read_text()) == [{"x": 1, "y": 2}, {"x": 3, "y": 4}]
    assert [(r.x, r.y) for r in ingest.DataclassIngestor(spark, path, Point).ingest().collect()] == [(1, 2), (3, 4)]
    with pytest.raises(FileExistsError):
        ingest.save_dataclasses(spark, [Point(1, 2)], path)
    ingest.save_dataclasses(spark, [Point(5, 6)], path, exist_ok=True)
    with pytest.raises(ValueError, match="do not fit"):
        ingest.load_dataclasses(spark, path, Company)
    (tmp_path / "o.json").write_text('{"x": 1}')
    with pytest.raises(TypeError):
        ingest.load_dataclasses(spark, str(tmp_path / "o.json"), Point)
    with pytest.raises(TypeError):
        ingest.save_dataclasses(spark, [1], str(tmp_path / "n.json"))
    df = ingest.dataclasses_to_dataframe(spark, [Company("A", 1), Company("B")])
    assert [tuple(r) for r in df.collect()] == [("A", 1), ("B", None)]
    assert ingest.dataclasses_to_dataframe(spark, [], Company).columns == ["ticker", "cik"]
    with pytest.raises(TypeError):
        ingest.dataclasses_to_dataframe(spark, [{"a": 1}])


def test_ingestors(spark):
    df = spark.range(10).select(F.col("id").alias("_ord"))
    source = ingest.InMemoryIngestor(df)
    data = [1, [2]]
    copied = ingest.InMemoryIngestor(data).ingest()
    copied[1].append(3)
    assert data == [1, [2]] and ingest.InMemoryIngestor(data, copy=False).ingest() is data
    assert [r[0] for r in ingest.FirstNIngestor(source, 3).ingest().collect()] == [0, 1, 2]
    assert [r[0] for r in ingest.LastNIngestor(source, 3).ingest().collect()] == [7, 8, 9]
    one = ingest.ShuffleIngestor(source, seed=1)
    first, second = ([r[0] for r in one.ingest().collect()] for _ in range(2))
    assert sorted(first) == sorted(second) == list(range(10)) and first != second
    assert first == [r[0] for r in ingest.ShuffleIngestor(source, seed=1).ingest().collect()]
    both = ingest.MappingIngestor({"a": source, "b": ingest.ProcessorIngestor(source, lambda d: d.limit(2))})
    assert set(both.ingest()) == {"a", "b"} and both.union().groupBy("source").count().count() == 2
    assert [r[0] for r in ingest.FrameLoader(df).lazy_load()] == list(range(10)) and ingest.FrameLoader([1]).load() == [1]
    with pytest.raises(ValueError, match="at least 1"):
        ingest.FirstNIngestor(source, 0)


def test_fake(spark):
    a, b = (fake.fake_documents(spark, 4, seed=1).collect() for _ in range(2))
    assert a == b and [r.id for r in a] == ["doc-0", "doc-1", "doc-2", "doc-3"] and a != fake.fake_documents(spark, 4, seed=2).collect()
    assert fake.fake_records(spark, 0).count() == 0 and a[0].page_content.count(".") == 5
    with pytest.raises(ValueError, match="negative"):
        fake.fake_records(spark, -1)


def test_processors(spark):
    df = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "score int, _ord long")
    steps = pipeline.SequentialProcessor(pipeline.SortByKey("score", reverse=True), pipeline.LambdaProcessor(lambda d: d.where("score > 1")))
    assert [r.score for r in steps(df).collect()] == [3, 2] and pipeline.SequentialProcessor()(df) is df
    meta = Metadata.columns("score")
    for p, expected in ((pipeline.FilterByMetadata(meta, "score", 1), [1]), (pipeline.FilterByMetadataRange(meta, "score", 2), [3, 2]), (pipeline.FilterByMetadataValues(meta, "score", {1, 3}), [3, 1]), (pipeline.SortByMetadata(meta, "score"), [1, 2, 3]), (pipeline.FirstN(2), [3, 1]), (pipeline.LastN(2), [1, 2])):
        assert [r.score for r in df.transform(p).collect()] == expected
    assert sorted(r.score for r in pipeline.Shuffle(seed=3)(df).collect()) == [1, 2, 3]


def test_sequence_processor(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "x long")

    def half(row):
        if row["x"] % 2:
            raise ValueError("odd")
        return {"y": row["x"] // 2}

    assert sorted(r.y for r in pipeline.SequenceProcessor(half, "y long", raise_on_error=False, partitions=2)(df).collect()) == [0, 1, 2]
    errors = pipeline.SequenceProcessor(half, "y long", errors="why")(df).collect()
    assert sum(r.why == "ValueError: odd" for r in errors) == 3 and len(errors) == 6
    with pytest.raises(Exception, match="odd"):
        pipeline.SequenceProcessor(half, "y long")(df).collect()
    with pytest.raises(ValueError, match="negative"):
        pipeline.SequenceProcessor(half, "y long", partitions=-1)


def test_registry_and_configs(spark):
    known = pipeline.default_registry(spark)
    step = known.resolve({"_target_": "processor.first_n", "n": 2}, pipeline.Processor)
    assert step.n == 2 and known.resolve(step, pipeline.Processor) is step
    with pytest.raises(TypeError):
        known.resolve({"_target_": "processor.first_n", "n": 2}, ingest.Ingestor)
    with pytest.raises(ValueError, match="unknown target"):
        known.resolve({"_target_": "os.system", "command": "true"})
    store = pipeline.Factory({"_target_": "store.in_memory"}, known, StoreTable).make()
    assert isinstance(store, StoreTable) and pipeline.Factory(step).make() is step
    made = config.ModelConfig.from_kwargs(model="m", temperature=0.5)
    assert made.to_kwargs() == {"model": "m", "temperature": 0.5} and made.get_value("temperature") == 0.5 and made.get_value("no", 1) == 1
    with pytest.raises(TypeError):
        made.extra["temperature"] = 1
    with pytest.raises(ValueError, match="repeat"):
        config.ModelConfig(extra={"model": "x"})
    other = config.AgentConfig(model=made, system_prompt="s")
    assert other.cache_key() == config.AgentConfig(model=config.ModelConfig.from_kwargs(temperature=0.5, model="m"), system_prompt="s").cache_key() and len(other.cache_key(10)) == 10
    assert other.cache_key() != config.AgentConfig(model=made).cache_key()


def test_configurations_are_read_only_keys():
    made = config.ModelConfig(model="m", extra={"stop": ["a"], "t": {"x": 1}})
    with pytest.raises(KeyError, match="nothing"):
        made.get_value("nothing")
    assert made.get_value("nothing", None) is None and made["stop"] == ["a"] and made.model == "m" and dict(made.extra) == {"stop": ["a"], "t": {"x": 1}}
    same = config.ModelConfig.from_kwargs(t={"x": 1}, model="m", stop=["a"])
    assert same == made and {made: 1}[same] == 1 and made != config.Config(extra={"model": "m", "stop": ["a"], "t": {"x": 1}})
    assert list(config.Config()) == [] and config.AgentConfig().to_kwargs() == {"model": None, "system_prompt": None}
    with pytest.raises(AttributeError):
        made.model = "n"
    with pytest.raises(TypeError):
        config.ModelConfig(temperature=1)
    with pytest.raises(ValueError):
        config.ModelConfig(extra={"extra": 1})


def test_cache(spark):
    calls = []
    run = runs.CachingRun(runs.Run(lambda x: calls.append(x) or x * 2))
    assert [run.invoke(1), run.invoke(1), run.batch([1, 2, 2])] == [2, 2, [2, 4, 4]] and calls == [1, 2, 2]
    assert asyncio.run(run.ainvoke(2)) == 4 and asyncio.run(run.abatch([1, 2])) == [2, 4] and len(calls) == 3
    bad = runs.CachingRun(runs.Run(lambda x: 1 // x))
    assert isinstance(bad.batch([0], return_exceptions=True)[0], ZeroDivisionError) and bad._local == {}
    with pytest.raises(ZeroDivisionError):
        bad.batch([0])
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    counter = spark.sparkContext.accumulator(0)

    def shout(s):
        counter.add(1)
        return None if s is None else s.upper()

    cached = runs.CachingRun(runs.Run(shout), runs.CacheTable(spark))
    assert sorted(map(str, (r.output for r in cached.transform(df, "t").collect()))) == ["A", "A", "B", "None"] and counter.value == 3
    assert cached.transform(df, "t").count() == 4 and counter.value == 3


def test_recording(spark):
    store = StoreTable.in_memory(spark, kind="record")
    run = runs.RecordingRun(runs.Run(lambda s: s[::-1]), store, extra={"model": "m"})
    assert run.invoke("ab", {"run_id": "r1", "metadata": {"tag": 1}}) == "ba"
    failing = runs.RecordingRun(runs.Run(lambda s: s.nowhere), store)
    with pytest.raises(AttributeError):
        failing.invoke("x")
    assert isinstance(failing.batch(["x"], return_exceptions=True)[0], AttributeError)
    assert list(run.stream(lambda v: iter(["Hel", "lo"]), "q")) == ["Hel", "lo"]
    meta = sorted((json.loads(r.metadata) for r in store.all().collect()), key=lambda m: m["input"])
    assert [(m["input"], m["output"]) for m in meta] == [("ab", "ba"), ("q", "Hello"), ("x", None)]
    assert meta[0]["run_id"] == "r1" and meta[0]["tag"] == 1 and meta[0]["model"] == "m" and meta[2]["error"].startswith("AttributeError")
    with pytest.raises(ValueError, match="reserved"):
        runs.RecordingRun(runs.Run(str), store, extra={"input": 1})
    with pytest.raises(ValueError, match="reserved"):
        run.invoke("x", {"metadata": {"error": 1}})
    with pytest.raises(ValueError, match="configs"):
        run.batch(["a", "b"], [{}])


def test_pairs_and_chat_runs(spark):
    run = runs.InputOutputRun(runs.Run(lambda x: 10 // x))
    assert run.invoke(5) == runs.InputOutputPair(5, 2)
    out = run.batch([5, 0], return_exceptions=True)
    assert out[0] == runs.InputOutputPair(5, 2) and isinstance(out[1], ZeroDivisionError)
    agent = runs.ChatRun(lambda ms: f"{len(ms)} messages", system_prompt="Be brief.")
    assert agent.invoke("hi")["messages"] == [{"role": "system", "content": "Be brief."}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "2 messages"}]
    assert len(agent.batch(["a", {"messages": ["b"]}])) == 2
    df = spark.createDataFrame([([("user", "hi")],)], f"messages {chat.MESSAGES}")
    assert [m.role for m in agent.transform(df).first().messages] == ["system", "user", "assistant"]
    for bad in (5, {"no": 1}):
        with pytest.raises(TypeError):
            chat.coerce_value(bad)


def test_agents_from_configs(spark):
    calls = []
    known = pipeline.Registry()
    known.register("model.echo", lambda prefix="": lambda ms, **kw: calls.append(kw) or prefix + ms[-1]["content"])
    conf = config.AgentConfig(model=config.ModelConfig.from_kwargs(model="echo", prefix="> "), system_prompt="s")
    plain = agents.AgentFactory(conf, known)
    assert plain.make().invoke("hi")["messages"][-1] == {"role": "assistant", "content": "> hi"}
    cached = agents.CachingAgentFactory(plain).make()
    assert cached.invoke("a") == cached.invoke("a") and len(calls) == 2
    store = StoreTable.in_memory(spark, kind="record")
    agents.RecordingAgentFactory(plain, store, config=conf).make().invoke("x")
    assert json.loads(store.all().first().metadata)["config_key"] == conf.cache_key()
    model = agents.CachingModel(lambda ms, **kw: calls.append(kw) or len(calls))
    m = [{"role": "user", "content": "q"}]
    assert model(m) == model(m) != model(m, stop=["x"]) and model.bind(tools=["t"])(m) != model(m)
    with pytest.raises(TypeError):
        agents.AgentFactory(config.AgentConfig(), known).make()
    assert runs.default_serialize({"a": (Point(1, 2), [Company("t")])}) == {"a": [{"x": 1, "y": 2}, [{"ticker": "t", "cik": None}]]}
    assert chat.generate_run_id({"b": 1, "a": 2}) == chat.generate_run_id({"a": 2, "b": 1}) != chat.generate_run_id({})


def test_usage(spark):
    result = {"messages": [{"usage_metadata": {"input_tokens": 3, "output_tokens": 2, "total_tokens": 9}}, {"x": [{"usage_metadata": {"input_tokens": 1}}]}]}
    assert chat.find_usage(result) == {"input_tokens": 4, "output_tokens": 2, "total_tokens": 9}
    assert chat.accumulate_usage({"input_tokens": 1}, result)["input_tokens"] == 5
    row = spark.range(1).select(chat.format_usage(F.struct(F.lit(1234).alias("input_tokens"), F.lit(567).alias("output_tokens"), F.lit(1801).alias("total_tokens"))).alias("s")).first()
    assert row.s == "[tokens] in=1,234 | out=567 | total=1,801"
    df = spark.createDataFrame([(0, 1, None, 1), (1, 2, 3, 5)], "i int, input_tokens int, output_tokens int, total_tokens int")
    assert [r.total_total_tokens for r in runs.accumulated_usage(df, "i").orderBy("i").collect()] == [1, 6]
    blocks = spark.createDataFrame([([("text", "a"), ("image", "b"), ("text", "c")],)], "b array<struct<type:string,text:string>>")
    assert blocks.select(chat.as_text(F.col("b")).alias("t")).first().t == "ac"
    assert chat.run_ids({"run_id": "x"}) == "x" and chat.run_ids(None, 2) == [None, None]
    with pytest.raises(ValueError, match="configs"):
        chat.run_ids([{}], 2)


CASES = [
    ('{"summary": "ok", "rating": 4}', 1),
    ('```json\n{"summary": "ok", "rating": 4}\n```', 1),
    ('```\n{"summary": "ok", "rating": 4}\n```', 1),
    ('{"summary": "ok", "rating": 4,}', 2),
    ('Sure: {"summary": "ok", "rating": 4} Bye', 3),
    ('Sure: {"summary": "ok", "rating": 4,} {"b": 1}', 3),
    ('{"summary": "ok", "rating": 9}', None),
    ('{"summary": "", "rating": 4}', None),
    ('{"summary": "ok"}', None),
    ('{"summary": "ok", "rating": 4', None),
    ("no json", None),
    (None, None),
]


def test_structured_parsing(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    valid = lambda v: (F.length(v["summary"]) >= 1) & v["rating"].between(1, 5)
    got = json_repair.parse_structured(df, "t", "summary string, rating int", valid=valid).orderBy("i").collect()
    assert [r.parsed_attempt for r in got] == [a for _, a in CASES]
    assert all((r.parsed is None) == (r.parsed_error is not None) for r in got) and "no json" in got[10].parsed_error
    native = df.withColumn("n", F.when(F.col("i") == 10, F.struct(F.lit("n").alias("summary"), F.lit(1).alias("rating"))))
    out = {r.i: r for r in runs.structured_output(native, "t", "summary string, rating int", native_col="n").collect()}
    assert not out[10].used_fallback and out[10].parsed.summary == "n" and out[0].used_fallback and out[11].parsed_error


def test_balanced_objects():
    assert json_repair.first_object('x {"a": "}\\"{", "b": {"c": 1}} y') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert json_repair.first_object("{ open") is None and json_repair.first_object("none") is None and json_repair.first_object(None) is None


def test_retry():
    replies = iter(["nope", "nope", '{"a": 1}'])
    assert json_repair.parse_text_with_retry(lambda: next(replies), {"a": int}) == {"a": 1}
    with pytest.raises(json_repair.StructuredParseError) as e:
        json_repair.parse_text_with_retry(lambda: "nope", {"a": int}, max_attempts=2)
    assert e.value.raw == "nope"
    with pytest.raises(ValueError, match="max_attempts"):
        json_repair.parse_text_with_retry(lambda: "", {}, max_attempts=0)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("1", "a", "x", 0), ("2", "bb", "x", 1), ("3", "a", "y", 2)]
    spark.createDataFrame(rows, "id string, page_content string, lang string, _ord long").repartition(3).write.parquet(folder)
    stream = spark.readStream.schema("id string, page_content string, lang string, _ord long").parquet(folder)
    out = []
    incremental.stream_dedup(stream).writeStream.foreachBatch(lambda b, e: out.extend(r.page_content for r in b.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == ["a", "bb"]
    store = StoreTable.in_memory(spark)
    incremental.stream_to_store(stream, store, str(tmp_path / "c2")).awaitTermination()
    assert store.count() == 3
    chunks = spark.readStream.schema("id string, page_content string, lang string, _ord long").parquet(folder)
    joined = {}
    incremental.stream_chunks(chunks, lambda b, e: joined.update((r.lang, r.output) for r in b.collect()), str(tmp_path / "c3"), run_id="lang", seq="_ord", chunk="page_content").awaitTermination()
    assert joined == {"x": "abb", "y": "a"}


def test_chunks_of_a_run_over_several_batches(spark, tmp_path):
    folder, ddl = str(tmp_path / "chunks"), "run string, seq long, chunk string"
    seen: list[dict] = []

    def drain() -> None:
        rows = spark.readStream.schema(ddl).parquet(folder)
        incremental.stream_chunks(rows, lambda b, e: seen.append({r.run: (r.output, r.n_chunks) for r in b.collect()}), str(tmp_path / "c"), run_id="run").awaitTermination()

    for part in ([("a", 1, "He"), ("b", 1, "x")], [("a", 3, "o"), ("a", 2, "ll")], [("b", 2, None), ("a", 3, "o!"), ("c", None, "lost")]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(folder)
        drain()
    latest = {}
    for s in seen:
        latest |= s
    assert latest == {"a": ("Hello!", 3), "b": ("x", 2)} and any(s.get("a") == ("Hello", 3) for s in seen)


def test_reports(spark):
    df = fake.fake_documents(spark, 3, seed=1)
    meta = Metadata.columns("author", "topic")
    shown = report.content_stats_report(stats.content_stats_exact(df, meta=meta))
    assert "exact" in shown and "no issues" in shown
    assert "approximate" in report.content_stats_report(stats.content_stats_approx(df, meta=meta))
    assert "no documents" in report.content_stats_report({"count": 0})
    assert "author" in report.metadata_report(profile.metadata_profile(df, meta))
    assert "doc-0" in report.document_report(df, 1, max_length=20)
    assert report.markdown_report("# Title\n- **bold** and `code`\n[a](b)") == "Title\n=====\n• bold and code\na (b)"
    assert report.pretty_report({"a": 1}) == "{'a': 1}"
    out = io.StringIO()
    assert list(report.progress("abc", total=3, label="rows", out=out)) == ["a", "b", "c"] and "rows: 3 of 3, done" in out.getvalue()


def test_environment(tmp_path):
    assert environment.is_available("json") and not environment.is_available("no_such_module")
    with pytest.raises(ImportError, match="no_such_module"):
        environment.require("no_such_module")
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "mark").touch()
    assert environment.project_root(tmp_path / "a" / "b", "mark") == (tmp_path / "a").resolve() and environment.project_root(tmp_path, "no such mark") is None
    assert environment.commit_hash(tmp_path) is None


def test_one_cache_for_all(spark):
    calls = []
    table = runs.CacheTable(spark)
    run = runs.CachingRun(runs.Run(lambda s: calls.append(s) or f"<{s}>"), table)
    assert run.invoke("é") == "<é>" and run.batch(["é", "b"]) == ["<é>", "<b>"] and calls == ["é", "b"]
    df = spark.createDataFrame([("é",), ("c",), (None,)], "t string")
    assert {r.t: r.output for r in run.transform(df, "t").collect()} == {"é": "<é>", "c": "<c>", None: "<None>"}
    assert run.batch(["c", None]) == ["<c>", "<None>"] and calls == ["é", "b"]
    table.add(spark.createDataFrame([(runs.default_key("c"), "later")], "key string, value string"))
    assert run.invoke("c") == "<c>"  # the oldest entry counts
    other = runs.CachingRun(runs.Run(lambda v: {"n": v, "l": (1, 2)}), runs.CacheTable(spark))
    assert other.invoke(5) == {"n": 5, "l": (1, 2)} and other.invoke(5) == {"n": 5, "l": [1, 2]}
    small = runs.CachingRun(runs.Run(lambda v: v), keep=2)
    assert small.batch([1, 2, 3]) == [1, 2, 3] and len(small._local) == 2


def test_structured_calls(spark):
    schema = "city string, degrees double"
    plain = lambda ms: '```json\n{"city": "' + ms[-1]["content"] + '", "degrees": 7.5}\n```'
    got = runs.invoke_structured_llm(spark, plain, "Oslo", schema, system_prompt="s")
    assert got.parsed == {"city": "Oslo", "degrees": 7.5} and got.used_fallback and got.usage == dict.fromkeys(chat.USAGE, 0) and got.raw.startswith("```") and got.seconds >= 0
    native = lambda ms: {"content": "", "parsed": {"city": "Rome", "degrees": 20.0}, "usage_metadata": {"input_tokens": 3, "output_tokens": None}}
    got = asyncio.run(runs.ainvoke_structured_llm(spark, native, "x", schema))
    assert got.parsed["city"] == "Rome" and not got.used_fallback and got.usage["input_tokens"] == 3
    with pytest.raises(runs.StructuredOutputError):
        runs.invoke_structured_llm(spark, lambda ms: "no JSON", "x", schema)
    assert runs.invoke_structured_llm(spark, lambda ms: "no JSON", "x", schema, raise_error=False).error

    def mixed(ms):
        if ms[-1]["content"] == "bad":
            raise ValueError("no")
        return native(ms) if ms[-1]["content"] == "n" else plain(ms)

    rows = {r.q: r for r in runs.structured_calls(spark.createDataFrame([("n",), ("Oslo",), ("bad",)], "q string"), "q", mixed, schema).collect()}
    assert rows["n"].parsed.city == "Rome" and not rows["n"].used_fallback and rows["Oslo"].parsed.city == "Oslo" and rows["Oslo"].used_fallback
    assert rows["bad"].parsed is None and "ValueError" in rows["bad"].parsed_error and rows["n"].input_tokens == 3


def test_chat_streams_and_structured_replies():
    run = runs.ChatRun(lambda ms: {"content": "hi", "parsed": {"a": 1}}, system_prompt="s", chunks=lambda ms: iter(["h", "i", str(len(ms))]))
    assert run.invoke("x")["structured_response"] == {"a": 1} and run.invoke("x")["messages"][-1] == {"role": "assistant", "content": "hi"}
    assert list(run.stream("x")) == ["h", "i", "2"] and list(runs.ChatRun(lambda ms: "all").stream("x")) == ["all"]

    async def gather():
        return [c async for c in run.astream("x")]

    assert asyncio.run(gather()) == ["h", "i", "2"]


def test_recorded_asynchronous_stream(spark):
    store = StoreTable.in_memory(spark, kind="record")
    run = runs.RecordingRun(runs.Run(str), store)

    async def chunks(value):
        for c in value:
            yield c

    async def gather():
        return [c async for c in run.astream(chunks, "abc")]

    assert asyncio.run(gather()) == ["a", "b", "c"] and json.loads(store.all().first().metadata)["output"] == "abc"


def test_running_usage_over_all_rows(spark):
    rows = [(i, i % 5, 1, None) for i in range(200)]
    df = spark.createDataFrame(rows, "o long, input_tokens int, output_tokens int, total_tokens int").repartition(5)
    got = [(r.o, r.total_input_tokens, r.total_output_tokens, r.total_total_tokens) for r in runs.accumulated_usage(df, "o").orderBy("o").collect()]
    assert got == [(i, sum(k % 5 for k in range(i + 1)), i + 1, 0) for i in range(200)]


def test_serialized_values():
    @dataclasses.dataclass
    class Inner:
        x: int

    class Dumps:
        def model_dump(self):
            return {"inner": Inner(1)}

    assert runs.default_serialize({"a": (Dumps(), {3}), "t": Inner}) == {"a": [{"inner": {"x": 1}}, {3}], "t": Inner}


def test_shared_folder_needs_a_name_on_a_cluster():
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_scratch_scope(spark):
    with session.scratch_scope(spark) as tables:
        session.materialize(spark.range(3))
        kept = session.materialize(spark.range(5))
        own = tables.pop()
    assert kept.count() == 5 and len(tables) == 1
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(tables[0]).count()
    session.delete_tables(spark, [own])
