from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.model import Metadata, with_order
from quillspark.operators import dedup, filters, formatting, frames, ordering, profile, sketches, stats, vectors
from quillspark.plans import catalog

TYPED = Metadata.columns("category", "page")
JSON = Metadata.json("metadata")


def ids(df):
    return [r.id for r in df.orderBy("_ord").collect()]


@pytest.fixture(scope="module")
def typed(spark):
    rows = [("A", "Science", 1), ("B", "Cooking", 2), ("C", "Science", 3), ("D", "Technology", 4), ("E", None, None)]
    return with_order(spark.createDataFrame([(i, f"text {i}", c, p, k) for k, (i, c, p) in enumerate(rows)], "id string, page_content string, category string, page int, _ord long"))


@pytest.fixture(scope="module")
def loose(spark):
    """Metadata as JSON with all its types."""
    rows = [{"y": 2022, "b": True, "s": "abc"}, {"y": "2022", "b": False}, {"y": 2022.0, "n": None, "a.b": "z"}, {"y": "abc"}, {"a": {"b": "nest"}}, {"y": True}]
    return spark.createDataFrame([(str(i), json.dumps(m), i) for i, m in enumerate(rows, 1)], "id string, metadata string, _ord long")


def test_filter_eq(typed):
    assert ids(filters.filter_by_metadata(typed, TYPED, "category", "Science")) == ["A", "C"]
    assert ids(filters.filter_by_metadata(typed, TYPED, "category", None)) == ["E"]
    assert ids(filters.filter_by_metadata(typed, TYPED, "nowhere", "x")) == []
    assert ids(filters.filter_by_metadata(typed, TYPED, "nowhere", None)) == ["A", "B", "C", "D", "E"]


def test_filter_is_pushed_down(typed, tmp_path, spark):
    typed.write.parquet(str(tmp_path / "t"))
    plan = filters.filter_by_metadata_range(spark.read.parquet(str(tmp_path / "t")), TYPED, "page", 2, 3)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(page,2)" in plan and "LessThanOrEqual(page,3)" in plan


@pytest.mark.parametrize(("bounds", "expected"), [((2, 3), ["B", "C"]), ((3, None), ["C", "D"]), ((None, 2), ["A", "B"]), ((None, None), ["A", "B", "C", "D"]), ((9, 1), [])])
def test_filter_range(typed, bounds, expected):
    assert ids(filters.filter_by_metadata_range(typed, TYPED, "page", *bounds)) == expected


def test_filter_values(typed, spark):
    assert ids(filters.filter_by_metadata_values(typed, TYPED, "category", {"Science", "Cooking"})) == ["A", "B", "C"]
    assert ids(filters.filter_by_metadata_values(typed, TYPED, "category", set())) == []
    assert ids(filters.filter_by_metadata_values(typed, TYPED, "category", {"Cooking", None})) == ["B", "E"]
    assert ids(filters.filter_by_metadata_values(typed, TYPED, "page", spark.createDataFrame([(1,), (4,), (4,)], "p int"))) == ["A", "D"]
    assert ids(filters.filter_by_metadata_values(typed, TYPED, "page", [1, 3])) == ["A", "C"]
    assert ids(filters.filter_by_metadata_values(typed, TYPED, "page", spark.createDataFrame([("1",)], "p string"))) == []


def test_typed_columns_compare_like_python(spark):
    """Strings equal strings only; booleans and numbers compare by value."""
    rows = spark.createDataFrame([("A", "1", 1, True, 1.0, 0), ("B", "z", 2, False, 0.5, 1), ("C", None, None, None, None, 2)], "id string, s string, n int, b boolean, x double, _ord long")
    meta = Metadata.columns("s", "n", "b", "x")
    eq = lambda k, v: ids(filters.filter_by_metadata(rows, meta, k, v))
    assert eq("s", 1) == [] and eq("s", "1") == ["A"] and eq("s", True) == [] and eq("s", None) == ["C"]
    assert eq("n", "1") == [] and eq("n", 1) == eq("n", 1.0) == eq("n", True) == ["A"] and eq("n", False) == [] and eq("n", 1.5) == []
    assert eq("b", 1) == eq("b", True) == eq("b", 1.0) == ["A"] and eq("b", 0) == ["B"] and eq("b", 2) == [] and eq("b", "true") == []
    assert eq("x", 1) == eq("x", True) == ["A"] and eq("x", "0.5") == [] and eq("x", [1]) == []
    several = lambda k, v: ids(filters.filter_by_metadata_values(rows, meta, k, v))
    assert several("s", [1, "z"]) == ["B"] and several("n", ["1", 2, True]) == ["A", "B"] and several("b", ["x", 0, None]) == ["B", "C"] and several("x", ["a"]) == []
    assert several("b", spark.createDataFrame([(1,)], "v int")) == ["A"]
    between = lambda k, *v: ids(filters.filter_by_metadata_range(rows, meta, k, *v))
    assert between("s", 0, 5) == [] and between("s", "0", "5") == ["A"] and between("n", True, 2) == ["A", "B"] and between("b", 1) == ["A"] and between("n", "1") == []
    with pytest.raises(Exception, match="cannot be compared"):
        filters.filter_by_metadata_range(rows, meta, "s", 0, 5, strict=True).collect()


def test_filters_over_maps(spark):
    rows = spark.createDataFrame([("A", {"k": 1}, 0), ("B", {"k": 2, "j": 1}, 1), ("C", {}, 2)], "id string, metadata map<string,int>, _ord long")
    meta = Metadata.map()
    assert ids(filters.filter_by_metadata(rows, meta, "k", "1")) == [] and ids(filters.filter_by_metadata(rows, meta, "k", True)) == ["A"]
    assert ids(filters.filter_by_metadata_values(rows, meta, "j", [1, None])) == ["A", "B", "C"] and ids(filters.filter_by_metadata_range(rows, meta, "k", 2)) == ["B"]


@pytest.mark.parametrize(
    ("key", "value", "expected"),
    [("y", 2022, ["1", "3"]), ("y", "2022", ["2"]), ("b", True, ["1"]), ("b", "true", []), ("n", None, ["1", "2", "3", "4", "5", "6"]), ("a.b", "nest", []), ("a.b", "z", ["3"]), ("a", {"b": "nest"}, ["5"]), ("y", 1, ["6"]), ("b", 0, ["2"])],
)
def test_filter_json_compares_like_python(loose, key, value, expected):
    assert ids(filters.filter_by_metadata(loose, JSON, key, value)) == expected


def test_filter_json_range_and_presence(loose):
    assert ids(filters.filter_by_metadata_range(loose, JSON, "y", 2000, 2022)) == ["1", "3"]
    assert ids(filters.filter_by_metadata_range(loose, JSON, "y", "2", "b")) == ["2", "4"]
    assert ids(filters.filter_by_metadata_range(loose, JSON, "n")) == ["3"]  # present and null
    assert ids(filters.filter_by_metadata_range(loose, JSON, "n", lower=0)) == []
    with pytest.raises(Exception, match="cannot be compared"):
        filters.filter_by_metadata_range(loose, JSON, "n", lower=0, strict=True).collect()


def test_map_metadata(spark):
    df = spark.createDataFrame([("1", {"k": "a"}, 0), ("2", {"k": None}, 1), ("3", {}, 2), ("4", None, 3)], "id string, m map<string,string>, _ord long")
    meta = Metadata.map("m")
    assert ids(filters.filter_by_metadata(df, meta, "k", "a")) == ["1"]
    assert ids(filters.filter_by_metadata(df, meta, "k", None)) == ["2", "3", "4"]
    assert ids(filters.filter_by_metadata_range(df, meta, "k")) == ["1", "2"]
    assert [r.k for r in df.select(meta.n_keys().alias("k")).collect()] == [1, 1, 0, 0]


def test_sort(spark):
    df = spark.createDataFrame([("b.txt", 0), (None, 1), ("a.txt", 2), ("b.txt", 3)], "source string, _ord long")
    meta = Metadata.columns("source")
    places = lambda d: [r._ord for r in d.collect()]
    assert places(ordering.sort_by_metadata(df, meta, "source")) == [2, 0, 3, 1]
    assert places(ordering.sort_by_metadata(df, meta, "source", reverse=True)) == [0, 3, 2, 1]
    assert places(ordering.sort_by_metadata(df, meta, "source", keep_missing=False)) == [2, 0, 3]
    assert places(ordering.sort_by_key(df.where("source is not null"), "source", reverse=True)) == [0, 3, 2]
    with pytest.raises(Exception, match="nowhere"):
        ordering.sort_by_key(df, "nowhere").collect()


def test_first_last_shuffle_sample(spark):
    df = spark.range(20).select(F.col("id").alias("_ord"))
    assert [r[0] for r in ordering.first_n(df, 3).collect()] == [0, 1, 2]
    assert [r[0] for r in ordering.last_n(df, 3).collect()] == [17, 18, 19]
    one = [r[0] for r in ordering.shuffle(df, 1).collect()]
    assert sorted(one) == list(range(20)) and one != list(range(20))
    assert one == [r[0] for r in ordering.shuffle(df.repartition(5), 1).collect()]
    assert one != [r[0] for r in ordering.shuffle(df, 2).collect()]
    assert ordering.sample_n(df, 7).count() == 7
    for f in (ordering.first_n, ordering.last_n):
        with pytest.raises(ValueError, match="at least 1"):
            f(df, 0)


def test_extreme_lengths(spark):
    df = spark.createDataFrame([("a", "xx", 0), ("b", "", 1), ("c", "y", 2), ("d", "z", 3), ("e", "  ", 4), ("f", None, 5)], "id string, page_content string, _ord long")
    assert ordering.shortest_document(df).first().id == "b"
    assert ordering.shortest_document(df, ignore_empty=True).first().id == "c"
    assert ordering.longest_document(df).first().id == "a"
    assert ordering.longest_document(df.where("id = 'e'"), ignore_empty=True, treat_whitespace_as_empty=True).first() is None
    assert [(r.id, r.length) for r in ordering.document_id_lengths(df, sort=True).collect()][:3] == [("b", 0), ("f", 0), ("c", 1)]


def test_dedup_and_consistency(spark):
    meta = Metadata.json("metadata")
    rows = [(None, "A", '{"a":1,"b":2}'), (None, "A", '{"b":2,"a":1}'), ("1", "A", '{"a":1}'), ("1", "B", '{"a":1}'), ("1", "A", '{"a":1}')]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, page_content string, metadata string, _ord long")
    assert sorted(r._ord for r in dedup.deduplicate(df, meta, log=True).collect()) == [0, 2, 3]
    assert not dedup.check_consistency(df, meta)
    with pytest.raises(dedup.DocumentConsistencyError):
        dedup.check_consistency(df, meta, raise_error=True)
    assert dedup.check_consistency(df.where("_ord <> 3"), meta)
    assert dedup.consistency_violations(df, meta).first().first_conflict == 3


def test_duplicate_groups(spark):
    df = spark.createDataFrame([("a", "hello", 0), ("b", "world", 1), (None, "hello", 2), ("d", "world", 3), ("e", "x", 4)], "id string, page_content string, _ord long")
    assert [r.ids for r in dedup.duplicate_content_groups(df).collect()] == [["a", None], ["b", "d"]]
    assert dedup.duplicate_content_groups(df.limit(0)).collect() == []


def test_ids_and_hashes(spark):
    meta = {"b": 1, "a": "é", "c": 1.0}
    df = spark.createDataFrame([(None, "Hello", json.dumps(meta), 0), ("keep", "World", "{}", 1)], "id string, page_content string, metadata string, _ord long")
    made = dedup.assign_ids(df, JSON, byte_parity=False).orderBy("_ord").collect()
    assert uuid.UUID(made[0].id).version == 5 and made[1].id == "keep"
    canonical = df.select(text.canonical_json(F.col("metadata")).alias("c")).first().c
    assert canonical == json.dumps(meta, sort_keys=True)
    own = df.select(text.hash_document_uuid(F.col("page_content"), text.canonical_json(F.col("metadata"))).alias("u")).first().u
    assert own == str(uuid.uuid5(uuid.UUID(text.ID_NAMESPACE), "Hello" + canonical))
    assert dedup.assign_ids(df, JSON, force=True).where("id = 'keep'").count() == 0
    for n in (2, 64, 128):
        assert len(df.select(text.hash_document(F.col("page_content"), JSON.canonical(), n).alias("h")).first().h) == n
    with pytest.raises(ValueError, match="length"):
        text.digest(F.lit("x"), 129)
    one = dedup.hash_documents(df, JSON).first().digest
    assert one != dedup.hash_documents(df.withColumn("_ord", -F.col("_ord") + 1), JSON).first().digest
    assert json.loads(dedup.copy_ids_to_metadata(df, JSON).orderBy("_ord").collect()[1].metadata) == {"source_id": "keep"}


def test_uuid5_matches_python(spark):
    rng = random.Random(1)
    values = ["", "é🎉", *["".join(rng.choice("abc é\n🎉\\\"") for _ in range(rng.randint(0, 30))) for _ in range(200)]]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.uuid5(F.col("v")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(text.ID_NAMESPACE), r.v)) for r in got)


def test_blanks_match_python_strip(spark):
    blanks = [chr(c) for c in range(0x3100) if not chr(c).strip()]
    assert len(blanks) == 29
    values = [*blanks, "".join(blanks), "a", " a ", "", "​", *[chr(c) for c in (0x1B, 0x20, 0x86, 0x2030)]]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", text.is_whitespace_only(F.col("v")).alias("w"), text.strip(F.col("v")).alias("s")).collect()
    assert all(r.w == (r.v != "" and not r.v.strip()) and r.s == r.v.strip() for r in got)


def test_truncate_and_length(spark):
    rows = [("hello world again", 13), ("abcdefghij klm", 12), ("short", 10), ("aaaaaaaaaaaaaaa", 5)]
    for value, n in rows:
        got = spark.createDataFrame([(value,)], "v string").select(text.truncate(F.col("v"), n).alias("t"), text.length(F.col("v")).alias("n")).first()
        cut = value[:n]
        if len(value) > n and cut.rfind(" ") > n * 0.8:
            cut = cut[: cut.rfind(" ")]
        assert got.t.content == (cut.rstrip() if len(value) > n else value) and got.t.truncated == (len(value) > n) and got.n == len(value)


def _frame(spark, lengths):
    return spark.createDataFrame([(f"d{i}", "x" * n + "", i) for i, n in enumerate(lengths)], "id string, page_content string, _ord long")


def _percentile(lengths, p):
    own = sorted(lengths)
    return own[round(p / 100 * (len(own) - 1))]


def test_stats_of_known_lengths(spark):
    r = stats.content_stats_exact(_frame(spark, [2, 4, 4, 4, 5, 5, 7, 9])).first()
    assert (r.avg_chars, r.std_dev_chars, r.p50_chars, r.p90_chars, r.p99_chars, r.duplicate_count) == (5.0, 2.0, 5, 7, 9, 3)
    r = stats.content_stats_exact(_frame(spark, range(1, 11))).first()
    assert (round(r.std_dev_chars, 12), r.p50_chars, r.p90_chars, r.p99_chars) == (round(2.8722813232690143, 12), 5, 9, 10)
    r = stats.content_stats_exact(_frame(spark, [])).first()
    assert (r["count"], r.total_chars, r.avg_chars, r.std_dev_chars, r.min_chars, r.min_doc_id, r.p50_chars) == (0, 0, 0.0, 0.0, None, None, 0)


def test_stats_of_rows_with_gaps(spark):
    rows = [("ok", "real content", "x"), ("empty", "", "x"), ("whitespace", "   \t\n", "x"), (None, "no id", "x"), ("no_meta", "content", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, page_content string, source string, _ord long")
    r = stats.content_stats_exact(df, meta=Metadata.columns("source")).first()
    assert (r["count"], r.total_chars, r.avg_chars, round(r.std_dev_chars, 12)) == (5, 29, 5.8, round(3.8678159211627436, 12))
    assert (r.min_chars, r.min_doc_id, r.max_chars, r.max_doc_id, r.p50_chars, r.p90_chars) == (0, "empty", 12, "ok", 5, 12)
    assert (r.empty_count, r.whitespace_only_count, r.none_id_count, r.missing_metadata_count, r.duplicate_count) == (1, 1, 1, 1, 0)
    a = stats.content_stats_approx(df, meta=Metadata.columns("source")).first()
    assert (a["count"], a.total_chars, a.min_doc_id, a.max_doc_id, a.p50_chars_approx, a.approx_duplicate_count) == (5, 29, "empty", "ok", 5, 0)


def test_percentiles_against_python(spark):
    rng = random.Random(3)
    for _ in range(4):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(1, 60))]
        r = stats.content_stats_exact(_frame(spark, lengths)).first()
        assert [r[f"p{p}_chars"] for p in (50, 90, 99)] == [_percentile(lengths, p) for p in (50, 90, 99)]
        assert r.duplicate_count == len(lengths) - len(set(lengths))


def test_incremental_stats_equal_batch(spark):
    parts = [[3, 1, 4], [1, 5], [9, 2, 6]]
    made = stats.ExactContentStats()
    for k, part in enumerate(parts):
        made.update(spark.createDataFrame([(f"{k}-{i}", "y" * n, i) for i, n in enumerate(part)], "id string, page_content string, _ord long"))
    r = made.result().first()
    assert (r["count"], r.total_chars, r.min_doc_id, r.max_doc_id, r.p50_chars, r.duplicate_count) == (8, 31, "0-1", "2-0", 4, 1)
    assert made.result().first() == r


def test_profile_of_mixed_values(spark):
    rows = [{"source": "a.pdf", "author": "x"}, {}, {"source": None}, {"source": ""}, {"source": 123}]
    df = spark.createDataFrame([(str(i), json.dumps(m), i) for i, m in enumerate(rows)], "id string, metadata string, _ord long")
    got = {r.key: r for r in profile.profile_flags(profile.metadata_profile(df, JSON)).collect()}
    s = got["source"]
    assert s.value_types == ["NoneType", "int", "str"] and s.none_or_empty_count == 2 and s.unique_values_sample_truncated
    assert s.unique_values_sample == ["", None, "a.pdf"]
    assert (got["author"].present_in_docs, got["author"].missing_in_docs) == (1, 4)
    assert s.flags == ["missing values", "mixed types", "has None/empty"]
    o = profile.metadata_overview(df, JSON).first()
    assert (o["count"], o.missing_metadata_count, o.min_keys, o.max_keys, o.distinct_keys_seen) == (5, 1, 0, 2, 2)


def test_profile_lists_and_caps(spark):
    df = spark.createDataFrame([(str(i), json.dumps({"tags": ["a"], "uid": f"u{i}"}), i) for i in range(10)], "id string, metadata string, _ord long")
    got = {r.key: r for r in profile.metadata_profile(df, JSON).collect()}
    assert got["tags"].value_types == ["list"] and got["tags"].unique_values_sample == [] and got["tags"].unique_values_sample_truncated
    assert got["uid"].unique_values_sample == ["u0", "u1", "u2"] and got["uid"].unique_values_sample_truncated
    full = {r.key: r for r in profile.metadata_profile(df, JSON, n_sample_values=None).collect()}
    assert len(full["uid"].unique_values_sample) == 10 and not full["uid"].unique_values_sample_truncated


def test_profile_sample_rule_against_python(spark):
    rng = random.Random(5)
    for _ in range(5):
        values = [rng.choice(["a", "b", "c", "d", "e", ["x"]]) if rng.random() < 0.9 else None for _ in range(12)]
        df = spark.createDataFrame([(str(i), json.dumps({"k": v} if v is not None else {}), i) for i, v in enumerate(values)], "id string, metadata string, _ord long")
        seen, cut = [], False
        for v in values:
            if v is None or cut and isinstance(v, str):
                continue
            if isinstance(v, list):
                cut = True
            elif v not in seen:
                if len(seen) < 3:
                    seen.append(v)
                else:
                    cut = True
        rows = profile.metadata_profile(df, JSON).collect()
        assert not rows or (rows[0].unique_values_sample, rows[0].unique_values_sample_truncated) == (sorted(seen), cut)


def test_formats(spark):
    df = spark.createDataFrame([("The cat sat.", "z", "a", 0), ("Dogs \"bark\".", None, None, 1)], "page_content string, zebra string, apple string, _ord long")
    meta = Metadata.columns("zebra", "apple")
    assert formatting.format_documents(df, meta).first().text == '<document id="1">\napple: a\nzebra: z\n\nThe cat sat.\n</document>\n\n<document id="2">\nDogs "bark".\n</document>'
    assert formatting.format_documents(df, None, "markdown").first().text == '## Document 1\n\nThe cat sat.\n\n## Document 2\n\nDogs "bark".'
    expected = [{"id": 1, "metadata": {"apple": "a", "zebra": "z"}, "content": "The cat sat."}, {"id": 2, "content": 'Dogs "bark".'}]
    assert formatting.format_documents(df, meta, "json").first().text == json.dumps(expected, indent=2)
    assert formatting.format_documents(df.limit(0), None, "json").first().text == "[]"
    assert formatting.format_documents(df.limit(0)).first().text == ""
    loose = df.select("page_content", "_ord", F.lit('{"b": 1, "a": "x"}').alias("metadata")).limit(1)
    assert formatting.format_documents(loose, JSON, "markdown").first().text == "## Document 1\n\n- a: x\n- b: 1\n\nThe cat sat."
    with pytest.raises(ValueError, match="unknown"):
        formatting.format_documents(df, None, "html")


def test_bloom_filter(spark):
    own = sketches.BloomFilter(1000, 0.01)
    assert abs(sketches.BloomFilter(1_000_000, 0.01).size - 9_585_058) < 64 and "ä" not in own
    assert not any(own.add_and_check(f"k{i}") for i in range(5))
    assert all(f"k{i}" in own and own.add_and_check(f"k{i}") for i in range(5))
    assert sum(f"other{i}" in own for i in range(1000)) < 50
    jvm = sketches.spark_bloom_filter(spark.range(10), "id", 100, 0.01)
    assert all(jvm.mightContain(i) for i in range(10))
    with pytest.raises(ValueError, match="fp_rate"):
        sketches.BloomFilter(10, 2)


def test_vectors_and_frames(spark):
    df = spark.createDataFrame([("id_0", [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]), ("id_1", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), ("id_2", [2.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "id string, embedding array<float>")
    assert [r.id for r in vectors.nearest(df, [1, 0, 0, 0, 0, 0.5], 2).collect()] == ["id_0", "id_2"]
    shown = vectors.inspect_embeddings(df, 1).first()
    assert (shown.dimension, shown.components) == (6, "[1.0000, 0.0000, 0.0000, 0.0000, 0.0000, …]")
    gaps = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert frames.drop_null_columns(gaps).columns == ["a"] and frames.drop_null_columns(gaps.limit(0)).columns == ["a", "b"]
    chunks = frames.split_text(spark.createDataFrame([("d", "abcdefghij")], "id string, page_content string"), chunk_size=4, overlap=1).collect()
    assert [c.page_content for c in chunks] == ["abcd", "defg", "ghij"]


@pytest.mark.parametrize("name", ["format_xml", "format_markdown", "format_json"])
def test_every_document_is_formatted(spark, name):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = "\n".join(r.text for r in catalog.QUERIES[name](spark, sf).collect())
    assert len(texts) > 10 and all((json.dumps(t, ensure_ascii=False) if "json" in name else t) in got for t in texts)


def test_whole_tables_in_the_catalogue(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = {name: catalog.QUERIES[name](spark, sf).count() for name in ("id_lengths_sorted", "declarative_pipeline", "recorded_runs")}
    assert n == {
        "id_lengths_sorted": docs.count(),
        "declarative_pipeline": docs.where("lang = 'en' and n_chars >= 1000").count(),
        "recorded_runs": spark.read.parquet(f"{sf}/conversations.parquet").count(),
    }


@pytest.mark.parametrize("name", ["declarative_pipeline", "id_lengths_sorted", "sort_by_key", "sort_by_metadata_asc", "sort_by_metadata_desc", "sort_by_metadata_drop_missing"])
def test_places_do_not_depend_on_partitions(spark, name):
    """The sort's shuffle has many partitions, of which few of small rows make one."""
    from .test_entry import compare

    few, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = {k: spark.conf.get(k) for k in (few, size, least)}
    try:
        for k, v in ((few, "64"), (size, "16k"), (least, "1k"), ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")):
            spark.conf.set(k, v)
        compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.1")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")


# -- incremental forms -----------------------------------------------------
def _parts(spark, n=4000):
    rows = [(f"d{i}", "x" * ((i * 37) % 1013) + str(i % 1900), i % 7, i) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, page_content string, k int, _ord long")
    return df, [df.where(f"_ord >= {a} and _ord < {a + n // 4}").withColumn("_ord", F.col("_ord") - a) for a in range(0, n, n // 4)]


def test_incremental_approximate_statistics(spark):
    df, parts = _parts(spark)
    meta = Metadata.columns("k")
    state = stats.ApproxContentStats(meta=meta)
    for p in parts:
        state.update(p)
    got, exact = state.result().first().asDict(), stats.content_stats_exact(df, meta=meta).first().asDict()
    for c in ("count", "total_chars", "avg_chars", "std_dev_chars", "min_chars", "max_chars", "min_doc_id", "max_doc_id", "empty_count", "missing_metadata_count"):
        assert got[c] == pytest.approx(exact[c]), c
    lengths = sorted(len(r.page_content) for r in df.collect())
    for p in (50, 90, 99):
        place = sum(x < got[f"p{p}_chars_approx"] for x in lengths) / len(lengths)
        assert abs(place - p / 100) < 0.015
    distinct = exact["count"] - exact["duplicate_count"]
    assert abs(got["count"] - got["approx_duplicate_count"] - distinct) <= 4 * got["duplicate_error"] * distinct
    assert set(got) == set(stats.content_stats_approx(df, meta=meta).columns)
    empty = stats.ApproxContentStats().update(df.limit(0)).result().first()
    assert (empty["count"], empty.min_chars, empty.p50_chars_approx, empty.approx_duplicate_count) == (0, None, 0, 0)


def test_approximate_percentiles_and_duplicates_keep_their_error(spark):
    df, _ = _parts(spark)
    got, exact = stats.content_stats_approx(df).first(), stats.content_stats_exact(df).first()
    assert all(abs(got[f"p{p}_chars_approx"] - exact[f"p{p}_chars"]) <= 5 for p in (50, 90, 99))
    distinct = exact["count"] - exact["duplicate_count"]
    assert abs(got["count"] - got["approx_duplicate_count"] - distinct) <= 4 * got["duplicate_error"] * distinct


@pytest.mark.parametrize("unit", ["docs", "records"])
def test_incremental_profile(spark, unit):
    df, parts = _parts(spark, 400)
    meta = Metadata.columns("k")
    state = profile.MetadataProfile(meta, unit=unit)
    for p in parts:
        state.update(p)
    assert state.result().collect() == profile.metadata_profile(df, meta, unit=unit).collect()
    loose = spark.createDataFrame([("1", json.dumps({"s": "a", "t": [1]}), 0), ("2", json.dumps({"s": None}), 1)], "id string, metadata string, _ord long")
    one = profile.MetadataProfile(Metadata.json()).update(loose.where("_ord = 0")).update(loose.where("_ord = 1").withColumn("_ord", F.lit(0).cast("long")))
    assert sorted(map(str, one.result().collect())) == sorted(map(str, profile.metadata_profile(loose, Metadata.json()).collect()))
    with pytest.raises(ValueError, match="no rows yet"):
        profile.MetadataProfile(meta).result()


def test_hash_of_values():
    class Own:
        def __init__(self, x):
            self.x = x

    registry = text.HasherRegistry()
    registry.register(Own, lambda o: {"x": o.x})
    with pytest.raises(ValueError):
        registry.register(Own, repr)
    assert text.hash_value({"a": 1, "b": [Own(2)]}, registry) == text.hash_value({"b": (Own(2),), "a": 1}, registry)
    assert text.hash_value(1) != text.hash_value("1") and text.hash_value({1: "x"}) != text.hash_value({"1": "x"}) and len(text.hash_value(None, length=10)) == 10
    with pytest.raises(TypeError):
        text.hash_value(Own(1))
    assert text.hash_value(Own(1), ignore_unhashable=True) == text.hash_value(Own(2), ignore_unhashable=True)
