from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lang_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    found = lang_id.fit_and_identify(spark.read.parquet(f"{SF}/documents.parquet"))
    return lang_id.digest(found).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(labelled):
    own = [r for r in labelled if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in labelled)
    assert sum(r.lang == r.lang_pred for r in own) / len(own) >= 0.98
    assert all(0 <= r.score <= 1 for r in labelled)


def test_spans_cover_words_in_order(labelled):
    for r in labelled[:200]:
        assert all(a < b for a, b in zip(r.span_starts, r.span_ends, strict=True))
        assert all(b <= a for b, a in zip(r.span_ends, r.span_starts[1:], strict=False))
        assert all(x != y for x, y in zip(r.span_langs, r.span_langs[1:], strict=False))
        assert all(r.text[a].isalpha() or r.text[a : a + 1] for a in r.span_starts)


def _brute(scores, penalty):
    n, k = scores.shape
    v, back = scores[0].copy(), []
    for t in range(1, n):
        step = np.array([[v[i] - (penalty if i != j else 0) for i in range(k)] for j in range(k)])
        back.append(step.argmax(1))
        v = step.max(1) + scores[t]
    return v.max()


def _value(scores, path, penalty):
    return sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    texts = [rng.normal(0, 3, (int(rng.integers(1, 40)), 3)) for _ in range(60)]
    for scores, path in zip(texts, lang_id.viterbi(texts, 4.0), strict=True):
        assert _value(scores, path.tolist(), 4.0) == pytest.approx(_brute(scores, 4.0))
        const = lang_id.constant_path(scores, 4.0)
        if const is not None:
            assert _value(scores, [const] * len(scores), 4.0) == pytest.approx(_brute(scores, 4.0))


def _model(spark):
    rows = [("the quick brown fox and the lazy dog " * 20, "en"), ("der schnelle braune fuchs und der faule hund " * 20, "de"), ("быстрая лиса и ленивая собака " * 20, "ru")]
    return lang_id.fit(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string"))


def test_scripts_and_mixed_texts(spark):
    model = _model(spark)
    rng = random.Random(2)
    english, german = "the lazy dog and the quick fox".split(), "der faule hund und der schnelle fuchs".split()
    mixed = " ".join([rng.choice(english) for _ in range(30)] + [rng.choice(german) for _ in range(40)])
    rows = [("собака", None), (mixed, 1), ("12 34 !?", 2), (None, 3), ("", 4), ("漢字", 5), ("schnelle " * 3000, 6)]
    df = spark.createDataFrame([(t, i, "x") for i, (t, _) in enumerate(rows)], "text string, doc_id long, language string")
    got = {r.doc_id: r.language for r in lang_id.identify(df, model).collect()}
    assert got[0].lang_pred == "ru"
    assert got[1].langs == ["en", "de"] and got[1].lang_pred == "de" and mixed[got[1].starts[1] :].split()[0] in german
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 and got[i].starts == [] for i in (2, 3, 4))
    assert (got[5].lang_pred, got[5].score) == ("de", 0.0) and got[6].lang_pred == "de"


def test_offsets_are_code_points(spark):
    model = _model(spark)
    text = "🎉🎉 the dog"
    got = lang_id.identify(spark.createDataFrame([(text,)], "text string"), model).first().language
    assert (got.starts, got.ends) == ([3], [10])


def test_empty_tables_and_repeats(spark):
    ddl = "doc_id long, text string, lang string"
    assert lang_id.fit_and_identify(spark.createDataFrame([], ddl)).collect() == []
    rows = spark.createDataFrame([(None, "a b", None), (1, "a b", None), (1, "a b", None)], ddl)
    assert [r.lang_pred for r in lang_id.digest(lang_id.fit_and_identify(rows)).collect()] == ["und"] * 3


def test_prediction_ignores_labels_and_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    model = lang_id.fit(docs)
    a = [r.language for r in lang_id.identify(docs, model).orderBy("doc_id").collect()]
    b = [r.language for r in lang_id.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).orderBy("doc_id").collect()]
    assert a == b


def test_repeated_rows_and_null_ids_are_sampled_once(spark):
    rows = [(None, "the same words again and again", "en")] * 300 + [(7, "les mots de la langue", "fr")] * 200 + [(i, f"other words of a text number {chr(97 + i)}", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = lang_id.fit(df, docs_per_language=5)
    assert few.langs == ["en", "fr"]
    found = lang_id.digest(lang_id.fit_and_identify(df)).collect()
    assert len(found) == len(rows) and not any(r.held_out is None for r in found) and all(not r.held_out for r in found if r.doc_id is None)


def test_ties_go_to_the_first_language(spark):
    rows = [(0, "abc abc", "xx"), (2, "abc abc", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df)
    assert [r["lang_pred"] for r in lang_id.label(["abc", "abc abc"], model, 12.0)] == ["aa", "aa"]
