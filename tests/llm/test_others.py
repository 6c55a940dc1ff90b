from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, packing, quality, queries, token_count

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, contamination string"


# -- decontamination -------------------------------------------------------
def brute_contamination(docs, items, window=13):
    """The contract word by word."""
    wins = []
    for i, t in items:
        w = decontaminate.normal_words(t)
        wins += [(i, w[k : k + window]) for k in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for d, t in docs:
        words, hit, had = decontaminate.normal_words(t), set(), set()
        for i, w in wins:
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    had.add(i)
        ids = ",".join(sorted(str(i) for i in had if i is not None))
        out.append((d, len(words), len(hit), len(had), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out)


def run_contamination(spark, docs, items, **options):
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(spark.createDataFrame([(*d, "x") for d in docs], DOCS), b, **options)
    return sorted(tuple(r) for r in decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


@pytest.mark.parametrize("block_windows", [10, 10**6])
def test_contamination_against_brute_force(spark, block_windows):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "Bb", "c1", "é", "Ünd", "x_y", "don't", "日本"]) + rng.choice(["", "q", "zz"])
    items = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(15)] + [(99, None), (1, "repeated item id with words"), (None, "no item id here"), (None, "repeated item id with words")]
    docs = []
    for d in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        docs.append((d, rng.choice([" ", "", " - "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (1, docs[1][1]), (103, "word " * 50_000), (104, "a repeated item id with words"), (105, "no item id here or there")]
    assert run_contamination(spark, docs, items, block_windows=block_windows) == brute_contamination(docs, items)


def test_contamination_offsets(spark):
    text = "Ünder🎉 THE, big old TREE; stands"
    df = spark.createDataFrame([(1, text, None)], DOCS)
    items = spark.createDataFrame([(5, "the big old tree")], "item_id long, text string")
    r = decontaminate.find_contamination(df, items).first().contamination
    assert [text[a:b] for a, b in zip(r.starts, r.ends, strict=True)] == ["THE, big old TREE"] and r["items"] == ["5"] and r.contaminated


def test_many_different_words_and_string_ids(spark):
    items = spark.createDataFrame([("q1", " ".join(f"v{i}" for i in range(70_000)))], "item_id string, text string")
    docs = spark.createDataFrame([("d", " ".join(f"v{i}" for i in range(60_000, 60_013))), ("e", "v1 v3")], "doc_id string, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.find_contamination(docs, items).collect()}
    assert got["d"].n_hit == 13 and got["d"]["items"] == ["q1"] and got["e"].n_hit == 0


def test_contamination_of_empty_tables(spark):
    assert run_contamination(spark, [], [(1, "a b")]) == []
    assert [r[2:4] for r in run_contamination(spark, [(1, "a b")], [])] == [(0, 0)]


# -- packing ---------------------------------------------------------------
def test_packing_keeps_every_token(spark, count):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.6) * 40))) for i in range(400)] + [(500, None), (501, ""), (7, "again and again"), (None, "no id"), (502, " w" * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, capacity int")
    got = packing.pack_documents(df, shard_rows=100).collect()
    per_doc, per_bin = {}, {}
    for r in got:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.n_tokens
        per_bin.setdefault(r.bin_id, []).append(r)
    expected = {}
    for d, t in rows:
        if t:
            expected[d] = expected.get(d, 0) + count(t)
    assert per_doc == expected
    for own in per_bin.values():
        used, capacity = own[0].used, own[0].capacity
        assert used == sum(r.n_tokens for r in own) <= capacity in packing.SIZES
        assert not [s for s in packing.SIZES if used <= s < capacity]
        spans = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in own)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    pieces = sorted((r.doc_offset, r.n_tokens) for r in got if r.doc_id == 502)
    assert [p[0] for p in pieces] == [0, 8192, 16384] and sum(p[1] for p in pieces) == 20_000


def test_best_fit_against_plain_search():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 64) for _ in range(60)), reverse=True)
        where, _ = packing.best_fit(lengths, (16, 32, 64), 32)
        rooms: list[int] = []
        for n, b in zip(lengths, where, strict=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                assert rooms[b] == min(fits)
            else:
                assert b == len(rooms)
                rooms.append(32 if n <= 32 else 64)
            rooms[b] -= n
        trials = [sum(next(s for s in (16, 32, 64) if s >= u) + 5 for u in packing.best_fit(lengths, (16, 32, 64), s, 5)[1]) for s in (None, 16, 32, 64)]
        _, _, final = packing.pack(lengths, (16, 32, 64), 5)
        assert sum(final) + 5 * len(final) == min(trials)


def optimum(lengths, sizes, overhead):
    """Least cost over all partitions of the pieces."""
    from functools import cache

    n = len(lengths)
    sums = [sum(x for i, x in enumerate(lengths) if m >> i & 1) for m in range(1 << n)]
    cost = [min((s + overhead for s in sizes if s >= t), default=None) for t in sums]

    @cache
    def best(m):
        if not m:
            return 0
        low, rest = m & -m, m & (m - 1)
        part, out = rest, None
        while True:
            c = cost[part | low]
            if c is not None:
                c += best(rest & ~part)
                out = c if out is None or c < out else out
            if not part:
                return out
            part = (part - 1) & rest

    return best((1 << n) - 1)


def test_packing_is_near_the_optimum():
    rng = random.Random(6)
    ratios, single = [], []
    for _ in range(60):
        lengths = sorted((rng.choice([rng.randint(1, 12), rng.randint(8, 40)]) for _ in range(rng.randint(1, 9))), reverse=True)
        _, used, final = packing.pack(lengths, (10, 20, 40), 3)
        assert sum(used) == sum(lengths)
        least = optimum(lengths, (10, 20, 40), 3)
        ratios.append((sum(final) + 3 * len(final)) / least)
        single.append(sum(packing.fits_of((10, 20, 40))[u] + 3 for u in packing.best_fit(lengths, (10, 20, 40), 40, 3)[1]) / least)
    assert min(ratios) >= 1 and max(ratios) <= 1.25 and sum(ratios) < min(61.2, sum(single))


def test_trial_fill():
    left = packing._Remaining([5, 5, 3, 2, 1])
    assert [left.filled(r) for r in (0, 1, 4, 10, 13, 100)] == [0, 1, 4, 10, 13, 16]
    left.take(5)
    assert left.filled(10) == 10 and left.filled(9) == 9


def test_packing_of_nothing_and_layouts(spark):
    ddl = "doc_id long, text string"
    assert packing.pack_documents(spark.createDataFrame([], ddl)).collect() == []
    df = spark.createDataFrame([(i, " w" * (i + 1)) for i in range(50)], ddl)
    a, b = (sorted(tuple(r) for r in packing.pack_documents(d).collect()) for d in (df, df.repartition(7)))
    assert a == b
    words = packing.pack_documents(spark.createDataFrame([("x", "a b"), ("y", "c"), (None, "d e f")], "doc_id string, text string"), length=F.size(F.split("text", " "))).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.capacity, r.used) for r in words) == [("None", 3, 512, 6), ("x", 2, 512, 6), ("y", 1, 512, 6)]


# -- token counts ----------------------------------------------------------
@pytest.fixture(scope="module")
def count():
    enc = token_count.encoding(token_count.default_ranks())
    return lambda t: len(enc.encode_ordinary(t))


def random_text(rng, n):
    pieces = [" ", "  ", "\n", "\n\n", "\t", "word", "Wörter", "don't", "it's ", "123", " 4567", "!?", "日本語", "🎉", "\x1c", " ", " ", "a", " the"]
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_tree_counts_after_edits(count, seed):
    rng = random.Random(seed)
    counter = token_count.counter(token_count.default_ranks())
    text = random_text(rng, rng.choice([0, 1, 50, 800]))
    tree = token_count.TokenTree(text, counter, leaf_chars=rng.choice([1, 7, 64]))
    assert tree.n_tokens == count(text) and tree.text() == text
    for _ in range(60):
        start, n, new = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 5, 200]), random_text(rng, rng.choice([0, 1, 4, 100]))
        a = max(0, min(start, len(text)))
        text = text[:a] + new + text[min(len(text), a + n) :]
        tree.edit(start, n, new)
        assert tree.text() == text and tree.n_tokens == count(text) and tree.n_chars == len(text)
        assert sum(tree.tokens()) == tree.n_tokens


def test_edits_touch_few_leaves(count):
    counter = token_count.counter(token_count.default_ranks())
    tree = token_count.TokenTree("some words here " * 20_000, counter)
    tree.encoded = 0
    tree.edit(100_000, 3, "new")
    assert tree.encoded < 5_000


def test_token_query_against_encoding(spark, count):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (4, "plain words " * 900), (4, "plain words " * 900), (5, " "), (6, "🎉é" * 30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tokens int")
    got = token_count.digest(df).collect()

    def edited(t):
        n = len(t)
        for start, k, new in ((n // 3, 0, " (reviewed) "), (n // 2, 7, ""), (n * 3 // 4, 4, "x\n")):
            start = min(start, len(t))
            t = t[:start] + new + t[start + k :]
        return t

    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got) == sorted((d, count(t or ""), count(edited(t or ""))) for d, t in rows)
    assert token_count.digest(df.limit(0)).collect() == []


def test_a_tree_from_stored_leaves(spark, count):
    """The second run encodes nothing but what the edit touches; a state of another text is not used."""
    text = "some words here " * 20_000
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "short text")], "doc_id long, text string")
    kept = token_count.count_tokens(docs).collect()
    assert [r.tokens.n_encoded_chars for r in kept] == [len(text), 0, 10]
    edit = [(100_000, 3, "new")]
    rows = [(r.doc_id, r.text, (r.tokens.leaf_chars, r.tokens.leaf_tokens), edit) for r in kept] + [(4, text, ([5], [1]), edit), (5, "abc", None, None), (6, "abc", ([1, None], [1, 1]), None)]
    again = spark.createDataFrame(rows, f"doc_id long, text string, state {token_count.STATE_DDL}, edits {token_count.EDITS_DDL}")
    got = {r.doc_id: r.tokens for r in token_count.count_tokens(again, edits=F.col("edits"), state=F.col("state"), keep_text=True).collect()}
    edited = text[:100_000] + "new" + text[100_003:]
    assert got[1].n_encoded_chars == got[1].n_reencoded_chars < 5_000 and got[4].n_encoded_chars > len(text)
    for i in (1, 4):
        assert got[i].n_tokens == count(text) and got[i].n_tokens_edited == count(edited) and got[i].text_edited == edited
    assert got[2].text_edited == "new" and got[3].text_edited == "short textnew" and got[5].n_tokens == got[6].n_tokens == count("abc")


def test_gathered_edits(spark, count):
    docs = spark.createDataFrame([(1, "one two three"), (2, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "ONE"), (1, 1, 4, 3, "2")], "doc_id long, edit_no int, start long, n_delete long, insert string")
    joined = docs.join(token_count.gather_edits(edits), "doc_id", "left")
    got = {r.doc_id: r.tokens for r in token_count.count_tokens(joined, edits=F.col("edits")).collect()}
    assert got[1].n_tokens_edited == count("ONE 2 three") and got[2].n_tokens_edited == count("x") == got[2].n_tokens


# -- quality ---------------------------------------------------------------
def synthetic(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 80))]
        if toxic:
            words[3] = words[7] = "scum"
        text = " ".join(words) if good else "### ".join(words) + "$$$"
        docs.append((i, text, f"host{i % 7}", "p"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = synthetic()
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    train = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, train, host=F.col("host"), path=F.col("path")).collect()}
    assert len(got) == len(docs)
    test = labels[400:]
    assert sum((got[i].p_toxic >= 0.5) == bool(t) for i, _, t in test) / len(test) > 0.95
    assert sum((got[i].p_quality >= 0.5) == bool(q) for i, q, _ in test) / len(test) > 0.95
    assert all(got[i].keep == (got[i].p_quality >= 0.5 and got[i].p_toxic < 0.5) for i in got)


def test_site_rates_against_brute_force(spark):
    """Rates of the site's other documents, shrunk with the same priors, in plain Python."""
    import math

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.gauss(0, 2), rng.gauss(-1, 1)) for i in range(300)]
    rows += [(300 + i, "big", "z", 3.0, -3.0) for i in range(500)] + [(900, "one", "z", -3.0, 2.0)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double")
    out, priors = quality.with_site_rates(scored)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for col, k in ((3, "quality"), (4, "toxic")):
        mean, k_host, k_path = priors[k]
        p = {r[0]: 1 / (1 + math.exp(-r[col])) for r in rows}
        assert mean == pytest.approx(sum(p.values()) / len(rows))
        for i, h, q, *_ in rows:
            of_host = [p[r[0]] for r in rows if r[1] == h and r[0] != i]
            of_path = [p[r[0]] for r in rows if r[1] == h and r[2] == q and r[0] != i]
            host = (sum(of_host) + k_host * mean) / (len(of_host) + k_host)
            rate = min(1 - 1e-4, max(1e-4, (sum(of_path) + k_path * host) / (len(of_path) + k_path)))
            assert got[i][f"{k}_rate"] == pytest.approx(rate, abs=1e-9)
            assert got[i][f"{k}_shift"] == pytest.approx(math.log(rate / (1 - rate)) - math.log(mean / (1 - mean)), abs=1e-6)
    assert abs(got[900].quality_rate - priors["quality"][0]) < 1e-3  # a site of one document has no others


def test_sites_help_on_held_out_rows(spark):
    """Labels that depend on the site as well: the fitted weight gains, and is small where sites tell nothing."""
    rng = random.Random(7)
    rate = {f"h{i}": (0.9 if i % 2 else 0.1) for i in range(12)}
    docs, labels = [], []
    for i in range(1500):
        h = rng.choice(list(rate))
        good = rng.random() < rate[h]
        told = ["fine" if good else "poor"] if rng.random() < 0.45 else []
        docs.append((i, " ".join([f"w{rng.randint(0, 400)}" for _ in range(30)] + told), h, "p"))
        labels.append((i, int(good), int(rng.random() < 0.1)))
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    train = spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int")
    right = {}
    for w in (0.0, None):
        got = {r.doc_id: r.p_quality >= 0.5 for r in quality.classify(df, train, host=F.col("host"), path=F.col("path"), site_weight=w).collect()}
        right[w] = sum(got[i] == bool(q) for i, q, _ in labels[800:]) / 700
    assert right[None] > right[0.0] + 0.05


def test_repeated_labels_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "good words", "h", "p", 5.0)] * 50 + [(2, "bad words", "h", "p", 5.0)], "doc_id long, text string, host string, path string, quality double")
    labels = spark.createDataFrame([(1, 1, 0)] * 9 + [(2, 0, 1), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.labelled_rows(docs, labels, "doc_id", "text", 100).count() == 2
    assert len(quality.classify(docs, labels, host=F.col("host"), path=F.col("path")).collect()) == 51


def test_hosts_and_paths_of_urls(spark):
    urls = ["https://A.example.org/news/2020/x.html", "http://b.example/", "no url", None, "https://c.example"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(quality.host_of(F.col("u")), quality.path_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("a.example.org", "/news"), ("b.example", "/"), (None, None), (None, None), ("c.example", None)]


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "h", None), (2, "", "h", None), (3, "fine words here", "h", "p"), (4, "x" * 300_000, "h", "p")], "doc_id long, text string, host string, path string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, None), (2, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        got = quality.classify(docs, labels, host=F.col("host"), path=F.col("path")).collect()
        assert len(got) == 5 and not any(r.keep for r in got if r.doc_id in (1, 2))
    assert quality.classify(docs.limit(0), none, host=F.col("host"), path=F.col("path")).collect() == []


# -- queries and pipeline --------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    from tests.test_entry import compare

    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, sizes = [], [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        names.append(name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.where("length(text) <> n_chars").count() == 0
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 0
    ran = corpus_pipeline.run(spark, SF)
    assert ran.count() == sizes[5] and ran.select(F.countDistinct("doc_id")).first()[0] == sizes[4]


def test_pipeline_of_odd_and_planted_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = [" ".join(f"{a}{b} the and" for b in "abcdefgh") for a in "xyz"]
    rows = [(1, clean[0], "en"), (2, clean[0], "en"), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (6, item, "en"), (7, clean[1], None), (8, clean[2], "en"), (8, clean[2], "en")]
    docs = spark.createDataFrame([(i, t, g, None, len(t) if t is not None else None) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {1: clean[0], 7: clean[1], 8: clean[2]}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {1, 7, 8}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], docs.schema), SF).count() == 0


def test_near_dedup_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(None, a, "en"), (None, a, "en"), (None, b, "en"), (1, b, "en"), (5, c, "en"), (5, d, "fr"), (5, d, "en"), (3, c + " end", "en"), (None, None, "en"), (7, "", "en"), (8, "", "en")]
    want = {(None, a, "en"), (1, b, "en"), (5, d, "en"), (3, c + " end", "en"), (None, None, "en"), (7, "", "en"), (8, "", "en")}
    for own in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, g, None, len(t or "")) for i, t, g in own], "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
        assert got.columns == list(corpus_pipeline.COLUMNS)
        got = [(r.doc_id, r.text, r.lang) for r in got.collect()]
        assert len(got) == len(want) and set(got) == want
