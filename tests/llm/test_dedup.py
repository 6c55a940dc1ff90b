from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import near_dup, substring_dedup
from quillspark.llm.decontaminate import normal_words

DDL = "doc_id long, text string, dedup string"


def brute_repeats(rows, window=50):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is None:
            continue
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run_repeats(spark, rows):
    got = substring_dedup.digest(spark.createDataFrame([(*r, "clash") for r in rows], DDL))
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 80, 200]))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 90))]
        if rows and rng.random() < 0.3:
            w = list(rng.choice(rows)[1].split())
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w)) : rng.randrange(len(w)) + 1] = [word()]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w) or " "))
    return rows


@pytest.mark.parametrize(("seed", "runs"), [(0, 1000), (1, 1000), (2, 1), (3, 2)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, runs):
    monkeypatch.setattr(substring_dedup, "_RUNS_A_TASK", runs)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    assert run_repeats(spark, rows) == brute_repeats(rows)


def test_repeats_of_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    same = " ".join(["x"] * 200)
    rows = [(3, None), (4, ""), (5, " \n"), (1, same), (2, same), (2, same), (9, same + " y"), (None, same), (7, long), (8, long + " end"), (6, "é " * 60), (10, " a " * 60), (11, " a " * 60), (12, " ".join(f"u{i}" for i in range(50))), (13, " ".join(f"u{i}" for i in range(50)))]
    assert run_repeats(spark, rows) == brute_repeats(rows)
    assert run_repeats(spark, []) == []


def test_rows_of_one_id_do_not_remove_each_other(spark):
    a, b = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, b)]
    assert run_repeats(spark, rows) == brute_repeats(rows)


def test_string_ids_and_repeated_rows_of_sources(spark):
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = [base, base[:200] + ["x"] + base[200:], base[:120] + ["y"] + base[120:], base[30:330], base[:200] + ["x"] + base[200:]]
    rows = [(k, " ".join(t)) for k, t in zip(["b", "b", "c", "d", "a"], texts, strict=True)] * 2
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, len(r.text.split()), r.dedup.n_removed, hashlib.sha256(r.dedup.kept.encode()).hexdigest()) for r in got) == brute_repeats(rows)


def test_runs_are_compacted_and_keep_their_source(spark):
    """Edges of two texts that differ in one word: a run ends where the graph branches."""
    words = [f"v{i}" for i in range(120)]
    texts = {1: words, 2: [*words[:80], "other", *words[81:]]}
    wanted = {d: [{"anchor": a, "path": p, "branches": True} for a, p in zip(*(x.tolist() for x in substring_dedup.paths_of(substring_dedup.word_hashes(" ".join(t).encode()))[2:]), strict=True)] for d, t in texts.items()}
    df = spark.createDataFrame([(d, " ".join(t), wanted[d]) for d, t in texts.items()], "doc_id long, text string, wanted array<struct<anchor:long,path:long,branches:boolean>>")
    sources = df.mapInArrow(substring_dedup._source_rows(50, 16), "doc_id long, anchor long, path long, place int, sha binary, edges array<long>, words string")
    runs = [r for r in substring_dedup.compacted_runs(sources).collect() if r.doc_id > r.src]
    places = {(r.anchor, r.path): r.place for r in sources.where("doc_id = 2").collect()}
    lost = sorted(places[r.anchor, r.path] + r.lost + k for r in runs for k in range(r.n))
    assert lost == list(range(31)) and len(runs) < 31  # the windows in front of the changed word; those behind it are 39 words long


def test_other_words_at_the_source_are_not_accepted(spark, monkeypatch):
    """Were all hashes equal by accident, the words decide."""
    a, b = ([f"{k}{i}" for i in range(50)] for k in "ab")
    losses = [{"anchor": 0, "path": 0, "lost": -1, "n": 1, "sha": substring_dedup._digest([w.encode() for w in a])}]
    monkeypatch.setattr(substring_dedup, "paths_of", lambda *x: tuple(np.array([v]) for v in (0, 0, 0, 0)))
    cut = lambda words: substring_dedup._cut_text(pa.scalar(" ".join(words)), losses, 50, 16)["n_removed"]
    assert cut(a) == 50 and cut(b) == 0


def test_removed_ranges_and_clashing_columns(spark):
    p = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(1, p, "a"), (2, f"new {p} words", "b")], DDL)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert got[2].dedup.kept == "new words" and got[2].dedup.starts == [1] and got[2].dedup.ends == [51] and got[1].dedup.n_removed == 0


def test_chunks_do_not_change_results(monkeypatch, spark):
    rows = corpus(9, 25)
    expected = brute_repeats(rows)
    hashes = substring_dedup.word_hashes(" ".join(f"w{i}" for i in range(5000)).encode())
    monkeypatch.setattr(substring_dedup, "_CHUNK_BYTES", 64)
    assert (substring_dedup.word_hashes(" ".join(f"w{i}" for i in range(5000)).encode()) == hashes).all()
    for d, t in rows:
        raw = t.encode()
        assert len(substring_dedup.word_hashes(raw)) == len(raw.split())
    assert run_repeats(spark, rows) == expected


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 40, 3000).astype(np.uint64)
    first, last, anchor, _ = substring_dedup.paths_of(h)
    assert first[0] == 0 and last[-1] == len(h) - 50 and (first[1:] == last[:-1] + 1).all()
    seen = {}
    for a, b, k in zip(first, last, anchor, strict=True):
        for p in range(a, b + 1):
            assert seen.setdefault(h[p : p + 50].tobytes(), k) == k


# -- near duplicates -------------------------------------------------------
def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(above[j] + 1, now[-1] + 1, above[j - 1] + (x != y)))
        above = now
    return above[-1]


def brute_classes(rows, threshold=0.8):
    """Plain dynamic programming over all pairs; rows of one id share a class."""
    words = [(d, normal_words(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(words):
        for b, t in words[:i]:
            longest = max(len(s), len(t))
            if s and t and find(a) != find(b) and 5 * min(len(s), len(t)) >= 4 * longest and 5 * (longest - plain_distance(s, t)) >= 4 * longest:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in parent}


def run_classes(spark, rows):
    got = near_dup.near_duplicates(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, class_id string, node string")).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.class_id for r in got}


def edits(rng, words, n, word):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
        w = w or [word()]
    return w


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(4, 150))]
        rows += [(len(rows) + 100 + k, " ".join(edits(rng, base, rng.randint(0, len(base) // 8), word))) for k in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    assert run_classes(spark, rows) == brute_classes(rows)


def test_texts_that_share_a_passage_and_their_copies(spark):
    """Buckets of a common passage hold many unlike texts; the exact round finds the copies among them."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    common = [word() for _ in range(60)]
    rows = []
    for i in range(25):
        own = common + [word() for _ in range(40)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(edits(rng, own, 12, word)))]
    expected = brute_classes(rows)
    assert set(expected.values()) == set(range(0, 50, 2))
    assert run_classes(spark, rows) == expected


def test_large_group_with_chains(spark):
    """Copies of copies: most pairs are below the threshold, chains hold the class together."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    now = [word() for _ in range(120)]
    rows = [(0, " ".join(now))]
    for i in range(1, 60):
        now = edits(rng, now, 9, word)
        rows.append((i, " ".join(now)))
    assert run_classes(spark, rows) == brute_classes(rows)


@pytest.mark.parametrize("block", [7, near_dup.BLOCK if hasattr(near_dup, "BLOCK") else 1024])
def test_every_pair_of_a_bucket_is_decided(spark, monkeypatch, block):
    """Copies of one text that are about as far from each other as a link allows."""
    monkeypatch.setattr(near_dup, "BLOCK", block, raising=False)
    rng, rows = random.Random(3), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for _ in range(12):
        base = [word() for _ in range(90)]
        for _ in range(25):
            own = list(base)
            for at in rng.sample(range(90), 12):
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    words = [near_dup.words_of(t) for _, t in rows]
    name, buckets = list(range(len(rows))), defaultdict(list)
    for d, w in enumerate(words):
        for key in near_dup.keys_of(w).tolist():
            buckets[key].append(d)
    for a, b in {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}:
        if name[a] != name[b] and near_dup.aligned(words[a], words[b]):
            name = [min(name[a], name[b]) if n in (name[a], name[b]) else n for n in name]
    assert run_classes(spark, rows) == dict(enumerate(name))


def unlike_texts_of_equal_words(n):
    """Texts of one passage and the same words in other orders, and a near copy of each tenth."""
    rng, rows = random.Random(7), []
    common, others = [f"c{i}" for i in range(40)], [f"o{i}" for i in range(25)]
    for i in range(n):
        own = common + rng.sample(others, 25)
        rows.append((10 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((10 * i + 1, " ".join(edits(rng, own, 6, lambda: f"x{rng.randrange(10**6)}"))))
    return rows


def test_no_table_holds_the_pairs_of_a_family(spark, monkeypatch):
    """No two of these texts' profiles differ: the rows made grow with the texts, not with their pairs."""
    rows, sizes, write = unlike_texts_of_equal_words(240), [], near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df: (found := write(df), sizes.append(found.count()))[0])
    assert run_classes(spark, rows) == {d: d - d % 10 for d, _ in rows}
    assert max(sizes) <= len(rows) * sum(keys for _, _, keys, _, high in near_dup.SCALES if high is None or high >= 65)


def test_no_table_of_the_pipeline_holds_the_pairs_of_a_family(spark, monkeypatch):
    import corpus_pipeline

    rows, sizes, write = unlike_texts_of_equal_words(240), [], near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df: (found := write(df), sizes.append(found.count()))[0])
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in rows if d % 10 == 0]
    assert max(sizes) <= len(rows) * sum(keys for _, _, keys, _, high in near_dup.SCALES if high is None or high >= 65)


def test_profiles_never_leave_out_a_link():
    rng = random.Random(5)
    for n in (6, 30, 200, 1500):
        for _ in range(30):
            a = [f"w{int(rng.expovariate(0.05))}" for _ in range(n)]
            b = edits(rng, a, rng.randrange(max(1, n // 4)), lambda: f"w{rng.randrange(400)}")
            pair = sorted((near_dup.words_of(" ".join(x)) for x in (a, b)), key=len)
            size = np.array([len(x) for x in pair])
            profile = np.stack([np.frombuffer(near_dup.profile_of(x), np.uint8) for x in pair])
            zero, own = np.zeros(2, np.int64), np.array([1, 2])
            found = sum(len(x) for x, _, _ in near_dup.near_pairs(zero, zero, zero > 0, own, size, profile, 0.8))
            assert found or not near_dup.aligned(*pair)


def test_order_counts(spark):
    """Swapped halves keep nearly all shingles and are no copies; 8 of 200 replaced words are."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    few = list(base)
    for i in range(8):
        few[25 * i + 3] = f"new{i}"
    assert run_classes(spark, [(1, " ".join(base)), (2, " ".join(base[100:] + base[:100])), (3, " ".join(few))]) == {1: 1, 2: 2, 3: 1}


def test_different_texts_of_one_id(spark):
    rng = random.Random(9)
    a, b = ([f"{k}{rng.randint(0, 10**6)}" for _ in range(60)] for k in "ab")
    rows = [(10, " ".join(a)), (10, " ".join(b)), (11, " ".join(b[:30] + ["x"] + b[31:])), (12, " ".join(a[:30] + ["x"] + a[31:])), (13, "alone")]
    assert run_classes(spark, rows) == {10: 10, 11: 10, 12: 10, 13: 13}


def test_string_and_null_ids(spark):
    t = " ".join(f"t{i}" for i in range(40))
    rows = [("b", t), ("a", t + " end"), (None, t), (None, "no other text"), (None, None), ("c", None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("None", "None"), ("None", "None"), ("None", "a"), ("a", "a"), ("b", "a"), ("c", "c")]


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, None), (5, "One two."), (6, "one TWO"), (7, "one two three"), (8, "a " * 400), (9, "a " * 390), (10, "x y z v w " * 50), (12, "long text " + " ".join(f"t{i}" for i in range(30_000))), (13, "long text " + " ".join(f"t{i}" for i in range(29_900)))]
    got = run_classes(spark, rows)
    assert (got[1], got[2], got[3], got[4]) == (1, 2, 3, 4) and got[6] == 5 and got[7] == 7 and got[9] == 8 and got[10] == 10 and got[13] == 12
    assert run_classes(spark, []) == {}


def test_alignment_within_bands():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.randint(2, 9)
        a = [rng.randrange(k) for _ in range(rng.randint(0, 24))]
        b = edits(rng, a, rng.randint(0, 6), lambda: rng.randrange(k)) if a and rng.random() < 0.6 else [rng.randrange(k) for _ in range(rng.randint(0, 24))]  # noqa: B023
        limit, true = rng.randint(0, 10), plain_distance(a, b)
        assert near_dup.distance(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (true if true <= limit else None)
        assert near_dup.band_distance(a, b, limit) == (true if true <= limit else None)


@pytest.mark.parametrize(("n", "sim", "least"), [(5, 0.8, 0.9), (20, 0.8, 0.9), (40, 0.8, 0.9), (80, 0.8, 0.9), (100, 0.8, 0.9), (400, 0.8, 0.9), (100, 0.85, 0.97), (400, 0.9, 0.995)])
def test_share_of_links_that_meet_in_a_bucket(n, sim, least):
    rng = np.random.default_rng(n)
    met, tries = 0, 300
    for _ in range(tries):
        w = rng.integers(0, 2**63, n).astype(np.uint64)
        v = w.copy()
        at = rng.choice(n, int((1 - sim) * n + 1e-9), replace=False)
        v[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
        met += len(np.intersect1d(near_dup.keys_of(w), near_dup.keys_of(v))) > 0
    assert met >= least * tries


def test_occurrences_and_keys():
    s = np.array([5, 7, 5, 5, 7], np.uint64)
    assert near_dup.occurrences(s).tolist() == [0, 0, 1, 2, 1]
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 70_000).astype(np.uint64)
    whole = near_dup.omh_keys(x, 8, 3)
    near_dup._CHUNK, old = 1000, near_dup._CHUNK
    try:
        assert (near_dup.omh_keys(x, 8, 3) == whole).all()
    finally:
        near_dup._CHUNK = old
    assert (near_dup.omh_keys(x[::-1].copy(), 8, 3) != whole).all()  # order counts


def test_components_raise_when_unfinished(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        near_dup.components(links, max_rounds=1)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x} or all(got.get(x, x) == find(x) for x in parent)
