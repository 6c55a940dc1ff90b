"""Language identification: script ranges, then Viterbi over words.

A model has log probabilities of hashed letter trigrams (with word ends) for each
language and the scripts that the language is written in.  A text's words (runs
of letters and marks) get one score a language: the sum over their trigrams, if
the word's script is one of the language's, else a large penalty.  The path of
languages over the words that maximises the scores less ``switch_penalty`` for
each change labels the spans; the language with the most letters is the
document's, and its share of the letters is the score.

The model is fitted on a bounded sample of labelled rows: for each language about
``docs_per_language`` different whole texts, chosen by a hash of the text, each once however
often it is repeated; the n-gram counts are made by the executors and summed.  The model has 256 kB a
language, which is what is broadcast.

Defined results: a null text or one without letters is ``und`` with score 0 and
no spans; a word in a script that no language uses is neutral and its letters
count for none; ties between languages go to the first by name; repeated rows each get their own result; with
no labelled row every text is ``und``; a row with a null id is not held out.  Memory grows with the words of one text,
not with a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
BUCKETS = 1 << 16
RESULT_DDL = "lang_pred string, score double, starts array<long>, ends array<long>, langs array<string>"
_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("langs", pa.list_(pa.string()))])

# First and last code points of Unicode blocks by script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_NAMES = [*SCRIPTS, "Other"]
_OTHER = len(_NAMES)
_TABLE = 0x20000
_FORBIDDEN = -50.0
_GROUP_CHARS = 1 << 19
_VITERBI_CELLS = 2_500_000
_HELD_CHARS = 16 << 20
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Script number (0: neither letter nor mark; negative: mark) and lower case by code point."""
    global _tables
    if _tables is None:
        script, lower = np.zeros(_TABLE + 1, np.int8), np.arange(_TABLE + 1, dtype=np.uint32)
        ranges = np.full(_TABLE, _OTHER, np.int8)
        for n, name in enumerate(SCRIPTS, 1):
            for a, b in SCRIPTS[name]:
                ranges[a : min(b + 1, _TABLE)] = n
        for c in range(_TABLE):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                script[c] = ranges[c] if kind == "L" else -1
                low = chr(c).lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        script[_TABLE] = _NAMES.index("Han") + 1
        _tables = script, lower
    return _tables


@dataclass
class Words:
    """Words of some text: code point ranges, letters, script; trigrams of all their letters in order."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    offsets: np.ndarray
    trigrams: np.ndarray


def words_of(text: str) -> Words:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    script, lower = _code_tables()
    at = np.minimum(codes, _TABLE)
    kind = script[at]
    kind[codes > 0x3FFFF] = 0
    inside = kind != 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(inside, lower[at], 0)
    mixed = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA6B) + padded[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    trigrams = (mixed >> np.uint32(16))[inside]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))[:-1] if len(starts) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(kind[inside], offsets) if len(starts) else np.zeros(0, np.int8)
    return Words(starts, ends, top, offsets, trigrams)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    forbidden: np.ndarray  # scripts x languages: penalty a word
    neutral: np.ndarray  # scripts that no language uses

    def scores(self, words: Words) -> np.ndarray:
        s = np.add.reduceat(self.logp[words.trigrams], words.offsets, axis=0).astype(np.float64)
        script = np.maximum(words.script, 0)
        s += self.forbidden[script]
        s[self.neutral[script]] = 0.0
        return s


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if group and size + len(t) > _GROUP_CHARS:
                yield group
                group, size = [], 0
            group.append(i)
            size += len(t) + 1
    if group:
        yield group


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of every word, for several texts at once (time steps in
    common, longest text first)."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    n_lang = flat.shape[1]
    v = flat[at].copy()
    best = np.zeros((sizes[0], len(order)), np.int16)
    stay = np.ones((sizes[0], len(order), n_lang), bool)
    active = len(order)
    for t in range(1, int(sizes[0])):
        while sizes[active - 1] <= t:
            active -= 1
        now = v[:active]
        b = now.argmax(1)
        change = now[np.arange(active), b][:, None] - penalty
        s = now >= change
        best[t, :active], stay[t, :active] = b, s
        v[:active] = np.where(s, now, change) + flat[at[:active] + t]
    paths = [None] * len(order)
    for k, i in enumerate(order):
        n = int(sizes[k])
        path = np.empty(n, np.int16)
        state = int(v[k].argmax())
        own_stay, own_best = stay[:n, k], best[:n, k]
        for t in range(n - 1, -1, -1):
            path[t] = state
            if not own_stay[t, state]:
                state = int(own_best[t])
        paths[i] = path
    return paths


def constant_path(scores: np.ndarray, penalty: float) -> int | None:
    """The language of the best path if that path never changes, told exactly:
    no stretch of words gains more than ``penalty`` in another language."""
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    return best if (gain - low).max() < penalty else None


def label(texts: list[str | None], model: Model, penalty: float) -> list[dict]:
    out: list[dict] = [{"lang_pred": UND, "score": 0.0, "starts": [], "ends": [], "langs": []} for _ in texts]
    mixed: list[tuple] = []
    pending = 0

    def put(i: int, path, starts, ends, told) -> None:
        letters = np.bincount(path, weights=(ends - starts) * told, minlength=len(model.langs))
        cut = np.flatnonzero(np.diff(path)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(path)])) - 1
        top = int(letters.argmax())
        out[i] = {"lang_pred": model.langs[top], "score": float(letters[top] / (ends - starts).sum()), "starts": starts[first].tolist(), "ends": ends[last].tolist(), "langs": [model.langs[x] for x in path[first]]}

    def resolve() -> None:
        if mixed:
            for (i, _, *own), path in zip(mixed, viterbi([m[1] for m in mixed], penalty), strict=True):
                put(i, path, *own)
            mixed.clear()

    if not model.langs:
        return out
    for group in _groups(texts):
        words = words_of("\n".join(texts[i] for i in group))
        if not len(words.starts):
            continue
        scores = model.scores(words)
        base, w = 0, 0
        for i in group:
            end = base + len(texts[i])
            stop = int(np.searchsorted(words.starts, end))
            own = slice(w, stop)
            if stop > w and (words.script[own] > 0).any():
                starts, ends, s = words.starts[own] - base, words.ends[own] - base, scores[own]
                told = ~model.neutral[np.maximum(words.script[own], 0)]
                const = constant_path(s, penalty)
                if const is None:
                    mixed.append((i, s, starts, ends, told))
                    pending = max(pending, len(s))
                    if pending * len(mixed) > _VITERBI_CELLS:
                        resolve()
                        pending = 0
                else:
                    put(i, np.full(len(s), const, np.int16), starts, ends, told)
            base, w = end + 1, stop
    resolve()
    return out


def _label_batches(held: list[list[str | None]], model: Model, penalty: float) -> Iterator[pa.Array]:
    found = iter(label([t for own in held for t in own], model, penalty))
    for own in held:
        yield pa.array([next(found) for _ in own], _RESULT)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1500, smoothing: float = 0.2) -> Model:
    """Fit on about ``docs_per_language`` texts of each language (all, if fewer)."""
    own = F.xxhash64(F.col(text_col))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy(lang_col).agg(F.approx_count_distinct(own, 0.02)).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((_OTHER + 1, 0)), np.ones(_OTHER + 1, bool))
    grain = 1 << 20
    keep = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(grain, -(-grain * docs_per_language // counts[g]))))])
    sample = rows.where(F.pmod(own, F.lit(grain)) < F.element_at(keep, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).distinct()
    number = {g: n for n, g in enumerate(langs)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), _OTHER + 1), np.int64)
        for frame in frames:
            for g, own in frame.groupby("lang")["text"]:
                texts = own.to_list()
                for group in _groups(texts):
                    w = words_of("\n".join(texts[i] for i in group))
                    grams[number[g]] += np.bincount(w.trigrams, minlength=BUCKETS)
                    scripts[number[g]] += np.bincount(np.maximum(w.script, 0), minlength=_OTHER + 1)
        for table, shift in ((grams, 0), (scripts, BUCKETS)):
            lang, bucket = np.nonzero(table)
            yield pd.DataFrame({"lang": lang.astype(np.int32), "bucket": (bucket + shift).astype(np.int32), "n": table[lang, bucket]})

    summed = sample.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (summed[c].to_numpy() for c in ("lang", "bucket", "n"))
    table = np.zeros((BUCKETS + _OTHER + 1, len(langs)))
    table[bucket, lang] = n
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((grams + smoothing) / (grams.sum(0) + smoothing * BUCKETS)).astype(np.float32)
    used = scripts >= np.maximum(1, 0.005 * scripts.sum(0))
    forbidden = np.where(used, 0.0, _FORBIDDEN)
    neutral = ~used.any(1)
    neutral[0] = True  # marks alone
    return Model(langs, logp, forbidden, neutral)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", switch_penalty: float = 12.0, out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang_pred, score, and the spans
    (starts, ends, langs).  A column of that name is replaced.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # several batches go through Viterbi together: its steps are as many as the
        # longest text has words, however many texts take part
        held: list[list[str | None]] = []
        for batch in batches:
            held.append(batch.to_pylist())
            if sum(len(t) for own in held for t in own if t) > _HELD_CHARS:
                yield from _label_batches(held, shared.value, switch_penalty)
                held = []
        yield from _label_batches(held, shared.value, switch_penalty)

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """The contract's folds: fit where the id's remainder is not 1, label every row."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model)


def digest(found: DataFrame, out: str = "language") -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), F.col(f"{out}.lang_pred").alias("lang_pred"), F.col(f"{out}.score").alias("score"), F.col(f"{out}.starts").alias("span_starts"), F.col(f"{out}.ends").alias("span_ends"), F.col(f"{out}.langs").alias("span_langs"))
