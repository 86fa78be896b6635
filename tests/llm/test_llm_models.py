"""Language identification and quality against plain versions of their own; the lexicon of fingerprints over repeated rows."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest

from sparkloom.llm import imatch, langid, quality


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def letters(text):
    return ["".join(g) for alpha, g in groupby((text or "").lower(), str.isalpha) if alpha]


def grams(word, n):
    word = f" {word} "
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def plain_model(rows):
    """Log frequencies of words (kind 0) and n-grams by dictionaries: langs, tables of term to a list by language."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for word in letters(text):
            counts[0, lang][word] += 1
            for n in range(1, langid.LONGEST + 1):
                counts[n, lang].update(grams(word, n))
    counts = {k: {t: n for t, n in c.items() if n > 1} for k, c in counts.items()}
    langs = sorted({lang for (_, lang), c in counts.items() if c})
    tables = []
    for kind in range(langid.LONGEST + 1):
        own = [counts.get((kind, lang), {}) for lang in langs]
        terms = set().union(*own)
        most = max((sum(c.values()) for c in own), default=0)
        added = [langid.SMOOTHING * max(1, sum(c.values())) / max(1, most) for c in own]
        whole = [sum(c.values()) + a * len(terms) for c, a in zip(own, added, strict=True)]
        tables.append({t: [math.log((c.get(t, 0) + a) / w) for c, a, w in zip(own, added, whole, strict=True)] for t in terms})
    return langs, tables


def plain_scores(langs, tables, text):
    total = [0.0] * len(langs)
    for word in letters(text):
        if word in tables[0]:
            total = [a + b for a, b in zip(total, tables[0][word], strict=True)]
            continue
        for n in range(langid.LONGEST, 0, -1):
            logs = [tables[n][g] for g in grams(word, n) if g in tables[n]]
            if logs:
                total = [a + langid.UNSEEN * sum(x) / len(logs) for a, x in zip(total, zip(*logs, strict=True), strict=True)]
                break
    return total


def test_op3_against_dictionaries(docs):
    rows = {r.doc_id: r for r in docs.collect()}
    learnt = [(r.text, r.lang) for i, r in rows.items() if r.lang is not None and r.text is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs, tables = plain_model(learnt)
    for got in langid.language_id(docs).collect():
        text = rows[got.doc_id].text
        if not letters(text):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        total = plain_scores(langs, tables, text)
        best = max(total)
        assert got.score == pytest.approx(1 / sum(math.exp(t - best) for t in total), rel=1e-6)
        assert total[langs.index(got.lang_pred)] == pytest.approx(best, rel=1e-9)


def test_op3_learns_rare_languages(spark):
    """A language with few documents is learnt beside one with many, and doesn't draw the other's unseen words."""
    common = [f"the cat sat on word{'abcdefghij'[i % 10]} near the house" for i in range(300)]
    rare = ["le chat dort dans la maison bleue"] * 3
    rows = [(i, t, "en") for i, t in enumerate(common)] + [(1000 + i, t, "fr") for i, t in enumerate(rare)]
    rows += [(2000, "le chat dort", None), (2001, "the cat near qqqq", None), (2002, "the house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_langid(df, sample=20)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.language_id(df, model).collect()}
    assert (got[2000], got[2001], got[2002]) == ("fr", "en", "en")


def test_op3_and_op8_ties_repeats_and_clashing_names(spark):
    rows = [(i, "same words here", ("aa", "bb")[i % 2], "x", 1.0, "y") for i in (0, 1, 3, 4, 5, 7, 8, 9)]
    assert {zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows} >= {True}
    rows += rows[:1] + [(None, "same words here", None, None, None, None), (50, None, "aa", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, _rank string")
    got = langid.language_id(df).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id != 50} <= {"aa", "bb"} and len({r.score for r in got if r.doc_id != 50}) == 1
    assert [(r.lang_pred, r.score) for r in got if r.doc_id == 50] == [("und", 0.0)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(0, 1), (None, 1), (3, None)], "doc_id long, quality int")
    scored = quality.quality_classifier(df, labels).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id != 50}) == 1
    assert scored[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]


def test_long_texts(spark):
    """Texts of several megabytes, some without a space, among short ones."""
    words = "alpha beta gamma delta "
    rows = [(1, words * 150_000, "en"), (2, "x" * 3_000_000, "en"), (3, words, "fr"), (4, "é" * 1_000_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    assert langid.language_id(df).count() == quality.quality_classifier(df, labels).count() == 4
    got = {r.doc_id: r for r in imatch.document_fingerprints(df, low=0.0, high=1.0).collect()}
    assert [got[i].n_chars for i in (1, 2, 3, 4)] == [len(t) for _, t, _ in rows]


def shape(word):
    """The shape of a word of plain bytes, in the terms of the module's own description."""
    upper = sum(65 <= c <= 90 for c in word)
    letter = upper + sum(97 <= c <= 122 or c >= 128 for c in word)
    digit = sum(48 <= c <= 57 for c in word)
    case = 0 if not letter else 1 if not upper else 2 if upper == letter else 3
    digits = 0 if not digit else 2 if digit == len(word) else 1
    size = sum(len(word) >= x for x in (4, 12, 30))
    last = word[-1] if not (65 <= word[-1] <= 90 or 97 <= word[-1] <= 122 or word[-1] >= 128 or 48 <= word[-1] <= 57) else 0
    return case, digits, min(4, len(word) - letter - digit), size, last


def indicators(text):
    found = (text or "").encode().split()  # bytes split at ASCII white space
    low, shapes = [w.lower() for w in found], [shape(w) for w in found]
    out = {("word", w) for w in low}
    for n in range(1, 5):
        out |= {("shapes", *shapes[i : i + n], *(low[i + k] == low[i + k + 1] for k in range(n - 1))) for i in range(len(low) - n + 1)}
    return out


def hashed(texts):
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    return quality.features(np.frombuffer(b"".join(data), np.uint8), offsets)


def test_op8_indicators_against_sets(docs, monkeypatch):
    """With room for all hashes, indicators are as many, and as many are shared, as the plain ones."""
    monkeypatch.setattr(quality, "BITS", 48)
    texts = [r.text for r in docs.limit(60).collect()] + ["", None, "A a a A1 -- x! ÉÉ", "one"]
    plain, got = [indicators(t) for t in texts], hashed(texts)
    assert [len(f) for f in got] == [len(p) for p in plain]
    for i in range(len(texts) - 1):
        assert len(np.intersect1d(got[i], got[i + 1])) == len(plain[i] & plain[i + 1])


def test_op8_fit_is_the_optimum():
    """The gradient of the squared hinge loss is near 0 at what dual coordinate descent returns."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(80)]
    ratio = rng.normal(size=30)
    y = np.where([(r < 15).sum() > len(r) / 2 for r in rows], 1.0, -1.0)
    cost = rng.uniform(0.5, 2, 80)
    scaled, bias = quality._descend(rows, y, ratio, cost, epochs=3000)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = ratio[r] / math.sqrt(len(r) + 1), 1.0
    w = np.append(scaled / ratio, bias)
    slack = np.maximum(0, 1 - y * (x @ w))
    gradient = w - 2 * x.T @ (cost * y * slack)
    assert np.linalg.norm(gradient) <= 0.02 * np.linalg.norm(w)


def test_op8_class_ratio_and_score():
    """Weights of a fitted model against counts by hand: an indicator of one class only speaks for it."""
    texts = [f"good calm plain text{i}" for i in range(20)] + [f"bad loud noise text{i}" for i in range(20)]
    model = quality.fit(hashed(texts), np.array([1] * 20 + [0] * 20))
    score = model.scores(hashed(["good calm plain", "bad loud noise", "words never met", ""]))
    assert score[0] >= 0.7 > score[1]
    good, bad = (hashed([t])[0] for t in ("good", "bad"))
    only = np.setdiff1d(good, bad), np.setdiff1d(bad, good)
    assert (model.weight[only[0]] >= 0).all() and (model.weight[only[1]] <= 0).all()


def test_op5_lexicon_counts_repeated_ids_once(spark):
    texts = {i: f"w{i % 7} v{i % 5} u{i % 3} t{i}" for i in range(60)}
    once = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    again = [(i, texts[i]) for i in range(0, 60, 7) for _ in range(30)] + [(3, texts[3] + " zz"), (4, "~ larger text")] + [(None, "w1 w2")] * 50
    both = once.unionByName(spark.createDataFrame(again, "doc_id long, text string"))
    want = {r.doc_id: tuple(r) for r in imatch.document_fingerprints(once, low=0.0, high=0.2).collect()}
    assert {r.doc_id: tuple(r) for r in imatch.document_fingerprints(both, low=0.0, high=0.2).collect()} == want
