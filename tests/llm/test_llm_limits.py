"""What the operators take besides time: memory of workers and driver, calls of a library."""

import tracemalloc

import numpy as np
import pytest

from sparkloom.llm import _pool, _shared, pieces, quality, repair
from sparkloom.llm.queries import tokenizer

CASES = ["Word word WORD wOrd", "École école ÉCOLE Straße STRASSE ÿ Ÿ þ Þ × ÷", "<|startoftext|> <|STARTOFTEXT|> Don't DON'T İI J̌ ǰ ΣΑΣ", "Aé1Bé Á Á", "", "7 Seven"]


def test_op7_units_of_other_case_are_encoded_once(monkeypatch):
    code = repair.Encoder(tokenizer("word_bpe_49k.json"))
    assert code.lowers
    data = np.frombuffer("".join(CASES).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in CASES)])
    ids, sizes = code.rows(data, offsets)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    for k, t in enumerate(CASES):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == code.tokenizer.encode(t, add_special_tokens=False).ids, t
    asked = []
    together = code._together
    monkeypatch.setattr(code, "_together", lambda texts: (asked.extend(texts), together(texts))[1])
    code.pool = _pool.Pool()
    code.rows(data[:19], np.array([0, 19]))
    assert asked == ["word"]


def test_distinct_spans():
    for kind in (np.uint8, np.uint32):
        data = np.frombuffer(b"ab ab b a  ab", np.uint8).astype(kind)
        starts, ends = np.array([0, 3, 6, 8, 11]), np.array([2, 5, 7, 9, 13])
        first, back, spans, borders = _pool.distinct(data, starts, ends)
        assert first.tolist() == [0, 2, 3] and back.tolist() == [0, 0, 1, 2, 0]
        assert bytes(spans.astype(np.uint8)) == b"abba" and spans.dtype == kind and borders.tolist() == [0, 2, 3, 4]
        none = np.zeros(0, np.int64)
        assert [len(x) for x in _pool.distinct(data, none, none)] == [0, 0, 0, 1]


def test_gather_works_in_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    flat, first, size = np.arange(100, dtype=np.int32), rng.integers(0, 50, 300), rng.integers(0, 50, 300)
    for most in (1, 40, 1 << 18):
        monkeypatch.setattr(_pool, "GATHERED", most)
        out, n = _pool.gather(flat, first, size)
        assert out.tolist() == [x for a, m in zip(first.tolist(), size.tolist(), strict=True) for x in range(a, a + m)] and n is size
    monkeypatch.undo()
    flat, first, size = np.zeros(8, np.uint8), np.zeros(1_000_000, np.int64), np.full(1_000_000, 8)
    tracemalloc.start()
    out, _ = _pool.gather(flat, first, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 8_000_000 and peak < 4 * len(out)


def test_op9_memory_of_a_long_text():
    m = pieces.model(tokenizer("piece_bpe_32k.model"))
    text = "some words of a long text, again and again. " * 50_000
    m.encode([text[:1000]])
    tracemalloc.start()
    ids, sizes = m.encode([text])
    assert m.decode(ids, sizes) == [text.encode()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text)


@pytest.mark.parametrize("module", [pieces, quality])
def test_small_slices(module):
    assert module.SLICE <= 1 << 19


def test_settled_collects_the_drivers_garbage(spark):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())

    before = collections()
    _shared.settled(spark)
    assert collections() > before
