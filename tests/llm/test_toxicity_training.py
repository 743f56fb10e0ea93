"""Training of the toxicity model on the driver."""

import random
import re
from pathlib import Path

import numpy as np

from ledgerbrook.llm import toxicity
from ledgerbrook.llm.common import ngram_buckets


def test_training_takes_little_memory(monkeypatch):
    """The n-grams of the training texts aren't all held at once."""
    rng = random.Random(29)
    stock = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(stock, k=14_000)) for _ in range(60)]
    monkeypatch.setattr(toxicity, "STEPS", 1)
    held = lambda key: int(re.search(rf"{key}:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    Path("/proc/self/clear_refs").write_text("5")  # the peak counts from here
    before = held("VmRSS")
    model = toxicity.Model(texts, [i % 2 for i in range(60)], (1.0, 1.0), epochs=1)
    grown = held("VmHWM") - before
    assert np.isfinite(model.bias) and grown < 150, grown


def test_bags_of_long_texts(monkeypatch):
    """Cut in parts or kept in a file, a text's n-grams and their counts are those of the whole."""
    rng = random.Random(31)
    long = " ".join("".join(rng.choices("abcé1 -", k=rng.randint(1, 9))) for _ in range(150_000)) + " " + "ab " * 50_000
    texts = ["", long, "Some words, and some more words", "x" * 300_000]
    monkeypatch.setattr(toxicity, "SPOOL", 1000)
    kept = toxicity.Bags()
    for b, n in toxicity.Model.bags(texts):
        kept.add(b, n)
    assert len(kept) == 4 and len(long) > 2 * toxicity.SLICE_CHARS
    for i, text in enumerate(texts):
        whole = [bucket for _, bucket in ngram_buckets([text], toxicity.SIZES, toxicity.BITS, digits=True)]
        want = np.unique(np.concatenate(whole) if whole else np.zeros(0, np.int64), return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(kept[i], want, strict=True))
        assert " ".join(toxicity.parts(text)) == text
    assert kept[1][1].max() >= 1 << 14  # more than a short entry counts
