"""The byte network against a plain convolution, byte by byte, and its memory on a very long text."""

import tracemalloc

import numpy as np
import pytest

from skeinframe.llm import language_id as lid


@pytest.fixture(scope="module")
def net():
    return lid.fit(["the cat and the dog " * 20, "der und die das " * 20, "le chat et le chien " * 20], ["en", "de", "fr"], epochs=1)


def plain_odds(net, text):
    """Mean log-odds of a text by loops over windows, places, bytes of a filter and dimensions."""
    starts = list(range(0, len(text), lid.WINDOW))
    starts[-1] = max(0, min(starts[-1], len(text) - lid.WINDOW))
    total, done = np.zeros(len(net.langs)), 0
    for s in starts:
        window = text[s : s + lid.WINDOW]
        features = []
        for width, filters in zip(lid.WIDTHS, net.filters):
            places = range(max(1, len(window) - width + 1))
            values = [sum(net.embed[window[p + j] if p + j < len(window) else 0] @ filters[j] for j in range(width)) for p in places]
            features.append(np.max(values, axis=0))
        z = np.maximum(np.concatenate(features) + net.bias, 0) @ net.out + net.out_bias
        total += z * (s + len(window) - done)
        done = s + len(window)
    return total / len(text)


@pytest.mark.parametrize("batch", [256, 3])
def test_scores_equal_a_plain_convolution(net, monkeypatch, batch):
    monkeypatch.setattr(lid.Scorer, "BATCH", batch)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (1, 2, 3, 4, 5, 40, 255, 256, 257, 511, 512, 513, 1500)]
    got = lid.Scorer(net).log_odds(texts)
    assert np.allclose(got, [plain_odds(net, t) for t in texts], atol=1e-4)


def test_windows_have_one_length_and_leave_nothing_out():
    for n in (1, 255, 256, 257, 1000, 1024):
        starts = lid.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + lid.WINDOW))}
        assert covered == set(range(n)) and all(s + lid.WINDOW <= n for s in starts if n >= lid.WINDOW)


def test_a_very_long_text_takes_no_more_memory_than_a_batch(net):
    scorer, text = lid.Scorer(net), b"the cat and the dog sat on the mat. " * 200_000
    tracemalloc.start()
    odds = scorer.log_odds([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert net.langs[int(odds.argmax())] == "en"
    assert peak < 60e6
