"""The best window of a text, as ``difflib`` has it, without taking every window apart."""

import difflib
import random

from glossa.operators import verify


def plain(quote, text):
    step, width = max(len(quote) // 4, 8), len(quote) + len(quote) // 4
    return max(difflib.SequenceMatcher(None, quote, text[at : at + width]).ratio() for at in range(0, max(len(text) - len(quote), 0) + 1, step))


def test_best_window_is_that_of_all_windows():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abcdefghijklmnopqrstuvwxyz éß,."[: rng.choice([1, 2, 4, 12, 31])]
        n = rng.choice([0, 1, 2, 20, 33, 80, 159, 160, 161, 200, 260])
        quote, text = ("".join(rng.choices(letters, k=k)) for k in (n, rng.choice([0, 1, n // 2, n, 3 * n + 5, 700])))
        at = rng.randrange(len(text) + 1)
        text = text[:at] + quote[: n // 2] + "x" + quote[n // 2 + 1 :] + text[at:] if rng.random() < 0.5 else text
        assert verify.best_window(quote, text) == plain(quote, text)


def test_long_texts_take_no_matcher_a_window(monkeypatch):
    made = []

    class Counted(difflib.SequenceMatcher):
        def __init__(self, *args, **named):
            made.append(1)
            super().__init__(*args, **named)

    monkeypatch.setattr(verify.difflib, "SequenceMatcher", Counted)
    rng = random.Random(1)
    for n in (80, 240):
        verify.best_window("".join(rng.choices("abcdef ", k=n)), "".join(rng.choices("abcdef ", k=5_000)))
    assert len(made) < 10
