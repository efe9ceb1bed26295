"""Scripts shared by texts of the same pattern."""

import random

from alertfold.functions import script
from alertfold.functions.script import fold_texts


def test_texts_of_a_pattern_share_a_script(monkeypatch):
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab0\0\1é") for _ in range(rng.randrange(12))) for _ in range(2))
        want = script._script(a, b) if len(a) <= len(b) else script._script(b, a).translate(script._SWAPPED)
        assert script.script(a, b) == want
    calls = []
    plain = script._first_cheapest_cut
    monkeypatch.setattr(script, "_first_cheapest_cut", lambda *texts: calls.append(1) or plain(*texts))
    for n in range(300):
        assert fold_texts([f"disk {n + 100} is full", "disk ??? is full"]) == "disk ??? is full"
    assert len(calls) < 300
