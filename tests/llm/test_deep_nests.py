"""Every level of a deep nest of escapes is scanned: against layers of the whole text for all levels."""

import base64
import random

from chronolith.llm import secrets


def test_each_middle_level_has_its_span():
    deep = 60
    _, every = secrets.find_secrets("x %" + "25" * deep + "41 y")
    end = 5 + 2 * deep
    # level h leaves "%", deep - h times "25", and "41": digits from behind what it unwrapped to the end
    assert every == [(3 + 2 * h, 2, end) for h in range(deep) if 2 * (deep - h) + 2 >= 24]


def test_stretches_against_whole_layers(monkeypatch):
    rng = random.Random(21)
    secret = base64.b64encode(b"password=hunter2secretx").decode()
    before = ["", "a ", "word ", "token", "password", "\n", "AKIA" + "Z" * 10, "abcdef0123456789abcdef", secret, " = ", "é", "secret: ", "x", "QUJD" * 5 + "\n" + "QUJD" * 5]
    behind = ["", "hunter2secret", "KIA" + "Z" * 16, "abcdef0123456789abcdef01", secret, " tail", "\n", "=abcdefgh", "_-/" + secret, "~"]

    def nest(deep):
        inner = rng.choice(["41", "3D", "2e", "0a", "C3", "c3%25a9", "61", "5E", "78"])
        return rng.choice(["%" + "25" * deep + inner, "\\" + "u005c" * deep + "u00" + inner[:2], "%" + "5Cu0025" * (deep // 2) + inner, "%3" * deep + "35"])

    def found(text, whole):
        monkeypatch.setattr(secrets, "WHOLE", whole)
        return secrets.find_secrets(text)[1]

    for _ in range(80):
        text = "".join(rng.choice(before) + nest(rng.randint(5, 30)) + rng.choice(behind) for _ in range(rng.randint(1, 3)))
        text = text if rng.random() < 0.85 else "see " + base64.b64encode(text.encode()).decode() + " end"
        assert found(text, 8) == found(text, 1 << 30), text
