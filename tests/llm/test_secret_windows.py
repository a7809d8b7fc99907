"""Letters-only tokens, and allow-listed runs inside long tokens."""

import random
import string

from wardline.llm import secrets


def added(frame, texts):
    rows = secrets.secret_digest(frame(list(enumerate(texts)))).collect()
    return [r["n_added"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_letters_only(frame):
    chance = random.Random(3)
    drawn = "".join(chance.sample(string.ascii_letters, 24))
    assert added(frame, [f"key {drawn} end", "counterrevolutionaries internationalizations", "donaudampfschifffahrtsgesellschaft", "x" * 50_000]) == [1, 0, 0, 0]


def test_runs_only_excuse_their_windows(frame):
    chance = random.Random(4)
    half = ["".join(chance.sample(string.ascii_letters + string.digits, 30)) for _ in range(2)]
    short = ["Zk3", "p9W"]
    runs = ["AAAAAA", "z" * 40, "AbCdEfGh", "0123456789", "QWERTYUI"]
    assert added(frame, [half[0] + r + half[1] for r in runs]) == [1] * 5
    assert added(frame, [short[0] + "0123456789" + short[1] + "abcdefgh" + short[0], "7" + "ab" * 12 + "cccccc"]) == [0, 0]
    assert added(frame, ["EXAMPLE" + half[0], "sha256-" + half[0]]) == [0, 0]  # these patterns still judge the whole
