"""Statistics of whole texts, computed batch by batch from their bytes."""

from __future__ import annotations

import numpy as np

#: The base counts of a text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The features of the models, in this order.
FEATURES = (
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share",
    "top_word_share", "same_as_last_share", "upper_share", "digit_share", "stops_per_word", "marks_per_word",
    "words_per_line", "one_char_share",
)

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, list(b" \t\n\v\f\r"))
_FOLLOWING = (_BYTES & 0xC0) == 0x80
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOP = np.isin(_BYTES, list(b"."))
_MARK = np.isin(_BYTES, list(b"!?,;:\"'()-"))


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """Base counts and features of one text; null counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        symbols = int(np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)[_SYMBOL].sum())
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    seen_bytes = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    points = len(text) - int(seen_bytes[_FOLLOWING].sum())
    chars = points - int(seen_bytes[_SPACE].sum())
    symbols = int(seen_bytes[_SYMBOL].sum())
    earlier: set[bytes] = set()
    lines = repeated = 0
    for line in text.split(b"\n"):
        if line in earlier:
            lines, repeated = lines + 1, repeated + 1
        elif line.strip():
            lines += 1
            earlier.add(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    in_windows = _repeated_words(ids, len(known))
    upper, lower = int(seen_bytes[_UPPER].sum()), int(seen_bytes[_LOWER].sum())
    counts = [n, chars, symbols, repeated, in_windows]
    features = [
        float(np.log1p(n)),
        chars / n,
        symbols / n,
        repeated / lines,
        in_windows / n,
        len(known) / n,
        float(np.bincount(ids).max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        upper / max(1, upper + lower),
        float(seen_bytes[_DIGIT].sum()) / chars,
        float(seen_bytes[_STOP].sum()) / n,
        float(seen_bytes[_MARK].sum()) / n,
        n / lines,
        sum(1 for w in words if len(w) == 1) / n,
    ]
    return counts, features


def _repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that are found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 2_000_000:  # three ids would not fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:n] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for j in range(3):
        covered[j : j + n] |= again
    return int(covered.sum())


def batch_statistics(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows by COUNTS) and features (rows by FEATURES) of a batch."""
    both = [statistics(t) for t in texts]
    return (
        np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS)),
        np.array([f for _, f in both], dtype=np.float64).reshape(-1, len(FEATURES)),
    )
