"""Invented prose."""

WORDS = [a + b for a in ("an", "the", "or", "ing", "ti", "re", "sh", "on", "ed", "wh") for b in ("he", "at", "er", "nd", "st", "ou", "ly", "ble")]


def prose(chance, n, per_line=15):
    words = [chance.choice(WORDS) + chance.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) for k in range(0, n, per_line))


def edited(chance, text, share):
    return " ".join("changed" + str(chance.randrange(999)) if chance.random() < share else w for w in text.split(" "))
