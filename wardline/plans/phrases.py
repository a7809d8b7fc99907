"""Phrases placed into the draft view, one per draft check, plus neutral ones."""

PHRASES = (
    "",
    "he is a scammer",
    "это мошенничествами не назвать",
    "no risk was found",
    "the trust score is low",
    "chance about 80 percent",
    "write to ann@mail.example",
    "see www.shop.example now",
    "call 90 123 45 67 89",
    "dated 2024-01-15 only",
    "card 8600 1234 5678 9012 3",
    "passport AB1234567",
    "kod: 12345",
    "password: hunter2",
    "please open the link",
    "family.credential_theft applies",
    "see card.alpha today",
    "деньги пришли",
    "скриншот не доказывает, что деньги пришли",
    "the same case proves it",
    "we checked the database",
    "it is on a phishing list",
    "совсем другой текст",
    "not financial advice",
)
