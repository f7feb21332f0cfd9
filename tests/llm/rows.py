"""Small documents that hold the hard cases, and plain Python versions of the rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside; as extra columns they must do no harm.
CLASH = ("row", "digest", "keep_id", "n", "kept", "node", "root", "score", "lang_pred", "_row", "size")


def text_of(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Exact and near copies, blanks, nulls, repeated rows, one very long text, two languages."""
    rng = random.Random(seed)
    base = [text_of(rng, rng.randint(1, 80)) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = text_of(rng, 1)
        text = " ".join(words) if rng.random() < 0.7 else text.upper()
        rows.append((i, text, rng.choice(["en", "fr"]), f"s{i % 4}", len(text)))
    long = text_of(rng, 9000)
    hot = [(1000 + i, base[0] + " x", "en", "s0", 1) for i in range(40)]
    odd = [
        (2000, None, None, None, None),
        (2001, "", "en", "s1", 0),
        (2002, " \t\n\x0b\x0c\r ", "en", None, 7),
        (2003, "one", "fr", "s2", 3),
        (2003, "one", "fr", "s2", 3),
        (2004, "\u00a0\u3000 \u00c9t\u00e9 e\u0301", "fr", "\u00e9", 6),
        (None, "no id here", "en", "s0", 10),
        (None, "no id here", "en", "s0", 10),
        (2005, long, "en", "s3", len(long)),
        (2006, long + " tail", "en", "s3", len(long)),
    ]
    return rows + hot + odd


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH})


def words(text: str | None, lower: bool = True) -> list[bytes]:
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if lower else raw)
