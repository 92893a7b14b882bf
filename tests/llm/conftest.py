from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of thing house water light over under stone river", "de": "der und das haus wasser licht über stein fluss nicht auch"}


def prose(rng, n, lang="en"):
    syllables = ["ka", "lo", "mi", "ter", "ven", "sho", "ra", "qui"] if lang == "en" else ["sch", "keit", "ung", "ver", "zu", "ß", "ä", "lich"]
    return " ".join(rng.choice(WORDS[lang].split()) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 300), rng.choice(["en", "de"])) for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(base)]
    near = base[0].split()
    near[50] = "changed"
    rows += [
        (100, base[0], "en", "s0"), (101, " ".join(near), "en", None), (102, base[1] + " " + base[2], None, "s1"), (103, None, "en", "s1"), (104, "", "de", "s1"), (105, " \n\t ", "de", "s1"),
        (106, "one two", "en", "s2"), (107, "one two", "en", "s2"), (108, "x" * 5000, "en", "s2"), (109, "ha " * 3000, "en", "s2"), (110, prose(rng, 20000), "en", "s2"), (None, base[3], "en", "s0"), (None, None, None, None),
        (111, base[4], "de", "s0"), (111, base[4], "de", "s0"), (112, "12 34 .. !!", "en", "s0"), (113, "é😀 ﬁ ①　x y", "de", "s0"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns of names that operators use inside."""
    out = odd
    for name in ("key", "row", "class", "root", "fingerprint", "toxicity", "lang_pred", "n_entities", "topic", "n_tokens", "weight", "spans", "_row", "_found", "_new", "value", "kind"):
        out = out.selectExpr("*", f"'x' as {name}")
    return out
