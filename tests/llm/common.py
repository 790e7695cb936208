"""Documents that no operator may stumble over, and plain-Python helpers."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ta", "né", "or", "li", "ung", "ß", "co")) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_documents():
    """Nulls in every column, empty and very long texts, repeated rows and ids, near and exact copies."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, "one", "en", "b", 3),
        (7, "one two three\n\n \tfour five\x0bsix", "en", None, 3), (8, prose(2, 6000), "de", "c", 9), (9, prose(2, 6000) + " end", "de", "c", 9), (10, prose(3, 40) + "\n" + base, "en", "a", 1),
        (11, "x" * 50_000, "en", "a", 1), (12, prose(4, 30), "en", "a", 1), (12, prose(4, 30), "en", "a", 1), (12, prose(5, 30), "en", "a", 1), (None, base, "en", "a", 1), (None, prose(6, 20), None, "z", 1), (14, " \n\t ", "en", "a", 1),
    ]
    return rows + [(100 + i, prose(100 + i, 25), "en", ("a", "b", "c", None)[i % 4], 1) for i in range(40)]


def clashing(df):
    """df with extra columns named like those that operators make or use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("kept") for c in (
        "size",
        "score",
        "node",
        "shard",
        "slot",
        "target",
        "copies",
        "n_words",
        "contaminated",
        "predicted",
        "digest",
        "label",
        "doc",
        "body",
        "gram",
    )})
