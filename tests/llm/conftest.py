import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def split(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and extra columns whose names operators use inside."""
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    same = "the same text of some words that is found in two rows and counts as one class of equal sets here now"
    rows = [
        (None, "a text without an id but with words in it, quite a few of them to be honest", "en"),
        (1, None, "en"),
        (2, "", "en"),
        (3, " \t\n ", None),
        (4, long, "en"),
        (5, same, "de"),
        (6, same, "de"),
        (7, same + " changed", "de"),
        (8, same, None),
        (8, same, None),
        (9, "one two", "en"),
        (10, "ONE  TWO", "en"),
        (11, "é ß   日本語 <|endoftext|> it's 12½!", "fr"),
        (12, "ALL!! CAPS!! JUNK!! " * 30, "en"),
        (13, long, "en"),
        (None, None, None),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n int, rid string, bucket int, part int, at string, kid int, places string, held boolean"
    full = [(i, t, g, "src0", len(t) if t else 0, 0.5, 1, "x", 2, 3, "y", 4, "z", True) for i, t, g in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def plain(odd):
    """The same rows as (doc_id, text) pairs."""
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
