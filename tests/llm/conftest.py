import random

import pytest

WORDS = "the of and lorem ipsum dolor sit amet elit sed eius tempor über Straße niño año être déjà data model token shard graph field river stone cloud".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([".", ",", ""]) if r.random() < 0.2 else "") for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h long, slot int, length int, keep boolean"


def rows(texts, first=0):
    """Documents with extra columns whose names clash with those that operators use inside."""
    langs = ["en", "fr", None]
    return [(i + first, t, langs[i % 3], f"src{i % 3}" if i % 7 else None, len(t or ""), "x", 1, 2, 3, True) for i, t in enumerate(texts)]


EDGES = [None, "", " ", "\n\n", "one", "two words", "a  b   c", " lead", "trail ", "tab\tand\nline", "İstanbul Ünïcode ß ΟΔΟΣ", "😀 emoji 😀", "<|endoftext|> special", "x" * 3000, "é" * 50, "12.5 3,4", "don't 's we'll", " nbsp em", "\x00\x01 ctrl \x1c fs"]


@pytest.fixture(scope="session")
def edge_texts():
    base = [prose(k, 20 + 7 * k) for k in range(12)]
    return [*EDGES, *base, *base[:4], base[0] + " extra", prose(99, 6000)]


@pytest.fixture(scope="session")
def edges(spark, edge_texts):
    made = rows(edge_texts)
    made += [(None, *made[25][1:]), (None, *made[3][1:]), made[26], made[26]]  # null ids and repeated rows
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
