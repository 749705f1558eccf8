import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, row string, spans binary, component_id string, h string"


def edge_rows():
    """Nulls, empties, ties, repeated rows, a very long text, odd characters; passages that recur across documents."""
    rng = random.Random(5)
    words = [a + b for a in ("ta", "re", "mo", "li", "én") for b in ("ka", "so", "n", "ß", "vu.")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    lines = "\n".join(text(6) for _ in range(5))
    texts = [
        (1, text(40) + " " + passage + " " + text(30)), (2, text(25) + "\n" + passage), (3, None), (4, ""), (5, " \t\n\x0b "), (6, "one"), (None, passage), (8, lines), (9, "intro\n\n" + lines + "\nend"),
        (9, "intro\n\n" + lines + "\nend"), (10, text(3000) + passage), (11, lines + "\n" + lines), (12, "It " * 50), (13, passage.upper()), (14, "日本語 テキスト　です Привет"), (15, "a b c <|endoftext|> \x01x"),
        (9, "another text under a used id " + passage), (16, text(19)), (17, passage + " x"), (18, passage), (18, passage), (None, None),
    ]
    return [(i, t, [None, "en", "fr"][k % 3], [None, "src0", "src0"][k % 3], None, 7, "clash", b"x", "clash", "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
