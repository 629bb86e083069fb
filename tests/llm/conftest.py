import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, length string, score string, token string"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions in old kettles under pale moons".split()


def hard_texts() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(WORDS[i % 20] + str(i % 997) for i in range(60_000))
    prose = " ".join(WORDS * 4)
    texts = [
        (1, prose), (2, prose), (3, prose + " end"), (3, prose + " end"), (4, None), (5, ""), (6, "   "), (7, long), (8, "\n\n\t\v\f\r"),
        (None, "no id here " * 9), (None, None), (9, "x" * 300_000), (10, "  two  spaces ▁ mark "), (11, "café naïve ß İ ΣΣ é H̱  nbsp em \U0001f600 漢字"),
        (12, "a\x00b <s> </s> <0x41> <unk> ́start"), (13, "Line one.\nLine one.\nLine two.\n" * 12), (14, "ONE, Two; three! 'll don't 12 3.4 a1b2 $$$ ***"), (15, "of " * 500), (16, "word"),
        (17, "pär " * 30 + "| # * $ % & < >" * 20), (18, "퟿  ￿ tail"), (19, prose.upper()), (20, prose.replace("fox", "cat", 1)),
    ]
    return [(i, t, "en", "src0", len(t) if t is not None else None, "x", "y", "z", "w", "v") for i, t in texts]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
