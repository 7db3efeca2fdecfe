import pytest

#: Names that operators use inside, as columns of the input.
CLASHES = "words h1 h8 _row _doc _id _own node component key first n start end starts ids kept score bucket digest carried gone lines".split()

LONG = " ".join(f"w{i % 977} x{i % 131}" for i in range(40_000)) + "\nlast line"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from loadaudit.llm.common import ship

    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, an id with
    two texts, and extra columns whose names operators use inside."""
    a = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one."
    rows = [
        (1, a, "en", "s"), (1, a, "en", "s"), (2, a, None, None), (3, None, None, None), (4, "", "en", "s"), (5, " \n\t ", "en", "s"), (None, a + " More.", "en", "s"),
        (None, None, None, None), (6, LONG, "en", "s"), (7, "Ünï ßtring\n\nŒuvre é 日本 🙂", "de", "s"), (7, "another text of the same id", "en", "s"), (8, "a", "en", "s"), (9, "\n" * 50, "en", "s"),
        (10, "ab " * 3000, "en", "s"), (11, "de la maison le chat et la souris vont dans la rue avec les enfants", "fr", "s"), (12, "\x00\x01 <|endoftext|> 'll 's", "en", "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")
