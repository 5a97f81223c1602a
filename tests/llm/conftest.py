import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mister how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that depends on seed."""
    out, x = [], seed * 2654435761 % (1 << 32)
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % (1 << 32)
        out.append(WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empties, blanks, a very long text, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, prose(1, 60_000), "en", "b", 1), (5, prose(2, 80), "en", "b", 2), (5, prose(2, 80), "en", "b", 2), (6, prose(2, 80).upper(), "de", "c", 3),
        (7, "x" * 700_000, "en", "c", 4), (8, "one", "en", None, 5), (9, "one two\n\none  TWO\nÄ é 😀", "en", "a", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["host", "score", "line", "doc", "id", "n", "key", "media", "size", "rep", "kept"]
    return df.withColumns({c: F.lit("clash") for c in clashing}).cache()
