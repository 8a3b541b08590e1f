import pytest

from columbine.llm.common import bound_batches, ship_package

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empty, long, repeated and near-equal texts;
    extra columns bear names that the operators use themselves."""
    ship_package(spark)
    bound_batches(spark)
    base = "The quick brown fox jumps over the lazy dog, then it sleeps. " * 12
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"),
        (6, base), (7, base), (7, base), (8, base + "tail"), (9, LONG),
        (10, "head " + PASSAGE + " end"), (11, "Other start. " + PASSAGE), (12, "Ünïcödé été 日本語 🙂 straße " * 30),
        (13, "line a\nline a\nline b\n\nline a"), (14, "x y z x y z q"), (15, "!!! ### $$$ % & | < >"),
        (None, "a text without id"), (16, "Released under the MIT License. GNU General Public License, CC BY."),
        (17, "<|endoftext|> special <|startoftext|>  two  spaces\n\n\nthree"), (18, "a" * 3000), (19, "ab" * 900),
    ]
    out = [(i, t, "xx", "h1" if k % 3 else None, 5, "c", 1, 2.0, "r", 7, True)
           for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 "name string, fp bigint, score double, raw string, k bigint, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
