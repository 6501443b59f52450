import random

import pytest

WORDS = [f"{a}{b}" for a in "the of and to in is that re con per st ble ing tion er an".split() for b in "o a en it us ard ix um eth al".split()]


@pytest.fixture(scope="session")
def corpus(spark):
    """300 small documents with copies, near copies, shared passages, nulls, empties, one long text, and clashing column names."""
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passage, line = text(40), "Common Line number one"
    docs = []
    for i in range(300):
        t = text(rnd.randrange(5, 90))
        if i % 10 == 1:
            t = f"{text(8)} {passage} {text(6)}"
        if i % 12 == 2:
            t = f"{text(5)}\n  {line.upper() if i % 24 == 2 else line}\t\n{text(4)}"
        if i % 15 == 3 and docs:
            t = docs[rnd.randrange(len(docs))][1] or ""
        if i % 15 == 4:
            base = (docs[rnd.randrange(len(docs))][1] or "").split()
            if len(base) > 30:
                base[rnd.randrange(len(base))] = "changed"
                t = " ".join(base)
        if i % 15 == 5 and docs:
            t = " ".join((docs[rnd.randrange(len(docs))][1] or "").split()) + " \n"
        docs.append([i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, len(t), i, i])
    docs[7][1] = docs[8][1] = None
    docs[9][1] = docs[10][1] = ""
    docs[11][1] = " \t\n"
    docs[12][1] = text(9000)
    docs[13][1] = "tha " * 60 + passage
    docs[14][1] = "x" * 5000
    return [tuple(d) for d in docs]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tid long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, corpus):
    """Rows repeated whole, and a row without an id."""
    return spark.createDataFrame([*corpus[:30], *corpus[:5], (None, "a row without an id", None, None, None, None, None)], SCHEMA)
