"""Small documents with the awkward cases: null and empty texts, nulls in other columns, repeats, ties, a very long text, clashing columns."""

import random

WORDS = "the of and to in is das der die und le la les des un que el los por una".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "x", "yz", "éa"]) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    base = text(1, 120)
    near = base.split()
    near[60] = "changed"
    long = text(2, 30_000)
    out = [(i, text(100 + i, 25 + 7 * (i % 9)), ["en", "de", "fr"][i % 3], f"s{i % 4}") for i in range(40)]
    out += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, " ".join(near), "en", None), (103, base, "en", "s0"), (103, base, "en", "s0")]
    out += [(200, None, "en", "s0"), (201, "", None, "s0"), (202, " \n\t ", "en", None), (None, text(5, 30), "de", "s2"), (203, "short", "fr", "s3"), (204, "two words", None, None), (205, long, "en", "s0")]
    return [(*r, None if r[1] is None else len(r[1]), "extra") for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept string")


def words(t):
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
