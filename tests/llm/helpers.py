"""Small inputs with the cases that every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size long, node string, start string, pos string, score string, rank string, n_lines string, bands string, label_ string"
EDGES = [
    (None, "a document without an id, long enough to be looked at by everyone", "en", "a", 1),
    (900, None, None, None, None),
    (901, "", "en", "", 0),
    (902, " \n\t \n", None, "b", 5),
    (903, "123 456 !!", "en", "b", 10),
    (904, "the same text in two rows of one id, five words and more", "en", "b", 10),
    (904, "the same text in two rows of one id, five words and more", "en", "b", 10),
]


def documents(spark, rows, clashing=False):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)
    if clashing:
        for name in CLASHING.split(", "):
            column, kind = name.split()
            df = df.selectExpr("*", f"cast(1 as {kind}) `{column}`")
    return df


def vocabulary(seed, size=400):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 7))) for _ in range(size)]


def texts(seed, count, least=1, most=200):
    """Random texts with copies, near copies and shared passages."""
    draw, words = random.Random(seed), vocabulary(seed)
    out = []
    for i in range(count):
        own = [draw.choice(words) for _ in range(draw.randint(least, most))]
        if out and i % 4 == 1:
            own = draw.choice(out).split(" ")
            if i % 8 == 1:
                own[draw.randrange(len(own))] = "CHANGED"
        if out and i % 4 == 2:
            other = draw.choice(out).split(" ")
            at = draw.randrange(len(own) + 1)
            own[at:at] = other[: draw.randint(30, 60)]
        out.append(" ".join(own))
    return out
