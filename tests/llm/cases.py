"""Documents with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that an operator might use for itself, or returns.
CLASH = "shard int, slot string, size string, n_words string, kept string, taken int, word string, bucket int, pos int, score string"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def prose(rng, words):
    out = []
    for i in range(words):
        out.append(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else ""))
        if rng.random() < 0.05:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def documents(seed=5, n=60):
    """Prose, exact and near copies, and rows that are null, empty, blank, odd or repeated."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 4, 5, 6, 40, 60, 120, 400])) for _ in range(n)]
    texts += [texts[4], texts[7].upper(), texts[9] + " tail"]
    long = prose(rng, 300)
    for i in range(6):
        words = long.split(" ")
        words[10 * i] = f"odd{i}"
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t ", "x", "é ß ñ z", "a  b   c\n\n\nd", "́x", prose(rng, 9_000)]
    texts += ["The The The The The " * 20, "### a ### b " * 40, "same line here\n" * 40]
    rows = [(i * 3, t, ["en", "fr", None][i % 3], [None, "b", "a"][i % 3], 7) for i, t in enumerate(texts)]
    return rows + [(None, texts[5], "en", "a", None), (0, texts[0], "en", None, 7), (0, texts[0], "en", None, 7)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """The same rows, with extra columns."""
    extra = [f"cast(null as {kind}) as {name}" for name, kind in (x.split() for x in CLASH.split(", "))]
    return df.selectExpr("*", *extra)


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
