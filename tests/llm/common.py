"""Small document tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = ["the", "an", "re", "tion", "er", "st", "on", "ing", "or", "ble", "é", "ß", "nd", "wh"]


def prose(rng, n):
    """``n`` invented words in lines of about ten."""
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if i % 10 == 9 else " ") for i, w in enumerate(words)).strip()


def awkward_rows():
    """Null keys and texts, empty and blank texts, repeated rows, a long text."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    return [(None, None, None, None, None), (None, "", "en", "a", 0), (-1, None, "en", None, None),
            (-2, "", None, "a", 0), (-3, " \t\n\x0b", "en", "", 4), (-4, "x", "en", "b", 1), (-4, "x", "en", "b", 1),
            (-5, "A b\nA b\n c", "en", "b", 10), (-6, long, "en", "hot", len(long)),
            (-7, "word " * 400, "en", "hot", 2000), (-8, "𝄞é<|endoftext|> '$", "en", "hot", 18)]


def documents(spark, n=120, seed=3, extra=()):
    """``n`` prose documents, some copied or nearly so, and the awkward rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 40, 80, 150]))
        if i % 7 == 3 and rows:
            text = rng.choice(rows)[1]
        if i % 7 == 5 and rows:
            text = rng.choice(rows)[1] + " " + prose(rng, 1)
        rows.append((i, text, "en", rng.choice(["hot", "hot", "hot", "a", "b", "c"]), len(text)))
    return spark.createDataFrame(rows + awkward_rows() + list(extra), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators use themselves."""
    names = ["shard", "slot", "kept", "fp", "h", "__w", "__row", "__key", "w", "matches", "in_mix", "__digest"]
    for i, name in enumerate(names):
        df = df.withColumn(name, df["doc_id"] * 0 + i)
    return df


def rows(df, *columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect()))
