"""Small tables with every awkward case, and plain-Python helpers."""

import random

WORDS = "the of and thing edle ouren station wher inter ending able thon erre shines atha blend".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "s", "ly", "ation", "en"])
        out.append(w + (".\n" if k % 17 == 16 else "," if k % 11 == 10 else ""))
    return " ".join(out)


PASSAGE = prose(99, 60)

ROWS = [
    (1, prose(1, 120), "en", "a", 10),
    (2, prose(1, 120), "en", "a", 10),
    (3, prose(1, 119) + " other", "en", None, 10),
    (4, prose(4, 80) + PASSAGE + prose(5, 80), "de", "b", None),
    (5, prose(6, 80) + PASSAGE + prose(7, 80), None, "b", 1),
    (6, None, None, None, None),
    (7, "", "en", "a", 0),
    (8, " \n\t ", "en", "a", 4),
    (9, "éß" * 3000, "de", "c", 6000),
    (10, "x" * 30000, "en", "a", 30000),
    (11, "one two", "en", "a", 7),
    (12, prose(8, 6000), "fr", "hot", 1),
    (13, "mail bob@mail.example.com or +1 (269) 555-3296 4524132264652876 at 10.0.0.7 4080166431094600.", "en", "a", 1),
    (13, "mail bob@mail.example.com or +1 (269) 555-3296 4524132264652876 at 10.0.0.7 4080166431094600.", "en", "a", 1),
    (None, prose(20, 100), "en", "a", 1),
    (14, "日本語 ﬁne İ Σ΄ <|endoftext|> ½ don't Á", "en", "a", 1),
    (15, "spam ### $$$ " * 60, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["d", "t", "row", "kept", "rank", "part", "size", "key", "old", "shard", "windows", "fp", "rep", "count", "id", "base", "regions", "spans", "quality", "bad", "fold", "n_words"]


def documents(spark, rows=None):
    """The awkward table with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def empty(spark):
    return documents(spark, [])
