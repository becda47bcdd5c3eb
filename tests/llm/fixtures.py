"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix very old potions near a quiet river bank "


def sentences(k: int, words: int = 60) -> str:
    """Different prose for each k."""
    own = [f"{w}{(k * 7 + i) % 13}" if i % 3 else w for i, w in enumerate((PROSE * 20).split()[:words])]
    return " ".join(own)


def awkward(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", None, 3),
        (5, "two  words\n", "en", "s", 11), (5, "two  words\n", "en", "s", 11), (6, "two words ", "en", "s", 10),
        (None, "two words ", "en", "s", 10), (None, None, None, None, None), (7, "a b c d e f g", "en", "s", 13),
        (8, sentences(1), "en", "s", 1), (9, sentences(1) + " end", "en", "s", 1), (9, sentences(2), "en", "s", 1),
        (10, "éà 😀 ｗｉｄｅ İstanbul ß \x00 \x1c x y", "fr", "s", 1), (11, (sentences(3) + "\n") * 400, "en", "s", 1),
        (12, "<|endoftext|> <b>&amp;", "en", "s", 1), (13, "x" * 30_000, "en", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The table with columns of names that operators use inside."""
    names = ["_text", "_row", "_hash", "key", "kept", "sequence_id", "offset", "n_words", "score", "component", "block",
             "size", "n", "bands", "text_hash", "text_sha256", "n_tokens", "_words", "_ratios", "spans", "secret_spans"]
    return df.withColumns({name: F.lit("clash") for name in names})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
