"""Small documents that hold every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat of a house went over in rain and some dog said that many birds fly home again today".split()


def sentence(start, length):
    return " ".join(WORDS[(start * 7 + i * (start % 5 + 1)) % len(WORDS)] for i in range(length))


def awkward(spark):
    """Nulls in any column, empty and blank texts, a very long one, repeated rows, odd characters, clashing names."""
    data = [
        (1, "plain words stand here for a while and then some more of them", "en", "s", 10),
        (2, None, None, None, None),
        (None, "no id but a text with rather many words in it so that rules pass", "en", "s", 1),
        (None, None, "de", None, 0),
        (3, "", "en", "s", 0),
        (4, " \t\n\x0b\x0c\r ", "fr", "s", 3),
        (5, "same row twice, with the words of it repeated as they are in both", "en", "s", 9),
        (5, "same row twice, with the words of it repeated as they are in both", "en", "s", 9),
        (6, "é漢字😀 \x00   don't <|endoftext|> it's 12³ — ok", "xx", "s", 9),
        (7, sentence(3, 30_000), "en", "s", 9),
        (8, "12345 678 !!! ###", "en", "s", 9),
        (-9, "x", "en", "s", 9),
        (10, "y" * 200_000, None, "s", 9),
    ]
    return spark.createDataFrame(data, DOCS)


def with_clashes(docs):
    """Columns that have the names of results and of inner columns."""
    names = "score predicted kept log_ratio simhash is_trusted text_md5 n_words shard slot key h at one id known nth rank bucket".split()
    return docs.selectExpr("*", *[f"'mine' AS `{n}`" for n in names])
