"""Texts with the awkward cases, and a table made of them."""

LONG = "word " * 30_000 + "end"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the hunter in the wood."),
    (2, None),
    (3, ""),
    (4, "   \n\t  "),
    (5, LONG),
    (6, "one"),
    (7, "The quick brown fox jumps over the lazy dog and runs away from the hunter in the wood."),
    (7, "a row that repeats an id"),
    (8, "İstanbul ΣΣ 中文 \u00a0 x\u0085y <|im_end|>\n <\\|im_end|> é e\u0301 😀😀"),
    (9, "same same same same\nsame same same same\nsame same same same"),
    (9, "same same same same\nsame same same same\nsame same same same"),
    (None, "no id"),
    (10, "x" * 5000),
]


def awkward(spark):
    """With further columns whose names are those that operators use inside."""
    rows = [(i, t, None, "src", -1, "d", "r", "s", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, range string, shard string, n int")


def same(rows, expected):
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    return sorted(map(tuple, rows), key=key) == sorted(map(tuple, expected), key=key)
