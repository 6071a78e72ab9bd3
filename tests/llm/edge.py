"""Documents with everything that may be odd about them."""

LONG = " ".join(f"word{i % 911} of{i % 7}" for i in range(20_000))
LINE = "This very same line of more than forty characters stands in many documents"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept string, size long, shard int, score double, h1 long, n long, id long, pair long, comp long"
TEXTS = [
    None, "", " ", "\n", "\n\n", "one", "two words", "a b c", "tie tie tie tie", LONG, LONG, "naïve Éclair ÉCLAIR ΣΑΣ İx", "\x00 nul \x1c fs\x85 nel", "🙂 emoji 🙂🙂",
    *[f"{LINE}\nown line number {i} that is also rather long, forty characters\n{LINE.upper() if i % 2 else LINE}" for i in range(7)],
    *["copy of the same short text, word for word " * 4] * 5,
    "x" * 3000, "|" * 50, "a | b | c | d |\n" * 40,
]


def rows():
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 1, "x", 2, 3, 0.5, 4, 5, 6, 7, 8) for i, t in enumerate(TEXTS)]
    out += [(None, "a document without an id, seven words", "en", None, *out[0][4:]), (None, None, None, None, *out[0][4:])]
    return out + [out[6], out[6], out[20]]  # repeated rows


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
