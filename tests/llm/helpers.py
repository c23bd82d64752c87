import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([r if isinstance(r, tuple) and len(r) == len(schema.split(",")) else (*r, "en", "src", 0) for r in rows], schema)


def sentence(rng: random.Random, words: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


#: Null, empty, blank, one word, no blanks for long, line ends, characters beyond Latin, special strings, controls.
ODD = [None, "", "   ", "\n\n", "word", "x" * 5000, "a\r\nb\tc  d", "中文 字 😀 text", "<|endoftext|> a<|startoftext|>b", "\x00 \x1f\x1c x", "É́ ñ ​\xa0 ß", "it's don't I'LL 12 3½"]
