"""Fixtures shared by the tests of the training-data operators."""

import random
import zlib

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns that carry the names the operators use inside
CLASH = DOCS + ", _id string, _text string, row string, node string, n long, score double, copy string, host string"


def prose(rng: random.Random, words: int) -> str:
    syllables = ["ba", "ko", "ri", "tu", "men", "sol", "dar", "lin", "vex", "om"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


def messy_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and white texts, ties, repeated rows, one very long text, special strings, other scripts."""
    rng = random.Random(seed)
    long_text = prose(rng, 9000)
    base = prose(rng, 120)
    rows = [(0, base, "en", "a", 1), (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, None, "en", "a", None),
            (3, "", "en", "b", 0), (4, " \t\n\x0b\f\r ", None, "b", 3), (None, base, "en", None, 5), (None, None, None, None, None),
            (5, long_text, "en", "c", 9), (6, "one two three", "en", "c", 2), (7, "One  two\nthree", "en", "c", 2),
            (8, "<|endoftext|> x <|endoftext|>", "en", "c", 2), (9, "日本語 テキスト ßüéñ €5 🙂 a  b c", "ja", "d", 2),
            (10, "a b a b a b a b", "en", "d", 2), (-3, prose(rng, 60), "en", "d", 2)]
    for i in range(11, 40):
        rows.append((i, prose(rng, rng.randint(1, 200)), "en", rng.choice("abcd"), i))
    return rows


def frame(spark, rows, clash: bool = False):
    if not clash:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 7, 0.5, "c", "h") for r in rows], CLASH)


def crc_mod(value, mod: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % mod
