import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, r string, row_id long, _stats string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and near texts, odd characters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        None, "", " \n\t ", "one", base, base, near, base.upper(), prose(2, 30_000), "x" * 50_000, "é 日本語 ½ ٣ 🙂 <|endoftext|> don't", "a  b\n\n c\x1cd\x85e f",
        "mail me at bob.smith@mail.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111, host 10.0.0.255", "GNU  General\nPublic License; MIT licence. Released under the MIT License.",
    ]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    rows = [(i, t, "en", "s", len(t or ""), 7, "r", 3, "x") for i, t in enumerate(odd_texts)]
    rows.append((4, odd_texts[4], "en", "s", 1, 7, "r", 3, "x"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
