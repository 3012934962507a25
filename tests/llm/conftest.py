"""Documents with all that may stand in a table."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, _gone int, h string, all_spans string, place int, fp int"


def sentences(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("aeioumnrstdlkp") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): copies, near copies, nulls, empty, long and odd texts; a third of the rows is one text."""
    rng = random.Random(3)
    base = [" ".join(sentences(rng, rng.randint(30, 60))) for _ in range(12)]
    out: list[tuple[int | None, str | None]] = [(k, "\n".join(base[j] for j in range(k % 12, min(12, k % 12 + 3)))) for k in range(20)]
    near = base[0].split()
    for k in range(20, 30):
        near[rng.choice((0, 1, len(near) - 1))] = f"changed{k}"
        out.append((k, " ".join(near) + "\n" + base[1]))
    out += [(k, "the same short text everywhere, password=hunter2hunter2 and more words of it") for k in range(30, 60)]
    out += [(60, None), (61, ""), (62, " \t\n\x0b "), (63, "one"), (64, "a b c d"), (65, "A B C D"), (66, "x\ty\r\nz\x0cw \x0b v\n\nx y z w v")]
    out += [(67, "ÄÖ Σίσυφος ΣΑΣ ﬁne é 数字 １２ ½ don't I'LL <|endoftext|> <|startoftext|>a\x1cb"), (68, "AKIA" + "Q7" * 8 + " " + "0f" * 20 + " token: \"abcdefgh1234\" secret = short")]
    out += [(69, "\n".join(" ".join(sentences(rng, 12)) for _ in range(3000))), (70, "### $$$ %%% " * 20), (71, base[3] + "\n" + base[3] + "\n" + base[3])]
    return out


def frame(spark, rows):
    """Rows of (doc_id, text) with the other columns of documents and some whose names may clash."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "w", 1, "h", "a", 5, 6) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return dict(corpus())


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, repeated and null doc_ids, nulls in all columns."""
    return frame(spark, [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, None), (None, "a b c d e f g h"), (2, None), (3, "")])


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [(1, "x")]).where("false")
