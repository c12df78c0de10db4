import numpy as np
import pyarrow as pa

from tickloom.llm.words import LONG, Words


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_break_polynomials_differ():
    words = [w for n in (32, 64, 128, 1024, 4096) for w in (thue_morse(n), thue_morse(n, "b", "a"))]
    for lower in (False, True):
        assert len(np.unique(Words(pa.array([" ".join(words)]), lower).hashes())) == len(words)


def test_case_and_place_do_not_matter():
    for n in (3, LONG, LONG + 1, 500):
        word = thue_morse(n)
        got = Words(pa.array([word, f"x {word.upper()}", None, f"{word}\n\t{word}  y"]), True).hashes()
        assert got[0] == got[2] == got[3] == got[4] and len(set(got.tolist())) == 3
        assert len(set(Words(pa.array([word, word.upper()])).hashes().tolist())) == 2
