import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of some texts; ids from 0."""

    def build(texts, sources=None, langs=None):
        rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd():
    """Texts that must not break anything: null, empty, blank, one word, copies, near copies, a long one."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    long = " ".join(r.choice(vocabulary) for _ in range(9000))
    base = " ".join(r.choice(vocabulary) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    return [None, "", " \n\t", "word", base, base, near, long, base + "\n" + base, "ÀÉ x y  z", "a b", "line one here\nline one here\nline one here\nline two"]
