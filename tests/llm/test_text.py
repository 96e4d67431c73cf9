"""Words of Arrow strings."""

import pyarrow as pa

from docgrid.llm import jaccard as J
from docgrid.llm import text as T


def test_words_split_at_ascii_space_only():
    words, at = T.words_of(pa.array([" Ab\x0bc d\x1ce ", None, "", "É x"]), lower=True)
    assert words.to_pylist() == ["ab", "c d\x1ce", "É", "x"] and at.tolist() == [0, 2, 2, 2, 4]


def test_slices_give_what_whole_arrays_give():
    texts = ["é à b c d e"] * 500 + [None, "ñ ö ü ß A"] * 500
    a = pa.array(texts)
    whole = [x.tolist() for x in J.shingle_sets(a, 3)]
    parts = [x.tolist() for p in J.pieces(a, 1000) for x in J.shingle_sets(p, 3)]
    assert parts == whole
