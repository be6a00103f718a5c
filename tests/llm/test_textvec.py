import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stageflow.llm import textvec as V

PATTERNS = {"space": r"[^\x20\x09-\x0D]+", "word": r"\w+", "both": r"\w+|[^\w\s]+"}
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t.,!é\U0001f600", max_size=30)), max_size=6)


@settings(deadline=None)
@given(TEXTS, st.sampled_from(sorted(PATTERNS)))
def test_equal_words_have_equal_hashes(texts, kind):
    w = V.words(texts, kind)
    plain = [re.findall(PATTERNS[kind], t or "") for t in texts]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert w.chars.tolist() == [len(x) for x in flat]
    assert len(set(w.hash.tolist())) == len(set(flat)) and all((w.hash[i] == w.hash[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@settings(deadline=None)
@given(TEXTS)
def test_grams(texts):
    w = V.words(texts, "space")
    h, at = w.grams(2)
    plain = [p for t in texts for p in [re.findall(PATTERNS["space"], t or "")]]
    pairs = [q for p in plain for q in zip(p, p[1:], strict=False)]
    assert len(h) == len(pairs) and len(set(h.tolist())) == len(set(pairs))


def test_pieces_give_the_same_words(monkeypatch):
    text = "some words in a row " * 50 + "x" * 300 + " end"
    whole = V.words([text, None, "tail"], "space")
    monkeypatch.setattr(V, "PIECE", 64)
    cut = V.words([text, None, "tail"], "space")
    assert (whole.hash == cut.hash).all() and (whole.first == cut.first).all()
