"""Nothing of the corpus is left out: rare characters."""

import numpy as np
import pytest

from plenum.llm import lm


def test_rare_characters_are_scored_as_themselves(spark):
    """Greek beyond the alphabet: each character is the symbol's probability times its share, and isn't easy to predict."""
    latin = ["".join(chr(33 + (i * j) % 93) for j in range(400)) for i in range(1, 41)]
    greek = ["".join(chr(0x3B1 + (i + 5 * j) % 24) for j in range(60)) for i in range(2)]
    rows = spark.createDataFrame(list(enumerate(latin + greek)), "doc_id long, text string")
    points, w, others = lm.learn(rows.select("text"))
    got = {r.doc_id: r for r in lm.score_documents(rows, model=(points, w, others)).collect()}
    as_symbol = {r.doc_id: r.log_likelihood for r in lm.score_documents(rows, model=(points, w)).collect()}
    known, text = set(points.tolist()), "".join(latin + greek)
    rest = sum(ord(c) not in known for c in text)
    assert rest == 120
    for i, t in enumerate(latin + greek):
        share = sum(np.log(text.count(c) / (rest + 1)) for c in t if ord(c) not in known)
        assert got[i].log_likelihood == pytest.approx(as_symbol[i] + share, abs=1e-6)
    assert got[len(latin)].log_likelihood < as_symbol[len(latin)] - 60 * 3
    lacking = lm.own_share(np.array([0x4E2D]), others)[0]
    seen = {ord(c) for c in text}
    assert np.exp(others[1]).sum() + (lm.UNICODE - len(seen)) * np.exp(lacking) == pytest.approx(1)
