import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


@pytest.mark.parametrize("lang", [None, "de"])
def test_nothing_learnt_rejects_nothing(spark, documents, lang):
    """No labels, or labels on held-out rows only: only texts without letters go."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0][:5]
    texts = ["wort und wort", "é", "12 34", None, "💥 ünd"]
    docs = documents(list(zip(held, texts)), lang=[lang] * 5)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect()} == {"wort und wort", "é", "💥 ünd"}
