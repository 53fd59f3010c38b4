"""White space too long for the fast way's splitter."""

import numpy as np
import public_tokenizers
import pytest

from epipanel.llm import packing, pieces

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = 2_000_000


@pytest.mark.parametrize("text", [" " * LONG + "word", "a" + " \n\t\u3000" * (LONG // 4) + "word b", "<|endoftext|>" + "\n" * LONG + "x y",
                                  " " * (pieces.LONGEST_SPACE + 1) + "x", " " * pieces.LONGEST_SPACE + "x"])
def test_long_space_is_the_library(text):
    encoder = pieces.encoder(BYTES)
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text, "b c"])[0] == np.array(want, "<u4").tobytes()


def test_packing_of_long_space(spark):
    docs = spark.createDataFrame([(1, " " * LONG + "word"), (2, "two words")], "doc_id long, text string")
    found = packing.pack(docs, BYTES).collect()
    want = {i: len(pieces.encoder(BYTES).encode([t])[0]) // 4 + 1 for i, t in ((1, " " * LONG + "word"), (2, "two words"))}
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == want
