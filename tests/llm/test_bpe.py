import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from scriptorium.llm import bpe  # noqa: E402

PATH = bpe.default_path()
REAL = Tokenizer.from_file(PATH)


def real(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("abthein' s<|>endoftx\né́$1", max_size=80))
def test_any_text_equals_the_library(text):
    own = bpe.vocabulary(PATH)
    ids = own.encode(text)
    assert ids == real(text)
    assert own.decode(ids) == REAL.decode(ids, skip_special_tokens=False)


def test_every_token_of_the_vocabulary():
    own = bpe.vocabulary(PATH)
    words = [t.replace("</w>", "") for t in list(REAL.get_vocab())]
    words += [a + b for a, b in zip(words[::7], words[3::7])]
    for w, e in zip(words, REAL.encode_batch(words, add_special_tokens=False)):
        assert own.encode(w) == e.ids, w


def test_documents_nulls_and_long_texts(spark):
    long = "the theere ing " * 60_000 + "x" * 200_000
    rows = [(1, "Hello <|endoftext|> world", "a"), (2, None, "b"), (3, "", "c"), (4, long, "d"), (4, long, "d"), (5, " \n", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.digests(df, "doc_id", "text").collect())
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 4, 5]
    for r in got:
        ids = real({x[0]: x[1] for x in rows}[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r.doc_id: r for r in bpe.encode(df, "doc_id", "text").collect()}
    assert list(full[1].ids) == real(rows[0][1]) and full[1].decoded == REAL.decode(real(rows[0][1]), skip_special_tokens=False)
    assert bpe.digests(df.limit(0), "doc_id", "text").count() == 0
