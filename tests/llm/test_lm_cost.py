"""What makes operator 1 cheaper changes no id, no score and no gradient."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ahocorasick")

from tidemill.llm import attention, lm  # noqa: E402
from tidemill.llm.common import ragged  # noqa: E402

TEXTS = ["", "  ", "The cat's  hat\n\n\tis on; 12 hats", "né x  ÄÖ '", "<|endoftext|> Ab\tcd <|endoftext|>x", "日本 語 a\xa0b", "the the THE cat"]


def words(bpe, texts, blank=False, **limits):
    flat, starts, ends, hashes, per = lm.words_of(texts)
    keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if blank:
        flat = np.zeros_like(flat)
    pool, begin, size = bpe.encode_words(flat, starts[first], ends[first], keys, **limits)
    each = size[which]
    return pool[ragged(begin[which], each)].tolist(), np.append(0, np.cumsum(each))[np.append(0, np.cumsum(per))].tolist()


def test_words_are_encoded_once_and_as_in_their_text():
    bpe = lm.load_bpe("byte_bpe_50k.json")
    bpe._reset()
    for texts in (TEXTS, TEXTS[2:3] * 3, TEXTS[:1], []):
        column = pa.array(texts, pa.large_string())
        ids, off = bpe.encode_column(lm.normal_texts(column))
        assert words(bpe, column) == (ids.tolist(), off.tolist())
        assert words(bpe, column, blank=True) == (ids.tolist(), off.tolist())  # known words are not read again
    assert words(bpe, pa.array(TEXTS, pa.large_string()), keep=1)[0] == words(bpe, pa.array(TEXTS, pa.large_string()))[0]


def test_places_that_are_context_only_need_no_hidden_rows():
    rng = np.random.default_rng(4)
    p = attention.unpack(rng.normal(0, 0.3, attention.SIZE).astype(np.float32))
    tables = attention.tables_of(rng.integers(0, 3, (attention.CLASSES, attention.CLASSES)))
    x, y = rng.integers(0, attention.CLASSES, (2, 2 * attention.BLOCK + 3, attention.LENGTH))
    ready = attention.projected(p)
    whole, rest = attention._hidden(p, ready, x)[1], attention._hidden(p, ready, x, attention.OVERLAP)[1]
    assert np.allclose(whole.reshape(*x.shape, -1)[:, attention.OVERLAP :], rest.reshape(len(x), -1, attention.WIDTH), atol=1e-4)
    mask = np.ones(x.shape, bool)
    every = attention.log_probs(p, tables, x, y, mask, ready).reshape(x.shape)
    mask[:, : attention.OVERLAP] = False
    assert np.allclose(attention.log_probs(p, tables, x, y, mask, ready), every[mask], atol=1e-4)
    one = np.concatenate([attention.log_probs(p, tables, x[i : i + 1], y[i : i + 1], mask[i : i + 1], ready) for i in range(len(x))])
    assert np.allclose(one, every[mask], atol=1e-4)
    assert attention.log_probs(p, tables, x, y, np.zeros(x.shape, bool), ready).shape == (0,)
