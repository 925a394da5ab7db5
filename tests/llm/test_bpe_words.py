"""Words behind a space are kept once, and candidates for a last token are told by four bytes."""

from __future__ import annotations

import public_tokenizers

from tracewright.llm import bpe
from tracewright.llm.queries import MULTI


def test_words_are_kept_once_and_encoded_like_merges():
    tok = bpe.Tokenizer(public_tokenizers.path(MULTI), public_tokenizers.PATTERN)
    text = "some words zzqxv notably don't café12345 中文 antidisestablishmentarianism"
    want = [i for piece in tok.split(text) for i in tok.v.merge(piece.encode())]
    assert tok.encode(text) == want
    assert " zzqxv" not in tok._piece and "zzqxv" in tok._rest
    assert all(len(t) in tok.v.long_ends[t[-4:]] for t in tok.v.ranks if len(t) > 3)
    assert all(tok.v.ends[t][0] == 3 for t in tok.v.ranks if len(t) == 3)
