"""Token counts against the tokenizer library."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from siltstone.llm import tokencount as T
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n x", "'s it's", "<|endoftext|>a <|endoftext|>", "\x1c\x85\u2028\u3000 z", "é naïve 😀👍🏽 ٣٤", "\u200b\u180e q", "<|endoftext", "a" * 300, "word " * 50, "!?..  ##"]


def test_odd_texts(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(99, None, 1), (None, "a b", 2), (3, ODD[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(str, T.count_tokens(df, PATH, limit=3).collect()))
    want = []
    for i, t, _ in rows:
        n = len(LIB.encode(t or "", add_special_tokens=False).ids)
        want.append(f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={n}, over_limit={n > 3})")
    assert got == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert T.counter(PATH).count(text) == len(LIB.encode(text, add_special_tokens=False).ids)


def test_every_whole_token_is_one():
    c = T.counter(PATH)
    sample = sorted(c.whole)[::97]
    assert all(len(LIB.encode(w, add_special_tokens=False).ids) == 1 for w in sample if len(c.find(w)) == 1)


def test_empty(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_kinds_of_files_are_refused(tmp_path):
    """Whatever would be counted otherwise is an error, not a wrong count."""
    import json

    import public_tokenizers
    import pytest
    from siltstone.llm import tokencount as T

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    T.check(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"type": "Unigram"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match="byte-level"):
            T.check(spec | change)
