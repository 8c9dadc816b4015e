import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brassvane.llm import tokens

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def bpe():
    return tokens.vocabulary(PATH)


ALPHABET = st.sampled_from(list("ab cdE12'\"\n\t .,的中国发展é😂　") + ["'re", "'ll", "'s", "  ", "<|endoftext|>", "​", "the", " market"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=60), st.integers(1, 12))
def test_tree_equals_direct(parts, leaf):
    b, text = tokens.vocabulary(PATH), "".join(parts)
    done = b.tree(text, leaf)
    assert done.flat() == b.enc.encode_ordinary(text) and done.text == text
    assert b.decode(done.flat()) == text


def test_same_as_the_other_library(bpe):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("<|endoftext|>x", "公司 2024年", "don't  stop\n\n now", "é é ７７"):
        assert bpe.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_one_long_pretoken(bpe):
    rng = random.Random(0)
    text = "".join(rng.choice("abcdefgh的中国人") for _ in range(6000))  # no boundary anywhere: only pairs of tokens can stabilise
    assert bpe.tree(text, 64).flat() == bpe.enc.encode_ordinary(text)


def test_join_is_associative(bpe):
    a, b, c = (bpe.leaf(x) for x in ("It's  ", " 中国", "'re done\n"))
    assert bpe.join(bpe.join(a, b), c) == bpe.join(a, bpe.join(b, c))
    assert bpe.join(bpe.leaf(""), a) == a == bpe.join(a, bpe.leaf(""))


def test_encode_frame(spark, bpe):
    texts = [None, "", " ", "plain", "<|endoftext|>", "长文本" * 500, "word " * 400, "plain"]
    df = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode(df, "doc_id", "text", leaf=50).collect())
    assert got == sorted((i % 7, bpe.enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert tokens.encode(df.limit(0), "doc_id", "text").collect() == []
    assert tokens.encode(df, "doc_id", "text").schema["ids"].dataType.simpleString() == "array<int>"


def test_usual_texts_take_the_tree(bpe, monkeypatch):
    seen, join = [], tokens.ByteBpe.join
    monkeypatch.setattr(tokens.ByteBpe, "join", lambda self, a, b: seen.append(1) or join(self, a, b))
    text = "The market closed higher. 大盘今天走势平稳，" * 12  # about 440 letters
    assert bpe.encode(text) == bpe.enc.encode_ordinary(text) and len(seen) >= 1
