"""Token counts and cuts by a vocabulary."""

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocabulary
from tidemark.operators import context


@pytest.fixture(scope="module")
def ranks():
    return vocabulary.read_ranks(P.path("byte_bpe_50k.tiktoken"))


TEXTS = ["", "hello", "hello world, it's 2024!", "  spaces   and\n\nlines ", "ünïcödé straße 東京 🎉🎉🎉 नमस्ते", "x" * 300, "a1b2c3 <|endoftext|> foo_bar", "\x00\x1c"]


def test_pattern_is_the_vocabularys(ranks):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    known = vocabulary.encoding(ranks)
    for text in TEXTS:
        assert known.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_have_as_many_tokens_as_asked(ranks):
    known = vocabulary.encoding(ranks)
    rng = random.Random(3)
    words = [w for t in TEXTS for w in t.split()] + ["token", "ization", ".", "\n"]
    exact = tried = 0
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(1, 30)))
        whole = known.encode_ordinary(text)
        most = rng.randrange(0, len(whole) + 2)
        got = vocabulary.cut(known, text, most)
        have = len(known.encode_ordinary(got))
        assert text.startswith(got) and have <= most
        if len(whole) <= most:
            assert got == text
        else:
            # no later token of the first ``most`` ends a prefix that fits
            ends = [known.decode_bytes(whole[:k]) for k in range(most + 1)]
            fits = [e for e in ends if e.decode("utf-8", "ignore").encode() == e and len(known.encode_ordinary(e.decode())) <= most]
            assert got.encode() == max(fits, key=len)
            tried += 1
            exact += have == most
    assert exact / tried > 0.8  # the others would part a character or a word


def test_vocabulary_in_a_table(spark, ranks):
    known = vocabulary.Vocabulary.load(spark, P.path("byte_bpe_50k.tiktoken"))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None])], "k int, t string").repartition(3)
    local = vocabulary.encoding(ranks)
    got = {r["k"]: (r["n"], r["c"]) for r in rows.select("k", known.count(F.col("t")).alias("n"), known.first(F.col("t"), 3).alias("c")).collect()}
    assert got == {k: (0 if t is None else len(local.encode_ordinary(t)), None if t is None else vocabulary.cut(local, t, 3)) for k, t in enumerate([*TEXTS, None])}


def test_summaries_are_cut_by_real_counts(spark):
    known = vocabulary.Vocabulary.load(spark, P.path("byte_bpe_50k.tiktoken"))
    said = [("system", "s")] + [("user" if k % 2 else "assistant", "word " * (k % 7 + 1)) for k in range(40)]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "c int, k int, role string, text string")
    got = context.summarizer_cutoff(rows, "c", "k", "role", known.count(F.col("text"))).first()["cutoff"]
    sizes = [len(vocabulary.encoding(known.ranks).encode_ordinary(t)) for _, t in said]
    total, cum, want = sum(sizes[1:]), 0, 0
    for k in range(1, len(said)):
        cum += sizes[k]
        if said[k][0] == "assistant" and (cum >= int(total * 0.9) or len(said) - 1 - k <= 5):
            want = k + 1
            break
    assert got == want
