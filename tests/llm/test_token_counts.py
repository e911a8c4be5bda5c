import random

import public_tokenizers
import tokenizers

from graphloom.llm.bpe import Vocabulary
from graphloom.llm.token_counts import PrefixCounter, count_tokens, prefix_counts_at, truncate_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_prefixes_like_the_library():
    lib, v = tokenizers.Tokenizer.from_file(PATH), Vocabulary.load(PATH)
    c, rnd = PrefixCounter(v), random.Random(3)
    for _ in range(60):
        raw = "".join(rnd.choice("abcdeinthe rsé") for _ in range(rnd.randint(1, 25))).replace(" ", "") or "x"
        raw = raw.encode()
        counts, _ = c.prefix_counts([raw])
        assert counts.tolist() == [len(v.encode_piece(raw[:i])) if i else 0 for i in range(len(raw) + 1)]
    texts = ["", "a  b\n\n", "x" * 700, "<|endoftext|> hi", "é日本 12 don't"] + ["".join(rnd.choice("abAB ''\n\t  éÉσ0½ !?.<|>日") for _ in range(40)) for _ in range(500)]
    assert list(c.count_all(texts)) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(v.encode(c.truncate("the quick brown fox jumps over the lazy dog", 4))) <= 4


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hi there", 7)], "doc_id long, text string, N_TOKENS int")
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).orderBy("doc_id").collect()] == [(0, 0, False), (0, 0, False), (8, 2, False)]


def test_budgets_over_a_table(spark):
    """Truncation and prefix counts as columns, against the library on each prefix; clashing names, no rows."""
    lib = tokenizers.Tokenizer.from_file(PATH)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = [None, "", "hi", "the quick brown fox jumps over the lazy dog, twice", "naïve café über größe", "a  b\n\nc   d" * 4]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Truncated string")
    got = {r.doc_id: r.truncated for r in truncate_tokens(df, PATH, 5).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        assert t.startswith(got[i]) and count(got[i]) <= 5
        assert got[i] == t or count(got[i]) >= 4  # a character may add two
    at = {r.doc_id: r.prefix_tokens for r in prefix_counts_at(df, PATH, 4).collect()}
    assert at[0] == at[1] == at[2] == []
    whole = {r.doc_id: r.n_tokens for r in count_tokens(df, PATH).collect()}
    assert all(len(at[i]) == len((t or "").encode()) // 4 and max(at[i], default=0) <= whole[i] + 3 for i, t in enumerate(texts))
    ascii_ = texts[3]
    pieces = lib.pre_tokenizer.pre_tokenize_str(ascii_)
    ends = {b for _, (_, b) in pieces}
    assert all(n == count(ascii_[: 4 * (k + 1)]) for k, n in enumerate(at[3]) if 4 * (k + 1) in ends)
    assert truncate_tokens(df.limit(0), PATH, 5).count() == prefix_counts_at(df.limit(0), PATH, 4).count() == count_tokens(df.limit(0), PATH).count() == 0
