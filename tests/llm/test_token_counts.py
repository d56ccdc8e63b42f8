import random

import pytest
from pyspark.sql import functions as F

from cuelake.llm.queries import vocabulary
from cuelake.llm.token_counts import PrefixCounter, TokenCounts, WordTables, longest_prefix, prefix_tables, token_counts, tokens_of_prefix, truncated

PARTS = ["a", "B", "'", "s", "re", "'re", "'ll", "é", "é", "İ", "ΑΣ", "Σ", " ", " ", "  ", "\n", "1", "23", "!", "<|", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "日本", "한", "ᄒ", "ᅡ", "the", "ing", "tion", "x̣̂", "😀", "ﬁ", "\x00", "~", "don't", "　", "||", "́", "aaaa", "ooooooo"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_against_the_library(library):
    tables, rng = WordTables(TokenCounts(vocabulary())), random.Random(5)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        found, want = tables.documents([text])[0], counted(library, [text[:i] for i in range(len(text) + 1)])
        assert found.table().tolist() == want and found.n_tokens == want[-1], text
        for budget in (0, 1, 3, 9):
            assert found.longest(budget) == max(i for i, n in enumerate(want) if n <= budget), (text, budget)


def test_the_pass_on_random_bytes(library):
    counter, rng = PrefixCounter(vocabulary()), random.Random(6)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    closed, begin = counter.counts([w.encode() for w in words])
    for word, a, b in zip(words, begin, begin[1:]):
        assert closed[a:b].tolist() == counted(library, [word[: i + 1] for i in range(len(word))])


def test_the_query_on_every_document(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in token_counts(docs, TokenCounts(vocabulary(), limit=100)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for (doc, text), n in zip(texts.items(), counted(library, list(texts.values()))):
        got = rows[doc]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(text.encode()), n, n > 100)
        cut = counted(library, [text[: got.fits_chars], text[: got.fits_chars + 1]])
        assert cut[0] <= 100 and (got.fits_chars == len(text) or cut[1] > 100)


def test_odd_rows_and_forgetting(spark, library):
    long = "x" * 30_000 + " " + "word " * 30_000
    rows = [(1, None, "a"), (1, "", "b"), (None, "  \n", "c"), (2, long, "d"), (2, "a<|endoftext|>b", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit, r.fits_chars) for r in token_counts(docs, TokenCounts(vocabulary(), words=1)).collect())
    n = counted(library, [long])[0]
    assert got[:4] == [(0, 3, 0, False, 3), (1, 0, 0, False, 0), (1, 0, 0, False, 0), (2, 15, 3, False, 15)]
    assert got[4][:4] == (2, len(long), n, True) and counted(library, [long[: got[4][4]], long[: got[4][4] + 1]]) == [2048, 2049]
    assert token_counts(docs.where("false"), TokenCounts(vocabulary())).count() == 0


def test_tables_answer_budgets(spark, library):
    docs = spark.createDataFrame([(1, "Don't tokenise  this again, ünïcode"), (2, None)], "doc_id long, text string")
    both = docs.join(prefix_tables(docs, TokenCounts(vocabulary())), "doc_id").orderBy("doc_id")
    got = both.select(tokens_of_prefix("prefix_tokens", F.lit(7)).alias("seven"), truncated("text", "prefix_tokens", F.lit(4)).alias("cut"), longest_prefix("prefix_tokens", F.lit(0)).alias("none")).collect()
    text = "Don't tokenise  this again, ünïcode"
    prefixes = counted(library, [text[:i] for i in range(len(text) + 1)])
    assert got[0].seven == prefixes[7] and got[0].none == 0
    assert got[0].cut == text[: max(i for i, n in enumerate(prefixes) if n <= 4)]
    assert (got[1].seven, got[1].cut, got[1].none) == (0, None, 0)
