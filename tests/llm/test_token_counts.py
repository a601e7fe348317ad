import random

import public_tokenizers

from tallymart.llm.token_counts import Automaton, token_counts, vocabulary

from . import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces, longest):
    n = 0
    while word:
        k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces)
        word, n = word[k:], n + 1
    return n


def test_automaton_equals_greedy_matching():
    r = random.Random(2)
    pieces = [bytes([c]) for c in b"abc"] + [bytes(r.choice(b"abc") for _ in range(r.randint(2, 7))) for _ in range(60)]
    automaton = Automaton(pieces)
    for _ in range(3000):
        word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 30)))
        assert automaton.count(word) == greedy(word, set(pieces), 7)


def test_counts_of_texts(spark):
    pieces = set(vocabulary(PATH))
    longest = max(map(len, pieces))
    texts = brute.sample(3) + ["Hello WORLD naïve 漢字", "x" * 5000, "  \x00"]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(brute.docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        assert got[i] == (len(words), sum(greedy(w, pieces, longest) for w in words))


def test_empty_table_and_null_ids(spark):
    assert token_counts(brute.docs(spark, []), PATH).collect() == []
    assert [tuple(r) for r in token_counts(brute.docs(spark, [None, None], [None, 3]), PATH).orderBy("doc_id").collect()] == [(None, 0, 0), (3, 0, 0)]
