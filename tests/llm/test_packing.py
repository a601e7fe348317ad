import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallymart.llm.packing import best_fit, best_fit_packing, local_search

from . import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts_by_id, length):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 0] for i, t in texts_by_id.items()}
    pieces = {}
    for i, own in ids.items():
        for n, at in enumerate(range(0, len(own), length)):
            part = own[at : at + length]
            pieces[i, n] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(by), -(-sum(map(len, ids.values())) // length)


def test_pieces_and_sequences(spark):
    odd = ["it's <|endoftext|>x A B", "don't stop I'LL 12345 étude", "naïve ﬁ Σας ΣΑΣ", "́ lone", "<|startoftext|>", "a" * 3000]
    texts = brute.sample(8) + odd
    bins, least = check(best_fit_packing(brute.docs(spark, texts), PATH, length=128).collect(), dict(enumerate(texts)), 128)
    assert bins <= least * 1.02 + 1


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert best_fit_packing(brute.docs(spark, []), PATH).collect() == []
    rows = best_fit_packing(brute.docs(spark, ["a b", "a b", None, ""], [5, 5, None, 6]), PATH).collect()
    assert sorted(r.length for r in rows) == [1, 1, 3, 3] and len({r.sequence_id for r in rows}) == 1


def test_search_never_adds_bins_and_helps():
    r = np.random.default_rng(1)
    for low, high in ((300, 1100), (700, 900), (1, 2049)):
        sizes = r.integers(low, high, 600)
        bins, room = best_fit(sizes, 2048)
        before = len(set(bins.tolist()))
        squares = (np.bincount(bins, sizes) ** 2).sum()
        after = local_search(sizes, bins.copy(), room, 2048)
        fill = np.bincount(after, sizes)
        assert fill.max() <= 2048 and len(set(after.tolist())) <= before and (fill**2).sum() >= squares


def test_an_exchange_empties_a_bin():
    sizes = np.array([6, 3, 5, 4, 2])
    out = local_search(sizes, np.array([0, 0, 1, 1, 2]), [1, 1, 8], 10)
    assert len(set(out.tolist())) <= 3 and np.bincount(out, sizes).max() <= 10


def test_words_are_encoded_as_the_tokenizer_encodes_whole_texts(monkeypatch):
    import random

    from tallymart.llm import packing

    r = random.Random(3)
    tokenizer, coder = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    letters = [*map(chr, range(33, 127)), *map(chr, range(0x80, 0x250)), "\u0301", "Σ", "漢", "字", "ﬁ", "\u2028", "🙂", "٣", "<|endoftext|>"]
    monkeypatch.setattr(packing, "REMEMBERED", 400)
    for _ in range(150):
        common = ["the", "It's", "we'LL", "don't.", "1234", "(a|b)", "''s"]
        text = " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(20))
        assert coder.encode(text.encode().split())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_block_looks_up_its_different_parts_not_its_words():
    from tallymart.llm import packing

    seen = []

    class Counted(dict):
        def get(self, key, default=None):
            seen.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            seen.append(key)
            return super().__getitem__(key)

    tokenizer, coder = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for name, value in list(vars(coder).items()):
        if isinstance(value, dict):
            setattr(coder, name, Counted(value))
    words = [f"{a}{b}" for a in ("the", "Cat's", "dog") for b in ("", ".", ",", "!", "?", ";", ":", ")")] * 50
    ids = coder.encode([w.encode() for w in words])[0]
    assert ids.tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert len([s for s in seen if isinstance(s, bytes)]) <= 2 * 11  # the, cat, 's, dog and seven signs


def test_whole_texts_are_encoded_as_the_tokenizer_encodes_them():
    import random

    from tallymart.llm import packing

    r = random.Random(4)
    tokenizer, coder = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    some = [*map(chr, range(128)), *map(chr, range(0x80, 0x260)), *"''' \n\tsrtvelmdSRTVELMD01" * 4, "<|", "<|endoftext|>", "́", "漢", "🙂", " ", "　", "²", "½", "Ⱥ"]
    for _ in range(300):
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(3)]
        ids, lengths = coder.encode([t.encode() for t in texts])
        expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(expected, []) and lengths.tolist() == [len(e) for e in expected]
    assert [x.tolist() for x in coder.encode([b"", b" \n"])] == [[], [0, 0]]
