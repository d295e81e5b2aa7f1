import hashlib
import itertools
import random
import sys
from array import array

import numpy as np
import pytest

from dendroscan.llm import tokens
from dendroscan.llm.bpe import MergeAutomaton, WordBpe
from dendroscan.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bpe(tokenizer):
    return WordBpe(tokens.tokenizer_source(tokenizer), cache_chunks=500)


def random_texts(vocab):
    rng = random.Random(3)
    kinds = ["abc", "ab", "aeiou thn", "eéèßñ's'tre ", "a", ["<|endoftext|>", "x", " ", "<"], "aA'SΣςİK \x1c\u0085 ", "0123456789½²٣ a", "あ한字́e "]
    out = ["".join(rng.choice(k) for _ in range(rng.randrange(60))) for k in kinds for _ in range(150)]
    words = [w.replace("</w>", "") for w in vocab]
    out += ["".join(rng.choice(words) for _ in range(3)) for _ in range(800)]
    return [*out, "", " ", "don't we'LL 'S", "a\x1cb", "é Å", "a" * 999, "<|startoftext|><|ENDoftext|>"]


def test_encodes_and_decodes_as_the_library(bpe, library, small):
    texts = random_texts(bpe.vocab) + [r.text for r in small.collect()]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = bpe.encode(text)
        assert list(array("I", got)) == want.ids, text[:80]
        assert bpe.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_every_code_point(bpe, library):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0, sys.maxunicode + 1, 7) if not 0xD800 <= c < 0xE000] + [f"a{chr(c)}b" for c in range(0x3000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(array("I", bpe.encode(text))) == want.ids, hex(ord(text[1]))


def test_library_words_give_the_same_ids(bpe, tokenizer, small):
    ids = tokens.LibraryIds(tokens.tokenizer_source(tokenizer), bound=200)
    texts = [*random_texts(bpe.vocab), None, *[r.text for r in small.collect()]]
    assert [x.tobytes() for x in ids.texts(texts, at_once=100)] == [bpe.encode(t) for t in texts]
    spaces = [f"a{chr(c)}b" for c in range(0x3100)]
    assert [x.tobytes() for x in ids.texts(spaces, at_once=50)] == [bpe.encode(t) for t in spaces]


class Counted(tokens.ChunkIds):
    """A word's ids are its code points; counts the chunks that aren't remembered."""

    asked = 0

    def _learn(self, words):
        self.asked += len(words)
        return super()._learn(words)

    def encode_words(self, words):
        return [np.array([ord(c) for c in w], "<u4").tobytes() for w in words]


def test_many_different_chunks_are_learnt_once():
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(250_000)]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    ids = Counted([])
    for _ in range(2):
        for got, text in zip(ids.texts(texts, at_once=50), texts, strict=True):
            assert "".join(map(chr, got.tolist())) == text.replace(" ", "")
    assert ids.asked == len(words)


def test_chunks_alike_but_for_their_ends(bpe, tokenizer):
    ids = tokens.LibraryIds(tokens.tokenizer_source(tokenizer), bound=50)
    chunks = [start + end * n for start in ("a", "abcdefg", "Ab\u00e9") for end in ("\0", "b", "\u00e9") for n in range(20)]
    texts = ["", None, *chunks, " ".join(chunks), " ".join(reversed(chunks)), *chunks]
    assert [x.tobytes() for x in ids.texts(texts, at_once=7)] == [bpe.encode(t) for t in texts]


def test_table_of_chunks_whose_slots_clash(monkeypatch):
    monkeypatch.setattr(tokens._Known, "_slot", lambda self, first, second: (first % np.uint64(2)).astype(np.int64) + len(self.slots) - 2)
    rng, known, want = np.random.default_rng(5), tokens._Known(4), {}
    for _ in range(6):
        new = [k for k in {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))} if k not in want]
        first, second = np.array(new, np.uint64).reshape(-1, 2).T
        assert (known.find(first, second) < 0).all()
        sizes = rng.integers(0, 4, len(new))
        flat = rng.integers(0, 99, sizes.sum()).astype("<u4")
        known.add(first, second, sizes, flat)
        known.aside(rng.integers(0, 99, 40).astype("<u4"))
        want |= {k: x.tolist() for k, x in zip(new, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}
        first, second = np.array(list(want), np.uint64).T
        entry = known.find(first, second)
        assert [known.ids[known.ends[e] : known.ends[e + 1]].tolist() for e in entry] == list(want.values())


def plain_bpe(word, merges):
    parts = list(word)
    while True:
        pairs = [(merges[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in merges]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_of_random_merges():
    rng = random.Random(5)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = {}
        for _ in range(rng.randrange(1, 14)):
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            # a trained list makes each token once, by the merge that its parts would undergo
            if u + v not in vocab and plain_bpe(u + v, merges) == [u, v]:
                merges[u, v] = len(merges)
                vocab[u + v] = len(vocab)
        automaton, names = MergeAutomaton(vocab, list(merges), ""), {i: t for t, i in vocab.items()}
        for _ in range(80):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            assert [names[t] for t in automaton.walk(word)] == plain_bpe(word, merges), (word, merges)


def test_op9_whole_table(spark, small, library):
    got = {r.doc_id: r for r in queries()["op9_bpe_automaton"](spark, SF).collect()}
    for r in small.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)
        assert (got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256, got[r.doc_id].n_tokens) == want


def test_decode_frame(spark, odd, tokenizer):
    out = tokens.decode(tokens.encode_decode(odd, tokenizer).select("ids", "decoded").withColumnRenamed("decoded", "was"), tokenizer)
    assert out.count() == 11 and out.where("was <> decoded").count() == 0


def check_sums(rows, lengths):
    assert {r.n_tokens for r in rows} == set(lengths)
    for r in rows:
        at_least = [n for n in lengths if n >= r.n_tokens]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), len(at_least), sum(at_least))
        assert r.docs_at_most == sum(n <= r.n_tokens for n in lengths) and r.total_docs == len(lengths)
        assert r.total_tokens == sum(lengths) and r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)


def test_op10_whole_table(spark, small, library):
    lengths = [len(library.encode(r.text, add_special_tokens=False).ids) for r in small.collect()]
    check_sums(queries()["op10_token_counts"](spark, SF).collect(), lengths)


def test_sums_between_rows(spark, odd, tokenizer):
    lengths = [0, 0, 0, 5, 5, 9, 2000]
    h = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "n_tokens long, n_docs long")
    sums = tokens.suffix_sums(h, block=4).cache()
    check_sums(sums.collect(), lengths)
    for limit in (0, 1, 5, 6, 9, 100, 2000, 5000):
        assert tokens.truncated_total(sums, limit).first().truncated_total == sum(min(n, limit) for n in lengths)
    for share, want in ((0.1, 0), (0.43, 5), (0.5, 5), (0.8, 9), (1.0, 2000)):
        assert tokens.quantile(sums, share).first().n_tokens == want
    empty = tokens.suffix_sums(h.limit(0))
    assert empty.count() == 0 and tokens.truncated_total(empty, 5).first().truncated_total == 0 and tokens.quantile(empty, 0.5).first().n_tokens is None
    assert sum(r.n_docs for r in tokens.length_histogram(odd, tokenizer).collect()) == 11
