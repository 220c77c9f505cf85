"""Encoding and decoding against the tokenizers library."""

import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from gristmill.llm import transducer

from .helpers import DOCUMENTS, awkward

FILE = transducer.read_vocabulary()
LIBRARY = Tokenizer.from_str(FILE)
PARTS = [
    *["a", "e", "in", "the", "'s", "'", "!", "?!", " ", "\n", "1", "É", "é", "é", "ß", "日", "本", "ा", "क", "İ", "Σ", "ς", "́"],
    *["\U0001f600", "<|endoftext|>", "<|endo", "՘", "Ɐ", "x", "th", "ing", "ᅡ", "ᄀ", "ﬁ", "\x85", "​", "Ɤ"],
    *["\U00011935\U00011930", "\x1c", "'RE", "ำ", "゙", "か"],
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def same(encoder, text):
    ids = encoder.ids(text)
    return (ids, transducer.Decoder(FILE).feed(ids, last=True)) == expected(text)


@pytest.mark.parametrize("chunk, window", [(64, 8), (61, 40), (1 << 16, 512)])
def test_random_texts(monkeypatch, chunk, window):
    monkeypatch.setattr(transducer, "WINDOW", window)
    encoder, rng = transducer.Encoder(FILE, chunk), random.Random(chunk)
    for _ in range(400):
        some = PARTS[: rng.randint(2, len(PARTS))]
        assert same(encoder, "".join(rng.choice(some) for _ in range(rng.randint(0, 400))))


LONG = [
    "a" * 200_000,
    "ab" * 70_000,
    "!" * 140_000,
    "é" * 50_000,
    "'" * 3000 + " " * 200_000 + "x",
    "a" * 70_000 + "'s" + "b" * 70_000,
    "x" * 65_534 + "'re it",
    "!" * 65_535 + "'s",
    "b" + "́" * 70_000,
]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_words(text):
    assert same(transducer.Encoder(FILE), text)


def test_memory_of_a_long_word_is_bounded():
    merger = transducer.Encoder(FILE).merger
    stream, count = transducer.Stream(merger), 0
    for _ in range(300):
        count += len(stream.feed(b"inthe" * 200))
        assert len(stream._held) <= merger.lookahead + transducer.WINDOW
    assert count and stream.feed(b"", last=True)


def small_vocabulary(merges):
    letters = transducer.byte_letters()
    vocab = {c: i for i, c in enumerate([*letters, *(c + "</w>" for c in letters)])}
    for left, right in merges:
        vocab.setdefault(left + right, len(vocab))
    return vocab


@pytest.mark.parametrize("seed", range(12))
def test_tokens_before_the_lookahead_are_final(seed):
    """Merge lists of few letters, where chains are long: all ways to go on agree."""
    rng, made, merges = random.Random(seed), ["a", "b", "c"], []
    while len(merges) < 14:
        pair = (rng.choice(made), rng.choice(made))
        if len("".join(pair)) <= 9 and pair not in merges and "".join(pair) not in made:
            merges.append(pair)
            made.append("".join(pair))
    merger = transducer.Merger(small_vocabulary(merges), merges, "</w>")

    def tokens(text):
        return merger.merge([merger.inner[b] for b in text.encode()])

    for _ in range(150):
        start = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        ways = [tokens(start + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for _ in range(6)]
        final, end = [], 0
        for token in ways[0]:
            end += merger.lengths[token]
            if end > len(start) - merger.lookahead:
                break
            final.append(token)
        assert all(way[: len(final)] == final for way in ways)
        # Both ways to merge agree.
        ids = [merger.inner[b] for b in (start * 3).encode()]
        assert merger._merge_short(ids) == merger._merge_long(ids)


def test_a_merge_list_that_uses_what_it_has_not_made_is_refused():
    merges = [("ab", "c"), ("a", "b")]
    with pytest.raises(ValueError):
        transducer.Merger(small_vocabulary([*merges, ("a", "b")]), merges, "</w>")


def test_documents(spark):
    docs = awkward(spark)
    texts = docs.select("doc_id", "text").collect()
    found = transducer.coding_report(docs).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = []
    for r in texts:
        ids, text = expected(r.text)
        wanted.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(text)))
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    encoded = transducer.encode_documents(docs)
    shown = transducer.decode_documents(encoded).collect()
    assert sorted(((r.doc_id, r.text) for r in shown), key=repr) == sorted(((r.doc_id, expected(r.text)[1]) for r in texts), key=repr)
    assert transducer.coding_report(docs.limit(0)).count() == 0


def test_plain_words_come_back(spark):
    docs = spark.createDataFrame([(1, "Überall  Wörter, it's 42 日本!", "de", "s", 0), (2, None, "de", "s", 0)], DOCUMENTS)
    shown = {r.doc_id: r.text for r in transducer.decode_documents(transducer.encode_documents(docs), plain=True).collect()}
    assert shown == {1: "überall wörter , it 's 4 2 日本 ! ", 2: ""}
    cut = transducer.Decoder(FILE, plain=True)
    ids = transducer.Encoder(FILE).ids("ἠ")
    assert "".join(cut.feed([i]) for i in ids) + cut.feed([], last=True) == "ἠ "
    assert transducer.Decoder(FILE, plain=True).feed(ids[:1], last=True) == "�"


def test_unknown_files_are_refused():
    told = json.loads(FILE)
    told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        transducer.Encoder(json.dumps(told))
    with pytest.raises(ValueError):
        transducer.Decoder(json.dumps(json.loads(FILE) | {"decoder": {"type": "ByteLevel"}}))
