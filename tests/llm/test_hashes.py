"""Words and runs of words by their hashes: long words that a polynomial modulo a power of two can't tell apart."""

import random

import numpy as np
import pytest

from tidewire.llm import common, fingerprint, jaccard, substring


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def hashes(words):
    raw = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    return common.word_hash(np.frombuffer(raw, np.uint8), ends - np.array([len(w) for w in words]), ends)


def test_words_differ_and_equal_words_are_equal_wherever_they_are():
    rng = random.Random(1)
    words = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 9000]))) for _ in range(4000)})
    words += [b"\x00" * n for n in range(1, 40) if b"\x00" * n not in words]
    found = hashes(words)
    assert len(set(found.tolist())) == len(words)
    order = rng.sample(range(len(words)), len(words))
    assert (hashes([words[k] for k in order]) == found[order]).all()
    assert len(hashes([])) == 0


@pytest.mark.parametrize("size", [64, 1024, 2048, 4096, 1 << 16])
def test_complements_of_the_thue_morse_word_differ(size):
    a, b = thue_morse(size)
    assert len(set(hashes([a.encode(), b.encode()]).tolist())) == 2


def test_runs_of_words_are_known_by_all_their_words_in_order():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 3, 3000).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 35, 64, 100):
        got = common.run_hash(items, k)
        runs = [tuple(items[i : i + k].tolist()) for i in range(len(items) - k + 1)]
        assert len(got) == len(runs) and len(set(zip(runs, got.tolist(), strict=True))) == len(set(runs)) == len(set(got.tolist()))
    a, b = (np.array([hash_ for c in word for hash_ in [ord(c) * 977]], np.uint64) for word in thue_morse(1024))
    assert common.run_hash(a, 1024)[0] != common.run_hash(b, 1024)[0] and len(common.run_hash(a, 2000)) == 0


@pytest.mark.parametrize("size", [1024, 4096])
def test_operators_tell_long_words_apart(spark, size):
    a, b = thue_morse(size)
    common_words = " ".join(f"w{k}" for k in range(34))
    rows = [(1, a), (2, b), (3, f"{common_words} {a}"), (4, f"{common_words} {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got[1] == 1 and got[2] == 2  # 3 and 4 share 30 of 32 shingles
    assert {(r.doc_id, r.text) for r in substring.without_repeats(df).collect()} == set(rows)
    marks = fingerprint.of_texts([a, b])
    assert fingerprint.likeness(marks[:1], marks[1:])[0] == 0
