"""Byte kernels against plain Python."""
import random

import numpy as np
import pyarrow as pa

from casewright.llm import kernels as K


def texts(n=60, seed=1):
    rnd, alphabet = random.Random(seed), "aAbB zé\t\n🙂. "
    return [None if i % 9 == 0 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for i in range(n)]


def lowered(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return [lowered(w) for w in out]


def test_word_hashes_name_words_whatever_the_chunk():
    column, seen = pa.array(texts(), pa.string()), {}
    for limit in (1, 64, 1 << 20):
        got = [[] for _ in range(len(column))]
        for lo, _, data, off in K.chunks(column, limit):
            h, doc = K.word_hashes(data, off)
            for x, d in zip(h.tolist(), doc.tolist()):
                got[lo + d].append(x)
        for text, hashes in zip(column.to_pylist(), got):
            assert len(hashes) == len(words_of(text))
            for w, x in zip(words_of(text), hashes):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_ngrams_stay_in_their_document():
    column = pa.array(["a b c", "b c", "", "a"], pa.string())
    _, _, data, off = next(K.chunks(column))
    words, doc = K.word_hashes(data, off)
    two, at = K.ngram_hashes(words, doc, 2)
    assert at.tolist() == [0, 0, 1] and two[1] == two[2] != two[0]
    skip, at = K.ngram_hashes(words, doc, 2, skip=1)
    assert at.tolist() == [0] and skip[0] not in two


def test_sliced_and_empty_columns():
    column = pa.array(["xx yy", None, "zz"], pa.string()).slice(1)
    _, _, data, off = next(K.chunks(column))
    assert bytes(data) == b"zz" and off.tolist() == [0, 0, 2]
    assert list(K.chunks(pa.array([], pa.string()))) == []
    assert len(K.word_hashes(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0]) == 0
