"""Word and window hashes against the library, whole numbers and patterns that defeat weaker hashes."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from foliospark.llm import words as W


def thue_morse(n, a, b):
    return [(a, b)[k.bit_count() & 1] for k in range(n)]


def found(texts, *args, **kwargs):
    data, offsets = W.text_buffers(pa.array(texts))
    return data, W.find_words(data, offsets, *args, **kwargs)


def test_word_hashes_are_the_librarys():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aé😀Z9-") for _ in range(rng.randrange(1, 45))) for _ in range(rng.randrange(0, 60))) for _ in range(50)] + [None, "", "x" * 3_000_000]
    data, got = found(texts, seeds=(1, 2))
    raw = data.tobytes()
    for seed in (1, 2):
        assert got.hashes[seed].tolist() == [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(got.start, got.end, strict=True)]
    assert got.counts.tolist() == [len((t or "").split()) for t in texts]


def test_folded_words_hash_as_lower_case():
    _, got = found(["Straße ABC-def", "straße abc def"], W.ALNUM, W.LOWER)
    assert got.hashes[1][:3].tolist() == got.hashes[1][3:].tolist()


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_patterned_words_differ(size):
    _, got = found(["".join(thue_morse(size, "a", "b")), "".join(thue_morse(size, "b", "a"))], seeds=(1, 2))
    assert all(h[0] != h[1] for h in got.hashes.values())


def test_patterned_windows_differ():
    for size in (64, 1024, 4096):
        _, got = found([" ".join(thue_morse(size, "a", "b")), " ".join(thue_morse(size, "b", "a"))])
        sums = W.window_sums(got.hashes[1])
        one, two = W.window_at(sums, np.array([0, size]), np.array([size, 2 * size]))
        assert one != two


def test_window_hashes_are_polynomials_in_the_field():
    rng = random.Random(2)
    x = [rng.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1, W.FIELD, W.FIELD - 1]
    base = 0xD6E8FEB86659FD93
    up, down = W.powers(base, 400)
    assert [int(v) for v in up[:400]] == [pow(base, k, W.FIELD) for k in range(400)]
    assert all(int(a) * int(b) % W.FIELD == 1 for a, b in zip(up[:400], down[:400], strict=True))
    sums = W.window_sums(np.array(x, dtype=np.uint64), base)
    total, expected = 0, [0]
    for k, v in enumerate(x):
        total = (total + v * pow(base, k, W.FIELD)) % W.FIELD
        expected.append(total)
    assert [int(s) for s in sums] == expected
    again = W.window_sums(np.array([7, 8, *x], dtype=np.uint64), base)
    at = np.arange(len(x) - 13)
    assert (W.window_at(sums, at, at + 13) == W.window_at(again, at + 2, at + 15)).all()
