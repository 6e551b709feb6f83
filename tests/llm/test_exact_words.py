"""Words that share a hash are different words; near copies of one id; items that share a short text."""

import numpy as np
import pyarrow as pa
import xxhash

from foliospark.llm import decontaminate as D
from foliospark.llm import quality as Q
from foliospark.llm import words as W
from foliospark.llm.simhash import fingerprint, near_dedup

#: Two words with the same XXH64 under seed 1.
PAIR = ("basewordendingxx", "rbjn32qrm1j1ci09")


def buffers(*texts):
    return W.text_buffers(pa.array(texts, pa.large_string()))


def test_words_that_share_a_hash_have_numbers_of_their_own():
    assert xxhash.xxh64_intdigest(PAIR[0], 1) == xxhash.xxh64_intdigest(PAIR[1], 1)
    long = "x" * 90
    data, offsets = buffers(" ".join([*PAIR, "a", PAIR[1], "", long, "a", PAIR[0], long + "y", long]))
    words = W.find_words(data, offsets)
    number = W.exact_numbers(data, words.start, words.end, words.hashes[1])
    spelled = [data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    assert len(set(number.tolist())) == len(set(spelled)) == len(set(zip(number.tolist(), spelled, strict=True)))
    shared = W.exact_numbers(data, words.start, words.end, np.zeros(len(words.start), dtype=np.uint64))
    assert len(set(shared.tolist())) == len(set(zip(shared.tolist(), spelled, strict=True))) == len(set(spelled))


def test_a_benchmark_word_is_hit_by_its_own_bytes_only(spark):
    docs = spark.createDataFrame([(1, PAIR[1]), (2, PAIR[0].upper()), (3, " ".join(PAIR)), (4, None)], "doc_id long, text string")
    for items, want in (([("i", PAIR[0])], [0, 1, 1, 0]), ([("i", PAIR[0]), ("j", PAIR[1])], [1, 1, 2, 0])):
        bench = spark.createDataFrame(items, "item_id string, text string")
        got = {r["doc_id"]: r for r in D.decontaminate(docs, bench).collect()}
        assert [got[k]["n_hit"] for k in (1, 2, 3, 4)] == want and [got[k]["n_items"] for k in (1, 2, 3, 4)] == want


def test_items_that_share_a_short_text_are_named_once_a_text():
    phrases = D.Phrases.of([(f"i{k:03d}", "yes") for k in range(300)])
    data, offsets = buffers("yes " * 50_000, "no", "Yes")
    words, hit, items = D._scan(phrases, data, offsets)
    assert hit.tolist() == [True] * 50_000 + [False, True]
    assert [len(x) for x in items] == [300, 0, 300]


def test_lines_and_windows_repeat_by_their_bytes():
    a, b = PAIR
    texts = [f"{a}\n{b}\n{a}", f"{a} p q {b} p q", f"{a} p q {a} p q", f"{a}\n{a}", f"{b}\n", ""]
    counts, *_ = Q.measure(*buffers(*texts))
    assert counts["n_dup_lines"].tolist() == [1, 0, 0, 1, 0, 0]
    assert counts["n_repeat_words"].tolist() == [0, 0, 6, 0, 0, 0]


def test_byte_counts_do_not_depend_on_pieces(monkeypatch):
    texts = ["Ab# c1.\n\nüß 22 <x>!\nAb# c1.", "", "  ", "é" * 40 + "\n" + "é" * 40]
    want = Q.measure(*buffers(*texts))
    monkeypatch.setattr(Q, "PIECE", 7)
    got = Q.measure(*buffers(*texts))
    assert all((want[0][k] == got[0][k]).all() for k in want[0]) and (want[2] == got[2]).all()


def test_fingerprints_of_many_pieces_count_every_shingle():
    words = [f"w{k * k % 7919}" for k in range(140_000)]
    votes = np.zeros(64, dtype=int)
    for k in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42)
        votes += np.array([h >> b & 1 for b in range(64)])
    assert fingerprint(" ".join(words).encode()) == sum(1 << b for b in range(64) if votes[b] * 2 > len(words) - 3)


def test_near_copies_of_one_id_leave_one_text(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text + " "), (2, text), (3, "alone here"), (3, "quite another text of the same id"), (None, text), (4, "twice"), (4, "twice")]
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"].strip())) for r in kept) == [(0, len(text)), (1, len(text)), (3, 10), (3, 33), (4, 5), (4, 5)]


def test_results_do_not_depend_on_pieces(monkeypatch):
    from foliospark.llm import simhash as S

    texts = ["", "  ", "a", "a b c", "a b c d", "A b c d e\n f", " a  b c d e f g h a b c d e ", "long" * 9 + " x " + "y" * 30 + " z a b c d a b c d", "é " * 20]
    fps, (want, _, bins, _) = [S.fingerprint(t.encode()) for t in texts], Q.measure(*buffers(*texts))
    assert want["n_repeat_words"].tolist() == [0, 0, 0, 0, 0, 0, 10, 8, 20]
    for size in (1, 3, 10):
        monkeypatch.setattr(S, "PIECE", size)
        monkeypatch.setattr(Q, "PIECE", size)
        got, _, again, _ = Q.measure(*buffers(*texts))
        assert [S.fingerprint(t.encode()) for t in texts] == fps
        assert all((want[k] == got[k]).all() for k in want) and (bins == again).all()
