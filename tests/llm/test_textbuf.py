import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from spanloom.llm.textbuf import Packed, Table, buffers, identify, ranges, sequence_hash, slices, windows, words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b😀\x85", max_size=30)), max_size=8)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    got = []
    for lo, hi, buf, offs in slices(pa.array(texts, pa.string()), 16):
        s, e, first = words(buf, offs)
        raw = buf.tobytes()
        for i in range(hi - lo):
            got.append([raw[a:b].decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_slices_of_a_sliced_column():
    a = pa.array(["x", "yy", None, "zzz"])
    buf, offs = buffers(a.slice(1))
    assert buf.tobytes() == b"yyzzz" and offs.tolist() == [0, 2, 2, 5]
    assert list(slices(pa.array([], pa.string()))) == []


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def twins(n):
    """Two different texts of n letters that a polynomial hash modulo 2**64 can't tell apart."""
    return thue_morse(n), thue_morse(n, "b", "a")


def test_spans_are_equal_by_content_alone():
    text = b"abcabcXabc" + b"y" * 17 + b"Z" + b"y" * 17 + b"\0" + b"abc\0"
    at = [(0, 3), (3, 6), (7, 10), (1, 3), (10, 27), (28, 45), (28, 44), (46, 49), (46, 50), (45, 46), (5, 5)]
    p = Packed.of(np.frombuffer(text, np.uint8), *(np.array(x) for x in zip(*at)))
    number = p.numbers().tolist()
    for i, (a, b) in enumerate(at):
        for j, (c, d) in enumerate(at):
            assert (number[i] == number[j]) == (text[a:b] == text[c:d])


def test_different_items_of_one_hash_get_different_numbers():
    x = np.array([3, 1, 3, 2, 1, 1, 3, 9])
    got = identify(np.array([0, 0, 0, 0, 0, 0, 0, 1], np.uint64), lambda i, j: x[i] == x[j])
    assert all((got[i] == got[j]) == (x[i] == x[j]) for i in range(8) for j in range(8))
    assert identify(np.zeros(0, np.uint64), None).tolist() == []


def test_windows_are_compared_by_words():
    word, row = np.array([1, 2, 3, 1, 2, 3, 1, 2]), np.array([0, 0, 0, 0, 0, 0, 1, 1])
    at, number = windows(word, row, 2, np.zeros(8, np.uint64))
    assert at.tolist() == [0, 1, 2, 3, 4, 6]
    assert [(number[i] == number[j]) for i, j in ((0, 3), (0, 5), (1, 4), (0, 1), (2, 0))] == [True, True, True, False, False]
    assert len(windows(word[:1], row[:1], 2)[0]) == 0


def test_sequence_hash_and_ranges():
    x = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    h = sequence_hash(x, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3 and len(sequence_hash(x, 9)) == 0
    assert ranges(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]


def test_table_finds_what_was_added():
    r = np.random.default_rng(0)
    t, seen = Table(4), {}
    for k in range(30):
        lo = np.unique(r.integers(0, 500, 40).astype(np.uint64))
        p = Packed(np.full(len(lo), 8 + k % 2), lo, lo % np.uint64(3))
        p.hash = p.hash & np.uint64(3)  # few hashes for many spans
        new = np.flatnonzero(t.find(p) < 0)
        q = p.take(new)
        q.hash = p.hash[new]
        grown = t.bits
        for i, v in zip(new.tolist(), t.add(q).tolist()):
            seen[k % 2, int(lo[i])] = v
        if t.bits != grown:  # the table makes hashes anew
            t, seen = Table(12), {}
            continue
        assert t.find(p).tolist() == [seen[k % 2, x] for x in lo.tolist()]
    t = Table(4)
    many = Packed.of(np.arange(200, dtype=np.uint8), np.arange(190), np.arange(190) + 3)
    t.add(many.take(np.arange(100)))
    t.add(many.take(np.arange(100, 190)))
    assert t.find(many).tolist() == list(range(190)) and t.find(Packed(np.array([3]), np.zeros(1, np.uint64), np.zeros(1, np.uint64))).tolist() == [-1]
