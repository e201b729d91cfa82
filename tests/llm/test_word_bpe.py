import random
import sys
import hashlib

import odd
import pytest
from tokenizers import Tokenizer

from panelforge.llm import word_bpe
from panelforge.llm.tables import vocabulary


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def wanted(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digits = " ".join(map(str, ids))
        out.append(
            (
                i,
                len(ids),
                hashlib.sha256(digits.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )
        )
    return odd.ordered(out)


def test_odd_documents(docs, library):
    got = [tuple(r) for r in word_bpe.round_trip(docs).collect()]
    assert odd.ordered(got) == wanted(library, odd.texts())


def test_corpus(small, library):
    got = [tuple(r) for r in word_bpe.round_trip(small[0]).collect()]
    assert odd.ordered(got) == wanted(library, small[1])


def test_encode_and_decode(docs, library):
    encoded = word_bpe.encode(docs)
    decoded = word_bpe.decode(encoded)
    texts = odd.texts()
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in texts]
    assert odd.ordered((r[0], list(r[1])) for r in encoded.collect()) == odd.ordered(ids)
    back = [(i, library.decode(x, skip_special_tokens=False)) for i, x in ids]
    assert odd.ordered(tuple(r) for r in decoded.collect()) == odd.ordered(back)


def test_empty_table(no_docs):
    assert word_bpe.round_trip(no_docs).collect() == []


def test_long_words_by_scan_and_queue(monkeypatch):
    words = ["internationalization" * 3, "ab" * 25, "x" * 60, "éé" * 12]
    bpe = word_bpe.WordBpe(vocabulary())
    scanned = bpe._encode_words(words)
    monkeypatch.setattr(word_bpe, "SHORT", 0)
    assert bpe._encode_words(words) == scanned


def test_cache_in_two_generations():
    made = []

    def make(keys):
        made.extend(keys)
        return [2 * k for k in keys]

    known = word_bpe.Known(make, 3 * (word_bpe.PIECE_BYTES + 3))
    for keys in ([b"1", b"2", b"3", b"4"], [b"1", b"5"], [b"1", b"6", b"7", b"8"], [b"9", b"5"]):
        assert known.values_of(keys) == [2 * k for k in keys]
    assert made.count(b"1") == 1
    assert len(known) <= 6


def test_cache_is_bounded_by_bytes():
    """Many long pieces without white space, as in Chinese or Japanese lines and base64."""
    known = word_bpe.known_digits.__wrapped__(vocabulary())
    draw = random.Random(6)
    most = 0
    for _ in range(40):
        pieces = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(n)).encode()
                  for n in (5, 12, 20, 60, 3000) for _ in range(60)]
        assert len(known.values_of(pieces)) == len(pieces)
        assert all(len(key) <= word_bpe.LONGEST_KEPT for key in known)
        held = sum(sys.getsizeof(k) + sum(map(sys.getsizeof, v)) for k, v in known.items())
        most = max(most, held)
        assert held <= 1.2 * known.bytes
    small = word_bpe.Known(known._make, most // 8)
    for _ in range(20):
        small.values_of([f"{draw.random()}".encode() for _ in range(500)])
        assert small.bytes <= most // 8 + 500 * 800
