import hashlib
import json
import random

import numpy as np
import pytest

from windrow.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    return bpe.codec(path), tokenizers.Tokenizer.from_file(path)


def check(both, text):
    own, other = both
    packed = list(own.encode(text))
    want = other.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(packed), "<u4").tolist() == want
    assert "".join(own.decode(packed)) == other.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "it's we'll I'VE", "<|endoftext|>a<|endoftext|><|endoftext|>", " \x1c\x1d a\x85b c　", "\r\n\r\n\t\t x", "½²Ⅷ٣ 日本語 👩‍👩‍👧‍👦", "\x00﻿"])
def test_against_the_library(both, text):
    check(both, text)


def test_random_texts(both):
    rng = random.Random(1)
    for _ in range(600):
        check(both, "".join(rng.choice("ab c'stre\n\t 12é日👩_-=. ") for _ in range(rng.randint(0, 60))))
        check(both, "".join(rng.choice("etaoin") for _ in range(rng.randint(0, 80))))


def test_long_pieces_need_bounded_memory(both):
    rng = random.Random(2)
    for text in ("a" * 5000, " " * 4000, "=-" * 2000, "".join(rng.choice("etaoinsh") for _ in range(6000))):
        check(both, text)
    own = both[0]
    held = 0
    last = own._settled

    def watched(window, positions, before):
        nonlocal held
        held = max(held, len(positions))
        return last(window, positions, before)

    own._settled = watched
    try:
        list(own.transduce([("".join(rng.choice("etaoinsh") for _ in range(100))).encode() for _ in range(200)]))
    finally:
        del own._settled
    assert held < 4 * own.lookahead + 256


def test_chunks_do_not_matter(both):
    own = both[0]
    data = ("internationalisation" * 30).encode()
    assert list(own.transduce([data])) == list(own.transduce([data[i : i + 7] for i in range(0, len(data), 7)]))


def test_rows(spark, clashing, none):
    rows = bpe.encode_documents(clashing, digests=True).collect()
    assert len(rows) == clashing.count()
    first = {r.doc_id: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert (first[1].n_tokens, first[1].ids_sha256, first[1].decoded_sha256) == (0, empty, empty) == (first[2].n_tokens, first[2].ids_sha256, first[2].decoded_sha256)
    texts = {r.doc_id: r.text for r in clashing.collect()}
    for r in bpe.encode_documents(clashing).collect():
        if r.doc_id is not None:
            assert r.decoded == (texts[r.doc_id] or "")
    assert bpe.encode_documents(none).collect() == []


def invented(seed, n, most=30):
    rng = random.Random(seed)
    return list({" " * rng.randint(0, 1) + "".join(rng.choice(("th", "ing", "er", "on", "q", "é", "日", "9", "_", "👩")) for _ in range(rng.randint(1, most))) for _ in range(n)})


def test_stable_pairs_by_merges_undone(both):
    own, rng = both[0], random.Random(4)
    assert own.ordered
    tokens = [i for i in own.ids.values() if own._whole(i)]
    assert all(own._whole(i) == (own._merged(own.bytes[i]) == [i]) for i in rng.sample(sorted(own.ids.values()), 3000))
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    runs = [own.ids[x * n] for x in (b" ", b"=", b"-", b"a") for n in range(1, 9) if x * n in own.ids]
    pairs += [(a, b) for a in runs for b in runs]
    for token in rng.sample(tokens, 1000):  # neighbours that would rather merge
        data = own.bytes[token]
        pairs += [(own.ids[data[:k]], own.ids[data[k:]]) for k in range(1, len(data)) if data[:k] in own.ids and data[k:] in own.ids]
    pairs = [(a, b) for a, b in pairs if own._whole(a) and own._whole(b)]
    want = [own._merged(own.bytes[a] + own.bytes[b]) == [a, b] for a, b in pairs]
    assert [own._apart(a, b, len(own.made)) for a, b in pairs] == want == own.tables.apart(*np.array(pairs).T).tolist()
    assert 0.05 < np.mean(want) < 0.95


def test_pieces_together_as_one_by_one(both):
    own, other = both
    pieces = sorted((x.encode() for x in invented(5, 4000) if len(x.encode()) <= bpe.SHORT), key=len, reverse=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in own._together(pieces)] == [list(own.transduce([x])) for x in pieces]
    texts = ["", "<|endoftext|>a", "x" * 300, *(" ".join(invented(s, 40)) for s in range(6, 30))]
    for text, pieces in zip(texts, own.split(texts)):
        assert np.frombuffer(b"".join(own.encode(text, pieces)), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_memory_that_is_full_loses_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_MEMORY", 5000)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    own, other = bpe.Codec(bpe.default_vocabulary()), tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    texts = [" ".join(invented(s, 60, 8)) for s in range(4)]
    for text, pieces in zip(texts, own.split(texts)):
        assert np.frombuffer(b"".join(own.encode(text, pieces)), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_merges_out_of_order(both, tmp_path):
    spec = json.loads(open(bpe.default_vocabulary(), encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][:3000][::-1]
    (path := tmp_path / "odd.json").write_text(json.dumps(spec))
    own = bpe.Codec(str(path))
    assert not own.ordered
    token = next(i for i in own.ids.values() if len(own.bytes[i]) == 2 and own._whole(i))
    assert own._merged(own.bytes[token]) == [token] and own._stable(token, token) == (own._merged(2 * own.bytes[token]) == [token, token])
    assert own.split(["a b", "<|endoftext|>"]) == [["a", " b"], None]


def test_unknown_pieces_go_through_the_automaton_together(both, monkeypatch):
    """A text of unknown words asks for no token byte by byte and for no pair's own encoding."""
    own = bpe.Codec(bpe.default_vocabulary())
    asked = []
    for name in ("transduce", "_merged"):
        monkeypatch.setattr(own, name, lambda *a, name=name: asked.append(name))
    texts = [" ".join(invented(s, 50, 8)) for s in range(40, 44)]
    list(own.split(texts))
    assert len(own.memory) > 100 and asked == []
