"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list fixes for every prefix of a piece the *last* token of that prefix's encoding: it is the one vocabulary
entry that ends there, starts where another prefix ends, and forms a stable pair with that prefix's last token (their
bytes together encode to just these two tokens). An automaton over the vocabulary's bytes names the longest entry that ends
at each byte, a link from each entry the next shorter one. Whether a pair is stable is read off the merges that made its
tokens, undone from the latest on: it is, unless at some time a merge across the boundary came first.

No token is longer than ``lookahead`` bytes, so whatever follows, the final encoding passes through a boundary among the
last ``lookahead`` positions. Once the chains of last tokens that start at those positions meet in one boundary, everything
before it is stable and is emitted; only the last tokens behind it are kept.

Decoding runs the ids' bytes through an incremental UTF-8 state machine that holds at most three pending bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from windrow.llm.common import batches, strings, table

#: Fixed value: the published pattern that splits text before byte-level merges.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Bytes, about, that the remembered encodings of pieces take in either of two generations; a full one becomes the older.
PIECE_MEMORY = 20_000_000
#: Token pairs of which a worker remembers whether they are stable.
PAIR_MEMORY = 50_000
#: Pieces of at most so many bytes go through the automaton together, at most so many at once.
SHORT, TOGETHER = 32, 20_000
#: Pieces of a text that are joined at once.
AT_ONCE = 50_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def understood(spec: dict) -> None:
    """Raises ValueError for a vocabulary with settings that Codec does not carry out."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE":
        odd.append("model type")
    if spec.get("normalizer"):
        odd.append("normalizer")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        odd.append("pre_tokenizer")
    if after.get("type") != "ByteLevel":
        odd.append("decoder")
    odd += [f"added token {x['content']!r}" for x in spec.get("added_tokens", []) if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]
    if odd:
        raise ValueError(f"the vocabulary asks for more than byte-level merges: {', '.join(odd)}")


class Codec:
    """A vocabulary with its merge list. encode() and decode() are exact inverses on valid text.

    Beside the vocabulary itself it holds a bounded memory, whatever it encodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        understood(spec)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in vocabulary.items() if t not in self.added}
        if lacking := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"the vocabulary has no token for the bytes {lacking}")
        self.size = size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.lengths = [len(x) for x in self.bytes]
        #: The sufficient lookahead in bytes.
        self.lookahead = max(map(len, self.ids))
        self._read_merges([self.ids[raw(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge)] for merge in spec["model"]["merges"])
        del spec, vocabulary  # before the automaton is built, which takes their place in memory
        self._build_automaton()
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _read_merges(self, merges: Iterable[list[int]]) -> None:
        """ranks of pairs (left * size + right), made by rank; for each token the merge that makes it, and its parts.

        ordered: every token is made by one merge, after those that make its parts. Merges then happen in their order.
        """
        self.ranks: dict[int, int] = {}
        self.made, self.ordered = array("i"), True
        self.rank, self.left, self.right = (array("i", [-1]) * self.size for _ in range(3))
        for rank, (a, b) in enumerate(merges):
            token = self.ids[self.bytes[a] + self.bytes[b]]
            self.made.append(token)
            if self.ranks.setdefault(a * self.size + b, rank) == rank:
                parts_first = all(self.rank[x] >= 0 or self.lengths[x] == 1 for x in (a, b))
                self.ordered = self.ordered and self.rank[token] < 0 and parts_first
                self.rank[token], self.left[token], self.right[token] = rank, a, b

    def _build_automaton(self) -> None:
        """edges (node << 8 | byte) of the prefixes of tokens, fallback to a node's longest suffix, longest token that ends there.

        Only tokens to which their own bytes encode are in it: no encoding has others. shorter leads to a token's next suffix.
        """
        edges: dict[int, int] = {}
        depths, parents, ends, fallback, longest = array("i", [0]), array("i", [0]), array("B", [0]), array("i", [0]), array("i", [-1])
        for token, i in self.ids.items():
            if self._whole(i):
                node = 0
                for depth, byte in enumerate(token, 1):
                    key = node << 8 | byte
                    to = edges.get(key)
                    if to is None:
                        to = edges[key] = len(parents)
                        for column, x in ((depths, depth), (parents, node), (ends, byte), (fallback, 0), (longest, -1)):
                            column.append(x)
                    node = to
                longest[node] = i
        self.shorter = array("i", [-1]) * self.size
        for node in np.argsort(np.array(depths), kind="stable").tolist():
            if depths[node] > 1:
                back, byte = fallback[parents[node]], ends[node]
                while (to := edges.get(back << 8 | byte)) is None:
                    back = fallback[back]
                fallback[node] = to
                if longest[node] >= 0:
                    self.shorter[longest[node]] = longest[to]
                else:
                    longest[node] = longest[to]
        self.edges, self.fallback, self.longest = edges, fallback, longest
        self.tables = Tables(self)

    def _merged(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left. For a pair's few bytes only."""
        tokens = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(tokens) > 1:
            pairs = (a * self.size + b for a, b in zip(tokens, tokens[1:]))
            best = min(((self.ranks[p], i) for i, p in enumerate(pairs) if p in self.ranks), default=None)
            if best is None:
                break
            rank, i = best
            tokens[i : i + 2] = [self.made[rank]]
        return tokens

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if self.lengths[token] == 1:
            return True
        if not self.ordered:
            return self._merged(self.bytes[token]) == [token]
        a, b, rank = self.left[token], self.right[token], self.rank[token]
        return rank >= 0 and self._whole(a) and self._whole(b) and self._apart(a, b, rank)

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge before `limit` takes bytes of both tokens, neighbours whose own bytes encode to them.

        Goes back in time: the later of both tokens' merges is undone, of one and the same merge the right one (the left
        happens first); a merge across then must not be due before it.
        """
        ranks, rank, size = self.ranks, self.rank, self.size
        while ranks.get(a * size + b, limit) >= limit:
            x, y = rank[a], rank[b]
            if x > y:
                limit, a = x, self.right[a]
            elif y >= 0:
                limit, b = y + 1, self.left[b]
            else:
                return True
        return False

    def _stable(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens together encode to just these two."""
        if len(self.pairs) >= PAIR_MEMORY:
            self.pairs.clear()
        known = self._apart(a, b, len(self.made)) if self.ordered else self._merged(self.bytes[a] + self.bytes[b]) == [a, b]
        self.pairs[a * self.size + b] = known
        return known

    def _extend(self, last: list[int], node: int, data: bytes) -> int:
        """Appends to last the tokens that end the encodings up to each further byte; the automaton goes on from node."""
        edges, pairs = self.edges.get, self.pairs.get
        fallback, longest, shorter, lengths, size = self.fallback, self.longest, self.shorter, self.lengths, self.size
        for p, byte in enumerate(data, len(last)):
            while (to := edges(node << 8 | byte)) is None:
                node = fallback[node]
            node = to
            token = longest[node]
            while token >= 0:
                start = p - lengths[token]
                if start >= 0:
                    previous = last[start]
                    if previous < 0:
                        break
                    known = pairs(previous * size + token)
                    if known or known is None and self._stable(previous, token):
                        break
                token = shorter[token]
            else:
                raise ValueError("no token of the vocabulary can end here")
            last.append(token)
        return node

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that arrives in chunks, each emitted as soon as it is stable."""
        # last[p]: the token that ends p bytes behind the last boundary that is settled; last[0]: at it, -1 at the piece's start
        last, node = [-1], 0
        for chunk in chunks:
            for start in range(0, len(chunk), 256):
                node = self._extend(last, node, chunk[start : start + 256])
                if len(last) > 2 * self.lookahead:
                    settled = self._settled(self.lengths, last, self.lookahead)
                    if settled:
                        yield from self._path(last, settled)
                        last = last[settled:]
        yield from self._path(last, len(last) - 1)

    def _settled(self, lengths: list[int], last: list[int], lookahead: int) -> int:
        """The last boundary that every chain from the final lookahead positions passes through."""
        at = set(range(max(1, len(last) - lookahead), len(last)))
        while len(at) > 1:
            p = max(at)
            at.discard(p)
            at.add(p - lengths[last[p]])
        return at.pop()

    def _path(self, last: list[int], p: int) -> list[int]:
        ids, lengths = [], self.lengths
        while p > 0:
            ids.append(token := last[p])
            p -= lengths[token]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        """A piece's ids, packed as little-endian unsigned 32-bit integers."""
        packed = self.older.get(piece)
        if packed is None:
            ids = list(self.transduce([piece.encode()]))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self._remember(piece, packed)
        return packed

    def _remember(self, piece: str, packed: bytes) -> None:
        if self.held >= PIECE_MEMORY:
            self.older, self.memory, self.held = self.memory, {}, 0
        self.memory[piece] = packed
        self.held += 200 + 2 * len(piece) + len(packed)

    def split(self, texts: list[str]) -> list[list[str] | None]:
        """The texts' pieces, for encode(); None for long texts and those with added tokens.

        Short pieces that are not remembered are encoded together first, and remembered.
        """
        out = [None if len(t) > 1_000_000 or self.special and self.special.search(t) else PIECES.findall(t) for t in texts]
        if self.ordered:
            memory, older = self.memory, self.older
            new = {x for pieces in out if pieces for x in pieces if x not in memory and x not in older and len(x) <= SHORT}
            data = sorted(((y, x) for x in new if len(y := x.encode()) <= SHORT), key=lambda pair: len(pair[0]), reverse=True)
            for at in range(0, len(data), TOGETHER):
                some = data[at : at + TOGETHER]
                for (_, piece), packed in zip(some, self._together([y for y, _ in some])):
                    self._remember(piece, packed)
        return out

    def _together(self, pieces: list[bytes]) -> Iterator[bytes]:
        """What transduce() gives for every piece, packed; pieces of falling lengths, all one byte further at a time."""
        tables = self.tables
        sizes = np.array([len(x) for x in pieces])
        most, n = int(sizes[0]), len(pieces)
        text = np.frombuffer(b"".join([x.ljust(most) for x in pieces]), np.uint8).reshape(n, most).T
        last, every, node = np.full((most + 1, n), -1, np.int32), np.arange(n), np.zeros(n, np.int64)
        for p in range(1, most + 1):
            going = int(np.searchsorted(-sizes, -p, "right"))
            node = tables.step(node[:going], text[p - 1, :going].astype(np.int64))
            at, token = every[:going], tables.longest[node]
            while len(at):
                if token.min() < 0:
                    raise ValueError("no token of the vocabulary can end here")
                previous = last[p - tables.lengths[token], at]
                good = previous < 0
                inner = np.flatnonzero(~good)
                good[inner] = tables.apart(previous[inner], token[inner])
                last[p, at[good]] = token[good]
                at, token = at[~good], tables.shorter[token[~good]]
        ids, counts, at, p = np.zeros((n, most), "<u4"), np.zeros(n, np.int64), every, sizes.copy()
        while len(at):
            token = last[p, at]
            counts[at] += 1
            ids[at, most - counts[at]] = token
            p = p - tables.lengths[token]
            at, p = at[p > 0], p[p > 0]
        packed, row = ids.tobytes(), 4 * most
        for end, count in zip(range(row, n * row + 1, row), counts.tolist()):
            yield packed[end - 4 * count : end]

    def encode(self, text: str, pieces: list[str] | None = None) -> Iterator[bytes]:
        """The text's packed ids, in blocks of a bounded number of pieces; pieces: what split() gave for it."""
        if pieces is not None:
            yield self._joined(pieces)
            return
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, m.start())
            yield self.added[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        text = text if (start, end) == (0, len(text)) else text[start:end]
        if len(text) <= 1_000_000:
            blocks: Iterable[list[str]] = [PIECES.findall(text)]
        else:
            found = (m[0] for m in PIECES.finditer(text))
            blocks = iter(lambda: list(islice(found, AT_ONCE)), [])
        for block in blocks:
            yield self._joined(block)

    def _joined(self, pieces: list[str]) -> bytes:
        get, piece = self.memory.get, self._piece
        return b"".join([get(x) or piece(x) for x in pieces])

    def decoder(self) -> Decoder:
        return Decoder(self.bytes)

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids, block by block."""
        machine = self.decoder()
        for block in blocks:
            yield machine.feed(block)
        yield machine.feed(b"", True)


class Known:
    """Values of non-negative 64-bit keys, looked up by arrays of keys."""

    def __init__(self, values: dict[int, int]):
        keys, held = np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), np.int32, len(values))
        bits = (2 * len(keys) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = held[placed]
            keys, held, at = keys[~placed], held[~placed], at[~placed] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for those without."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class Tables:
    """A codec's automaton and merges for many pieces at once."""

    def __init__(self, own: Codec):
        self.edges, self.ranks, self.size, self.merges = Known(own.edges), Known(own.ranks), own.size, len(own.made)
        self.fallback, self.longest, self.shorter, self.rank, self.left, self.right = (np.array(x, np.int32) for x in (own.fallback, own.longest, own.shorter, own.rank, own.left, own.right))
        self.lengths = np.array(own.lengths, np.int32)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's nodes one byte further."""
        out = self.edges.find(node << 8 | byte).astype(np.int64)
        rest = np.flatnonzero(out < 0)
        back = node[rest]
        while len(rest):
            back = self.fallback[back].astype(np.int64)
            to = self.edges.find(back << 8 | byte[rest])
            out[rest] = to
            rest, back = rest[to < 0], back[to < 0]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codec._apart() of pairs of tokens, without a limit."""
        out, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), self.merges)
        while len(at):
            due = self.ranks.find(a.astype(np.int64) * self.size + b)
            across = (due >= 0) & (due < limit)
            out[at[across]] = False
            x, y = self.rank[a], self.rank[b]
            more = ~across & ((x >= 0) | (y >= 0))
            at, a, b, x, y = at[more], a[more], b[more], x[more], y[more]
            left = x > y
            a, b, limit = np.where(left, self.right[a], a), np.where(left, b, self.left[b]), np.where(left, x, y + 1)
        return out


class Decoder:
    """The byte-to-text state machine: bytes of an unfinished character, three at most, wait for the next block."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.machine = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, block: bytes, end: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.tokens.__getitem__, np.frombuffer(block, "<u4").tolist())), end)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def digested(own: Codec, text: str, pieces: list[str] | None = None) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them), block by block in constant memory."""
    ids, decoded, machine, n = hashlib.sha256(), hashlib.sha256(), own.decoder(), 0
    for block in own.encode(text, pieces):
        n += len(block) // 4
        ids.update(block)
        decoded.update(machine.feed(block).encode())
    decoded.update(machine.feed(b"", True).encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_documents(documents: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """One row a document: the columns of `keep`, then n_tokens and either (ids, decoded) or their SHA-256 digests.

    Null texts are empty texts: no ids. Every row, repeated ones too, yields its own row; an empty table yields none.
    Columns other than `keep` and text are not read, so extra ones with any name do no harm. The texts stay where they
    are read: nothing is shuffled. Long texts are encoded and decoded block by block.
    """
    path = vocabulary or default_vocabulary()
    fields = {f.name: f for f in documents.schema.fields}
    plain = documents.select(*keep, "text")
    out = "n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    schema = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in keep), out])
    kind = pa.string() if digests else pa.list_(pa.int32())
    names = [*keep, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(it, rows=256, chars=300_000):
            counts, ids, texts = [], [], []
            whole = strings(batch.column(len(keep)))
            for text, pieces in zip(whole, own.split(whole)):
                if digests:
                    n, a, b = digested(own, text, pieces)
                else:
                    packed = b"".join(own.encode(text, pieces))
                    n, a, b = len(packed) // 4, np.frombuffer(packed, "<i4"), "".join(own.decode([packed]))
                counts.append(n)
                ids.append(a)
                texts.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(texts, pa.string())], names)

    return plain.mapInArrow(run, schema)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
