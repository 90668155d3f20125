"""Byte-pair encoding and decoding by speculation and verification.

For the words of a block of texts that are not yet known:

1. greedy longest match over the vocabulary proposes tokens;
2. every adjacent pair of proposed tokens is tested, all pairs of the block at once: two tokens are compatible if no
   merge across their border would have run before the merges that made them. A proposal of which all pairs are
   compatible is the encoding;
3. the words of failing proposals, and only those, are merged exactly, lowest rank and leftmost first.

All three run over arrays: the proposals walk a trie from all bytes at once, and a step of the merging does one merge in each
word. Words of over `LONG` bytes are jumped through and merged one by one.

The vocabulary is a tokenizers file: byte-level BPE with an end-of-word suffix, whose words come from its own normaliser and
pattern. Texts with characters below U+0300 only are split here by the same rules; for others the file's own normaliser
and splitter are called. Strings of special tokens in a text give their ids, as in the library.

Cases: NULL and empty texts have no tokens; words of any length are merged in n log n steps; repeated rows are encoded
alike; an empty table gives no rows; a NULL doc_id is carried; further columns are ignored. Each worker keeps at most
`KNOWN` words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from splitclock.llm.common import column, table, texts

KNOWN = 400_000
BLOCK = 1 << 21
#: Longer words, in bytes, are not rows of a matrix.
LONG = 64
NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PairTable:
    """A number for each of some pairs of numbers, looked up for whole arrays: a hash table with linear probing."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray):
        keys, bits = a << 32 | b, max(4, (8 * len(a)).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] < 0]
            self._keys[slot[free]] = keys[free]
            left = left[self._keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & self._last
        self._values[slot] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of the pairs; `NONE` for others."""
        keys = a << 32 | b
        slot = self._slot(keys)
        found = self._keys[slot]
        out = self._values[slot]
        other = np.flatnonzero(found != keys)
        out[other] = NONE
        other = other[found[other] >= 0]
        while len(other):
            slot[other] = slot[other] + 1 & self._last
            found = self._keys[slot[other]]
            same = found == keys[other]
            out[other[same]] = self._values[slot[other[same]]]
            other = other[~same & (found >= 0)]
        return out


class Vocabulary:
    """Tokens, merges and their look-up tables."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [""] * size
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, k in model["vocab"].items():
            self.strings[k] = token
            ends = bool(suffix) and token.endswith(suffix)
            raw = bytes(to_byte[c] for c in (token[: -len(suffix)] if ends else token))
            (self.final if ends else self.inner)[raw] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.strings[k] = content
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([model["vocab"][a] for a, _ in pairs], np.int64)
        right = np.array([model["vocab"][b] for _, b in pairs], np.int64)
        made = np.array([model["vocab"][a + b] for a, b in pairs], np.int64)
        self.merges = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(left, right, made, strict=True))}
        self.pairs, self.made = PairTable(left, right, np.arange(len(made))), made
        # How a token was made: its rank (-1: a byte) and its two parts.
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        # Tokens that merging their own bytes does not give are never proposed.
        sound = np.ones(size, bool)
        sound[made] = self.compatible(left, right, top=False)
        for words in (self.inner, self.final):
            for raw in [w for w, k in words.items() if not sound[k]]:
                if len(raw) > 1:
                    del words[raw]
        self.byte_inner = [self.inner[bytes([b])] for b in range(256)]
        self.byte_final = [self.final[bytes([b])] for b in range(256)] if suffix else self.byte_inner
        if not suffix:
            self.final = self.inner
        # A trie of all tokens, the root's children first; of each node the token inside a word and at its end.
        nodes = {b: b + 1 for b in range(256)}
        ends: list[dict[int, int]] = [{}, {}]
        for own, words in zip(ends, (self.inner, self.final), strict=True):
            for raw, k in words.items():
                node = 0
                for b in raw:
                    node = nodes.setdefault(node << 8 | b, len(nodes) + 1)
                own[node] = k
        keys = np.fromiter(nodes, np.int64, len(nodes))
        self.trie = PairTable(keys >> 8, keys & 0xFF, np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.token_inner, self.token_final = np.full((2, len(nodes) + 1), -1, np.int64)
        for tokens, own in zip((self.token_inner, self.token_final), ends, strict=True):
            tokens[[*own]] = [*own.values()]

    def compatible(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """Whether two neighbouring tokens stay apart. ``top=False`` lets the pair itself merge at the end.

        Going back in time, the younger of the two border tokens is taken apart until both are bytes. A merge across
        the border would have run if its rank is below that of the merge that took one of its sides away; at equal rank
        the left one of two overlapping merges runs first.
        """
        a, b = a.copy(), b.copy()
        apart = np.ones(len(a), bool)
        limit = np.full(len(a), NONE, np.int64)
        live = np.arange(len(a))
        first = not top
        while len(live):
            x, y = a[live], b[live]
            if not first:
                crossing = self.pairs.get(x, y) < limit[live]
                apart[live[crossing]] = False
                live, x, y = live[~crossing], x[~crossing], y[~crossing]
            first = False
            rx, ry = self.rank[x], self.rank[y]
            go_left = rx > ry
            limit[live] = np.where(go_left, rx, ry + 1)
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_left, y, self.left[y])
            live = live[np.maximum(rx, ry) >= 0]
        return apart

    def proposals(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, tokens per word) by greedy longest match. The bytes of the words lie one after another."""
        stop = np.repeat(stops, stops - starts)
        token, step = np.empty(len(data), np.int64), np.ones(len(data), np.int64)
        at, node, depth = np.arange(len(data)), data + 1, 1
        while len(at):  # from every byte on; a longer token takes the place of a shorter one
            last = stop[at] == at + depth
            found = np.where(last, self.token_final[node], self.token_inner[node])
            hit = found >= 0
            token[at[hit]], step[at[hit]] = found[hit], depth
            at, node = at[~last], node[~last]
            node = self.trie.get(node, data[at + depth])
            at, node = at[node != NONE], node[node != NONE].astype(np.int64)
            depth += 1
        chosen = np.zeros(len(data), bool)
        long = stops - starts > LONG
        at = starts[~long]
        while len(at):
            chosen[at] = True
            after = at + step[at]
            at = after[after < stop[at]]
        for first, end in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            steps, k, places = step[first:end].tolist(), 0, []
            while k < len(steps):
                places.append(k)
                k += steps[k]
            chosen[first + np.array(places)] = True
        return token[chosen], np.add.reduceat(chosen, starts, dtype=np.int64)

    def proposal(self, word: bytes) -> list[int]:
        """Tokens of one word by greedy longest match."""
        data = np.frombuffer(word, np.uint8).astype(np.int64)
        return self.proposals(data, np.array([0]), np.array([len(word)]))[0].tolist()

    def merged(self, word: bytes) -> list[int]:
        """Tokens of one word by exact merging."""
        ids = [self.byte_inner[b] for b in word]
        ids[-1] = self.byte_final[word[-1]]
        return self._merged_long(ids)

    def merged_rows(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, tokens per word) by exact merging: one merge a word and step, of the least rank, leftmost
        first. A word is a row of a matrix between two columns of a token that merges with nothing."""
        width, no_token = int(counts.max()) + 2, len(self.strings)
        column = np.arange(width - 2)
        inside = column < counts[:, None]
        ids = np.full((len(starts), width), no_token, np.int64)
        raw = data[np.where(inside, starts[:, None] + column, 0)]
        ids[:, 1:-1] = np.where(inside, np.array(self.byte_inner)[raw], no_token)
        row = np.arange(len(starts))
        ids[row, counts] = np.array(self.byte_final)[raw[row, counts - 1]]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(starts), -1)
        flat, flat_ranks = ids.reshape(-1), ranks.reshape(-1)
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        while True:
            at = row * width + ranks[row].argmin(axis=1)
            rank = flat_ranks[at]
            going = rank != NONE
            if not going.all():
                row, at, rank = row[going], at[going], rank[going]
            if not len(row):
                break
            made, gone, left = self.made[rank], after[at], before[at]
            right = after[gone]
            flat[at], flat[gone], flat_ranks[gone] = made, no_token, NONE
            after[at], before[right] = right, at
            new = self.pairs.get(np.concatenate([made, flat[left]]), np.concatenate([flat[right], made]))
            flat_ranks[at], flat_ranks[left] = new[: len(at)], new[len(at) :]
        kept = ids != no_token
        return ids[kept], kept.sum(axis=1)

    def _merged_long(self, ids: list[int]) -> list[int]:
        """A heap of (rank, place) over a linked list."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = get((ids[i], ids[i + 1]))
            if m is not None:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                m = get((made, ids[after[j]]))
                if m is not None:
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[after[j]]))
            if before[i] >= 0:
                m = get((ids[before[i]], made))
                if m is not None:
                    heapq.heappush(heap, (m[0], before[i], m[1], ids[before[i]], made))
        return [k for k in ids if k >= 0]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids as little-endian unsigned 32-bit integers."""
        words = list(words)
        if not words:
            return iter(())
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        tokens, counts = self.proposals(data, starts, starts + sizes)
        owner = np.repeat(np.arange(len(words)), counts)
        border = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, which = np.unique(tokens[border] << 32 | tokens[border + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        wrong = np.zeros(len(words), bool)
        wrong[owner[border[~good[which]]]] = True
        ids = _pieces(tokens, counts)
        least = 0
        for most in (8, 16, 32, LONG):  # rows of about one width
            own = np.flatnonzero(wrong & (sizes > least) & (sizes <= most))
            if len(own):
                for i, x in zip(own.tolist(), _pieces(*self.merged_rows(data, starts[own], sizes[own])), strict=True):
                    ids[i] = x
            least = most
        for i in np.flatnonzero(wrong & (sizes > LONG)).tolist():
            ids[i] = np.array(self.merged(raw[i]), "<u4").tobytes()
        return zip(words, ids, strict=True)


def _pieces(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The tokens of each word as little-endian unsigned 32-bit integers."""
    data, ends = tokens.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _word_pattern(limit: int) -> re.Pattern:
    """The file's pattern over the characters below ``limit``, classes written out, the most frequent one first."""
    chars = [chr(c) for c in range(limit)]
    letters = re.escape("".join(c for c in chars if unicodedata.category(c)[0] == "L"))
    digits = re.escape("".join(c for c in chars if unicodedata.category(c)[0] == "N"))
    blanks = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^{re.escape(blanks)}{letters}{digits}]+")


#: The pattern of the vocabulary file that `_word_pattern` writes out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Texts to ids, with the words seen so far."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._ascii, self._latin = _word_pattern(0x80), _word_pattern(0x300)
        self._beyond = re.compile("[̀-\U0010ffff]")
        self._library = None
        with open(path, encoding="utf-8") as f:
            self._plain = json.dumps(SPLIT) in f.read()
        self._bytes = {c: b for b, c in enumerate(byte_characters())}

    def words(self, text: str) -> list[str]:
        if self._plain and text.isascii():
            return self._ascii.findall(text.lower())
        if self._plain and not self._beyond.search(text):
            return self._latin.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.vocabulary.path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in p).decode() for p, _ in pieces]

    def encode(self, block: list[str]) -> Iterator[bytes]:
        """The ids of each text of a block, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN:  # words that are met again come back from the older ones
            self.known, self.older = {}, self.known
        special = self.vocabulary.special
        split: list[list[tuple[int, list[str]]]] = []
        new: set[str] = set()
        for text in block:
            parts = []
            pieces = self.vocabulary.special_pattern.split(text) if special and any(s in text for s in special) else [text]
            for k, piece in enumerate(pieces):
                if k % 2:
                    parts.append((special[piece], []))
                elif piece:
                    words = self.words(piece)
                    new.update(words)
                    parts.append((-1, words))
            split.append(parts)
        new = new.difference(self.known)  # as long as the new ones, not as the known ones
        if new and self.older:
            again = new & self.older.keys()
            self.known.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self.known.update(self.vocabulary.encode_words(new))
        known = self.known.__getitem__
        for parts in split:
            yield b"".join(b"".join(map(known, words)) if k < 0 else int(k).to_bytes(4, "little") for k, words in parts)

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives for a file without a decoder: the tokens, one blank apart."""
        return " ".join(map(self.vocabulary.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def encoded_blocks(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, bytes]]:
    """(row of the batch, ids) in order, a block of about `BLOCK` characters at a time."""
    enc, block, start, size = encoder(path), [], 0, 0
    for i, text in enumerate(texts(batch)):
        block.append(text)
        size += len(text)
        if size >= BLOCK:
            yield from enumerate(enc.encode(block), start)
            block, start, size = [], i + 1, 0
    if block:
        yield from enumerate(enc.encode(block), start)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary): the ids of every text, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x for _, x in encoded_blocks(batch, path)]
            yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = encoder(path)
            counts, ids_sha, text_sha = [], [], []
            for _, ids in encoded_blocks(batch, path):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_vocabulary())
