"""Byte-level BPE vocabularies inside a task: distinct words are encoded once per worker and remembered.

The files' paths are parameters; nothing is copied. Both encoders take whole pre-tokens as bytes.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa

from placewise.llm import arrays

#: A worker forgets its words beyond this many, which bounds its memory; the ids stay the same.
REMEMBERED_WORDS = 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def _visible() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one above 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, free = [], 0x100
    for byte in range(256):
        table.append(chr(byte if byte in shown else free))
        free += byte not in shown
    return table


class LibraryWords:
    """Words by the model of a `tokenizers` file whose splitting is the byte-level pattern, and its added tokens.

    Added tokens are cut out of a text first, as the library does: leftmost, of those the longest, and those that match
    normalised text after the others. A file with tokens that take in blanks or match whole words only is refused. Without
    `special`, strings of special tokens are plain text.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.table = dict(enumerate(_visible()))
        tokens = {i: t for i, t in self.whole.get_added_tokens_decoder().items() if t.content and (special or not t.special)}
        if odd := [t.content for t in tokens.values() if t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"added tokens of {path} strip blanks or match whole words only: {odd}")
        self.added = {t.content.encode(): i for i, t in tokens.items()}
        self.size = max(self.whole.get_vocab_size(), *(i + 1 for i in tokens), 0)
        contents = [sorted((t.content.encode() for t in tokens.values() if t.normalized == late), key=len, reverse=True) for late in (False, True)]
        self.patterns = [re.compile(b"|".join(map(re.escape, c))) for c in contents if c]

    def __call__(self, word: bytes) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.table))]

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start, byte end and text of every word; an added token is one, and the text on each side is split on its own."""
        raw = data.tobytes()
        edges, begins = bounds, np.zeros(0, np.int64)
        for pattern in self.patterns:
            if not pattern.search(raw):
                continue
            taken = set(begins.tolist())
            parts = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if a not in taken]
            found = np.array([m.span() for a, b in parts for m in pattern.finditer(raw, a, b)], np.int64).reshape(-1, 2)
            edges = np.unique(np.concatenate([edges, found.ravel()]))
            begins = np.concatenate([begins, found[:, 0]])
        if not len(begins):
            return arrays.pretokens(data, bounds)
        starts, ends, part = arrays.pretokens(data, edges)
        whole = np.isin(edges[:-1], begins)[part]
        kept = ~whole | (starts == edges[part])
        starts, ends = starts[kept], np.where(whole, edges[part + 1], ends)[kept]
        return starts, ends, arrays.owner(starts, bounds)

    def lengths(self) -> np.ndarray:
        """Bytes of every id."""
        return np.array([len(t) for t in self.tokens()], np.int64)

    def tokens(self) -> list[bytes]:
        """Bytes of every id; none of an entry that is no byte-level spelling."""
        value = {shown: bytes([byte]) for byte, shown in enumerate(_visible())}
        tokens = [b""] * self.size
        for token, number in self.model_vocab():
            if set(token) <= value.keys():
                tokens[number] = b"".join(map(value.__getitem__, token))
        for content, number in self.added.items():
            tokens[number] = content
        return tokens

    def model_vocab(self) -> list[tuple[str, int]]:
        return list(self.whole.get_vocab(with_added_tokens=False).items())


class PieceWords:
    """Words by a `sentencepiece` file, of texts that begin with the blank that the library puts in front of them.

    A word is a run of blanks with what follows up to the next blank. Pieces never hold a blank behind another sign (a file
    where they do is refused), so no merge reaches from one word into the next. The sign U+2581 itself, which the library
    takes for a blank, is not one here: texts that hold it may be cut otherwise.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if odd := [p for p in self.pieces if "\u2581" in p.lstrip("\u2581")]:
            raise ValueError(f"pieces of {path} hold blanks inside: {odd[:5]}")

    def __call__(self, word: bytes) -> list[int]:
        # the library puts the first blank there again, except before nothing
        return self.model.encode(word[1:].decode("utf-8"), num_threads=1) if len(word) > 1 else [self.model.piece_to_id("\u2581")]

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begins = data == 0x20
        begins[1:] &= ~begins[:-1]
        begins |= arrays.marked(bounds, len(data))
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(data))[: len(starts)], arrays.owner(starts, bounds)

    def tokens(self) -> list[bytes]:
        """Bytes of every id."""
        one = re.compile("<0x([0-9A-F]{2})>")
        return [bytes.fromhex(m[1]) if (m := one.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in self.pieces]


class RankWords:
    """Words by the ranks of a `tiktoken` file, without special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def __call__(self, word: bytes) -> list[int]:
        number = self.ranks.get(word)
        return [number] if number is not None else self.encoding.encode_ordinary(word.decode("utf-8"))

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return arrays.pretokens(data, bounds)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


@functools.lru_cache(maxsize=4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table of a rank file: all bytes end to end, start and length of each id."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    return _table(tokens)


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


class Memory:
    """Encodes whole texts: splits a batch, looks distinct words up and encodes those not seen before."""

    def __init__(self, encode):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        # hashes of the words in ascending order and the place of each: 16 bytes a word, where a dictionary takes over 100
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int64)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        starts, ends, text = self.encode.words(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        codes, distinct, first = arrays.numbered(arrays.hashes(data, starts, ends))
        if len(self.keys) + len(distinct) > REMEMBERED_WORDS:
            self.forget()
        slot = np.searchsorted(self.keys, distinct)
        place = np.full(len(distinct), -1, np.int64)
        seen = np.flatnonzero(slot < len(self.keys))
        seen = seen[self.keys[slot[seen]] == distinct[seen]]
        place[seen] = self.places[slot[seen]]
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            found = [self.encode(raw[s:e]) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            place[new] = np.arange(len(self.lengths), len(self.lengths) + len(new))
            order = new[np.argsort(distinct[new])]
            self.keys, self.places = np.insert(self.keys, slot[order], distinct[order]), np.insert(self.places, slot[order], place[order])
            self.lengths = np.concatenate([self.lengths, np.array([len(x) for x in found], np.int64)])
            self.flat = np.concatenate([self.flat, np.array([i for x in found for i in x], np.int32)])
        begins = np.cumsum(self.lengths) - self.lengths
        at = place[codes]
        many = self.lengths[at]
        return arrays.gathered(self.flat, begins[at], many), np.bincount(text, many, minlength=len(bounds) - 1).astype(np.int64)


@functools.lru_cache(maxsize=4)
def memory(kind: str, path: str) -> Memory:
    """One memory for each worker process and file."""
    kinds = {"tokenizers": LibraryWords, "plain tokenizers": functools.partial(LibraryWords, special=False), "pieces": PieceWords, "ranks": RankWords}
    return Memory(kinds[kind](path))


@functools.lru_cache(maxsize=4)
def token_bytes(kind: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, start and length of each id."""
    return _table(memory(kind, path).encode.tokens())


def encoded(kind: str, path: str, column: pa.Array):
    """(first row, lengths, ids, data, bounds) of consecutive slices of a text column."""
    texts = arrays.strings(column)
    for at, rows in arrays.pieces(texts, arrays.PIECE_BYTES // 4):  # splitting takes some hundred bytes for each of a text
        data, bounds = arrays.laid_out(texts.slice(at, rows))
        ids, lengths = memory(kind, path).ids(data, bounds)
        yield at, lengths, ids, data, bounds
