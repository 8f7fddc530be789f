"""Token ids of whole texts by a byte-level vocabulary of the tokenizers library, with distinct words encoded once per worker.

``byte_bpe_50k.json`` normalises nothing and merges within the words of its own pattern only, so the ids of a text are
the ids of its words (with the space before them) end to end. The words of plain Latin texts are cut by array
operations and known by a 64-bit hash and their length; words that a worker has not met go to the library's BPE model
together. Texts with other characters, or with what may be a special token, go to the library as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import regex

from .common import mix, powers

#: The word pattern of byte-level vocabularies (letters and numbers are Unicode's), and its contractions.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Printable ASCII, space, tab, line ends, Latin-1 and Latin Extended-A.
PLAIN = r"[ -~\t\n\r¡-¬®-ſ]*+"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The kind of each plain character.
KINDS = np.array([SPACE if chr(c).isspace() else LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER for c in range(0x180)], np.uint8)


def word_starts(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of plain texts begin: code points end to end, and where each text begins."""
    if not len(chars):
        return np.empty(0, np.int64)
    kind = KINDS[chars]
    space = kind == SPACE
    head = np.zeros(len(chars) + 1, bool)
    head[bounds] = True
    starts = head[:-1].copy()
    starts[1:] |= (kind[1:] != kind[:-1]) & (chars[:-1] != 32)  # a single space belongs to what follows
    starts[1:] |= space[1:] & ~space[:-1]
    starts[:-1] |= space[:-1] & ~space[1:] & ~head[1:-1]  # the last of several spaces
    for p in _apostrophes(chars, kind, head):
        for tail in CONTRACTIONS:
            end = p + 1 + len(tail)
            if end <= len(chars) and not head[p + 1 : end].any() and all(chars[p + 1 + k] == ord(x) for k, x in enumerate(tail)):
                starts[p + 1] = False
                if end < len(chars):
                    starts[end] = True
                break
    return np.flatnonzero(starts)


def _apostrophes(chars: np.ndarray, kind: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Apostrophes that begin a word and stand before a letter."""
    at = np.flatnonzero(chars == 39)
    at = at[at + 1 < len(chars)]
    at = at[kind[at + 1] == LETTER]
    before = np.maximum(at - 1, 0)
    return at[head[at] | (kind[before] != OTHER) & (chars[before] != 32)]


class ByteEncoder:
    """Encodes texts to arrays of ids; holds about ``keep`` words: hashes in order, and where their ids are."""

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary_size = self.whole.get_vocab_size(with_added_tokens=True)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = [""] * 256  # a byte's character in the vocabulary
        for b in printable:
            self.letters[b] = chr(b)
        for i, b in enumerate(others):
            self.letters[b] = chr(256 + i)
        self.stop = self.letters[10]
        self.stop_id = self.whole.get_vocab()[self.stop]
        self.plain, self.keep = regex.compile(PLAIN), keep
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has. White space goes alone: a line end marks where a word stops."""
        letters = self.letters
        blank = [k for k, x in enumerate(words) if x.isspace()]
        solid = [x for x in words if not x.isspace()]
        spelled = [(letters[32] + x[1:] if x[0] == " " else x) if x.isascii() else "".join([letters[b] for b in x.encode()]) for x in solid]
        ids = np.array(self.pieces.encode_batch_fast([f" {self.stop} ".join([*spelled, ""])], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.stop_id)
        if len(ends) != len(solid):
            raise ValueError("the vocabulary merges across words")
        sizes = np.diff(ends, prepend=-1) - 1
        own = np.split(ids, ends + 1)[:-1] if blank else None
        ids = ids[ids != self.stop_id]
        if blank:
            each, rest = [], iter(own)
            for x in words:
                each.append(self.alone(x) if x.isspace() else next(rest)[:-1])
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids, sizes

    def _known(self, hashes: np.ndarray, words) -> np.ndarray:
        """Places of distinct, ordered hashes in the cache; ``words`` gives the words of those that are new."""
        at = np.searchsorted(self.hashes, hashes)
        new = at == len(self.hashes)
        new[~new] = self.hashes[at[~new]] != hashes[~new]
        if new.any():
            if len(self.hashes) > self.keep:
                self._forget()
                at, new = np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
            ids, sizes = self._encode_words(words(np.flatnonzero(new)))
            begin = len(self.pool) + np.append(0, np.cumsum(sizes)[:-1])
            self.pool = np.concatenate([self.pool, ids])
            self.hashes, self.first, self.size = (np.insert(old, at[new], fresh) for old, fresh in ((self.hashes, hashes[new]), (self.first, begin), (self.size, sizes)))
            at = np.searchsorted(self.hashes, hashes)
        return at

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum([len(x) for x in texts]))
        starts = word_starts(chars, bounds[bounds < len(chars)])
        if not len(starts):
            return [np.empty(0, np.uint32) for _ in texts]
        lengths = np.diff(starts, append=len(chars))
        within = np.arange(len(chars)) - np.repeat(starts, lengths)
        hashed = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within], starts)
        hashed = mix(hashed ^ (lengths.astype(np.uint64) << np.uint64(48)))
        distinct, example, number = np.unique(hashed, return_index=True, return_inverse=True)
        at = self._known(distinct, lambda new: [joined[a : a + n] for a, n in zip(starts[example[new]].tolist(), lengths[example[new]].tolist())])
        first, size = self.first[at][number], self.size[at][number]
        upto = np.append(0, np.cumsum(size))
        ids = self.pool[np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)]
        cuts = upto[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [("<|" not in x) and self.plain.fullmatch(x) is not None for x in texts]
        own = iter(self._plain([x for x, p in zip(texts, plain) if p]))
        return [next(own) if p else self.alone(x) for x, p in zip(texts, plain)]


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def byte_encoded(path: str, texts: Iterable[str | None], step: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of every text; null is empty. About ``step`` characters are encoded at once."""
    own = byte_encoder(path)
    held: list[str] = []
    size = first = at = 0
    for at, text in enumerate(texts, 1):
        held.append(text or "")
        size += len(held[-1])
        if size >= step:
            yield from enumerate(own.encode(held), first)
            held, size, first = [], 0, at
    if held:
        yield from enumerate(own.encode(held), first)
