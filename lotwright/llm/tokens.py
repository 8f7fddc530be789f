"""Token ids of whole texts by the tokenizers library, with distinct words encoded once per worker.

``word_bpe_49k.json`` drops white space and merges within the words of its own pattern only, so the ids of a
text are the ids of its words end to end. The words of plain Latin texts are cut by array operations and known by a 64-bit
hash and their length; words that a worker has not met go to the library's BPE model together. Texts with other
characters, or with what may be a special token, go to the full tokenizer (normaliser included) as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import regex

from .byte_tokens import CONTRACTIONS, KINDS, LETTER, NUMBER, OTHER, SPACE, ByteEncoder
from .common import mix, powers

#: The word pattern of the vocabulary file, letters and numbers being those of Unicode.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose normalisation is lower-casing alone: printable ASCII, space, line end, Latin-1 and Latin Extended-A but U+0130.
PLAIN = r"[ -~\n¡-¬®-įı-ſ]*+"


def word_starts(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character of lower-cased plain texts: code points end to end, and where each text begins."""
    kind = KINDS[chars]
    head = np.zeros(len(chars) + 1, bool)
    head[bounds] = True
    starts = head[:-1] | (kind == NUMBER)
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= kind != SPACE
    at = np.flatnonzero((chars[:-1] == 39) & (kind[1:] == LETTER))
    for p in at[head[at] | (kind[np.maximum(at - 1, 0)] != OTHER)]:
        for tail in CONTRACTIONS:
            end = p + 1 + len(tail)
            if end <= len(chars) and not head[p + 1 : end].any() and all(chars[p + 1 + k] == ord(x) for k, x in enumerate(tail)):
                starts[p + 1] = False
                if end < len(chars) and kind[end] != SPACE:
                    starts[end] = True
                break
    return starts


class Encoder(ByteEncoder):
    """Encodes texts to bytes of little-endian unsigned 32-bit ids; holds about ``keep`` words: hashes in order, and where their ids are."""

    def __init__(self, path: str, keep: int = 1_000_000):
        super().__init__(path, keep)
        vocabulary = self.whole.get_vocab()
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.last = np.zeros(self.vocabulary_size, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.plain = regex.compile(PLAIN)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has."""
        letters = self.letters
        spelled = [x if x.isascii() else "".join([letters[b] for b in x.encode()]) for x in words]
        ids = np.array(self.pieces.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary has words without an end token")
        return ids, np.diff(ends, prepend=0)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts."""
        joined = "".join(texts).lower()
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum([len(x) for x in texts]))
        starts = word_starts(chars, bounds[bounds < len(chars)])
        first = np.flatnonzero(starts)
        if not len(first):
            return [np.empty(0, np.uint32) for _ in texts]
        solid = KINDS[chars] != SPACE  # words hold no space, so their characters are neighbours without it
        bare = chars[solid]
        begin = np.flatnonzero(starts[solid])
        lengths = np.diff(begin, append=len(bare))
        within = np.arange(len(bare)) - np.repeat(begin, lengths)
        hashed = np.add.reduceat((bare.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within], begin)
        hashed = mix(hashed ^ (lengths.astype(np.uint64) << np.uint64(48)))
        distinct, example, number = np.unique(hashed, return_index=True, return_inverse=True)
        at = self._known(distinct, lambda new: [joined[a : a + n] for a, n in zip(first[example[new]].tolist(), lengths[example[new]].tolist())])
        start, size = self.first[at][number], self.size[at][number]
        upto = np.append(0, np.cumsum(size))
        ids = self.pool[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)]
        cuts = upto[np.searchsorted(first, bounds)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x.astype("<u4", copy=False).tobytes() for x in super().encode(texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(path: str, texts: Iterable[str | None], step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(position, ids as bytes) of every text; null is empty. About ``step`` characters are encoded at once."""
    own = encoder(path)
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
