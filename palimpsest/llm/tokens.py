"""Token ids of texts by a public BPE vocabulary, one dictionary look-up per repeated word.

The vocabulary's pre-tokenizer never joins text across white space, so a text's
ids are its words' ids in order. Words repeat; each worker keeps the ids of
those it has met in a bounded table. Words of printable ASCII and Latin letters
are cut into pre-tokens here and merged by the library's BPE model; every other
word, and every text that spells a special token, goes through the library's
whole encoder.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: A worker forgets its words, and their pieces, beyond so many and starts afresh.
MOST_WORDS, MOST_PIECES = 800_000, 400_000

# The vocabulary's pre-token pattern, for lower-case ASCII and Latin letters.
_LETTERS = "a-z\xdf-\xf6\xf8-\xffĀ-įı-ſ"
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\x20]+|\x20")
#: Words, parted by blanks, with a character beyond printable ASCII and Latin letters.
_ODD = re.compile(r"[^\x20]*[^\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ſ][^\x20]*")


def _byte_letters() -> list[str]:
    """The visible character that byte-level BPE writes for each byte."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class _Store(dict):
    """Number of each key met so far, with its ids in one flat array; number 0 has none."""

    def __init__(self, spell=None):
        super().__init__()
        self.spell = spell
        self.flat, self.starts = array("I"), array("q", [0, 0])

    def __missing__(self, key) -> int:
        return self.add(key, self.spell(key))

    def add(self, key, ids: list[int]) -> int:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        code = self[key] = len(self.starts) - 2
        return code

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``codes`` one after the other, and how many each has."""
        starts = np.frombuffer(self.starts, np.int64)
        first = starts[codes]
        lengths = starts[codes + 1] - first
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        return flat[places], lengths  # the views go with this call: an array with a view on it cannot grow


class WordEncoder:
    """Encodes texts with ``path``'s vocabulary, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words, self.pieces = _Store(), self._no_pieces()

    def _no_pieces(self) -> _Store:
        store = _Store(self._piece)
        store[" "] = 0
        return store

    def _piece(self, piece: str) -> list[int]:
        spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(spelled)]

    def _whole(self, text: bytes) -> list[int]:
        return self.whole.encode(text.decode(), add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words together: one pattern finds all their pieces, one gather joins the pieces' ids."""
        joined = b" ".join(words).decode()
        odd = {w.encode() for w in _ODD.findall(joined)}
        if odd:
            for word in odd:
                self.words.add(word, self._whole(word))
            words = [w for w in words if w not in odd]
            joined = b" ".join(words).decode()
        if not words:
            return
        if len(self.pieces) > MOST_PIECES:
            self.pieces = self._no_pieces()
        found = _PRE_TOKENS.findall(joined.lower())
        codes = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        ids, lengths = self.pieces.gather(codes)
        per_word = np.bincount(np.cumsum(codes == 0), weights=lengths, minlength=len(words)).astype(np.int64)
        store, base, at = self.words, len(self.words.starts) - 1, len(self.words.flat)
        store.flat.frombytes(ids.tobytes())
        store.starts.frombytes((at + np.cumsum(per_word)).tobytes())
        store.update(zip(words, range(base, base + len(words))))

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text as unsigned 32-bit numbers."""
        return self.encode_many([text.encode()])[0]

    def encode_many(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 ``texts`` one after the other, each followed by ``end_id`` if given, and where each text's ids end.

        One look-up per word and one gather for all texts together. ``bytes.split``
        parts words at ASCII white space alone, as the vocabulary's pre-tokenizer does.
        """
        if len(self.words) > MOST_WORDS:
            self.words = _Store()
        words: list = []
        ends = np.zeros(len(texts), np.int64)
        end = (end_id,)
        for k, text in enumerate(texts):
            if any(s in text for s in self.specials):  # one word to the table, encoded whole
                words.append((text,))
                if words[-1] not in self.words:
                    self.words.add(words[-1], self._whole(text))
            else:
                words += text.split()
            if end_id is not None:
                words.append(end)
            ends[k] = len(words)
        new = set(words).difference(self.words)
        if end in new:
            new.remove(end)
            self.words.add(end, [end_id])
        if new:
            self._learn(list(new))
        codes = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ids, lengths = self.words.gather(codes)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[ends]


#: Bytes of text encoded in one go, beyond one text.
TOGETHER = 1 << 20


def encoded(texts, tokens: WordEncoder, end_id: int | None = None):
    """(first text's number, ids, ends) for stretches of the Arrow column ``texts``; null counts as empty."""
    held: list[bytes] = []
    first, size = 0, 0
    for k, text in enumerate(texts):
        value = text.as_buffer().to_pybytes() if text.is_valid else b""
        held.append(value)
        size += len(value)
        if size >= TOGETHER:
            yield first, *tokens.encode_many(held, end_id)
            held, first, size = [], k + 1, 0
    if held:
        yield first, *tokens.encode_many(held, end_id)


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """This worker's encoder; ``vocabulary`` is a path, or a file name of the public tokenizers."""
    if vocabulary not in _encoders:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _encoders[vocabulary] = WordEncoder(path)
    return _encoders[vocabulary]
