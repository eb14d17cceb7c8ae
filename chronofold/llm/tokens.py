"""Token ids of whole texts, word by word with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Words that a Python worker remembers before it forgets all of them: about 90 MB.
WORDS_HELD = 400_000
#: Words that are encoded as one text.
JOINED = 256
#: Marks that end a plain word: with it they are two pieces for the tokenizer, whatever their number.
MARKS = ".,!?;:*$&#%"
#: Words that normalisation leaves as they are.
LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: 1 for an ASCII letter, 2 for a mark.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KINDS[list(MARKS.encode())] = 2


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, fewer different ones than stand there: ASCII letters are small, and a mark after an ASCII
    letter begins a word. The tokenizer does both itself, so the ids are those of the text.

    A text keeps its capitals if it may hold a special token, whose letters count as they are, or a combining mark
    (U+0300 to U+037F), which may be one sign with a small letter and not with the capital.
    """
    texts = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    kinds = _KINDS[data]
    marks = np.flatnonzero((kinds[1:] == 2) & (kinds[:-1] == 1)) + 1
    spaced = np.insert(data, marks, 32).tobytes()
    bounds = np.cumsum([0, *map(len, texts)])
    bounds = (bounds + np.searchsorted(marks, bounds)).tolist()  # a blank between two texts does no harm in either
    return [spaced[a:b].split() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class _Numbers(dict):
    """Words to numbers; a new word gets the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes texts with a tokenizer whose words never cross white space, so each word has the same ids anywhere.

    That holds for word_bpe_49k.json: white space is dropped, and neither its normalisation nor its merges cross it.
    Its pieces end with a token that ends in ``</w>``, by which the ids of joined words are told apart again.
    When there are too many words, those that have come up again are kept, half of WORDS_HELD at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for words that need no normalisation
        self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(1 << 20, "<u4")
        self.starts, self.lengths, self.seen = (np.zeros(1 << 18, np.int64) for _ in range(3))
        self.used = 0

    def _forget(self) -> None:
        words, seen = list(self.numbers), self.seen[: len(self.numbers)]
        kept = np.flatnonzero(seen > 1)
        kept = kept[np.argsort(-seen[kept], kind="stable")[: WORDS_HELD // 2]]
        lengths, seen = self.lengths[kept], seen[kept] // 2
        ids = self.flat[ragged(self.starts[kept], lengths)]
        self._clear()
        for k in kept.tolist():
            self.numbers[words[k]] = len(self.numbers)
        self._remember(0, lengths, ids)
        self.seen[: len(kept)] = seen

    def _remember(self, first: int, lengths: np.ndarray, ids: np.ndarray) -> None:
        last = first + len(lengths)
        while last > len(self.starts):
            self.starts, self.lengths, self.seen = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.lengths[first:last] = lengths
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, words: list[bytes]) -> None:
        first = len(self.numbers) - len(words)
        texts = b" ".join(words).decode().split(" ")
        # pieces of each plain word; 0 for one that has to be encoded by itself
        pieces = [1 if t.isalpha() else 2 * t.rstrip(MARKS).isalpha() for t in texts]
        latin = [bool(LATIN(t)) for t in texts]
        groups = []
        for encoder, some in ((self.plain, True), (self.tokenizer, False)):
            plain = [i for i, n in enumerate(pieces) if n and latin[i] == some]
            groups.append((encoder, [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]))
        alone = [i for i, n in enumerate(pieces) if not n]
        found: list[np.ndarray] = []
        lengths = np.zeros(len(words), np.int64)
        order: list[int] = []
        for encoder, parts in groups:
            joined = encoder.encode_batch_fast([" ".join([texts[i] for i in g]) for g in parts], add_special_tokens=False)
            for g, e in zip(parts, joined, strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.ends[ids]) + 1
                upto = np.cumsum([pieces[i] for i in g])
                if len(ends) != upto[-1]:  # a letter that lower case makes two signs of
                    alone += g
                    continue
                lengths[g] = np.diff(ends[upto - 1], prepend=0)
                found.append(ids)
                order += g
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            lengths[i] = len(e.ids)
            found.append(np.array(e.ids, "<u4"))
            order.append(i)
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        at = np.zeros(len(words), np.int64)  # from the order of encoding to that of the words
        at[order] = np.cumsum(lengths[order]) - lengths[order]
        self._remember(first, lengths, ids[ragged(at, lengths)])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8) as unsigned 32-bit numbers, without special tokens."""
        if len(self.numbers) > WORDS_HELD:
            self._forget()
        words = words_of(texts)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        self.seen[: len(self.numbers)] += np.bincount(numbers, minlength=len(self.numbers))
        lengths = self.lengths[numbers]
        flat = self.flat[ragged(self.starts[numbers], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]
        return np.split(flat, ends[:-1]) if len(texts) else []


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its memory of words lives on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    """The place of a public vocabulary file, looked up on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
