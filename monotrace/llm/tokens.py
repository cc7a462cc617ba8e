"""Token ids of a `tokenizers` file, kept per word.

BPE merges never cross a border that the file's own pre-tokenizer draws, so the ids of a text are
those of its words, one after the other. Each Python worker keeps the ids of words it has met and
asks the library only for new ones; texts that do not split safely, or that hold one of the file's added
tokens (<|endoftext|> and the like, which the library reads as that token), go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words whose ids a Python worker keeps (about 150 bytes each): half of them in use, and the half before, of which those met again are kept on.
KEPT_WORDS = 800_000

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WHITE = re.compile(r"\s")
_WORD_AND_MARKS = re.compile(r"(\n?[^\W\d_]+)([!-/:-@\[-`{-~]+)")


class OddWord(Exception):
    """A word whose ids hang on the white space around it."""


class WordIds(dict):
    """Word -> its ids as little-endian uint32 bytes.

    In a byte-level file a key stands for the word with the space before it, and a key that starts
    with a line feed for line feed and word.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Whether added tokens within texts are plain text.
        self.whole.encode_special_tokens = plain
        #: Texts that hold an added token as it is written go to the library whole; of one that is matched after normalizing, in any case of letters.
        added = self.whole.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.added_in_any_case = [t.content.lower() for t in added if t.normalized]
        kind = type(self.whole.pre_tokenizer).__name__
        #: "byte": a word's ids hold the space before it; "word": white space leaves no ids; "text": no known word border.
        self.kind = {"ByteLevel": "byte", "Sequence": "word"}.get(kind, "text")
        if self.kind == "word" and self.ids(" a  b\n") != self.ids("a b"):
            self.kind = "text"
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a single piece, as the pre-tokenizer cuts them, by the file's model alone."""
        got = self.pieces.get(text)
        if got is None:
            got = self.new_piece(text)
            if len(text) < 16:
                self.pieces[text] = got
        return got

    def new_piece(self, text: str) -> bytes:
        if text.isascii() and text[1:].isalpha():
            # of ASCII's printable bytes, the space alone has another letter in the file
            plain = text.replace(" ", "\u0120", 1)
        else:
            plain = (text if text.isascii() else text.encode().decode("latin-1")).translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def learned(self, word: str) -> bytes:
        if self.kind == "word":
            if word.isalpha() and max(word) < "\u0130":
                small = word.lower()
                return self[small] if small != word else self.new_piece(word)
            if (m := _WORD_AND_MARKS.fullmatch(word)) and m[1].isalpha() and max(word) < "\u0130" and "'" not in word:
                return self[m[1].lower()] + self.piece(m[2])
            return self.ids(word)
        if self.kind == "byte":
            if word.isalpha():
                return self.new_piece(f" {word}")
            if (m := _WORD_AND_MARKS.fullmatch(word)) and m[1].lstrip("\n").isalpha() and m[2][0] != "'":
                return (self[m[1]] if word[0] != "\n" else self.piece("\n") + self.piece(m[1][1:])) + self.piece(m[2])
            if word[:1] == "\n" and word[1:].isalpha():
                return self.piece("\n") + self.piece(word[1:])
            if not word or word == "\n" or _WHITE.search(word, word[0] == "\n"):
                raise OddWord
            return self.ids(word if word[0] == "\n" else f" {word}")
        return self.ids(word)

    def __missing__(self, word: str) -> bytes:
        if len(self) + len(self.pieces) > KEPT_WORDS // 2:
            self.before = dict(self)
            self.clear()
            self.pieces.clear()
        got = self.before.get(word)
        if got is None:
            got = self.learned(word)
        if len(word) < 32:
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian uint32 bytes."""
        get = self.__getitem__
        if any(t in text for t in self.added) or self.added_in_any_case and any(t in text.lower() for t in self.added_in_any_case):
            return self.ids(text)
        if self.kind == "word":
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if self.kind == "text" or not text:
            return self.ids(text)
        first, _, rest = text.replace("\n", " \n").partition(" ")
        try:
            return self.ids(first) + b"".join(map(get, rest.split(" "))) if rest else self.ids(text)
        except OddWord:
            first, *others = _LONE_SPACE.split(text)
            return self.ids(first) + b"".join([self.ids(f" {w}") if _WHITE.search(w) else get(w) for w in others])


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE files use for each byte: itself where printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b if b in printable else next(free)) for b in range(256)}


class PieceIds(dict):
    """Word -> its ids in a `sentencepiece` file, as little-endian uint32 bytes; keys are those of WordIds.

    A word stands for itself and the space before it, which the file marks in its pieces. No piece of such a file holds that mark after another
    character, nor a line feed, or the texts go to the library whole; so do texts with two spaces in a row.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.whole = SentencePieceProcessor(model_file=path)
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        self.by_words = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces) and self.ids("\na b")[4:] == self.ids("\na")[4:] + self.ids("b")
        self.before: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, num_threads=1)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEPT_WORDS // 4:
            self.before = dict(self)
            self.clear()
        got = self.before.get(word)
        if got is None:
            # before a line feed the library puts a space that is none of the text's
            got = self.ids(word) if word[:1] != "\n" else self.ids(word)[4:]
        if len(word) < 32:
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " \n").split(" ")
        return b"".join(map(self.__getitem__, words)) if self.by_words and all(words) else self.ids(text)


#: What stands for a space in pieces.
SPACE = "\u2581"


@functools.lru_cache(maxsize=3)
def word_ids(path: str, plain: bool = False) -> WordIds:
    """One store a file and Python worker."""
    return WordIds(path, plain)


@functools.lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """One store a file and Python worker."""
    return PieceIds(path)


@functools.lru_cache(maxsize=2)
def bytes_of_ids(path: str) -> tuple[bytes, np.ndarray]:
    """What each id of a tokenizer file stands for: all bytes one after the other, and where each id's begin (and the last end). Unknown and control ids stand for nothing."""
    if path.endswith(".model"):
        file = piece_ids(path).whole
        told = [b"" if file.is_control(i) or file.is_unknown(i) else bytes([int(file.id_to_piece(i)[3:5], 16)]) if file.is_byte(i) else file.id_to_piece(i).replace(SPACE, " ").encode() for i in range(file.get_piece_size())]
    else:
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = {i: t for t, i in word_ids(path, True).whole.get_vocab(with_added_tokens=True).items()}
        told = [bytes(letters[c] for c in vocabulary[i]) if i in vocabulary and all(c in letters for c in vocabulary[i]) else b"" for i in range(max(vocabulary) + 1)]
    return b"".join(told), np.concatenate(([0], np.cumsum([len(t) for t in told])))
