"""Token ids of whole texts through the tokenizers library, a chunk between single spaces at a time.

Both vocabularies split a text into words before they merge pairs, and no word reaches over the places where ``chunks``
cuts. A chunk's ids are remembered, so that the library runs once for each distinct chunk in a worker's bounded memory
and the ids equal those of the whole text. A new chunk of Latin letters, with punctuation behind them at most, is always two words to
either vocabulary, which go to the library's model without its general splitting. Of the others, those that begin with their
only space are encoded many at a time: a byte-level vocabulary begins a new word there, so the ids that begin with a space tell
the chunks apart.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

CACHED_CHUNKS = 1_000_000
GROUP = 512  # chunks encoded as one text
SPACE = "\u0120"  # fixed value: how byte-level vocabularies write a space
# fixed values: white space other than space and line feed
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# letters of Latin-1, which no normalisation changes, then ASCII punctuation other than the apostrophe, which can begin a word
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
ENDING = "".join(c for c in map(chr, range(0x21, 0x7f)) if not c.isalnum() and c != "'")
PRINTABLE = {*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)}
# byte-level vocabularies write a printable byte as itself, and the others, in order, as the characters from 256 on
WRITTEN = dict(zip((b for b in range(256) if b not in PRINTABLE), range(256, 512)))
LATIN = {c: c.encode().decode("latin-1").translate(WRITTEN) for c in map(chr, range(256))}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def leading(path: str) -> np.ndarray:
    """For each id, whether its bytes begin with a space."""
    ids = tokenizer(path).get_vocab()
    out = np.zeros(max(ids.values()) + 1, bool)
    out[[i for piece, i in ids.items() if piece.startswith(SPACE)]] = True
    return out


def space_chunks(text: str) -> list[str]:
    """Cuts before each single space and around each single line feed that stand between other characters.

    There a word with its leading space begins, whatever stands before and after.
    """
    if not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or any(c in text for c in OTHER_SPACE)):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    parts = text.split(" ")
    out = parts[:1]
    for part in parts[1:]:
        last = out[-1]
        if part and last and not part[0].isspace() and not last[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = f"{last} {part}"
    return out


def word_chunks(text: str) -> list[str]:
    """Words between white space, which this kind of vocabulary drops."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # not white space to the vocabulary
        return [w.decode() for w in text.encode("utf-8", "replace").split()]
    return text.split()


class Encoder:
    """Ids of texts; ``kept`` is the worker's memory of chunks and their ids as bytes, ``older`` what it held before it was full.

    When half of the memory is full, it becomes the older half, and of that only chunks that are met again stay: frequent chunks
    are learnt once, however many rare ones pass.
    """

    memories: dict[str, list[dict[str, bytes]]] = {}

    def __init__(self, path: str, chunks: Callable[[str], list[str]]):
        self.path, self.chunks = path, chunks
        self.halves = Encoder.memories.setdefault(path, [{"": b""}, {}])
        self.kept, self.older = self.halves
        self.model = tokenizer(path).model
        self.endings = {"": b""}  # ids of punctuation behind letters

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for a null or empty one."""
        cut = [self.chunks(text) if text else [] for text in texts]
        if len(self.kept) >= CACHED_CHUNKS // 2:
            self.halves[:] = self.kept, self.older = {"": b""}, self.kept
        kept, older = self.kept, self.older
        new = set().union(*cut).difference(kept)
        again = [chunk for chunk in new if chunk in older]
        kept.update(zip(again, map(older.__getitem__, again)))
        self._learn([*new.difference(again)])
        return [np.frombuffer(b"".join(map(kept.__getitem__, chunks)), np.uint32) for chunks in cut]

    def _learn(self, chunks: list[str]) -> None:
        others = self._learn_plain(chunks)
        alone = self._learn_together(others) if self.chunks is space_chunks else others
        for at in range(0, len(alone), 4096):
            some = alone[at:at + 4096]
            for chunk, result in zip(some, self._results(some)):
                self.kept[chunk] = array("I", result.ids).tobytes()

    def _learn_plain(self, chunks: list[str]) -> list[str]:
        """Learn chunks of letters and punctuation behind them from the model alone; the others are returned."""
        others, kept, older, lower = [], self.kept, self.older, self.chunks is word_chunks
        for chunk in chunks:
            letters = chunk.rstrip(ENDING)
            if not letters.isascii() or not (letters.isalpha() or letters[:1] == " " and letters[1:].isalpha()):
                found = PLAIN.fullmatch(chunk)
                if not found:
                    others.append(chunk)
                    continue
                letters = found[1]
            own = kept.get(letters) or older.get(letters)
            if own is None:  # kept also where only other endings were met, so that the model sees the letters once
                own = self._word(letters.lower() if lower else letters)
            kept[letters] = own
            if len(letters) < len(chunk):
                ending = chunk[len(letters):]
                if ending not in self.endings:
                    if len(self.endings) >= 10_000:
                        self.endings = {"": b""}
                    self.endings[ending] = self._word(ending)
                kept[chunk] = own + self.endings[ending]
        return others

    def _word(self, word: str) -> bytes:
        written = word.replace(" ", SPACE) if word.isascii() else "".join(map(LATIN.__getitem__, word))
        return array("I", [token.id for token in self.model.tokenize(written)]).tobytes()

    def _learn_together(self, chunks: list[str]) -> list[str]:
        """Learn chunks with one space, in front, in groups; the others, and groups whose ids do not tell them apart, are returned."""
        led, alone = [], []
        for chunk in chunks:
            (led if chunk[0] == " " and chunk.split() == [chunk[1:]] else alone).append(chunk)
        groups = [led[at:at + GROUP] for at in range(0, len(led), GROUP)]
        for at in range(0, len(groups), 16):
            some = groups[at:at + 16]
            for group, result in zip(some, self._results(["".join(group) for group in some])):
                ids = np.array(result.ids, np.uint32)
                starts = np.flatnonzero(leading(self.path)[ids])
                if len(starts) != len(group):
                    alone += group
                    continue
                body, edges = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                for chunk, a, b in zip(group, edges, edges[1:]):
                    self.kept[chunk] = body[a:b]
        return alone

    def _results(self, texts: list[str]) -> list:
        return tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)
