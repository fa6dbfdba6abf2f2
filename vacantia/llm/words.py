"""Encoding of whole texts word by word, with what was met before kept at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


_BEGIN = "\ufdd0"  # a code point that Unicode sets apart for such use


class Remembered(dict):
    """A dictionary in two generations: what was not asked for in a whole generation is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that have to be computed; the other ones are in the dictionary afterwards."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        older, fresh = self.older, []
        for key in keys.difference(self):
            value = older.get(key)
            if value is None:
                fresh.append(key)
            else:
                self[key] = value
        return fresh


class WordwiseEncoder:
    """Turns texts into the encodings of their words, in order.

    ``pattern`` splits a text into words that are encoded separately, and never joins a word with
    what stands before its leading space. So a text is cut at its spaces first, and a cut piece
    met before needs no splitting. Texts where white space meets white space are split as a whole.
    ``encode`` gets lists of distinct new words; ``join`` makes one encoding of several.
    """

    def __init__(
        self, pattern: str, encode: Callable[[list[str]], list], join: Callable[[Iterable], object],
        kept_pieces: int = 150_000, kept_words: int = 400_000,
    ):
        import regex

        self.split = regex.compile(pattern).findall
        self.encode, self.join = encode, join
        self.pieces, self.words = Remembered(kept_pieces), Remembered(kept_words)

    def _words(self, text: str) -> list[str]:
        """The pattern's words; the plain cases, a word and a word with a stop, need no pattern."""
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            return [text]
        if core[-1:] in ".," and core[:-1].isalpha():
            return [text[:-1], core[-1]]
        return self.split(text)

    def _encoded(self, texts: list[str]) -> list:
        parts = list(map(self._words, texts))
        fresh = self.words.missing(set().union(*parts))
        self.words.update(zip(fresh, self.encode(fresh)))
        word = self.words.__getitem__
        return [word(p[0]) if len(p) == 1 else self.join(list(map(word, p))) for p in parts]

    def __call__(self, texts: list[str]) -> Iterator:
        """One encoding per text."""
        # A line break is never joined with the word behind it, a space is. The mark stands for
        # the beginning of a text, which has no space.
        cut = [f"{_BEGIN}{t}".replace("\n", " \n").split(" ") for t in texts]
        fresh = self.pieces.missing(set().union(*cut))
        plain = []
        for piece in fresh:
            core = piece[1:] if piece[:1] in ("\n", _BEGIN) else piece
            if core and not core[0].isspace() and not core[-1].isspace():
                plain.append(piece)
            elif piece == _BEGIN:
                self.pieces[piece] = self.join([])
            else:
                self.pieces[piece] = False
        self.pieces.update(zip(plain, self._encoded([
            p[1:] if p[0] == _BEGIN else p if p[0] == "\n" else " " + p for p in plain
        ])))
        known = self.pieces.__getitem__
        for text, pieces in zip(texts, cut):
            try:
                if _BEGIN in text:
                    raise TypeError
                yield self.join(map(known, pieces))
            except TypeError:  # a piece that stands for nothing on its own
                yield self._encoded([text])[0]
