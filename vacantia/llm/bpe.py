"""Byte-level BPE: encoding by replaying merges over a word set at once, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.words import WordwiseEncoder

#: Words of up to so many bytes are merged in tables of equal width; a table has at most ``_ROWS`` words.
_WIDTHS = (4, 6, 8, 12, 16, 24, 32)
_ROWS = 20_000
_NO_RANK = np.iinfo(np.int32).max


class MergeReplay:
    """Applies the merges of a rank file to many words together, in rank order.

    Words of ordinary length lie in the rows of a table, with the ranks of their neighbouring pairs
    beside them. In each round every word that still has a pair with a rank merges its lowest one,
    the leftmost of equals, and looks up the two pairs it touched.

    Longer words lie in one linked sequence of tokens. An inverted index maps a merge's rank to the
    positions where its pair stands. The lowest rank is taken, its positions are merged from left
    to right, and only the pairs with the two touched neighbours are looked up anew. Words do not
    touch each other, so the result for a word is that of encoding it alone.
    """

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {
                base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)
            }
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self._pairs: dict[tuple[int, int], int | None] = {}
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _rank(self, a: int, b: int) -> int | None:
        pairs = self._pairs
        try:
            return pairs[a, b]
        except KeyError:
            if len(pairs) > 2_000_000:
                pairs.clear()
            found = pairs[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b])
            return found

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, as sorted numbers, and the ranks of what they make."""
        if self._table is None:
            ranks, found = self.ranks.get, {}
            for token, rank in self.ranks.items():
                for i in range(1, len(token)):
                    a = ranks(token[:i])
                    if a is not None:
                        b = ranks(token[i:])
                        if b is not None:
                            found[a << 32 | b] = rank
            keys = np.array(sorted(found), dtype=np.int64)
            made = np.array([found[k] for k in keys.tolist()], dtype=np.int32)
            # A last one that no pair is equal to, for pairs beyond the others.
            self._table = np.append(keys, np.iinfo(np.int64).max), np.append(made, _NO_RANK)
        return self._table

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of what pairs make; a negative token stands for none."""
        keys, made = self._pair_table()
        asked = a.astype(np.int64) << 32 | b
        at = np.searchsorted(keys, asked)
        return np.where((keys[at] == asked) & (a >= 0) & (b >= 0), made[at], _NO_RANK)

    def _encode_table(self, words: list[bytes], width: int) -> list[list[int]]:
        """Token ids of words of at most ``width`` bytes."""
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(-1, width)
        size = np.array([len(w) for w in words])
        # One column more, always empty, so that a row can move up by one.
        ids = np.full((len(words), width + 1), -1, dtype=np.int32)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], np.array(self.of_byte, dtype=np.int32)[raw], -1)
        best = np.full((len(words), width + 1), _NO_RANK, dtype=np.int32)
        best[:, :width] = self._ranks_of(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(words)), [[]] * len(words)
        columns = np.arange(width + 1)
        while len(row):
            at = best.argmin(axis=1)
            rank = best[np.arange(len(row)), at]
            over = rank == _NO_RANK
            if over.any():
                sizes = (ids[over] >= 0).sum(axis=1).tolist()
                for i, n, found in zip(row[over].tolist(), sizes, ids[over].tolist()):
                    out[i] = found[:n]
                more = ~over
                row, ids, best, at, rank = row[more], ids[more], best[more], at[more], rank[more]
            moved = np.minimum(columns + (columns > at[:, None]), width)
            ids, best = np.take_along_axis(ids, moved, 1), np.take_along_axis(best, moved, 1)
            each = np.arange(len(row))
            ids[each, at] = rank
            best[each, at] = self._ranks_of(rank, ids[each, at + 1])
            later = np.flatnonzero(at)
            before = at[later] - 1
            best[later, before] = self._ranks_of(ids[later, before], rank[later])
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, as byte-pair encoding by rank gives them."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = [whole]
            elif word:
                by_width.setdefault(next((w for w in _WIDTHS if len(word) <= w), 0), []).append(i)
        for width, places in by_width.items():
            for at in range(0, len(places), _ROWS):
                part = places[at:at + _ROWS]
                some = [words[i] for i in part]
                for i, ids in zip(part, self._encode_table(some, width) if width else self._encode_linked(some)):
                    out[i] = ids
        return out

    def _encode_linked(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words of any length."""
        ids: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        for word in words:
            at = len(ids)
            starts.append(at)
            whole = self.ranks.get(word)
            if whole is not None:
                ids.append(whole)
                after.append(-1)
                before.append(-1)
                continue
            ids.extend(self.of_byte[b] for b in word)
            after.extend(range(at + 1, at + len(word)))
            before.append(-1)
            before.extend(range(at, at + len(word) - 1))
            after.append(-1)
        index: dict[int, list[int]] = {}
        rank_of = self._rank
        for at, following in enumerate(after):
            if following >= 0:
                rank = rank_of(ids[at], ids[following])
                if rank is not None:
                    index.setdefault(rank, []).append(at)
        waiting = list(index)
        heapify(waiting)
        while waiting:
            rank = heappop(waiting)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for done, at in enumerate(places, 1):
                following = after[at]
                if ids[at] < 0 or following < 0 or rank_of(ids[at], ids[following]) != rank:
                    continue
                ids[at], ids[following] = rank, -1
                beyond, previous = after[following], before[at]
                after[at] = beyond
                if beyond >= 0:
                    before[beyond] = at
                sooner = False
                for left, right in ((previous, at), (at, beyond)):
                    if left < 0 or right < 0:
                        continue
                    new = rank_of(ids[left], ids[right])
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(waiting, new)
                        sooner |= new <= rank
                if sooner:
                    # A pair that ranks lower than the rest of this merge has come up: it goes first.
                    rest = places[done:]
                    if rest:
                        if rank in index:
                            index[rank].extend(rest)
                        else:
                            index[rank] = rest
                            heappush(waiting, rank)
                    break
        out = []
        for word, at in zip(words, starts):
            found = []
            while at >= 0 and word:
                found.append(ids[at])
                at = after[at]
            out.append(found)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Whole texts through :class:`MergeReplay`: the new words of a group of texts are replayed together."""

    def __init__(self, rank_file: str, pattern: str):
        self.replay = MergeReplay(rank_file)
        self.by_words = WordwiseEncoder(pattern, self._encode, self._join)

    def _encode(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        found = self.replay.encode([w.encode("utf-8", "replace") for w in words])
        return [(_text(ids), self.replay.decode(ids)) for ids in found]

    @staticmethod
    def _join(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        parts = list(parts)
        return b"".join([ids for ids, _ in parts]), b"".join([raw for _, raw in parts])

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        for ids, _ in self.by_words(texts):
            yield [int(i) for i in ids.split()]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded bytes."""
        for ids, raw in self.by_words(texts):
            yield (
                ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(raw).hexdigest()
            )


def _text(ids: list[int]) -> bytes:
    return b"".join(b"%d " % i for i in ids)


def _mapped(documents: DataFrame, make, schema: str, rows_of, group: int) -> DataFrame:
    """Texts in groups of a few hundred: a task holds one group's words and the bounded cache."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for batch in batches:
            for at in range(0, len(batch), group):
                part = batch.iloc[at:at + group]
                texts = ["" if t is None else t for t in part["text"]]
                yield pd.DataFrame(
                    [(d, *row) for d, row in zip(part["doc_id"], rows_of(encoder, texts))],
                    columns=[f.split()[0] for f in schema.split(", ")],
                )

    # NULL ids would become floats in pandas, so ids travel as text.
    named = documents.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return named.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(documents: DataFrame, rank_file: str, pattern: str, group: int = 400) -> DataFrame:
    """``(doc_id, ids)`` of every whole text; NULL counts as empty, which has no ids."""
    return _mapped(
        documents, lambda: TextEncoder(rank_file, pattern), "doc_id string, ids array<int>",
        lambda encoder, texts: ((ids,) for ids in encoder(texts)), group,
    )


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``(doc_id, raw)`` bytes of rows ``(doc_id, ids)``; NULL ids give NULL."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replay = MergeReplay(rank_file)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "raw": [None if ids is None else replay.decode(ids) for ids in batch["ids"]],
            })

    named = encoded.select(F.col("doc_id").cast("string"), "ids")
    return named.mapInPandas(run, "doc_id string, raw binary").withColumn(
        "doc_id", F.col("doc_id").cast("long")
    )


def digests(documents: DataFrame, rank_file: str, pattern: str, group: int = 400) -> DataFrame:
    """Encodes and decodes every whole text; per row the number of tokens and two digests."""
    return _mapped(
        documents, lambda: TextEncoder(rank_file, pattern),
        "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda encoder, texts: encoder.digests(texts), group,
    )
