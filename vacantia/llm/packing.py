"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths."""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import rank_in_group, written

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def id_encoder(vocabulary: str, pattern: str) -> Callable[[str], bytes]:
    """Whole texts to token ids, as little-endian 32-bit bytes.

    The vocabulary is the ``tokenizers`` file. Its tokens are read as ranks by ``tiktoken``, which gives
    the same ids (a test holds the two libraries against each other) in a third of the time. A text
    is split at the vocabulary's added tokens first, each of which is one id.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        described = json.load(file)
    tokens = described["model"]["vocab"]
    added = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    # The file writes bytes as letters: printable ones as themselves, the others from 256 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in printable}
    letters.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))})
    ranks = {
        bytes(letters[c] for c in token): rank for token, rank in tokens.items()
        if token not in added and all(c in letters for c in token)
    }
    encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def pieces(
    documents: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """One row per piece of a document: where it starts, how long it is, CRC-32 of its ids.

    A document is its ids and ``end_id`` (so an empty or NULL text is one token). Documents of at
    most ``capacity`` tokens stay whole; longer ones are cut into pieces of ``capacity``, the
    first taking the remainder. ``pattern`` is the vocabulary's own split pattern. Texts are tokenised whole,
    one at a time.
    """
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = id_encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode("" if text is None else text) + end
                total = len(ids) // 4
                begin, size, number = 0, (total - 1) % capacity + 1, 0
                while begin < total:
                    span = ids[4 * begin:4 * (begin + size)]
                    rows.append((doc_id, number, begin, size, zlib.crc32(span)))
                    begin, size, number = begin + size, capacity, number + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    typed = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # NULL ids would turn the column into floats in pandas: keep them apart as text.
    named = typed.withColumn("doc_id", F.col("doc_id").cast("string"))
    return named.mapInPandas(cut, _PIECES.replace("doc_id long", "doc_id string")).withColumn(
        "doc_id", F.col("doc_id").cast("long")
    )


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over a histogram of lengths.

    Works on groups of equal bins: all pieces of one length go to the group with the least room
    that still takes one, as many per bin as fit. Returns slots
    ``(length, first_rank, n, first_sequence, offset)``: the pieces of this length with ranks
    ``first_rank .. first_rank + n - 1`` lie at ``offset`` of consecutive sequences. The number of
    steps depends on the number of distinct lengths, at most ``capacity``, not on the pieces.
    """
    rooms: list[int] = []  # ascending distinct rooms of open bins
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, bins)
    slots, sequences = [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if room <= 0 or not n:
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                room, first, bins = capacity, sequences, -(-left // each)
                sequences += bins
            else:
                room = rooms[at]
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            each = room // length
            full = min(bins, left // each)
            for j in range(each if full else 0):
                slots.append((length, rank, full, first, capacity - room + j * length))
                rank += full
            put_back(room - each * length if full else 0, first, full)
            left -= full * each
            if full < bins:
                rest = min(left, each - 1) if left < each else 0
                for j in range(rest):
                    slots.append((length, rank, 1, first + full, capacity - room + j * length))
                    rank += 1
                left -= rest
                used = 1 if rest else 0
                put_back(room - rest * length, first + full, used)
                put_back(room, first + full + used, bins - full - used)
    return slots


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces.

    The histogram (one row per length, at most ``capacity``) is all that the driver sees. Pieces
    are ranked within their length, any of them being as good as another, and joined with the
    planned slots on the length and the rank's slot; the plan's size has the same bound, so it may
    be broadcast. An empty table gives no rows; equal rows are packed apart.
    """
    spark = cut.sparkSession
    cut = written(cut, "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    slots = plan(histogram, capacity)
    ranked = rank_in_group(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank")
    by_length: dict[int, list[tuple]] = {}
    for slot in slots:
        by_length.setdefault(slot[0], []).append(slot[1:])
    rows = [(length, *map(list, zip(*sorted(s)))) for length, s in by_length.items()]
    planned = spark.createDataFrame(
        rows, "length long, firsts array<long>, ns array<long>, sequences array<long>, offsets array<long>"
    )
    # The slot is the last one that begins at or before the rank.
    at = F.expr("size(filter(firsts, f -> f <= __rank)) - 1")
    return (
        ranked.join(F.broadcast(planned), "length").withColumn("__at", at)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.expr("sequences[__at] + __rank - firsts[__at]").alias("sequence_id"),
            F.expr("offsets[__at]").alias("offset"),
        )
    )
