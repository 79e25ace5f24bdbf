"""Best-fit packing of tokenised documents into fixed-length sequences.

A document's token ids end with an end id; a document longer than a sequence is
cut into pieces of a sequence's length, of which the last may be shorter.  Pieces
are packed online: each goes into the open bin with the least free space that
still holds it.  Open bins are kept by their free space in one integer used as a
bitset, so the best fit is one shift and one lowest-set-bit.  At most OPEN bins
are open; when one more is needed, the fullest is closed first.  A packer's memory
is thus fixed, however many pieces it takes.

Tokenising happens where the rows are read.  Only the pieces' numbers (a few
dozen bytes a document) are then dealt to packers, each of about PIECES pieces, so
that what a packer leaves unfilled, less than a sequence or two, is small beside
the thousands it fills.  Packers take pieces as they come, by id and piece, which
also makes a repeated task give the same bins.

Defined results: a null text is an empty one; an empty text is a piece of the
end id alone; a very long one is cut as above, never dropped.  Of bins with equal
free space the one that got it last is filled first.  Repeated rows are packed
each, null ids too.  An empty table gives an empty result.  Columns other than the
id and the text are ignored.  A special token's string in a text gets the ids that
the tokenizer's file gives it; `special_as_text` reads it as ordinary text instead.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CAPACITY = 4096
#: Open bins at most, and pieces a packer takes on average.
OPEN, PIECES = 512, 100_000
END_ID = 1
#: Words whose ids a worker remembers at most; beyond that it starts anew.
REMEMBERED = 1_200_000
#: New words that are encoded as one text.
TOGETHER = 512

_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    This tokenizer parts words at white space before anything else, so a text's ids are its blank-parted words' ids in
    a row, and a word need be encoded once only.  Special tokens' strings hold no white space, so they stay whole.  New
    words are encoded together, as one text, and the ids given to them by the places in it that they come from.
    """

    def __init__(self, tokenizer_path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.known: dict[str, bytes] = {"": b""}

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = b""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(known.get, words)) for words in split]  # one look for each word
        holes = []
        for words, ids in zip(split, found, strict=True):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                holes.append((ids, at, words[at]))
        new = list(dict.fromkeys(w for _, _, w in holes))
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            known.update(zip(part, self._ids(part), strict=True))
        for ids, at, w in holes:
            ids[at] = known[w]
        return [b"".join(ids) for ids in found]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        places = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(ids) // 4)
        if (np.diff(places) < 0).any():  # never seen; then each word by itself
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ends = np.cumsum([len(w) + 1 for w in words])
        cuts = [0, *(4 * np.searchsorted(places, ends)).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and with `ids` their ids as bytes."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = common.worker_state(("encoder", tokenizer_path, special_as_text), lambda: _Encoder(tokenizer_path, special_as_text))
        for batch in batches:
            keys, pieces, starts, lengths, sums, bodies = [], [], [], [], [], []
            for key, body in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                body += end
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[at : at + 4 * capacity]
                    keys.append(key)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if ids:
                        bodies.append(part)
            columns = [pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.record_batch(columns + [pa.array(bodies, pa.binary())] * ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return common.map_arrow(common.id_and_text(docs, id_col, text_col), run, _FIELDS + ", ids binary" * ids)


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, most_open: int = OPEN) -> Iterator[tuple[int, int]]:
    """Bin number and offset of each length in turn.

    `free` has bit s set where an open bin has s tokens free; `bins[s]` lists those bins.
    """
    free, n_open, n_bins = 0, 0, 0
    bins: dict[int, list[int]] = {}
    for length in lengths:
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        fits = free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            held = bins[space]
            number = held.pop()
            if not held:
                free ^= 1 << space
            n_open -= 1
        else:
            number, space, n_bins = n_bins, capacity, n_bins + 1
        yield number, capacity - space
        space -= length
        if space:
            if n_open == most_open:  # the fullest closes
                least = (free & -free).bit_length() - 1
                bins[least].pop()
                if not bins[least]:
                    free ^= 1 << least
                n_open -= 1
            held = bins.setdefault(space, [])
            held.append(number)
            free |= 1 << space
            n_open += 1


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, pieces_each: int = PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with `length`.  `pieces` should be a table: it is counted first, then packed."""
    from pyspark import TaskContext

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        waiting: list[int] = []

        def lengths() -> Iterator[int]:
            while True:
                yield waiting.pop()

        placed = best_fit(lengths(), capacity, most_open)
        for batch in batches:
            numbers, offsets = [], []
            for length in batch.column(batch.schema.get_field_index("length")).to_pylist():
                waiting.append(length)
                number, offset = next(placed)
                numbers.append(base + number)
                offsets.append(offset)
            yield pa.record_batch([*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    packers = max(1, round(pieces.count() / pieces_each))
    dealt = pieces.repartition(packers).sortWithinPartitions(*[common.quoted(c) for c in pieces.columns])
    return common.map_arrow(dealt, run, f"{schema}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenise, then pack: a row for each piece."""
    return pack(common.stash(tokenise(docs, tokenizer_path or default_tokenizer()), "pieces"))


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
