"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences and then into the binary digits of the rest, largest first. Every
piece is a sequence of its own whose length is a power of two, so none is padded and none crosses documents.
Sequences of one length form a bucket from which batches are drawn.

Token ids are those of the ``tokenizers`` file. Texts are encoded whole, and the ids of the last ones are kept, as
copies often follow one another.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of texts and ids that a worker keeps; beyond, it starts anew.
KEPT_BYTES = 4_000_000
#: Pieces that a task hands on at once.
BATCH_PIECES = 1 << 13
#: The rank encoder's pattern recurses once for each character of white space, and its stack ends at some 700,000; the
#: tokenizer's own does not.
_LONG_SPACE = re.compile(r"\s{10000}")
_ENCODERS: dict[tuple[str, str], Callable[[str], bytes]] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian 32-bit ids, the same as those of ``tokenizers`` without special tokens added."""

    def __init__(self, json_name: str, ranks_name: str | None):
        self.json_name, self.ranks = json_name, None
        if ranks_name:
            import base64

            import public_tokenizers
            import tiktoken

            with open(vocabulary(ranks_name), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes] = {}
        self.kept = 0

    @cached_property
    def whole(self):
        """The tokenizer itself, which few workers need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary(self.json_name))

    def _encode(self, text: str) -> bytes:
        # A special token's own string is a token for the tokenizer and ordinary text for the ranks.
        if self.ranks is None or "<|" in text or _LONG_SPACE.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = self._encode(text)
            size = len(text) + len(found)
            if self.kept + size > KEPT_BYTES:
                self.parts.clear()
                self.kept = 0
            if size <= KEPT_BYTES:
                self.parts[text] = found
                self.kept += size
        return found


def encoder(json_name: str, ranks_name: str | None) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (json_name, ranks_name) not in _ENCODERS:
        _ENCODERS[json_name, ranks_name] = Encoder(json_name, ranks_name)
    return _ENCODERS[json_name, ranks_name]


def binary_pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: ``longest`` as often as it fits, then the digits of the rest."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, bucket_place long"


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 1,
    longest: int = 2048,
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: where it lies in its document and which sequence it is; with ``with_ids`` also the ids.

    ``longest`` is a power of two. Each document ends with ``end_id``; null and empty texts have that id alone.
    Sequences are numbered by partition and place in it, so no number is given twice; numbers depend on how the table is
    dealt to tasks. Rows that repeat, null ids included, are documents of their own; an empty table gives no piece. Ids are
    cast to long, and a text that is no number raises. A text of any length is encoded whole, so a task needs some ten
    times its longest text. Other columns are not read, whatever their names.

    ``bucket`` is the binary logarithm of the sequence's length; ``bucket_place`` numbers the sequences of a bucket within
    a task's part of the table, so a batch of equal lengths is a range of (bucket, task, bucket_place) and
    ``write.partitionBy("bucket")`` lays the buckets out as folders without moving a row.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_name, ranks_name)
        number, places = TaskContext.get().partitionId() << 33, [0] * (longest.bit_length())
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        made = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start, length in binary_pieces(total, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    bucket = length.bit_length() - 1
                    row = (doc, start, length, zlib.crc32(piece), total, number, 0, bucket, places[bucket])
                    number += 1
                    places[bucket] += 1
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                    if with_ids:
                        cols[9].append(np.frombuffer(piece, "<u4").astype(np.int32))
                if len(cols[0]) >= BATCH_PIECES:
                    yield made(cols)
                    cols = [[] for _ in types]
            yield made(cols)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, schema)
