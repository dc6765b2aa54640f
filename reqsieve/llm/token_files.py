"""Token ids of documents as flat files of unsigned integers with 64-bit offsets (operator 10).

A file holds the documents of one range of ids, in ascending order:

    tokens    unsigned 16-bit integers (32-bit ones if the vocabulary needs them), little-endian;
              every document ends with id 0
    offsets   documents + 1 unsigned 64-bit integers: where each document starts, in tokens
    ids       a signed 64-bit integer per document
    known     a byte per document, 0 where the id was null
    trailer   documents, tokens and bytes per token as unsigned 64-bit integers, then one token of zeros

The tokens start at byte 0, so that ``numpy.memmap`` sees them as they are, and the index is mapped
the same way (``open_file``). A document's place in the whole corpus is the base of its file, the
prefix sum of the tokens in earlier files, plus its offset.

Files are made by Spark's own text writer: a row is the ids of a document, and the separator that
the writer puts after a row is the id 0. So any file system works that Spark can write to, and
a task that is lost or repeated leaves nothing behind.

Rows: one document each. A null text is empty (only the end id). Null ids come first; rows with
equal ids are ordered by text, and repeated rows are written as often as they occur. An empty table
makes no file with documents. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, parts_for, settle
from reqsieve.llm.words import Slice, hash_spans, slices

#: Text that goes into one file. A task holds one file in memory.
FILE_BYTES = 16 << 20
#: Stretches between spaces whose ids a worker keeps; it starts anew beyond.
KEPT_STRETCHES = 2_000_000
#: Text that is encoded at a time.
ENCODED_BYTES = 400_000

_CODE = {2: "H", 4: "I"}
_JOINING = "\u180e\u200b"
#: What a stretch is: after a space, the first of several, or a whole text.
SPACED, FIRST, ALONE = 0, 1, 2
_ROLE = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
_TRAILER = struct.Struct("<QQQ")


def item_bytes(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


class Encoder:
    """Texts to the bytes of their ids, the same as ``Tokenizer.encode`` gives.

    A byte-level BPE tokenizer encodes the pieces of a text one by one and always starts a piece at
    a space between two other characters. So what lies between such spaces is encoded once and kept,
    by a 64-bit hash of its bytes. Texts with other white space beside spaces, and all texts of any
    other kind of tokenizer, are encoded as a whole.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        split = said.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not any(said.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
        )
        self.known = Known(self.kind)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def stretches(self, texts: list[str], roles: list[int]) -> list[bytes | None]:
        """The ids of what lies between two spaces; None if a space beside it may be part of a longer piece."""
        wanted, place, out = [], [], [None] * len(texts)
        for i, (text, role) in enumerate(zip(texts, roles)):
            if role == SPACED:
                if not text.isalpha() and (not text or text[0].isspace() or text[-1].isspace() or text[0] in _JOINING or text[-1] in _JOINING):
                    continue
                text = " " + text
            elif role == FIRST and (not text or text[-1].isspace() or text[-1] in _JOINING):
                continue
            wanted.append(text)
            place.append(i)
        code = _CODE[self.kind.itemsize]
        for i, made in zip(place, self.tokenizer.encode_batch_fast(wanted, add_special_tokens=False)):
            out[i] = array(code, made.ids).tobytes()
        return out

    def texts(self, part: Slice) -> pa.Array:
        """The ids of all texts of a slice, as binary values."""
        if not self.by_piece:
            return pa.array([self._plain(part.text(i)) for i in range(len(part))], pa.binary())
        space = np.flatnonzero(part.data == 0x20)
        counts = np.diff(np.searchsorted(space, part.bounds)) + 1
        begins = np.concatenate(([0], np.cumsum(counts)))
        starts, ends = np.empty(begins[-1], np.int64), np.empty(begins[-1], np.int64)
        first, last = np.zeros(begins[-1], bool), np.zeros(begins[-1], bool)
        first[begins[:-1]] = last[begins[1:] - 1] = True
        starts[first], starts[~first] = part.bounds[:-1], space + 1
        ends[last], ends[~last] = part.bounds[1:], space
        role = np.where(first, np.where(last, ALONE, FIRST), SPACED)
        keys, where, each = np.unique(
            hash_spans(part.data, starts, ends) ^ _ROLE[role], return_index=True, return_inverse=True)
        data = part.data.tobytes()

        def make(new: np.ndarray) -> list[bytes | None]:
            place = where[new]
            return self.stretches([data[a:b].decode() for a, b in zip(starts[place].tolist(), ends[place].tolist())], role[place].tolist())

        at, size = self.known.find(keys, make)
        size = size[each]
        unsafe = np.unique(np.searchsorted(begins, np.flatnonzero(size < 0), "right") - 1)
        size = np.maximum(size, 0)
        cuts = np.concatenate(([0], np.cumsum(size)))
        ids = self.known.ids[np.repeat(at[each] - cuts[:-1], size) + np.arange(cuts[-1])]
        offsets = cuts[begins] * self.kind.itemsize
        if not len(unsafe):
            return pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        data = ids.tobytes()
        rows = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        for i in unsafe.tolist():
            rows[i] = self._plain(part.text(i))
        return pa.array(rows, pa.binary())

    def trim(self) -> None:
        if len(self.known.keys) > KEPT_STRETCHES:
            self.known = Known(self.kind)


class Known:
    """Ids by 64-bit key, in arrays: sorted keys, and where their ids are (size -1: none)."""

    def __init__(self, kind: np.dtype):
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, kind)

    def find(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of sorted keys are; ``make`` gives those of the keys at some places, as bytes or None."""
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            made = make(np.flatnonzero(new))
            size = np.array([-1 if m is None else len(m) // self.ids.itemsize for m in made])
            held = np.maximum(size, 0)
            at = len(self.ids) + np.cumsum(held) - held
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(m for m in made if m), self.ids.dtype)])
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.at = np.insert(self.at, place[new], at)
            self.size = np.insert(self.size, place[new], size)
            place = np.searchsorted(self.keys, keys)
        return self.at[place], self.size[place]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """One encoder per worker process: what it has learnt serves later tasks."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def _index(ids: list[int | None], sizes: list[int], width: int) -> bytes:
    offsets = np.concatenate(([0], np.cumsum(np.array(sizes, np.uint64)))).astype("<u8")
    known = np.array([i is not None for i in ids], np.uint8)
    values = np.array([i or 0 for i in ids], "<i8")
    return b"".join((offsets.tobytes(), values.tobytes(), known.tobytes(), _TRAILER.pack(len(ids), int(offsets[-1]), width)))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write the files. Files are ranges of ids and ordered by their names."""
    width = item_bytes(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, sizes = encoder(tokenizer_path, width), [], []
        for batch in batches:
            for part in slices(batch.column(1), ENCODED_BYTES, lower=False):
                rows = known.texts(part)
                ids += batch.column(0).slice(part.first, len(part)).to_pylist()
                sizes += (pc.binary_length(rows).to_numpy() // width + 1).tolist()
                yield pa.record_batch([rows], ["ids"])
                known.trim()
        if ids:
            yield pa.record_batch([pa.array([_index(ids, sizes, width)], pa.binary())], ["ids"])

    rows = only(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    parts = parts_for(rows, F.octet_length("text"), file_bytes)
    (
        rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(encode, "ids binary").select(F.col("ids").cast("string"))
        .write.option("lineSep", "\0" * width).text(path)
    )


def parse_file(content: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, offsets, ids and known ids of a file, as views of it."""
    size = len(content)
    for width in (2, 4):
        at = size - width - _TRAILER.size
        if at >= 0:
            n, tokens, said = _TRAILER.unpack(bytes(content[at: at + _TRAILER.size]))
            if said == width and tokens * width + 8 * (n + 1) + 9 * n == at:
                break
    else:
        raise ValueError("not a token file")
    index = tokens * width
    return (
        np.frombuffer(content, f"<u{width}", tokens),
        np.frombuffer(content, "<u8", n + 1, index),
        np.frombuffer(content, "<i8", n, index + 8 * (n + 1)),
        np.frombuffer(content, np.uint8, n, index + 8 * (2 * n + 1)),
    )


def open_file(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a file on a mounted disk, memory-mapped: nothing is read before it is used."""
    return parse_file(np.memmap(path, np.uint8, "r"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, file.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                if not len(content.as_buffer()):
                    continue
                tokens, offsets, ids, known = parse_file(np.frombuffer(content.as_buffer(), np.uint8))
                cuts = offsets.astype(np.int64)
                crc = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.record_batch({
                    "file": pa.array([name.as_py()] * len(ids), pa.string()),
                    "file_tokens": pa.array(np.full(len(ids), cuts[-1])),
                    "doc_id": pa.array(ids.astype(np.int64), mask=known == 0),
                    "at": pa.array(cuts[:-1]),
                    "n_tokens": pa.array(np.diff(cuts)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = settle(files.mapInArrow(read, "file string, file_tokens long, doc_id long, at long, n_tokens long, ids_crc32 long"))
    order = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    bases = (  # a row per file
        found.groupBy("file").agg(F.max("file_tokens").alias("tokens")).withColumn("nr", order)
        .select("file", (F.sum("tokens").over(Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("base"))
    )
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file")
