"""Token files: against the tokenizer itself, memory-mapped, and over odd rows."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reqsieve.llm import token_files
from reqsieve.llm.queries import QUERIES, tokenizer_path
from reqsieve.llm.words import slices


def expected(rows):
    """doc_id, start, n_tokens, ids_crc32 by the plain tokenizer."""
    tokenizer, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def ordered(df):
    return [tuple(r)[:4] for r in df.orderBy("start").collect()]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert ordered(QUERIES["op10_tokens"](spark, sf_dir)) == expected([tuple(r) for r in rows])


def test_odd_rows_over_many_files(spark, odd, folder):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    token_files.write_tokens(odd.withColumn("ids", odd.text), folder, tokenizer_path(), file_bytes=20_000)
    assert len(glob.glob(f"{folder}/part-*")) > 2
    assert ordered(token_files.read_tokens(spark, folder)) == expected(rows)


def test_memory_map(spark, table, folder):
    token_files.write_tokens(table([(-3, "b!"), (5, None), (1 << 60, "a")], "doc_id long, text string"), folder, tokenizer_path())
    found = []
    for path in sorted(glob.glob(f"{folder}/part-*")):
        tokens, offsets, ids, known = token_files.open_file(path)
        assert tokens.dtype == np.dtype("<u2") and offsets.dtype == np.dtype("<u8") and known.all()
        assert isinstance(tokens.base, np.memmap)
        found += [(int(i), tokens[a:b].tolist()) for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist())]
    assert [i for i, _ in found] == [-3, 5, 1 << 60]
    assert found[0][1][-2:] == [0, 0] and found[1][1] == [0]


def test_empty_table(spark, table, folder):
    token_files.write_tokens(table([], "doc_id long, text string"), folder, tokenizer_path())
    assert token_files.read_tokens(spark, folder).count() == 0


def encoded(encode, texts, limit=10_000):
    return [x for part in slices(pa.array(texts), limit, lower=False) for x in encode.texts(part).to_pylist()]


@pytest.mark.parametrize("limit", [1, 100, 100_000])
def test_encoder_agrees_with_the_tokenizer(limit):
    encode = token_files.Encoder(tokenizer_path(), 2)
    parts = [*"ab Z'9  \n\t.é\xa0\x1c\x85\u180e\u200b中😀'!|*<", "<|endoftext|>", "'s", "'ll", " the", "foo", ".\nBar", " a", ". "]
    draw = random.Random(3)
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 9))) for _ in range(5000)] + [None]
    assert encoded(encode, texts, limit) == [encode._plain(t or "") for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    encode = token_files.Encoder(tokenizer_path(name), 2)
    assert not encode.by_piece and encoded(encode, ["a b  c"]) == [encode._plain("a b  c")]
