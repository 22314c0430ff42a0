"""The registered queries as they are called, on the smallest tables: SQL where there is one, else the libraries by hand."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pytest

from leafscan.llm import queries
from leafscan.llm.common import vocabulary

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    duck.sql("SET temp_directory = ''")
    for table in ("documents", "embeddings", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found, wanted = queries.QUERIES[name](spark, DIR), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == sorted(repr([r[k] for k in order]) for r in wanted.fetchall())


def kinds(df):
    return dict(df.dtypes)


def test_op4_digests(spark, texts):
    import public_tokenizers
    import tiktoken

    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = queries.op4_byte_bpe(spark, DIR)
    assert kinds(found)["n_tokens"] == "bigint"
    rows = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = {}
    for k, text in texts.items():
        ids = library.encode_ordinary(text)
        want[k] = (len(ids), digest(",".join(map(str, ids)).encode()), digest(text.encode()))
    assert rows == want


def word_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.encode_special_tokens = True
    return {k: e.ids for k, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op5_places(spark, texts):
    ids = {k: [*v, 1] for k, v in word_ids(texts).items()}
    found = queries.op5_best_fit_packing(spark, DIR)
    assert {kinds(found)[c] for c in ("start", "length", "ids_crc32", "sequence_id", "offset")} == {"bigint"} and kinds(found)["piece"] == "int"
    rows = found.collect()
    want = {(k, at // 4096, at, len(v[at : at + 4096]), crc(v[at : at + 4096])) for k, v in ids.items() for at in range(0, len(v), 4096)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096 and len(sequences) <= 1.05 * sum(map(len, ids.values())) / 4096 + 1


def test_op8_ids(spark, texts):
    ids = {k: [*v, 2] for k, v in word_ids(texts).items()}
    want, start = {}, 0
    for k in sorted(ids):
        want[k] = (start, len(ids[k]), crc(ids[k]))
        start += len(ids[k])
    found = queries.op8_wavelet_shards(spark, DIR)
    assert {kinds(found)[c] for c in ("start", "n_tokens", "ids_crc32")} == {"bigint"}
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found.collect()} == want


def test_op10_digests(spark, texts):
    found = queries.op10_scaled_sketch(spark, DIR)
    rows = {r["doc_id"]: r for r in found.collect()}
    order = sorted(texts, reverse=True)
    for k, following in zip(order, [*order[1:], order[0]], strict=True):
        third = len(texts[k]) // 3
        edited = texts[k][: len(texts[k]) - third] + texts[following][:third]
        assert (rows[k]["n_chars"], rows[k]["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[k]["near_edited"] <= 1 and 0 <= rows[k]["near_next"] <= 1
