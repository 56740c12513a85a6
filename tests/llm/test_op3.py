import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import common
from lodestone.llm import op3_token_store as op


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op.VOCABULARY)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, op.END_ID]


def test_ids_are_the_library_s(library):
    rng = random.Random(5)
    some = [*" ab\n\t\x0b\x0c\r\x1c\x1f\x85\xa0 　​́̇ΣσİßÉé1２½!?.,-_'", "<|endoftext|>", "'s", "don't", "...", ". ", ".,"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    got = op.WordIds(op.VOCABULARY).batch(texts)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_checksums_of_parts():
    rng = np.random.default_rng(5)
    parts = [[rng.bytes(4 * int(n)) for n in rng.integers(1, 3000, k)] for k in (1, 2, 7, 1, 3)]
    flat = [x for d in parts for x in d]
    got = op.joined_crcs(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), np.cumsum([len(d) for d in parts]).tolist())
    assert got.tolist() == [zlib.crc32(b"".join(d)) for d in parts]



def test_chunks_follow_content():
    ids = np.random.default_rng(2).integers(0, 49000, 30000).astype(np.uint16)
    ends = op.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= op.MAX_CHUNK and sizes[:-1].min() >= op.MIN_CHUNK
    shifted = op.cuts(np.r_[np.arange(700, dtype=np.uint16), ids])
    assert len({e + 700 for e in ends} & set(shifted)) > 0.8 * len(ends)
    assert op.cuts(np.array([1], np.uint16)) == [1]
    assert max(np.diff([0, *op.cuts(np.zeros(20000, np.uint16))])) <= op.MAX_CHUNK


def test_store_round_trip(spark, odd, odd_rows, library):
    path = common.scratch_path(spark, "store")
    op.write_store(odd, path)
    want = sorted((tuple(ids_of(library, t)), -1 if i is None else i) for i, t in odd_rows)
    back = op.read_ids(spark, path).collect()
    assert sorted((tuple(r.ids), -1 if r.doc_id is None else r.doc_id) for r in back) == want
    rows = sorted(op.read_sums(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    sums = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert sums == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x, i in want)
    payloads = spark.read.parquet(f"{path}/chunks").filter("payload is not null")
    assert payloads.count() == payloads.select("digest").distinct().count() < spark.read.parquet(f"{path}/chunks").count()
    kept = {(r.level, r.part, r.place): r.root for r in spark.read.parquet(f"{path}/manifest").collect()}
    again = {(r.level, r.part, r.place): r.root for r in op.manifest(spark.read.parquet(f"{path}/recipes")).collect()}
    assert kept == again and sum(k[0] == 2 for k in kept) == 1


def test_a_changed_chunk_is_found(spark):
    path = common.scratch_path(spark, "store")
    op.write_store(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), path)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    bad = [(*r[:5], bytes(reversed(r.payload))) for r in chunks]
    spark.createDataFrame(bad, op.PIECE_ROW).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="doesn't match its digest"):
        op.read_sums(spark, path).collect()


def test_a_lost_chunk_is_found(spark):
    path = common.scratch_path(spark, "store")
    op.write_store(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"), path)
    kept = spark.read.parquet(f"{path}/chunks").filter("doc_id = 2").collect()
    spark.createDataFrame(kept, op.PIECE_ROW).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="can't be rebuilt"):
        op.read_sums(spark, path).collect()


def test_a_lost_recipe_is_found(spark):
    path = common.scratch_path(spark, "store")
    op.write_store(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"), path)
    recipes = spark.read.parquet(f"{path}/recipes")
    kept = spark.createDataFrame(recipes.filter("doc_id = 1").collect(), recipes.schema)
    kept.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        op.read_sums(spark, path)


def test_no_documents(spark, none):
    path = common.scratch_path(spark, "store")
    op.write_store(none, path)
    assert op.read_sums(spark, path).count() == 0


def test_chunks_of_documents_laid_end_to_end():
    rng = np.random.default_rng(7)
    documents = [rng.integers(0, 49000, int(n)).astype(np.uint16) for n in (1, 5000, 127, 128, 129, 9000, 1, 40, 20000)]
    documents.append(np.zeros(9000, np.uint16))
    got = op.cuts_of(np.concatenate(documents), np.cumsum([len(d) for d in documents]))
    assert got == [op.cuts(d) for d in documents]


def test_signs_behind_letters(library):
    rng = random.Random(8)
    words = ["".join(rng.choice("abzéßñE") for _ in range(rng.randint(1, 6))) + "".join(rng.choice("!#$%*._-^`|&@'<") for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    asked, store = [], op.WordIds(op.VOCABULARY)
    others, store._encode_others = store._encode_others, lambda some: asked.extend(some) or others(some)
    got = store.batch([" ".join(words)])[0]
    assert got.tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert not any(op._SIGNED.fullmatch(w) for w in asked)
