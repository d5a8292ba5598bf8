import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import SF, empty_docs, odd_docs, odd_rows, sample_texts

from voltaic.llm import byte_bpe, queries, token_orc


def whole_ids(texts, end_id=1):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.vocabulary(queries.WORD_BPE))
    return [e.ids + [end_id] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def expected_orc(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (i, _), ids in zip(rows, whole_ids([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1_matches_whole_text_encoding(spark):
    got = sorted(tuple(r) for r in queries.op1_token_orc(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_orc([(i, t) for i, t, _ in sample_texts()])


def test_op1_odd_rows_order_and_pruned_read(spark, tmpdir_path):
    path = tmpdir_path + "/orc"
    token_orc.write_tokens(odd_docs(spark), path, queries.vocabulary(queries.WORD_BPE), partitions=4, group_bytes=50)
    got = token_orc.token_digests(spark, path).collect()
    want = expected_orc([(r[0], r[1]) for r in odd_rows()])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == \
        sorted((i is not None, i or 0, n, c) for i, _, n, c in want)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    ids = [(r.start, r.doc_id) for r in got]
    assert [i for _, i in sorted(ids)] == [i for i, *_ in want]
    assert [r.doc_id for r in token_orc.read_tokens(spark, path, 9).collect()] == [9]
    plan = token_orc.read_tokens(spark, path, 9)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,9)" in plan
    token_orc.write_tokens(empty_docs(spark), path + "0", queries.vocabulary(queries.WORD_BPE))
    assert token_orc.token_digests(spark, path + "0").count() == 0


def test_op1_files_hold_bloom_filters_and_indexes(spark, tmpdir_path):
    import glob

    import pyarrow.orc
    path = tmpdir_path + "/orc"
    token_orc.write_tokens(odd_docs(spark), path, queries.vocabulary(queries.WORD_BPE), partitions=2)
    files = sorted(glob.glob(path + "/*.orc"))
    assert files
    for f in files:
        o = pyarrow.orc.ORCFile(f)
        assert o.row_index_stride == 1000 and str(o.schema.field("ids").type) == "list<item: int32>"


PIECES = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "中文", "🙂", "'s", "'ll", "12", "!!", "#", "\x1c", "\x85", "\u00a0", "\u2009",
          "\u3000", "xyz", "\x00", "İ", " \n", "٣", "e\u0301", "=\u0338", "unbelievably", "'", "Σ", ",'re", "’", "\x0b", "-", "A1b2"]


def random_texts(more=(), n=4000):
    rng = random.Random(1)
    texts = ["".join(rng.choice([*PIECES, *more]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return texts + ["a" * 5000, "abc" * 3000, "".join(rng.choice("abcdefghijklm") for _ in range(9000)), " " * 2000 + "x", "\n" * 999, "!" * 500]


@pytest.mark.parametrize("group_bytes", [1 << 20, 40])
def test_op1_equals_the_untouched_library_on_random_texts(group_bytes):
    texts = random_texts(["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "<|", "|>"])
    counts, ids = token_orc.Encoder(queries.vocabulary(queries.WORD_BPE), kept=100).encode([t.encode() for t in texts], group_bytes)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [i[:-1] for i in whole_ids(texts)]


@pytest.fixture(scope="module")
def merger():
    return byte_bpe.Merger(byte_bpe.load_ranks(queries.vocabulary(queries.MULTI_BPE)), queries.bpe_pattern())


def library(texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.load_ranks(queries.vocabulary(queries.MULTI_BPE)))
    return [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("group_bytes", [1 << 20, 40])
def test_op8_equals_the_library_on_random_texts(merger, group_bytes):
    texts = random_texts()
    assert merger.encode([t.encode() for t in texts], group_bytes) == library(texts)
    few = byte_bpe.Merger(merger.ranks, queries.bpe_pattern(), kept=30)
    assert few.encode([t.encode() for t in texts], group_bytes) == library(texts)
    assert len(few.known.number) == few.known.n == 30


def test_op8_equals_the_library_on_random_words(merger):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aeinorst éß") for _ in range(rng.randint(1, 60))).strip() for _ in range(20000)} - {""})
    counts, ids = merger.encode_words([w.encode() for w in words])
    enc = tiktoken.Encoding("own", pat_str="(?s).+", special_tokens={}, mergeable_ranks=merger.ranks)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(w) for w in words]


def test_op8_query_and_round_trip(spark):
    got = {r.doc_id: r for r in queries.op8_byte_bpe(spark, SF).collect()}
    rows = sample_texts()
    for (i, t, _), ids in zip(rows, library([t for _, t, _ in rows])):
        assert got[i].n_tokens == len(ids) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op8_odd_rows(spark):
    ranks = queries.vocabulary(queries.MULTI_BPE)
    got = byte_bpe.decode(byte_bpe.encode(odd_docs(spark), ranks, queries.bpe_pattern()), ranks).collect()
    want = library([r[1] for r in odd_rows()])
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == \
        sorted((str(r[0]), w, (r[1] or "").encode()) for r, w in zip(odd_rows(), want))
    assert byte_bpe.encode(empty_docs(spark), ranks, queries.bpe_pattern()).count() == 0
