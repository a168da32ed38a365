import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, duck, same
from hypothesis import given, settings
from hypothesis import strategies as st

from spark_netwatch.llm import queries
from spark_netwatch.llm.common import join_by_weight
from spark_netwatch.llm.exact_dedup import DigestIndex, digests, exact_dedup
from spark_netwatch.llm.packing import pack, sequences
from spark_netwatch.llm.tokens import Ids

FILE = queries.tokenizer_file("byte_bpe_50k.json")


def test_exact_dedup_equals_sql(spark):
    assert same(queries.op10_exact_dedup(spark, SF).toPandas(), duck(queries.OP10_SQL))


def test_exact_dedup_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a", "z"), (None, "a", "z"), (5, "a", "z"), (5, "a", "z"), (7, "A", "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id string")).collect()
    found = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got))
    assert found == [(0, 5, 4, False), (1, 2, 2, False), (2, 2, 2, True), (3, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (7, 7, 1, True)]
    assert {r.digest for r in got if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_index_persists_and_turns_known_digests_away(spark, tmp_path):
    docs = lambda *rows: digests(spark.createDataFrame(rows, "doc_id long, text string"))
    DigestIndex(spark, str(tmp_path / "i"), 4).ingest(docs((1, "a"), (2, "b"), (3, "a")))
    again = DigestIndex(spark, str(tmp_path / "i"), 4)
    again.ingest(docs((9, "a"), (10, "c")))
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 3, 10]


def test_heavy_and_light_keys_join_alike(spark):
    left = spark.createDataFrame([(i % 7 if i < 50 else 99, i) for i in range(3000)], "k long, v long")
    right = left.groupBy("k").count()
    assert sorted(map(tuple, join_by_weight(left, right, "k", "count", 3000).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(FILE)
    ids = Ids(FILE)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.sampled_from(["<|endoftext|>", "x<|endoftext|> y", "half <|endoftext"]), st.text("ab 1.,'\n\t é中　\x85ﬁs", max_size=60)), max_size=20))
    def check(texts):
        flat, n = ids.encode(pa.array([*texts, "a  b <|endoftext|> it's\n c"], pa.string()))
        ends = np.cumsum(n)
        for t, a, b in zip([*texts, "a  b <|endoftext|> it's\n c"], ends - n, ends):
            assert flat[a:b].tolist() == reference.encode(t or "", add_special_tokens=False).ids

    check()


def test_packing(spark):
    texts = [None, "", "one two three " * 300, "a", "b c d", "a", "long " * 5000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    pieces = pack(docs, FILE, length=64).toPandas().sort_values(["sequence_id", "offset"])
    ids = Ids(FILE)
    for i, t in enumerate(texts):
        flat, _ = ids.encode(pa.array([t], pa.string()))
        own = pieces[pieces.doc_id == i].sort_values("start")
        whole = np.append(flat, 1).astype("<u4")
        assert own.doc_tokens.unique().tolist() == [len(whole)]
        assert np.concatenate(own.ids.tolist()).tolist() == whole.tolist()
        for p in own.itertuples():
            assert zlib.crc32(whole[p.start:p.start + p.length]) == p.ids_crc32
    ends = pieces.groupby("sequence_id").length.sum()
    assert (ends[:-1] == 64).all() and ends.index.tolist() == list(range(len(ends)))
    assert (pieces.offset == pieces.groupby("sequence_id").length.cumsum() - pieces.length).all()
    full = sequences(spark.createDataFrame(pieces[["sequence_id", "offset", "ids"]]), 64).orderBy("sequence_id").collect()
    assert [len(r.ids) for r in full[:-1]] == [64] * (len(full) - 1)
    assert len(full[-1].ids) in (64, full[-1].n_tokens)
    assert pack(docs.filter("doc_id < 0"), FILE).count() == 0


@pytest.mark.parametrize("n,padded", [(5, 8), (4, 4), (8, 8)])
def test_a_short_sequence_is_padded_unless_a_power_of_two(spark, n, padded):
    pieces = spark.createDataFrame([(0, 0, list(range(n)))], "sequence_id long, offset long, ids array<int>")
    assert len(sequences(pieces, 8).first().ids) == padded
