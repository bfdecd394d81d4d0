import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tarn.llm import sharding

SCHEMA = "doc_id long, text string, shard string, tag string"


def test_matrix_has_the_sums():
    rows, columns = [5, 0, 7, 30], [11, 10, 10, 11]
    got = sharding.communication_matrix(rows, columns, 3)
    assert [sum(r) for r in got] == rows and [sum(c) for c in zip(*got, strict=True)] == columns


@pytest.mark.parametrize(("good", "bad", "drawn"), [(5, 7, 4), (1, 40, 30), (30, 3, 20), (400, 9600, 2500), (60, 60, 119)])
def test_draws_follow_the_hypergeometric_law(good, bad, drawn):
    random = np.random.Generator(np.random.PCG64(5))
    n = 20_000
    got = Counter(sharding._hypergeometric(random, good, bad, drawn) for _ in range(n))
    chance = lambda k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
    for k in range(max(0, drawn - bad), min(good, drawn) + 1):
        p = chance(k)
        assert abs(got[k] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 2, k


def test_the_law_is_the_same_beyond_1e9_rows():
    random = np.random.Generator(np.random.PCG64(6))
    good, bad, drawn = 10**11, 23 * 10**11, 10**8
    got = np.array([sharding._hypergeometric(random, good, bad, drawn) for _ in range(400)])
    mean, spread = drawn / 24, math.sqrt(drawn / 24 * 23 / 24)
    assert abs(got.mean() - mean) < 5 * spread / 20 and 0.8 < got.std() / spread < 1.2
    matrix = sharding.communication_matrix([10**9 + 7, 3 * 10**9, 5], [2 * 10**9, 2 * 10**9 + 12], 1)
    assert [sum(r) for r in matrix] == [10**9 + 7, 3 * 10**9, 5] and [sum(c) for c in zip(*matrix, strict=True)] == [2 * 10**9, 2 * 10**9 + 12]


def plain_matrix(owner, sizes, seed):
    """The same matrix by really shuffling all rows: the law that the drawn one follows."""
    rows = np.random.Generator(np.random.PCG64(seed)).permutation(np.repeat(np.arange(len(owner)), owner))
    cuts = np.cumsum([0, *sizes])
    return [[int((rows[a:b] == k).sum()) for a, b in zip(cuts, cuts[1:], strict=False)] for k in range(len(owner))]


def test_matrix_against_plain_shuffles():
    owner, sizes = [4, 1, 7], [5, 4, 3]
    drawn = Counter(str(sharding.communication_matrix(owner, sizes, k)) for k in range(6000))
    plain = Counter(str(plain_matrix(owner, sizes, k)) for k in range(6000))
    for matrix in drawn | plain:
        assert abs(drawn[matrix] - plain[matrix]) < 6 * math.sqrt(drawn[matrix] + plain[matrix]) + 3, matrix


def test_exact_sizes_gapless_slots_and_every_row_once(spark):
    rows = [(i, f"text {i % 9}", "old", None) for i in range(1000)] + [(None, None, None, "x")] * 7 + [(5, "text 5", "old", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shuffle_into_shards(docs, shards=24, block_rows=40).collect()
    assert Counter((r.doc_id, r.text, r.tag) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    assert got and sorted(map(tuple, sharding.shuffle_into_shards(docs.repartition(3), shards=24, block_rows=40).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_looks_uniform(spark):
    docs = spark.range(4800).selectExpr("id doc_id", "'same' text")
    got = sharding.shuffle_into_shards(docs, shards=24, block_rows=500)
    sums = [r[1] / 200 for r in got.groupBy("shard").agg({"doc_id": "sum"}).collect()]
    assert all(abs(x - 2400) < 500 for x in sums)  # five standard errors
    assert abs(got.stat.corr("doc_id", "slot")) < 0.08


def test_empty_and_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert sharding.shuffle_into_shards(docs).collect() == []
    few = sharding.shuffle_into_shards(spark.createDataFrame([(1, "a", "b", "c"), (2, None, "b", "c")], SCHEMA)).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "für"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op8_sharding(spark, str(tmp_path)).collect()}
    assert got[1].size == 12 and got[1].text_crc32 == zlib.crc32("für".encode()) and got[2].size == 8 and got[2].text_crc32 == 0
    assert got[1].law == "rows" and got[1].grown_shard is None


def test_maps_and_nested_columns_take_part_in_the_order(spark):
    docs = spark.range(60).selectExpr("id % 2 AS doc_id", "'same' AS text", "map('k', id) AS m", "array(named_struct('a', map(1, id))) AS nested", "parse_json(concat('{\"v\":', id, '}')) AS v")
    place = lambda d: {r.n: (r.shard, r.slot) for r in sharding.shuffle_into_shards(d, shards=5, block_rows=7).selectExpr("m['k'] AS n", "shard", "slot").collect()}
    first = place(docs)
    assert len(first) == 60 and first == place(docs.repartition(7)) and len(set(first.values())) == 60
