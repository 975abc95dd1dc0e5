import numpy as np
import pytest
from pyspark.sql import functions as F

from arborsig.functions import bits, vectors
from arborsig.functions.distance import EUCLIDEAN, EUCLIDEAN_SQ, HAMMING
from arborsig.operators.nearest import arg_nearest, distances, nearest
from arborsig.operators.prototype import majority_words, prototypes


def sigs(spark, rows):
    return spark.createDataFrame([(i, s if s is None else [s] if isinstance(s, int) else s) for i, s in enumerate(rows)], "id bigint, sig array<bigint>")


def test_hamming_values_and_squares(spark):
    assert HAMMING.matrix(HAMMING.rows([[0x0F], [0]]), HAMMING.rows([[0xF0], [-1]])).tolist() == [[8, 60], [4, 64]]
    got = [tuple(r) for r in distances(sigs(spark, [0x0F]), [(0xF0,)], squared=True).select("idx", "dist").collect()]
    assert got == [(0, 64)]


def test_wide_signatures_by_both_strategies(spark):
    rng = np.random.default_rng(0)
    rows = rng.integers(-(2**63), 2**63 - 1, size=(40, 4)).tolist()
    df, keys = sigs(spark, rows), [tuple(r) for r in rows[:7]]
    a = sorted(map(tuple, nearest(df, keys, strategy="sql").select("id", "idx", "dist").collect()))
    b = sorted(map(tuple, nearest(df, keys, strategy="arrow").select("id", "idx", "dist").collect()))
    assert a == b and [r[1] for r in a[:7]] == list(range(7))


@pytest.mark.parametrize("greatest", [False, True])
def test_ties_go_to_the_first_key(spark, greatest):
    keys = [(0b0000,), (0b0110,), (0b1111,)]
    for strategy in ("sql", "arrow"):
        assert nearest(sigs(spark, [0b0011]), keys, greatest=greatest, strategy=strategy).first()["idx"] == 0


def test_null_objects_and_no_keys(spark):
    for strategy in ("sql", "arrow"):
        rows = {r["id"]: r["idx"] for r in nearest(sigs(spark, [None, 3]), [(3,)], strategy=strategy).collect()}
        assert rows == {0: None, 1: 0}
    with pytest.raises(ValueError):
        nearest(sigs(spark, [1]), [])


def test_euclidean(spark):
    df = spark.createDataFrame([(0, [0.0, 3.0])], "id bigint, v array<double>")
    assert distances(df, [(4.0, 0.0)], "v", EUCLIDEAN).first()["dist"] == 5.0
    assert distances(df, [(4.0, 0.0)], "v", EUCLIDEAN_SQ).first()["dist"] == 25.0
    assert arg_nearest(np.array([[0.0, 3.0]]), np.array([[4.0, 0.0], [0.0, 2.0]]), EUCLIDEAN)[0].tolist() == [1]


def test_majority_is_strict(spark):
    rows = [("a", 0b01, 1), ("a", 0b10, 1), ("b", 0b011, 1), ("b", 0b001, 1), ("b", 0b111, 1), ("c", 0b01, 3), ("c", 0b10, 1), ("d", 0b01, 2), ("d", 0b10, 2)]
    df = spark.createDataFrame([(g, [s], w) for g, s, w in rows] + [("a", None, 1), (None, [1], 1)], "g string, sig array<bigint>, w int")
    assert {r["g"]: r["key"][0] for r in prototypes(df, "g", weight="w").collect()} == {"a": 0, "b": 0b011, "c": 0b01, "d": 0}
    assert majority_words(np.array([2] + [0] * 63), 3) == (1,)


def test_mean_and_empty_input(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 3), ("a", [5.0, 2.0], 1)], "g string, v array<double>, w int")
    assert prototypes(df, "g", "v", "w", bits=False).first()["key"] == [2.0, 2.0]
    assert prototypes(df.limit(0), "g", "v", bits=False).count() == 0


def test_bit_columns(spark):
    df = sigs(spark, [[-1, 1], [1 << 62, -(2**63)]])
    s = F.col("sig")
    rows = df.select(bits.popcount(s).alias("n"), bits.get_bit(s, 127).alias("top"), bits.set_bit(s, 64)[1].alias("set"), bits.invert(s)[0].alias("inv"), F.size(bits.unpack(s)).alias("size"), bits.show(s).alias("text")).collect()
    assert [r["n"] for r in rows] == [65, 2] and [r["top"] for r in rows] == [0, 1] and [r["set"] for r in rows] == [1, -(2**63) + 1]
    assert [r["inv"] for r in rows] == [0, ~(1 << 62)] and rows[0]["size"] == 128 and rows[0]["text"].endswith("0000000000000001")
    back = df.select(bits.pack(F.transform(bits.unpack(s), lambda b: b == 1), 128).alias("p"), "sig").collect()
    assert all(r["p"] == r["sig"] for r in back)


def test_signature_length_is_checked(spark):
    with pytest.raises(ValueError, match="not divisible by 64"):
        bits.words_of(100)
    with pytest.raises(Exception, match="must have 2 words"):
        sigs(spark, [1]).select(bits.check_bits(F.col("sig"), 128)).collect()


def test_vector_columns(spark):
    v = F.col("v")
    r = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(vectors.add(v, v).alias("a"), vectors.add_mult(v, v, -1).alias("m"), vectors.scale(v, 3).alias("s"), vectors.put(v, 1, 9.0).alias("p"), vectors.fill(1.5, 2).alias("f")).first()
    assert (r["a"], r["m"], r["s"], r["p"], r["f"]) == ([2, 4], [0, 0], [3, 6], [1, 9], [1.5, 1.5])
