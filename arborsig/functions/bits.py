"""Column builders for bit signatures: arrays of 64-bit words, bit i in word i // 64 at place i % 64, lowest first.

Null signatures give null results everywhere; words are signed, their bits count.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = 64


def words_of(bits: int) -> int:
    if bits <= 0 or bits % WORD:
        raise ValueError(f"a signature of {bits} bits is not divisible by {WORD}")
    return bits // WORD


def check_bits(sig: Column, bits: int) -> Column:
    """``sig``, or an error at run time if it is null or hasn't ``bits`` bits."""
    n = words_of(bits)
    return F.when(F.coalesce(F.size(sig) == n, F.lit(False)), sig).otherwise(F.raise_error(F.lit(f"signature must have {n} words")).cast("array<bigint>"))


def pack(flags: Column, bits: int) -> Column:
    """Words from an array of booleans; null flags are 0."""
    one = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.when(F.get(flags, F.lit(w * WORD) + i), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))
    return F.array(*[one(w) for w in range(words_of(bits))])


def unpack(sig: Column) -> Column:
    """The bits as an array of 0 and 1."""
    places = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.flatten(F.transform(sig, lambda w: F.transform(places, lambda i: F.call_function("shiftrightunsigned", w, i).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))))


def get_bit(sig: Column, i: int) -> Column:
    return F.call_function("shiftrightunsigned", sig[i // WORD], F.lit(i % WORD)).bitwiseAND(F.lit(1).cast("bigint")).cast("int")


def set_bit(sig: Column, i: int) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(i % WORD))
    return F.transform(sig, lambda w, k: F.when(k == i // WORD, w.bitwiseOR(mask)).otherwise(w))


def or_word(sig: Column, k: int, word: Column) -> Column:
    """Puts the 1 bits of ``word`` into word k; bits that are 1 stay so."""
    return F.transform(sig, lambda w, i: F.when(i == k, w.bitwiseOR(word)).otherwise(w))


def fill(word: int, n: int) -> Column:
    return F.array_repeat(F.lit(word).cast("bigint"), n)


def popcount(sig: Column) -> Column:
    return F.aggregate(sig, F.lit(0).cast("bigint"), lambda acc, w: acc + F.bit_count(w))


def xor(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def invert(sig: Column) -> Column:
    return F.transform(sig, lambda w: F.bitwise_not(w))


def show(sig: Column) -> Column:
    """The bits of each word, highest first, in groups of 16."""
    return F.array_join(F.transform(sig, lambda w: F.regexp_replace(F.lpad(F.conv(w.cast("string"), 10, 2), WORD, "0"), "(.{16})(?=.)", "$1 ")), " ")


def gather(sig: Column, dims: list[int]) -> Column:
    """A signature of the bits ``dims`` of ``sig`` in the order given, filled up with 0 to whole words."""
    words = []
    for w in range(0, max(len(dims), 1), WORD):
        word = F.lit(0).cast("bigint")
        for place, d in enumerate(dims[w : w + WORD]):
            word = word.bitwiseOR(F.call_function("shiftleft", get_bit(sig, d).cast("bigint"), F.lit(place)))
        words.append(word)
    return F.array(*words)


def sign_bits(v: Column, bits: int) -> Column:
    """A signature of the signs of a vector's numbers: 1 where a number is above 0."""
    return pack(F.transform(v, lambda x: x > 0), bits)
