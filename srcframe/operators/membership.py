"""Exact membership tests in the scan, by a cascade of bitsets.

A set of keys becomes a bitset (a Bloom filter): partial aggregation in tasks, then a union
of bitmaps, so its size depends on the number of keys and not on what else is in the rows.
The bitset is broadcast and tested where the rows are read, so rows that are tested, with
their texts, are not shuffled.

A bitset also lets some other keys pass. Those that do are counted out by narrow keys and
make the next bitset, which in turn lets some members pass, and so on; each level is a small
part of the one before. A key belongs to the set if the first level that does not hold it has
an odd number (counted from 0). So the answer is exact.

The first level has ``BITS`` bits for each key. Where that is more than a broadcast may hold
the caller joins by key instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from srcframe.session import BITSET_BYTES, materialize

# Bits for each key, and places of a key among them.
BITS, HASHES = 16, 3
# Bits of one bitmap of Spark's bitmap functions.
_BITMAP = 32768


class Cascade:
    """Levels of stored bitsets over the keys ``on``."""

    def __init__(self, on: Sequence[str], levels: list[tuple[DataFrame, int]]):
        self.on, self.levels = list(on), levels

    def member(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the boolean column ``name``: whether its key is in the set."""
        out = df
        flags = []
        for number, (bitset, bits) in enumerate(self.levels):
            flags.append(f"{name}_{number}")
            out = _tested(out, self.on, bitset, bits, number, flags[-1])
        found = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(flags))):
            found = F.when(~F.col(flags[number]), F.lit(number % 2 == 1)).otherwise(found)
        return out.withColumn(name, found).drop(*flags)


def _places(on: Sequence[str], bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), *on), F.lit(bits)) for i in range(HASHES)]


def bitset_of(keys: DataFrame, on: Sequence[str], bits: int, level: int = 0) -> DataFrame:
    """(number, bits): the bitmaps that have a bit set, 4 KB each."""
    places = keys.select(F.explode(F.array(*_places(on, bits, level))).alias("place"))
    return places.groupBy(F.bitmap_bucket_number("place").alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def _has_bit(bitmap: Column, place: Column) -> Column:
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
    return byte.bitwiseAND(mask) != 0


def _tested(df: DataFrame, on: Sequence[str], bitset: DataFrame, bits: int, level: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether all places of the key are set. The bitset is broadcast."""
    out, flags = df, []
    for i, place in enumerate(_places(on, bits, level)):
        number, held, flag = f"{name}_n{i}", f"{name}_b{i}", f"{name}_f{i}"
        side = F.broadcast(bitset.select(F.col("number").alias(number), F.col("bits").alias(held)))
        out = out.join(side, F.bitmap_bucket_number(place) == F.col(number), "left")
        out = out.withColumn(flag, F.coalesce(_has_bit(F.col(held), place), F.lit(False))).drop(number, held)
        flags.append(flag)
    whole = F.col(flags[0])
    for flag in flags[1:]:
        whole = whole & F.col(flag)
    return out.withColumn(name, whole).drop(*flags)


def bits_for(keys: int) -> int:
    return -(-max(1, keys) * BITS // _BITMAP) * _BITMAP


def cascade(members: DataFrame, others: DataFrame, on: Sequence[str], limit: int | None = None) -> Cascade | None:
    """The cascade that tells ``members`` from ``others`` (both narrow and stored, no key in both).

    None if the first level would need more than ``limit`` bytes.
    """
    inside, outside, levels = members, others, []
    while True:
        count = inside.count()
        if not count:
            return Cascade(on, levels)
        bits = bits_for(count)
        if bits // 8 > (BITSET_BYTES if limit is None else limit):
            return None
        level = len(levels)
        bitset = materialize(bitset_of(inside, on, bits, level))
        levels.append((bitset, bits))
        passed = materialize(_tested(outside, on, bitset, bits, level, "_in").where("_in").select(*on))
        inside, outside = passed, inside


def likely(df: DataFrame, members: DataFrame, on: Sequence[str], limit: int | None = None) -> DataFrame:
    """The rows of ``df`` that a bitset of ``members`` lets pass, in the scan: all members and few others.

    For members too many for a bitset, ``df`` as it is.
    """
    bits = bits_for(members.count())
    if bits // 8 > (BITSET_BYTES if limit is None else limit):
        return df
    bitset = materialize(bitset_of(members, on, bits))
    return _tested(df, on, bitset, bits, 0, "_likely").where("_likely").select(*[f"`{c}`" for c in df.columns])


def keep_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is among ``members`` (unique keys), tested in the scan."""
    return _split(df, members, on, True)


def drop_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is not among ``members``, tested in the scan."""
    return _split(df, members, on, False)


def _split(df: DataFrame, members: DataFrame, on: Sequence[str], wanted: bool) -> DataFrame:
    members = materialize(members.select(*on))
    others = materialize(df.select(*on).join(members, list(on), "left_anti"))
    held = cascade(members, others, on)
    if held is None:
        return df.join(members, list(on), "left_semi" if wanted else "left_anti")
    marked = held.member(df, "_member")
    return marked.where(F.col("_member") if wanted else ~F.col("_member")).select(*[f"`{c}`" for c in df.columns])
