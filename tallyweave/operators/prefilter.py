"""A filter by key that needs no shuffle of the rows it is applied to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the table that is broadcast: 131,072 rows of 64 bits at most, whatever the number of keys.
BITS = 1 << 23


def _word(hashed: Column, bits: int) -> Column:
    """Never null, so that no join asks for that below itself."""
    return F.coalesce(F.pmod(hashed, F.lit(bits // 64)), F.lit(0).cast("long"))


def _bit(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(63)).cast("int")


def likely_members(df: DataFrame, key: Column, members: DataFrame, member: Column, bits: int = BITS) -> DataFrame:
    """The rows whose key is among the members' keys, and a few others.

    The members' keys set bits in a table of fixed size, which is broadcast; rows whose
    bit is not set go before anything costly is done to them.  No wanted row is lost.
    The more members, the more other rows pass, up to all of them: then the filter
    costs its pass over the members and saves nothing.  Rows and members without a key go.
    """
    word, mask, hashed = "_prefilter_word", "_prefilter_bits", "_prefilter_hash"
    # Members without a key set no bit.  A filter would be pushed below the key and evaluate
    # one parsed from a document again for every test it consists of.
    hashes = members.select(F.when(member.isNotNull(), F.xxhash64(member)).alias(hashed))
    table = hashes.groupBy(_word(F.col(hashed), bits).alias(word)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(hashed)))).alias(mask))
    asked = F.xxhash64(key)
    hit = F.call_function("shiftrightunsigned", F.col(mask), _bit(asked)).bitwiseAND(F.lit(1).cast("long")) == 1
    return df.join(F.broadcast(table), (_word(asked, bits) == F.col(word)) & key.isNotNull()).where(hit).drop(word, mask)
