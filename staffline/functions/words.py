"""Sets of small integers packed into 32-bit words held in BIGINT columns.

A row of a piano roll is a set of steps and a chord is a set of pitches. Packed
into words they aggregate with ``bit_or``, which combines before the shuffle,
needs no sort and keeps a fixed-size buffer, however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 32
_FULL = (1 << WIDTH) - 1


def word_count(size: int) -> int:
    return -(-size // WIDTH)


def collect_words(value: Column, size: int, when: Column | None = None) -> list[Column]:
    """One ``bit_or`` aggregate per word; values outside [0, size) are ignored."""
    out = []
    for w in range(word_count(size)):
        lo, hi = w * WIDTH, min(size, (w + 1) * WIDTH)
        inside = (value >= lo) & (value < hi)
        if when is not None:
            inside = inside & when
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (value - lo).cast("int"))
        out.append(F.coalesce(F.bit_or(F.when(inside, bit)), F.lit(0).cast("bigint")))
    return out


def named(words: Sequence[Column], prefix: str) -> list[Column]:
    return [w.alias(f"{prefix}{i}") for i, w in enumerate(words)]


def columns(prefix: str, size: int) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(word_count(size))]


def count(words: Sequence[Column]) -> Column:
    total = F.bit_count(words[0])
    for w in words[1:]:
        total = total + F.bit_count(w)
    return total


def shift_up(words: Sequence[Column], by: int) -> list[Column]:
    """Add ``by`` to every member; members past the last word fall off."""
    skip, bits = divmod(by, WIDTH)
    zero = F.lit(0).cast("bigint")
    out = []
    for i in range(len(words)):
        src = i - skip
        if src < 0:
            out.append(zero)
            continue
        if bits == 0:
            out.append(words[src])
            continue
        moved = F.shiftleft(words[src], bits).bitwiseAND(F.lit(_FULL))
        if src > 0:
            moved = moved.bitwiseOR(F.shiftright(words[src - 1], WIDTH - bits))
        out.append(moved)
    return out


def intersect(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x.bitwiseAND(y) for x, y in zip(a, b)]


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(a, b)]


def members(words: Sequence[Column], size: int) -> Column:
    """Ascending array of the members."""
    word = F.array(*words)
    return F.filter(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.getbit(
            F.get(word, F.floor(i / WIDTH).cast("int")), (i % WIDTH).cast("int")
        )
        == 1,
    )
