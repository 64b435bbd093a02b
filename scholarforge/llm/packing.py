"""Filling fixed-capacity containers with items (p8): minimum bin slack.

Sizes are tokens of a public tokenizer whose file is a parameter.  Items are spread
over shares of about ``share`` items by a hash of their keys, and every share is
packed by itself, so no task holds more than that.  In a share, a container is
opened with the largest item left; the room that remains is filled by subset-sum
dynamic programming over a window of the remaining lengths: a bitset tells which
fillings can be reached, the one closest to the capacity is taken, and backtracking
gives the count of every length used.

An item larger than the capacity is cut into full containers, and its rest is an
item like others.  Defined results: null and empty texts have size 0 and lie in the
first container of their share; every item is placed exactly once (pieces of a cut
item have numbers from 0); ties go to the lower key; an empty table gives no
container; repeated keys are separate items.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pattern that splits a text into the pieces of the byte-level vocabularies, as their publishers give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(path: str, pattern: str = PATTERN):
    """``text -> number of tokens`` of a byte-level BPE given by ranks; the vocabulary is read once a worker."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def fill(room: int, lengths: list[int], left: dict[int, int], window: int) -> list[int]:
    """Lengths, out of the ``left`` ones, that fill ``room`` as closely as a window of them allows.

    The window takes lengths from large to small, as long as they fit, until it has
    ``window`` items; a filling without slack ends it early.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    taken = 0
    for n in lengths:
        if n > room or taken >= window:
            if taken >= window:
                break
            continue
        count = min(left.get(n, 0), room // n, window - taken)
        taken += count
        k = 1
        while count > 0:  # binary splitting: k items of a length at once
            k = min(k, count)
            steps.append((n, k, reach))
            reach = (reach | (reach << (n * k))) & mask
            count -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            out += [n] * k
            total -= n * k
    return out


def pack(sizes: list[int], capacity: int, window: int = 256) -> list[list[int]]:
    """Containers as lists of places in ``sizes``; every size is between 1 and ``capacity``."""
    places: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        places[sizes[i]].append(i)
    left = {n: len(p) for n, p in places.items()}
    lengths = sorted(left, reverse=True)
    out = []
    first = 0
    while True:
        while first < len(lengths) and not left[lengths[first]]:
            first += 1
        if first == len(lengths):
            return out
        largest = lengths[first]
        left[largest] -= 1
        room = capacity - largest
        chosen = [largest]
        if room:
            live = [n for n in lengths[first:] if left[n]] if first % 64 == 0 else lengths[first:]
            fits = [n for n in live if n <= room and left[n]]
            best = fill(room, fits, left, window)
            if room - sum(best) > 0 and len(fits) > window:  # a second window, from the small end
                other = fill(room, fits[::-1], left, window)
                best = max(best, other, key=sum)
            for n in best:
                left[n] -= 1
            chosen += best
        out.append([places[n].pop() for n in chosen])


PLACED = T.StructType([
    T.StructField("limit_id", T.IntegerType()), T.StructField("container", T.StringType()), T.StructField("key", T.LongType()),
    T.StructField("piece", T.IntegerType()), T.StructField("tokens", T.LongType()),
])


def packed(sized: DataFrame, key: str, tokens: str, limits: list[tuple[int, int]], share: int = 20_000, window: int = 256) -> DataFrame:
    """``limit_id, container, key, piece, tokens``: where every item lies, for every ``(limit_id, capacity)``."""
    shares = max(1, -(-sized.count() // share))

    def place(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["key", "tokens"], kind="stable")
        no = int(items["share"].iloc[0])
        limit = int(items["limit_id"].iloc[0])
        capacity = int(items["capacity"].iloc[0])
        rows, rest = [], []
        made = 0
        for k, n in zip(items["key"], items["tokens"]):
            piece = 0
            while n > capacity:
                rows.append((f"{no}-{made}", k, piece, capacity))
                made, piece, n = made + 1, piece + 1, n - capacity
            if n or not piece:
                rest.append((k, piece, n))
        blank = [r for r in rest if not r[2]]
        rest = [r for r in rest if r[2]]
        for content in pack([r[2] for r in rest], capacity, window):
            rows += [(f"{no}-{made}", *rest[i]) for i in content]
            made += 1
        rows += [(f"{no}-0", *r) for r in blank]
        out = pd.DataFrame(rows, columns=["container", "key", "piece", "tokens"])
        out.insert(0, "limit_id", limit)
        return out

    bounds = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity")) for i, c in limits if c and c > 0])
    rows = sized.select(F.col(key).cast("long").alias("key"), F.col(tokens).cast("long").alias("tokens"), F.pmod(F.xxhash64(F.col(key), F.lit("share")), F.lit(shares)).alias("share"))
    rows = rows.withColumn("l", F.explode(bounds)).select("key", "tokens", "share", "l.*")
    return rows.groupBy("limit_id", "share").applyInPandas(place, PLACED)
