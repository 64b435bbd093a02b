"""Evaluation texts leaking into training text (p9): a distributed positional inverted index.

The index is partitioned by document: a shard holds some thousand documents, and a
row of it one term with all its postings there (document and position).  A query
reads the rows of the test terms only and works shard by shard: starting from the
rarest term of every window of a test item, it takes that term's postings as
offsets of the item in a document and intersects them with the offset-adjusted
postings of the neighbouring terms, until runs of ``least`` consecutive words are
left.  With ``slack`` > 0, a term matches anywhere within that many words of its
place, and ``least`` of ``window`` terms must match (proximity).

Every posting of every document is indexed; no term is left out as too frequent.
Test items are taken in blocks of at most ``block_words`` words, so that what is
broadcast stays bounded.  Defined results: null and empty texts and items match
nothing; items shorter than ``least`` words match nothing; repeated ids are
reported once; empty tables give empty results; whole texts are indexed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.runtime import stage

_TOKEN = re.compile(r"\w+")
_INDEX = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("docs", T.BinaryType()), T.StructField("positions", T.BinaryType())])
#: The row of a shard that holds the keys of its documents instead of postings.
_KEYS = ""
_SHIFT = 1 << 24


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _TOKEN.findall(text.lower()) if text else []


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("positions", pa.binary())])
    part = TaskContext.get().partitionId()
    codes: dict[str, int] = {}
    for number, batch in enumerate(batches):
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        if len(codes) > 2_000_000:
            codes.clear()
        found, sizes = [], np.zeros(len(keys), dtype=np.int64)
        for i, text in enumerate(batch.column(1)):
            tokens = words(text.as_py())
            sizes[i] = len(tokens)
            found.append(np.fromiter((codes.setdefault(w, len(codes)) for w in tokens), dtype=np.int64, count=len(tokens)))
        if not len(keys):
            continue
        names = list(codes)
        code = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(code, kind="stable")
        doc = np.repeat(np.arange(len(keys), dtype="<i4"), sizes)[order]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pos = (np.arange(len(code)) - np.repeat(starts, sizes)).astype("<i4")[order]
        code = code[order]
        edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, dtype=np.int64)
        shard = (part << 32) + number
        terms = [_KEYS, *(names[code[a]] for a in edges[:-1])]
        docs = [keys.tobytes(), *(doc[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:]))]
        places = [b"", *(pos[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:]))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard)), pa.array(terms), pa.array(docs, pa.binary()), pa.array(places, pa.binary())], schema=kind)


def build_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """The positional inverted index of ``text``, stored in the shared folder; no exchange takes place."""
    return stage(df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_postings, _INDEX), "index")


class Shard:
    """Postings of the test terms in one shard, each as ``document * 2^32 + position``, sorted."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.keys = np.zeros(0, dtype="<i8")
        self.lists: dict[str, np.ndarray] = {}
        for term, docs, places in zip(rows["term"], rows["docs"], rows["positions"]):
            if term == _KEYS:
                self.keys = np.frombuffer(docs, dtype="<i8")
            else:
                self.lists[term] = (np.frombuffer(docs, dtype="<i4").astype(np.int64) << 32) + np.frombuffer(places, dtype="<i4") + _SHIFT

    def has(self, term: str, at: np.ndarray, slack: int) -> np.ndarray:
        """Whether ``term`` stands at, or within ``slack`` words of, each of the places ``at``."""
        posts = self.lists.get(term)
        if posts is None:
            return np.zeros(len(at), dtype=bool)
        i = np.searchsorted(posts, at - slack)
        return (i < len(posts)) & (posts[np.minimum(i, len(posts) - 1)] <= at + slack)


_MATCH = T.StructType([T.StructField("key", T.LongType()), T.StructField("item", T.LongType()), T.StructField("matched", T.LongType())])


def _search(shard: Shard, item: list[str], least: int, window: int, slack: int) -> dict[int, int]:
    """Documents of the shard (by ordinal) that hold the item, with the most words matched in a run or window."""
    n = len(item)
    if n < window:
        return {}
    count = [len(shard.lists.get(w, ())) for w in item]
    if slack == 0:
        anchors = {min(range(s, s + window), key=lambda j: (count[j], j)) for s in range(n - window + 1)}
    else:  # any window - least terms may be missing: so many rarest ones and one more must be tried
        anchors = {j for s in range(n - window + 1) for j in sorted(range(s, s + window), key=lambda j: (count[j], j))[: window - least + 1]}
    out: dict[int, int] = {}
    for j in sorted(anchors):
        at = shard.lists.get(item[j])
        if at is None:
            continue
        if slack == 0:
            run = np.ones(len(at), dtype=np.int64)
            for step in (1, -1):
                alive = np.arange(len(at))
                k = j + step
                while 0 <= k < n and len(alive):
                    alive = alive[shard.has(item[k], at[alive] + (k - j), 0)]
                    run[alive] += 1
                    k += step
        else:
            lo, hi = max(0, j - window + 1), min(n, j + window)
            hit = np.stack([shard.has(item[k], at + (k - j), slack) for k in range(lo, hi)], axis=1)
            total = np.cumsum(np.concatenate([np.zeros((len(at), 1), dtype=np.int64), hit], axis=1), axis=1)
            spans = [total[:, min(s + window, hi) - lo] - total[:, s - lo] for s in range(lo, j + 1) if s + window <= hi]
            run = np.max(spans, axis=0) if spans else np.zeros(len(at), dtype=np.int64)
        for d, r in zip(at[run >= least] >> 32, run[run >= least]):
            out[int(d)] = max(out.get(int(d), 0), int(r))
    return out


def _matcher(block: list[tuple[int, list[str]]], least: int, window: int, slack: int):
    def match(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows)
        found = [(int(shard.keys[d]), item, r) for item, tokens in block for d, r in _search(shard, tokens, least, window, slack).items()]
        return pd.DataFrame(found, columns=["key", "item", "matched"]).astype("int64")

    return match


def find(index: DataFrame, items: DataFrame, item_key: str, item_text: str, least: int = 12, window: int | None = None, slack: int = 0, block_words: int = 200_000) -> DataFrame:
    """``key, item, matched``: documents of the index that hold at least ``least`` words of an item.

    ``matched`` is the longest run of consecutive words (``slack`` 0), or the most
    terms matched in a window of ``window`` words.
    """
    window = window or least
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for row in items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).where("k is not null").toLocalIterator():
        tokens = words(row["t"])
        if len(tokens) < window:
            continue
        if size + len(tokens) > block_words and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row["k"], tokens))
        size += len(tokens)
    spark = index.sparkSession
    out = None
    for block in blocks:
        terms = sorted({w for _, tokens in block for w in tokens} | {_KEYS})
        wanted = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": terms}), "term string"))

        part = index.join(wanted, "term", "left_semi").groupBy("shard").applyInPandas(_matcher(block, least, window, slack), _MATCH)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key", "item").agg(F.max("matched").alias("matched"))
