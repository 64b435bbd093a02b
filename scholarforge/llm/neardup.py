"""Near-duplicate records with small edits (p5): tensored banding of minhashes.

Documents are sets of hashed word n-grams.  Exact copies (equal sets) are grouped
first and one of each group, its representative, goes on.  Two small collections of
``m`` and ``2 m`` sub-keys are made of ``width`` minhashes each; a table's key combines one
sub-key of either collection, so ``2 m * m`` tables need only ``3 * m * width``
minhashes.  Pairs that share a key are candidates, and every candidate is verified
on the whole sets.

A pair of similarity s agrees in i sub-keys of the one collection (m of them) and in j of
the other (2 m), both binomial with s^width, and meets in i * j tables; it is a candidate
if it meets in three tables of one sub-key of the first and if neither the sizes of the
sets nor the minhashes of the second collection rule the threshold out (three deviations
below the mean at the threshold).  With m = 16 and width = 2 a pair is found with a
probability of 0.98 at 0.5, 0.999 at 0.6, 0.9999 at 0.7.

Only the m sub-keys of the first collection are exchanged, each with all of the second
beside it; the tables are formed where documents with an equal first sub-key meet, so
that the exchange grows with m and not with m * m.  No bucket is capped: the documents of a
first sub-key that very many hold are cut into blocks by hash, and every pair of blocks is
met on its own in the same way, so that only pairs that pass all tests are ever written.
Every candidate is verified on its whole sets.

Defined results: documents with fewer than ``least_words`` words (or than n words)
belong to no pair and to a class of their own, but with ``whole`` equal texts of fewer than
n words (no words: equal signs) are copies; null and blank texts are alone likewise; an id
that is repeated is one document for every different text; empty tables give empty
results; whole texts are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.runtime import small_batches, stage

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], n: int, whole: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct hashes of all word n-grams of every text, and its number of words; words are cut by Arrow.

    ``whole``: a text of fewer than ``n`` words is one hash, that of all its words (no words: of its signs).
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), pattern=r"[^\pL\pN_]+", replacement=" ")
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    flat = parts.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)[flat.indices.to_numpy(zero_copy_only=False)]
    counts = np.array(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    counts[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False) | pc.equal(plain, " ").to_numpy(zero_copy_only=False)] = -1
    grams = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        grams = _mix(grams * _A + hashes[k : len(grams) + k] + _B)
    sets, at = [], 0
    for i, c in enumerate(counts):
        size = max(int(c), 0)
        if size >= n:
            own = np.sort(grams[at : at + size - n + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif whole and texts[i] and texts[i].strip():
            said = _mix(hashes[at : at + size] + np.arange(1, size + 1, dtype=np.uint64) * _A).sum(dtype=np.uint64, keepdims=True) if size else np.array([xxhash.xxh64_intdigest(texts[i].strip())], dtype=np.uint64)
            sets.append(_mix(said * _B + np.uint64(size)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        at += 1 if c < 0 else size  # an empty text is one empty word
    counts[counts < 0] = 0
    return sets, counts


def _seeds(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * _A)


def minhashes(sets: list[np.ndarray], seeds: np.ndarray, chunk: int = 60_000) -> np.ndarray:
    """Sets x minhashes. The sets hold well-mixed hashes and are not empty."""
    least = np.empty((len(sets), len(seeds)), dtype=np.uint64)
    at = 0
    while at < len(sets):  # so many sets at a time as stay in the processor's cache
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= chunk):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets[at:end]])[:-1]])
        for k, seed in enumerate(seeds):
            least[at:end, k] = np.minimum.reduceat(flat * (seed | np.uint64(1)), starts)
        at = end
    return least


def sub_keys(least: np.ndarray, width: int) -> np.ndarray:
    """Sets x sub-keys; a sub-key combines ``width`` minhashes."""
    parts = least.reshape(len(least), -1, width)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(width):
        out = _mix(out * _B + parts[:, :, k])
    return out


SKETCH = T.StructType([T.StructField("set_hash", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("text", T.StringType())])
#: Sub-keys of the second collection for each of the first; a pair must meet in LEAST_TABLES tables of one first sub-key.
SECOND, LEAST_TABLES = 2, 3


def sketch_udf(n: int, m: int, width: int, least_words: int, prepare: Callable[[str], str] | None = None, whole: bool = False):
    """``text -> (set_hash, keys, prepared text)``, null for texts with fewer words than ``least_words``.

    ``keys``: m sub-keys of 8 bytes, one byte of each minhash of SECOND * m others, and the size of the set.
    ``whole``: texts of fewer than ``n`` words are sets of one hash, that of all their words.
    """

    @F.pandas_udf(SKETCH)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seeds = _seeds((1 + SECOND) * m * width)
        for texts in batches:
            own = [prepare(t) if prepare and t else t for t in texts]
            rows: list[tuple] = [(None, None, None)] * len(own)
            found, counts = shingles(own, n, whole)
            places = [i for i, c in enumerate(counts) if len(found[i]) and (c >= max(least_words, n) or whole and c < n)]
            if places:
                sets = [found[i] for i in places]
                least = minhashes(sets, seeds)
                first = sub_keys(least[:, : m * width], width).view(np.uint8)
                second = _mix(least[:, m * width :]).astype(np.uint8)
                sizes = np.array([len(x) for x in sets], dtype="<u4")[:, None].view(np.uint8)
                for i, own_set, k in zip(places, sets, np.concatenate([first, second, sizes], axis=1)):
                    rows[i] = (xxhash.xxh64_intdigest(own_set.tobytes()) - (1 << 63), k.tobytes(), own[i])
            yield pd.DataFrame(rows, columns=["set_hash", "keys", "text"])

    return sketch


def _pack(values: np.ndarray, width: int = 5) -> bytes:
    return np.unique(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int = 5) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two packed sets."""
    if a == b:
        return 1.0
    x, y = _unpack(a), _unpack(b)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(x) + len(y) - shared)


def set_udf(n: int):
    """``text -> packed set``: the distinct n-gram hashes, 40 bits each, which tell the n-grams of a pair apart."""

    @F.pandas_udf(T.BinaryType())
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_pack(x >> np.uint64(24)) for x in shingles(list(texts), n, whole=True)[0]], dtype=object)

    return packed


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")


_SENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rows", T.BinaryType())])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _record(m: int, width: int) -> np.dtype:
    """What a document sends for one sub-key of the first collection: it, the id, the size, all sub-keys of the second."""
    return np.dtype([("x", "<u8"), ("id", "<i8"), ("size", "<u4"), ("y", "u1", (SECOND * m, width))])


def _records(batch: pa.RecordBatch, m: int, width: int) -> np.ndarray:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(ids), 8 * m + SECOND * m * width + 4)
    out = np.empty((len(ids), m), dtype=_record(m, width))
    out["x"] = np.ascontiguousarray(raw[:, : 8 * m]).view("<u8")
    out["id"] = ids[:, None]
    out["size"] = np.ascontiguousarray(raw[:, -4:]).view("<u4")
    out["y"] = raw[:, 8 * m : -4].reshape(len(ids), 1, SECOND * m, width)
    return out.reshape(-1)


def _second(rows: np.ndarray) -> np.ndarray:
    """Rows x sub-keys of the second collection."""
    y = rows["y"]
    out = np.zeros(y.shape[:2], dtype=np.uint16 if y.shape[2] <= 2 else np.uint64)
    for k in range(y.shape[2]):
        out = (out << out.dtype.type(8)) | y[:, :, k]
    return out


def _edges(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def _send(m: int, width: int, parts: int, hot: np.ndarray):
    """Rows packed by the task that will meet them; rows of hot sub-keys go another way."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("part", pa.int32()), ("rows", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _records(batch, m, width)
            if len(hot):
                rows = rows[~np.isin(rows["x"], hot)]
            to = ((rows["x"] >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            rows, to = rows[order], to[order]
            at = _edges(to) if len(to) else np.zeros(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to[at[:-1]].astype(np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], schema=kind)

    return walk


def _alike(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sizes of the sets and all minhashes of the second collection let a pair reach the threshold."""
    same = (left["y"] == right["y"]).reshape(len(left), left["y"].shape[1] * left["y"].shape[2])
    hashes = same.shape[1]
    enough = hashes * threshold - 3 * np.sqrt(hashes * threshold * (1 - threshold))  # three deviations below the mean at the threshold
    return (np.minimum(left["size"], right["size"]) >= threshold * np.maximum(left["size"], right["size"])) & (same.sum(axis=1) >= enough)


def _tiles(a: np.ndarray, b: np.ndarray | None, least: int, threshold: float, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs between the rows ``a`` and ``b`` (``None``: within ``a``) that share ``least`` second sub-keys, tile by tile.

    Rows come in the order of their sizes; tiles whose sizes rule the threshold out are left out.
    """
    within, b = b is None, a if b is None else b
    x, y = (np.ascontiguousarray(_second(rows).T) for rows in (a, b))
    count = np.uint8 if len(x) < 256 else np.uint16
    for lo in range(0, len(a), tile):
        hi_a = min(lo + tile, len(a))
        for hi in range(lo if within else 0, len(b), tile):
            hi_b = min(hi + tile, len(b))
            if a["size"][hi_a - 1] < threshold * b["size"][hi]:
                break
            if b["size"][hi_b - 1] < threshold * a["size"][lo]:
                continue
            shared = np.zeros((hi_a - lo, hi_b - hi), dtype=count)
            same = np.empty(shared.shape, dtype=bool)
            for p, q in zip(x[:, lo:hi_a], y[:, hi:hi_b]):
                np.equal(p[:, None], q, out=same)
                shared += same.view(np.uint8)
            left, right = np.nonzero(shared >= least)
            once = (left < right) if within and lo == hi else slice(None)
            yield left[once] + lo, right[once] + hi


def _pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Ids, the lesser first, of the pairs of rows that are alike."""
    hit = _alike(a, b, threshold) & (a["id"] != b["id"])
    return np.stack([np.minimum(a["id"], b["id"])[hit], np.maximum(a["id"], b["id"])[hit]], axis=1)


def _meet(m: int, width: int, least: int, threshold: float):
    """Pairs of one task that share a first sub-key and ``least`` second ones and are alike; large groups are met tile by tile."""

    def meet(sent: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(sent["rows"]), dtype=_record(m, width))
        rows = rows[np.argsort(rows["x"], kind="stable")]
        second = _second(rows)
        edges = _edges(rows["x"]) if len(rows) else np.zeros(1, dtype=np.int64)
        size, start = np.diff(edges), edges[:-1]
        found = [np.zeros((0, 2), dtype=np.int64)]

        for n in np.unique(size[(size > 1) & (size <= 32)]):
            i, j = np.triu_indices(n, 1)
            of_size, step = start[size == n], max(1, 100_000 // len(i))
            for at in range(0, len(of_size), step):
                left, right = (of_size[at : at + step, None] + i).ravel(), (of_size[at : at + step, None] + j).ravel()
                hit = (second[left] == second[right]).sum(axis=1) >= least
                found.append(_pairs(rows[left[hit]], rows[right[hit]], threshold))
        for at, n in zip(start[size > 32], size[size > 32]):
            own = rows[at : at + n]
            own = own[np.argsort(own["size"], kind="stable")]
            found += [_pairs(own[left], own[right], threshold) for left, right in _tiles(own, None, least, threshold)]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return meet


#: Documents of a hot sub-key that stand in one block.
BLOCK = 16_384
_BLOCKS = T.StructType([T.StructField("x", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("rows", T.BinaryType())])


def _send_blocks(m: int, width: int, hot: np.ndarray, of: np.ndarray):
    """Rows of the hot sub-keys, each in its block (by hash of the id, of ``of`` blocks), once for every pair of blocks it stands in."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _records(batch, m, width) if batch.num_rows else np.zeros(0, dtype=_record(m, width))
            rows = rows[np.isin(rows["x"], hot)]
            key = np.searchsorted(hot, rows["x"])
            no = _mix(rows["id"].view(np.uint64) * _A) % of[key].astype(np.uint64)
            order = np.lexsort([no, key])
            rows, key, no = rows[order], key[order], no[order].astype(np.int64)
            at = _edges(key * (int(of.max()) + 1) + no) if len(rows) else np.zeros(1, dtype=np.int64)
            out: list[tuple] = []
            for i, j in zip(at[:-1], at[1:]):
                x, own, packed = int(rows["x"][i : i + 1].view(np.int64)[0]), int(no[i]), rows[i:j].tobytes()
                out += [(x, min(own, other), max(own, other), own, packed) for other in range(int(of[key[i]]))]
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_BLOCKS.names)

    return walk


def _meet_blocks(m: int, width: int, least: int, threshold: float):
    """Pairs between two blocks of a hot sub-key, or within one, that share ``least`` second sub-keys and are alike."""

    def meet(sent: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for _, part in sent.groupby("no"):
            rows = np.frombuffer(b"".join(part["rows"]), dtype=_record(m, width))
            blocks.append(rows[np.argsort(rows["size"], kind="stable")])
        found = [np.zeros((0, 2), dtype=np.int64)]
        if len(blocks) == 2 or sent["lo"].iloc[0] == sent["hi"].iloc[0]:
            a, b = blocks[0], blocks[1] if len(blocks) == 2 else None
            found += [_pairs(a[left], (a if b is None else b)[right], threshold) for left, right in _tiles(a, b, least, threshold)]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return meet


def _hot(keys: DataFrame, m: int, width: int, hot: int, share: int = 8, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Sub-keys of the first collection that about ``hot`` documents or more hold, in order, and about how many do, over all tasks.

    Counted on every ``share``-th document by hash: this decides only which way a sub-key
    goes, never a result.  At most the ``most`` most frequent come to the driver (8 MB).
    """

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = np.unique(_records(batch, m, width)["x"], return_counts=True) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], schema=pa.schema([("x", pa.int64()), ("n", pa.int64())]))

    some = keys.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInArrow(firsts, "x long, n long")
    found = some.groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") * share >= hot).orderBy(F.desc("n")).limit(most).collect()
    keys_found = np.array([r["x"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys_found)
    return keys_found[order], np.array([r["n"] * share for r in found], dtype=np.int64)[order]


def blocks_of(rows: DataFrame, bucket: str, member: str, block: int) -> DataFrame:
    """``bucket, no, of, ids``: the members of every bucket of two or more in ``of`` blocks of about ``block``, by hash."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(bucket).alias("__k"), F.ceil(F.col("__n") / block).cast("int").alias("of"))
    cut = rows.join(sizes, F.col(bucket) == F.col("__k")).select(F.col(bucket).alias("bucket"), "of", F.pmod(F.xxhash64(member), F.col("of")).cast("int").alias("no"), F.col(member).alias("__m"))
    return cut.groupBy("bucket", "of", "no").agg(F.collect_list("__m").alias("ids"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``a < b`` of all members of a bucket: every pair of its blocks is met by a task of its own."""
    each = blocks.select("bucket", "no", "ids", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    two = each.groupBy("bucket", F.least("no", "other").alias("lo"), F.greatest("no", "other").alias("hi")).agg(F.collect_list("ids").alias("ids")).where("lo = hi or size(ids) = 2")
    u = two.select("lo", "hi", F.explode(F.element_at("ids", 1)).alias("u"), F.element_at("ids", -1).alias("v")).select("lo", "hi", "u", F.explode("v").alias("v"))
    return u.where("u != v and (lo != hi or u < v)").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def candidates(keys: DataFrame, m: int, block: int = BLOCK, threshold: float = 0.5, width: int = 2, rows_a_part: int = 131_072, least: int = LEAST_TABLES, hot: int = 4_096) -> DataFrame:
    """Pairs ``a < b`` of ids that meet in ``least`` tables and are alike; ``keys`` has ``id`` and ``keys`` as :func:`sketch_udf` makes them.

    Sub-keys that ``hot`` documents or more hold are met in pairs of blocks of about ``block`` documents.
    """
    keys = keys.select("id", "keys")
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() * m // rows_a_part, 1)
    hot_keys, held = _hot(keys, m, width, hot)
    near = keys.mapInArrow(_send(m, width, parts, hot_keys), _SENT).repartition(parts, "part").groupBy("part").applyInPandas(_meet(m, width, least, threshold), _PAIR)
    if len(hot_keys):
        blocks = keys.mapInArrow(_send_blocks(m, width, hot_keys, -(-held // block)), _BLOCKS).repartition(parts, "x", "lo", "hi")
        near = near.unionByName(blocks.groupBy("x", "lo", "hi").applyInPandas(_meet_blocks(m, width, least, threshold), _PAIR))
    return near.distinct()


def sketched(df: DataFrame, key: str, text: str, n: int = 5, m: int = 9, width: int = 2, least_words: int = 20, prepare: Callable[[str], str] | None = None, whole: bool = False) -> DataFrame:
    """``id, set_hash, keys, text`` of every document, staged; null but for the id where it is too short."""
    made = df.select(F.col(key).cast("long").alias("id"), sketch_udf(n, m, width, least_words, prepare, whole)(F.col(text)).alias("s")).select("id", "s.*")
    with small_batches(df.sparkSession):  # whole texts: many rows at once are much memory
        return stage(made, "sketches")


def similar_pairs(sketches: DataFrame, n: int, m: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b, similarity`` between different sets, named by their hash; ``sketches`` as :func:`sketched` makes them."""
    spark = sketches.sparkSession
    known = sketches.where("set_hash is not null")
    own = stage(known.groupBy(F.col("set_hash").alias("id")).agg(F.first("keys").alias("keys")), "sets")
    with small_batches(spark):
        near = stage(candidates(own, m, block, threshold), "candidates")
    # One text of every set that stands in a pair is shingled, once; the sets travel to their pairs.
    wanted = near.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    texts = known.join(wanted, "set_hash", "left_semi").groupBy("set_hash").agg(F.first("text").alias("text"))
    with small_batches(spark):
        sets = stage(texts.select("set_hash", set_udf(n)("text").alias("set")), "whole-sets")
    both = near.join(sets.select(F.col("set_hash").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("set_hash").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", _similarity("sa", "sb").alias("similarity")).where(F.col("similarity") >= threshold)


def row_pairs(sketches: DataFrame, n: int, m: int, threshold: float, block: int = 256) -> DataFrame:
    """Every pair of rows ``a < b`` whose sets are at least ``threshold`` alike, copies included."""
    with small_batches(sketches.sparkSession):
        links = stage(similar_pairs(sketches, n, m, threshold).select("a", "b"), "links")
    member = sketches.where("set_hash is not null").select("set_hash", "id").distinct()
    copies = block_pairs(blocks_of(member, "set_hash", "id", block))
    # the rows of either set in blocks, so that no task expands a large group by itself
    sizes = member.groupBy("set_hash").agg(F.ceil(F.count("*") / block).cast("int").alias("of"))
    packs = member.join(sizes, "set_hash").groupBy("set_hash", F.pmod(F.xxhash64("id"), F.col("of")).alias("no")).agg(F.collect_list("id").alias("ids"))
    packs = stage(packs.select("set_hash", "ids"), "packs")
    across = links.join(packs.select(F.col("set_hash").alias("a"), F.col("ids").alias("x")), "a").join(packs.select(F.col("set_hash").alias("b"), F.col("ids").alias("y")), "b")
    across = across.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    across = across.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return copies.unionByName(across).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge only, to a node that has none to a lesser one: then the edges name components."""
    rows = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
    return rows["n"] == rows["u"] and not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """``u, v``: every node of the links ``a, b`` that is not the least of its component, with the least one.

    Large stars and small stars in turn, staged, until every component is one star; the rounds
    grow with the logarithm of a component's length, and nothing ends them early.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges


def classes(sketches: DataFrame, n: int, m: int, threshold: float) -> DataFrame:
    """``id, class_id, links``: one row per document; class = the least id of connected documents, links = similar other sets."""
    with small_batches(sketches.sparkSession):
        links = stage(similar_pairs(sketches, n, m, threshold).select("a", "b"), "links")
    label = components(links).select(F.col("u").alias("set_hash"), F.col("v").alias("__c"))
    degree = links.select(F.explode(F.array("a", "b")).alias("set_hash")).groupBy("set_hash").agg(F.count("*").alias("links"))
    least = sketches.where("set_hash is not null").groupBy("set_hash").agg(F.min("id").alias("__id"))
    sets = stage(least.join(label, "set_hash", "left").join(degree, "set_hash", "left").select("set_hash", "__id", F.coalesce("__c", "set_hash").alias("__c"), "links"), "labels")
    named = sets.join(sets.groupBy("__c").agg(F.min("__id").alias("class_id")), "__c").select("set_hash", "class_id", "links")
    out = sketches.select("id", "set_hash").join(named, "set_hash", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
