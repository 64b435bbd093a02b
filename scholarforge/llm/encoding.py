"""Text decoded with the wrong character encoding: find it and restore it (p1).

A cell went through a latent *chain* of wrong decodings (for example UTF-8 bytes
read as Windows-1252, or that twice).  Each chain turns a character of the
repertoire into a known sequence, so a cell offers evidence for every chain whose
sequences it contains.  Expectation-maximisation pools that weak evidence over
all cells of a source and field: the E step gives each cell a posterior over the
chains and "undamaged"; the M step re-estimates the share of each chain per
source and field and the character model of undamaged text.  A cell is damaged if
"undamaged" has less than half of its posterior, and it is repaired with its most
probable chain.

U+FFFD marks bytes that are lost.  Such cells are always damaged; their words are
restored where exactly one frequent word of the collection fits the letters left.

Defined results: null and empty texts are undamaged and stay as they are; texts
are read whole, of any length; repeated ids are separate cells only if their
texts differ; empty tables give empty results; other columns stay, whatever their
names (working columns begin with ``__``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.runtime import stage

# Chains of wrong decodings that are tried, each a sequence of codecs.
CHAINS: dict[str, tuple[str, ...]] = {
    "latin1": ("latin-1",),
    "cp1252": ("cp1252",),
    "cp1250": ("cp1250",),
    "cp1251": ("cp1251",),
    "mac": ("mac_roman",),
    "cp437": ("cp437",),
    "cp850": ("cp850",),
    "latin1x2": ("latin-1", "latin-1"),
    "cp1252x2": ("cp1252", "cp1252"),
}
LOSSY = "lost"
KEEP = "undamaged"

# Code points whose damaged forms are looked for (Latin letters, usual punctuation and signs; Greek and Cyrillic).
REPERTOIRE = [*range(0xA0, 0x180), 0x192, *range(0x218, 0x21C), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x2044, 0x20AC, 0x2122]
SCRIPTS = [*range(0x386, 0x3CF), *range(0x400, 0x460), 0x490, 0x491]
# Chains in which the first bytes of these scripts become letters, not lines, dashes or the script itself.
SCRIPT_CHAINS = ("latin1", "cp1252", "latin1x2", "cp1252x2")


def _bytes_as(codec: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:  # as browsers do: an unassigned byte becomes the control of its number
            out.append(chr(b))
    return out


def mangle(text: str, chain: str) -> str:
    """``text`` as it reads after the chain of wrong decodings."""
    for codec in CHAINS[chain]:
        table = _bytes_as(codec)
        text = "".join(table[b] for b in text.encode("utf-8"))
    return text


@lru_cache(None)
def _forms(chain: str) -> dict[str, str]:
    tables = [_bytes_as(c) for c in CHAINS[chain]]
    out = {}
    for cp in REPERTOIRE + (SCRIPTS if chain in SCRIPT_CHAINS else []):
        text = chr(cp)
        for table in tables:
            text = "".join(table[b] for b in text.encode("utf-8"))
        out.setdefault(text, chr(cp))
    return out


def _klass(chars: set[str]) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(chars)) + "]"


@lru_cache(None)
def _regex(chain: str) -> re.Pattern:
    by_len: dict[int, list[set[str]]] = {}
    for form in _forms(chain):
        slots = by_len.setdefault(len(form), [set() for _ in form])
        for slot, c in zip(slots, form):
            slot.add(c)
    return re.compile("|".join("".join(map(_klass, by_len[n])) for n in sorted(by_len, reverse=True)))


def is_suspect(text: Column) -> Column:
    """Whether a text can hold damage under any chain: every form begins with two characters outside ASCII.

    Larger classes, alternatives and counted repeats are two to three times slower in Java.
    """
    return F.coalesce(text.rlike(r"[^\x00-\x7f][^\x00-\x7f]") | text.contains("\ufffd"), F.lit(False))


_EVIDENCE = T.ArrayType(T.StructType([T.StructField("chain", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("target", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("alone", T.IntegerType())]))


def _evidence_of(text: str) -> list[tuple]:
    out = []
    for chain in CHAINS:
        forms = _forms(chain)
        seen: Counter = Counter()
        alone: Counter = Counter()
        regex, last = _regex(chain), -1
        for m in regex.finditer(text):
            seq = m.group()
            if seq in forms:
                seen[seq] += 1
                # Letters of the form's own script beside the run speak for a genuine word of that script.
                before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                inside = (before and m.start() == last) or (after and regex.match(text, m.end()) is not None)
                alone[seq] += bool(inside) or not any("\u0370" <= c <= "\u05ff" for c in before + after)
                last = m.end()
        if seen and any("\u0370" <= c <= "\u05ff" for c in "".join(seen)):
            # a cell decoded wrongly as a whole leaves no letter of that script outside the forms
            rest = regex.sub(lambda m: "" if m.group() in forms else m.group(), text)
            if any("\u0370" <= c <= "\u05ff" for c in rest):
                alone.clear()
        out += [(chain, seq, forms[seq], n, alone[seq]) for seq, n in seen.items()]
    return out


@F.pandas_udf(_EVIDENCE)
def _evidence(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _evidence_of(t) if t else [])


def damaged_cells(df: DataFrame, key: str, fields: list[str], source: Column, tolerance: float = 1e-3, smoothing: float = 4.0) -> DataFrame:
    """One row per damaged cell: ``key, field, chain, posterior``.

    ``source`` is the column expression by which evidence is pooled.  ``chain`` is
    a name of :data:`CHAINS`, or ``lost`` where only lost bytes speak.  EM goes on
    until no chain's share of a field's cells changes by more than ``tolerance`` (made a
    little wider every round, so that it ends);
    ``smoothing`` is the weight, in cells, of the field's overall shares against those
    of a source.
    """
    parts = []
    for f in fields:
        parts.append(
            df.select(F.col(key).alias("__key"), F.lit(f).alias("__field"), F.coalesce(source.cast("string"), F.lit("")).alias("__source"), F.col(f).cast("string").alias("__text"))
            .where(is_suspect(F.col("__text")))
        )
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = cells.select("__key", "__field", "__source", F.col("__text").contains("�").alias("__lost"), F.explode_outer(_evidence("__text")).alias("e"))
    cells = stage(cells.select("__key", "__field", "__source", "__lost", "e.*"), "damage")

    # How many cells a source and a field have in all, damaged or not: narrow scan, combined before the shuffle.
    counts = df.select(F.coalesce(source.cast("string"), F.lit("")).alias("__source"), *[F.col(f).isNotNull().cast("long").alias(f"__n{i}") for i, f in enumerate(fields)])
    counts = counts.groupBy("__source").agg(*[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(len(fields))])
    sizes = stage(counts.select("__source", F.explode(F.array(*[F.struct(F.lit(f).alias("__field"), F.col(f"__n{i}").alias("__cells")) for i, f in enumerate(fields)])).alias("x")).select("__source", "x.*"), "sizes")
    total = {r["__field"]: float(r["n"] or 0) for r in sizes.groupBy("__field").agg(F.sum("__cells").alias("n")).collect()}

    # Character model of undamaged text, by field, over the characters that forms and targets use (a fixed set).
    model = _character_counts(df, fields)
    prior: DataFrame | None = None
    overall = {(f, c): 0.02 for f in fields for c in CHAINS}
    cells = cells.withColumn("chain", F.coalesce("chain", F.lit(LOSSY)))
    post = None
    while True:
        post = stage(_posterior(cells, model, prior, overall), "posterior")
        by = post.groupBy("__source", "__field", "chain").agg(F.sum("posterior").alias("w"))
        sums = {(x["__field"], x["chain"]): x["w"] for x in by.groupBy("__field", "chain").agg(F.sum("w").alias("w")).collect()}
        before, overall = overall, {(f, c): (sums.get((f, c), 0.0) + 0.5) / (total.get(f, 0.0) + 1.0) for f in fields for c in CHAINS}
        if max(abs(overall[x] - before[x]) for x in overall) <= tolerance:
            break
        tolerance *= 1.3
        grid = F.create_map(*[x for (f, c), p in overall.items() for x in (F.lit(f"{f}\t{c}"), F.lit(p))])
        prior = (
            by.join(sizes, ["__source", "__field"])
            .withColumn("prior", (F.col("w") + smoothing * F.coalesce(grid[F.concat_ws("\t", "__field", "chain")], F.lit(1e-6))) / (F.col("__cells") + smoothing))
            .select("__source", "__field", "chain", "prior")
        )
        model = _shift_model(cells, post, model)
    best = post.groupBy("__key", "__field").agg(F.sum("posterior").alias("posterior"), F.max_by("chain", F.struct("posterior", "chain")).alias("chain"), F.max("__lost").alias("__lost"))
    best = best.withColumn("chain", F.when(F.col("posterior") > 0.5, F.col("chain")).otherwise(F.lit(LOSSY)))
    best = best.withColumn("posterior", F.when(F.col("__lost"), F.lit(1.0)).otherwise(F.col("posterior")))
    return best.where("posterior > 0.5").select(F.col("__key").alias(key), F.col("__field").alias("field"), "chain", "posterior")


def _character_counts(df: DataFrame, fields: list[str]) -> dict[tuple[str, str], float]:
    """Characters by field; those beside lost bytes are no undamaged text and left out."""
    used = sorted({c for ch in CHAINS for form, t in _forms(ch).items() for c in form + t if ord(c) > 127})
    rows = None
    for f in fields:
        one = df.select(F.lit(f).alias("f"), F.regexp_replace(F.col(f).cast("string"), r"[\x00-\x7f]+|[^\x00-\x7f]?\ufffd+[^\x00-\x7f]?", "").alias("s")).where("s != ''").select("f", F.explode(F.split("s", "")).alias("c"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.where(F.col("c").isin(used)).groupBy("f", "c").count().collect()  # at most fields x the fixed characters
    return {(r["f"], r["c"]): float(r["count"]) for r in counts}


def _shift_model(cells: DataFrame, post: DataFrame, model: dict) -> dict:
    """Counts without the characters that belong to damage, and with those it stands for."""
    moved = (
        cells.join(post.where("posterior > 0.001").select("__key", "__field", "chain", "posterior"), ["__key", "__field", "chain"])
        .groupBy("__field", "seq", "target").agg(F.sum(F.col("n") * F.col("posterior")).alias("w")).collect()
    )  # at most fields x forms of the fixed chains
    model = dict(model)
    for r in moved:
        if r["seq"]:
            for c in r["seq"]:
                if ord(c) > 127:
                    model[r["__field"], c] = max(0.0, model.get((r["__field"], c), 0.0) - r["w"])
            model[r["__field"], r["target"]] = model.get((r["__field"], r["target"]), 0.0) + r["w"]
    return model


def _posterior(cells: DataFrame, model: dict, prior: DataFrame | None, overall: dict) -> DataFrame:
    by_field: dict[str, float] = {}
    for (f, _), n in model.items():
        by_field[f] = by_field.get(f, 0.0) + n
    default = math.log(1e-4)

    scores = {(f, c): math.log((n + 0.02) / (by_field[f] + 100.0)) for (f, c), n in model.items()}

    @F.pandas_udf(T.DoubleType())
    def gain(field: pd.Series, seq: pd.Series, target: pd.Series, n: pd.Series, alone: pd.Series) -> pd.Series:
        out = []
        for f, s, t, k, a in zip(field, seq, target, n, alone):
            if not s:
                out.append(0.0)
                continue
            floor = math.log(0.02 / (by_field.get(f, 0.0) + 100.0))
            kept = sum(scores.get((f, c), floor) for c in s if ord(c) > 127)
            # bounded, so that one repeated sequence does not outweigh the variety of the evidence
            out.append((scores.get((f, t), floor) - kept) * (min(a, 8) - 2.0 * min(k - a, 8)) if a or k else default)
        return pd.Series(out)

    scored = cells.withColumn("g", F.coalesce(gain("__field", F.col("seq"), F.col("target"), F.coalesce("n", F.lit(0)), F.coalesce("alone", F.lit(0))), F.lit(0.0)))
    scored = scored.groupBy("__key", "__field", "__source", "chain").agg(F.sum("g").alias("g"), F.max("__lost").alias("__lost"))
    grid = F.create_map(*[x for (f, c), p in overall.items() for x in (F.lit(f"{f}\t{c}"), F.lit(p))])
    if prior is not None:
        scored = scored.join(prior, ["__source", "__field", "chain"], "left")
    else:
        scored = scored.withColumn("prior", F.lit(None).cast("double"))
    scored = scored.withColumn("p", F.coalesce("prior", grid[F.concat_ws("\t", "__field", "chain")], F.lit(1e-6)))
    scored = scored.withColumn("a", F.when(F.col("chain") == LOSSY, F.lit(-60.0)).otherwise(F.col("g") + F.log(F.greatest("p", F.lit(1e-9)))))
    # Against "undamaged" (score 0, its share close to 1), the highest score taken out before exponents are formed.
    sums = scored.groupBy("__key", "__field", "__source").agg(F.collect_list(F.struct("chain", "a")).alias("x"), F.max("__lost").alias("__lost"), F.greatest(F.max("a"), F.lit(0.0)).alias("top"))
    sums = sums.withColumn("z", F.aggregate("x", F.exp(-F.col("top")), lambda acc, v: acc + F.exp(v["a"] - F.col("top"))))
    return sums.select("__key", "__field", "__source", "__lost", F.explode("x").alias("v"), "top", "z").select("__key", "__field", "__source", "__lost", F.col("v.chain").alias("chain"), (F.exp(F.col("v.a") - F.col("top")) / F.col("z")).alias("posterior"))


def repair_text(text: str | None, chain: str | None) -> str | None:
    """``text`` with the sequences of ``chain`` turned back."""
    if not text or chain not in CHAINS:
        return text
    forms = _forms(chain)
    return _regex(chain).sub(lambda m: forms.get(m.group(), m.group()), text)


@F.pandas_udf(T.StringType())
def _repair(text: pd.Series, chain: pd.Series) -> pd.Series:
    return pd.Series([repair_text(t, c) for t, c in zip(text, chain)], dtype=object)


# A word with lost characters, and its letters with every run outside ASCII as one mark.
_WORD = r"[\p{L}\p{M}�]+"


def _skeleton(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\x00-\x7f]+", "�")


def _restore_lost(broken: DataFrame, all_cells: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """Words with lost characters in ``broken`` replaced by the one word of the collection that fits.

    A word is taken if it has at least the share ``least`` of all occurrences of
    its skeleton. Only skeletons that occur broken are counted (semi join), so the
    exchange follows the damage and not the collection.
    """
    lost = broken.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))).alias("__w")).where(F.col("__w").contains("�"))
    lost = lost.withColumn("__s", _skeleton(F.col("__w"))).where(F.length("__s") > 2)
    wanted = lost.select("__s").distinct()
    # pieces between blanks are told apart by their bytes, far cheaper than by a pattern over whole texts
    pieces = all_cells.where(F.octet_length(text) != F.length(text)).select(F.explode(F.filter(F.split(F.col(text), " "), lambda w: F.octet_length(w) != F.length(w))).alias("__p")).where(F.col("__p").rlike(r"[\u00c0-\u024f]"))
    words = pieces.select(F.explode(F.regexp_extract_all("__p", F.lit(r"(?<!\p{L})[a-zA-Z]*+[\u00c0-\u024f][\p{L}\p{M}]*"), F.lit(0))).alias("__v"))
    words = words.groupBy("__v").count().withColumn("__s", _skeleton(F.col("__v"))).join(wanted, "__s", "left_semi")
    best = words.groupBy("__s").agg(F.max_by("__v", F.struct("count", "__v")).alias("__v"), (F.max("count") / F.sum("count")).alias("share")).where(F.col("share") >= least).select("__s", "__v")
    fixes = lost.join(best, "__s").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__w", "__v"))).alias("__fix"))

    @F.pandas_udf(T.StringType())
    def put(t: pd.Series, fix: pd.Series) -> pd.Series:
        word = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f]|�)+")
        return pd.Series([word.sub(lambda m, d=dict(f): d.get(m.group(), m.group()), x) if x and f is not None else x for x, f in zip(t, fix)], dtype=object)

    return broken.join(fixes, key, "left").withColumn(text, put(F.col(text), F.col("__fix"))).drop("__fix")


def repaired(df: DataFrame, key: str, field: str, source: Column, cells: DataFrame | None = None, restore_lost: bool = True) -> DataFrame:
    """``df`` with ``field`` as it was before the damage, and ``<field>_chain`` naming what was undone (null: nothing).

    Rows without suspicious characters pass straight through, unshuffled; only the
    others meet the posterior of their cell.
    """
    flag = f"{field}_chain"
    if cells is None:
        cells = stage(damaged_cells(df, key, [field], source), "cells")
    known = cells.where(F.col("field") == field).select(F.col(key), F.col("chain").alias(flag)).dropDuplicates([key])
    suspect = is_suspect(F.col(field))
    clean = df.where(~suspect).withColumn(flag, F.lit(None).cast("string"))
    broken = df.where(suspect).join(known, key, "left").withColumn(field, _repair(F.col(field), F.col(flag)))
    if restore_lost:
        lost = F.col(field).contains("�")
        broken = stage(broken, "broken")
        kept, gone = broken.where(~lost), broken.where(lost)
        broken = kept.unionByName(_restore_lost(gone, clean.select(key, field).unionByName(kept.select(key, field)), key, field))
    return clean.unionByName(broken.select(*clean.columns))
