"""Filling missing values from similar records (p2): chained equations.

A gap is first filled from other records of the same group (here: other crawls of
the same link), with the value most of them hold, the latest on ties.  Gaps that no
record of the group can fill go through chained equations: starting from the
overall mean or most frequent value, every incomplete field in turn is modelled on
all others - numeric fields by a distributed linear regression, categorical fields
of few frequent values by a multinomial logistic regression in which all rare values
are one class, categorical fields of many values - and which of the rare values it is -
by predictive matching with a donor of the same context, or of a wider one where
that has none - and its gaps are drawn anew from the model, with residual variation;
several rounds.  Donors are searched after the last one, as no round reads what they give.

Every field keeps its mask: ``<field>_filled`` is the completed field and
``<field>_from`` says where it comes from: ``own``, ``group`` or ``model``.

Defined results: a group key that is null or blank forms no group; a field nobody
knows stays null with ``<field>_from`` null; draws depend on the record's id and the
seed only, so repeated runs agree; repeated rows of one id give one row each; empty
tables give empty results; other columns stay, working columns begin with ``__``.
A hot group is aggregated before it is shuffled, and donors are spread over buckets
of bounded expected size, whatever the size of their context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarforge.functions.missing import has_value, plain
from scholarforge.runtime import stage

#: A category needs this share of the known values to be a level of a model; rarer ones share one indicator and one class.
LEAST_SHARE = 0.005
#: Up to so many levels a categorical field is modelled by logistic regression, one indicator a level as a predictor;
#: a field of more levels is filled from donors and predicts by the mean, at its value, of every numeric field.
MOST_LEVELS = 24


def group_donors(df: DataFrame, group: str, fields: list[str], order: str | None = None) -> DataFrame:
    """``group`` and, per field, the value that most records of the group hold (latest by ``order``, then lowest, on ties)."""
    when = F.col(order) if order else F.lit(None).cast("timestamp")
    cells = df.where(F.coalesce(F.trim(F.col(group).cast("string")) != "", F.lit(False))).select(
        F.col(group), when.alias("__t"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.when(has_value(F.col(f)), F.col(f).cast("string")).alias("v")) for f in fields])).alias("c")
    )
    values = cells.where("c.v is not null").groupBy(group, F.col("c.f").alias("__f"), F.col("c.v").alias("__v")).agg(F.count("*").alias("__n"), F.max("__t").alias("__t"))
    best = values.groupBy(group, "__f").agg(F.max_by("__v", F.struct("__n", "__t", F.hash("__v"), "__v")).alias("__v"))
    return best.groupBy(group).agg(*[F.max(F.when(F.col("__f") == f, F.col("__v"))).alias(f"__d_{f}") for f in fields])


def fill_from_group(df: DataFrame, group: str, fields: list[str], order: str | None = None) -> DataFrame:
    """``df`` with ``<field>_filled`` and ``<field>_from`` (``own``, ``group`` or null) for every field."""
    donors = group_donors(df, group, fields, order)
    out = df.join(donors, group, "left")
    for f in fields:
        own = has_value(F.col(f))
        out = out.withColumn(f + "_filled", F.when(own, F.col(f).cast("string")).otherwise(F.col(f"__d_{f}")))
        out = out.withColumn(f + "_from", F.when(own, "own").when(F.col(f"__d_{f}").isNotNull(), "group"))
    return out.drop(*[f"__d_{f}" for f in fields])


def _uniform(key: str, salt: str) -> Column:
    """A number in (0, 1) that depends on the record and the salt only."""
    return (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1_000_003)) + 0.5) / 1_000_003.0


def _normal(key: str, salt: str) -> Column:
    return F.sqrt(-2.0 * F.log(_uniform(key, salt + "a"))) * F.cos(2.0 * 3.141592653589793 * _uniform(key, salt + "b"))


def _year(c: Column) -> Column:
    """The number in a numeric cell, such as ``1994``, ``c. 2002`` or ``2001.0``."""
    return F.try_to_number(F.regexp_extract(plain(c), r"(\d{1,9})(?:\.0+)?\b", 1), F.lit("999999999")).cast("double")


def _levels(df: DataFrame, columns: list[str]) -> tuple[dict[str, list[str]], dict[str, str], set[str]]:
    """By column, the frequent values, the most frequent first; and the most frequent value, however rare; the columns that have rare values."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")).where("x.v is not null")
    counts = stage(cells.groupBy("x.c", "x.v").count(), "levels")
    total = counts.groupBy("c").agg(F.sum("count").alias("__all"), F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("__mode"))
    # at most 1 / LEAST_SHARE rows a column
    frequent = counts.join(F.broadcast(total), "c").where(F.col("count") >= LEAST_SHARE * F.col("__all")).orderBy(F.desc("count"), "v").collect()
    totals = total.collect()
    rare = {r["c"] for r in totals if sum(x["count"] for x in frequent if x["c"] == r["c"]) < r["__all"]}
    return {c: [r["v"] for r in frequent if r["c"] == c] for c in columns}, {r["c"]: r["__mode"] for r in totals}, rare


def _with_means(df: DataFrame, columns: list[str], numeric: list[str], scale: dict, weight: float = 5.0) -> DataFrame:
    """``__m_<column>_<number>``: mean of a numeric field over the other rows with the same value, drawn to the overall mean."""
    for c in columns if numeric else []:
        known = [F.when(~F.col(f"__gap_{n}"), F.col(f"__{n}") - scale[n][0]) for n in numeric]
        sums = df.groupBy(f"__{c}").agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(f"__s_{n}") for n, k in zip(numeric, known)], *[F.count(k).alias(f"__c_{n}") for n, k in zip(numeric, known)])
        df = df.join(sums.withColumnRenamed(f"__{c}", "__value"), F.col(f"__{c}").eqNullSafe(F.col("__value")), "left")
        df = df.withColumns({f"__m_{c}_{n}": (F.col(f"__s_{n}") - F.coalesce(k, F.lit(0.0))) / (F.col(f"__c_{n}") - k.isNotNull().cast("int") + weight) / scale[n][1] for n, k in zip(numeric, known)})
        df = df.drop("__value", *[f"__{x}_{n}" for x in "sc" for n in numeric])
    return df


def _design(df: DataFrame, target: str, numeric: list[str], levels: dict[str, list[str]], scale: dict[str, tuple[float, float]]) -> DataFrame:
    inputs = [c for c in df.columns if c.startswith("__m_")]
    made = {}
    for n in numeric:
        if n != target:
            made[f"__x{len(made)}"] = (F.col(f"__{n}") - scale[n][0]) / scale[n][1]
    for c, known in levels.items():
        if c != target:
            for v in known[1:MOST_LEVELS]:
                made[f"__x{len(made)}"] = F.when(F.col(f"__{c}") == v, 1.0).otherwise(0.0)
            made[f"__x{len(made)}"] = F.when(F.col(f"__{c}").isin(known), 0.0).otherwise(1.0)  # rare or missing
    inputs += list(made)
    return VectorAssembler(inputCols=inputs, outputCol="__features").transform(df.withColumns(made)).drop(*made) if inputs else df.withColumn("__features", F.lit(None))


def _draw_numeric(df: DataFrame, key: str, f: str, numeric: list[str], levels: dict, scale: dict, salt: str) -> DataFrame:
    data = _design(df, f, numeric, levels, scale)
    model = LinearRegression(featuresCol="__features", labelCol=f"__{f}", predictionCol="__p", solver="normal", regParam=1e-3).fit(data.where(f"not __gap_{f}").select("__features", f"__{f}"))
    sigma = float(model.summary.rootMeanSquaredError)
    drawn = F.round(F.col("__p") + sigma * _normal(key, f"{f}{salt}"))
    bounded = F.greatest(F.lit(scale[f][2]), F.least(F.lit(scale[f][3]), drawn))
    return model.transform(data).withColumn(f"__{f}", F.when(F.col(f"__gap_{f}"), bounded).otherwise(F.col(f"__{f}"))).drop("__features", "__p")


def _draw_class(df: DataFrame, key: str, f: str, numeric: list[str], levels: dict, scale: dict, names: list[str], rare: bool, salt: str) -> DataFrame:
    """The classes are ``names`` and, if there are ``rare`` values, one of all these, drawn as null."""
    place = F.create_map(*[x for i, v in enumerate(names) for x in (F.lit(v), F.lit(float(i)))])
    data = _design(df, f, numeric, levels, scale)
    label = F.coalesce(place[F.col(f"__{f}")], F.lit(float(len(names))))
    train = data.where(f"not __gap_{f}").withColumn("__label", label).select("__features", "__label")
    model = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__p", family="multinomial", maxIter=8, regParam=1e-3).fit(train)
    out = model.transform(data).withColumn("__p", vector_to_array("__p"))
    # the first class at which the summed probability passes a uniform number
    u = _uniform(key, f"{f}{salt}")
    at = F.aggregate("__p", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, p: F.struct((a["s"] + p).alias("s"), (a["n"] + F.when(a["s"] + p < u, 1).otherwise(0)).alias("n")), lambda a: a["n"])
    classes = [F.lit(v) for v in names] + [F.lit(None).cast("string")] * rare
    drawn = F.element_at(F.array(*classes), F.least(at + 1, F.lit(len(classes))))
    return out.withColumn(f"__{f}", F.when(F.col(f"__gap_{f}"), drawn).otherwise(F.col(f"__{f}"))).drop("__features", "__p", "rawPrediction", "prediction", "__label")


def _draw_donors(df: DataFrame, key: str, fields: dict[str, tuple[Column, Column]], numeric: list[str], context: list[str], salt: str, bucket: int = 16) -> DataFrame:
    """Predictive matching: one of the donors that are closest in the numeric fields, of those of the same context.

    ``fields`` has, by field, which rows are donors and which ask for one; all fields are searched at once.

    The context is all of ``context`` if it has donors, else the first column of it, else
    all rows.  Distances are taken between the distinct numeric values of gaps and donors
    of a context, so every donor is compared and none pairwise; the donor is drawn from all
    that are as close, through buckets of about ``bucket`` donors.
    """
    at = lambda names, level: F.xxhash64(F.col("__c.f"), F.lit(level), *[F.coalesce(F.col(f"__{c}"), F.lit("")) for c in names])
    wide = [at(context, 0), at(context[:1], 1), at([], 2)]
    cells = lambda side: df.withColumn("__c", F.explode(F.array_compact(F.array(*[F.when(rows[side], F.struct(F.lit(f).alias("f"), F.col(f"__{f}").alias("v"))) for f, rows in fields.items()]))))
    own, gaps = cells(0), cells(1)
    donors = own.select(F.explode(F.array(*wide)).alias("__ctx"), *[F.col(f"__{n}").alias(f"__g_{n}") for n in numeric], F.col("__c.v").alias("__value"), F.col(key).cast("string").alias("__donor"))
    had = [own.select(w.alias(f"__h{i}")).distinct().withColumn(f"__has{i}", F.lit(True)) for i, w in enumerate(wide[:2])]
    asked = gaps.select(F.col(key).alias("__who"), F.col("__c.f").alias("__f"), *[w.alias(f"__w{i}") for i, w in enumerate(wide)], *[F.col(f"__{n}").alias(f"__r_{n}") for n in numeric])
    for i, h in enumerate(had):
        asked = asked.join(h, F.col(f"__w{i}") == F.col(f"__h{i}"), "left")
    asked = asked.select("__who", "__f", F.when(F.col("__has0"), F.col("__w0")).when(F.col("__has1"), F.col("__w1")).otherwise(F.col("__w2")).alias("__ctx"), *[f"__r_{n}" for n in numeric])
    asked = stage(asked, "asked")
    given = [f"__g_{n}" for n in numeric]
    wanted = [f"__r_{n}" for n in numeric]
    kinds = donors.join(asked.select("__ctx").distinct(), "__ctx", "left_semi").groupBy("__ctx", *given).agg(F.ceil(F.count("*") / bucket).alias("__b"))
    away = reduce(lambda a, b: a + b, [F.abs(F.col(g) - F.col(r)) for g, r in zip(given, wanted)], F.lit(0.0))
    # few bytes become many pairs here, so adaptive execution must not put all contexts into one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nearest = asked.select("__ctx", *wanted).distinct().repartition(parts, "__ctx").join(kinds, "__ctx").groupBy("__ctx", *wanted).agg(F.min_by(F.struct("__b", *given), F.struct(away, F.xxhash64(F.lit(salt), *given, *wanted))).alias("__n"))
    drawn = asked.join(nearest, ["__ctx", *wanted]).select("__who", "__f", "__ctx", *[F.col(f"__n.{g}").alias(g) for g in given], F.pmod(F.xxhash64(F.col("__who").cast("string"), F.lit(salt)), F.col("__n.__b")).alias("__k"))
    offered = donors.join(kinds, ["__ctx", *given]).withColumn("__k", F.pmod(F.xxhash64("__donor", F.lit(salt)), F.col("__b"))).drop("__b")
    rank = F.struct(F.xxhash64("__donor", F.col("__who").cast("string"), F.lit(salt)), F.col("__donor"))
    best = drawn.join(offered, ["__ctx", *given, "__k"]).groupBy("__who").agg(*[F.min_by("__value", F.when(F.col("__f") == f, rank)).alias(f"__drawn_{f}") for f in fields])
    best = stage(best, "drawn")
    out = df.join(best, df[key] == best["__who"], "left")
    return out.withColumns({f"__{f}": F.when(F.col(f"__gap_{f}"), F.coalesce(f"__drawn_{f}", f"__{f}")).otherwise(F.col(f"__{f}")) for f in fields}).drop("__who", *[f"__drawn_{f}" for f in fields])


def impute(df: DataFrame, key: str, group: str, numeric: list[str], categorical: list[str], context: list[str], order: str | None = None, rounds: int = 3, seed: int = 7) -> DataFrame:
    """``df`` with ``<field>_filled`` and ``<field>_from`` for all ``numeric`` and ``categorical`` fields.

    ``context`` names complete or incomplete columns that describe a record, such as
    its department; they help the models and are not filled.
    """
    fields = [*numeric, *categorical]
    # A repeated id stays repeated, but the chained equations see it once.
    first = fill_from_group(df.select(key, group, *([order] if order else []), *fields, *context), group, fields, order)
    first = stage(first, "group-fill")
    keep = [F.col(key)]
    for f in numeric:
        keep += [_year(F.col(f + "_filled")).alias(f"__{f}")]
    for f in categorical:
        keep += [F.when(F.col(f + "_from").isNotNull(), F.trim(F.col(f + "_filled"))).alias(f"__{f}")]
    for c in context:
        keep += [F.when(has_value(F.col(c)), plain(F.col(c).cast("string"))).alias(f"__{c}")]
    work = first.dropDuplicates([key]).select(*keep)
    for f in fields:
        work = work.withColumn(f"__gap_{f}", F.col(f"__{f}").isNull())
    work = stage(work, "work")

    stats = work.agg(*[x for n in numeric for x in (F.avg(f"__{n}").alias(f"{n}_m"), F.stddev(f"__{n}").alias(f"{n}_s"), F.min(f"__{n}").alias(f"{n}_a"), F.max(f"__{n}").alias(f"{n}_b"))], F.count("*").alias("__rows")).first()
    if not stats["__rows"]:
        return _finish(df, first, work, key, numeric, categorical)
    # Placeholders that slip through as numbers must not stretch the bounds: keep within five deviations.
    scale = {}
    for n in numeric:
        m, s = stats[f"{n}_m"], stats[f"{n}_s"] or 1.0
        if m is not None:
            scale[n] = (m, max(s, 1e-9), max(stats[f"{n}_a"], round(m - 5 * s)), min(stats[f"{n}_b"], round(m + 5 * s)))
    numeric_known = [n for n in numeric if n in scale]
    found, modes, has_rare = _levels(work, [f"__{c}" for c in [*categorical, *context]])
    levels = {c.removeprefix("__"): v for c, v in found.items()}
    rare = {c: f"__{c}" in has_rare for c in categorical}
    modelled = [c for c in categorical if levels[c] and 1 < len(levels[c]) + rare[c] and len(levels[c]) <= MOST_LEVELS]
    matched = [c for c in categorical if len(levels[c]) > MOST_LEVELS or not levels[c]]
    few = {c: v for c, v in levels.items() if v and 1 < len(v) + (f"__{c}" in has_rare) and len(v) <= MOST_LEVELS}
    start = work
    for n in numeric_known:
        start = start.withColumn(f"__{n}", F.coalesce(f"__{n}", F.lit(round(scale[n][0]) * 1.0)))
    for c in categorical:
        if f"__{c}" in modes:
            start = start.withColumn(f"__{c}", F.coalesce(f"__{c}", F.lit(modes[f"__{c}"])))
    many = [c for c in context if len(levels[c]) > MOST_LEVELS or not levels[c]]
    work = stage(_with_means(start, many, numeric_known, scale), "start")
    for r in range(rounds):
        for n in numeric_known:
            work = _draw_numeric(work, key, n, numeric_known, few, scale, f"{seed}:{r}")
        for c in modelled:
            work = _draw_class(work, key, c, numeric_known, few, scale, levels[c], rare[c], f"{seed}:{r}")
        work = stage(work, f"round{r}")
    # What donors give is no predictor: rare values share one indicator with missing ones, and fields of many values have
    # none.  So no round reads it, and a search in each would be overwritten by that of the last.
    asking = {c: (~F.col(f"__gap_{c}") & ~F.col(f"__{c}").isin(levels[c]), F.col(f"__{c}").isNull()) for c in modelled if rare[c]}
    asking |= {c: (~F.col(f"__gap_{c}"), F.col(f"__gap_{c}")) for c in matched}
    if rounds and asking:
        work = _draw_donors(work, key, asking, numeric_known, context, f"{seed}:{rounds - 1}")
    return _finish(df, first, work, key, numeric, categorical)


def _finish(df: DataFrame, first: DataFrame, work: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    fields = [*numeric, *categorical]
    drawn = work.select(F.col(key), *[F.col(f"__{f}").cast("long").cast("string").alias(f"__m_{f}") for f in numeric], *[F.col(f"__{f}").alias(f"__m_{f}") for f in categorical])
    filled = first.select(key, *[x for f in fields for x in (f + "_filled", f + "_from")]).dropDuplicates([key])
    filled = filled.join(drawn, key, "left")
    for f in fields:
        model = F.col(f + "_from").isNull() & F.col(f"__m_{f}").isNotNull()
        filled = filled.withColumn(f + "_from", F.when(model, "model").otherwise(F.col(f + "_from"))).withColumn(f + "_filled", F.coalesce(f + "_filled", f"__m_{f}"))
    return df.join(filled.drop(*[f"__m_{f}" for f in fields]), key, "left")


def filled_cells(filled: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """``key, field`` of the cells that were filled from ``source`` (``group`` or ``model``)."""
    cells = filled.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + "_from").alias("s")) for f in fields])).alias("c"))
    return cells.where(F.col("c.s") == source).select(key, F.col("c.field").alias("field"))


def measured(df: DataFrame, key: str, group: str, numeric: list[str], categorical: list[str], context: list[str], order: str | None = None, hidden: float = 0.1, seed: int = 11) -> DataFrame:
    """Error of the imputation on known cells that are hidden from it.

    ``field, source, cells, equal, mean_error, mean_abs_error, spread_ratio``: share of equal
    values, for numbers also bias, mean absolute error and the spread of the imputed values
    against that of the true ones (1: the residual variation is kept).  A share ``hidden`` of
    the known cells of every field, by a hash of record and field, is taken out before.
    """
    fields = [*numeric, *categorical]
    taken = {f: has_value(F.col(f)) & (_uniform(key, f"{seed}{f}") < hidden) for f in fields}
    blank = df.select(key, group, *([order] if order else []), *context, *[F.when(~F.coalesce(taken[f], F.lit(False)), F.col(f)).alias(f) for f in fields])
    truth = df.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(taken[f], F.col(f).cast("string")).alias("was")) for f in fields])).alias("t")).select("__key", "t.*").where("was is not null")
    done = impute(blank, key, group, numeric, categorical, context, order)
    got = done.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + "_filled").alias("got"), F.col(f + "_from").alias("source")) for f in fields])).alias("g")).select("__key", "g.*")
    both = truth.join(got, ["__key", "field"]).where("source in ('group', 'model')")
    a, b = F.when(F.col("field").isin(numeric), _year(F.col("was"))), F.when(F.col("field").isin(numeric), _year(F.col("got")))
    same = F.coalesce(a == b, plain(F.col("was")) == plain(F.col("got")))
    return both.groupBy("field", "source").agg(F.count("*").alias("cells"), F.avg(same.cast("double")).alias("equal"), F.avg(b - a).alias("mean_error"), F.avg(F.abs(b - a)).alias("mean_abs_error"), (F.stddev(b) / F.stddev(a)).alias("spread_ratio"))
