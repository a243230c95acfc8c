"""Robust multivariate outliers of text statistics, in native operations.

Every text gets its statistics (words, symbols, repeated lines, repeated 3-word
windows). Texts that break a base rule fail outright. Of the others, transformed
vectors are judged within their language and source: location and scatter are
minimum-covariance-determinant estimates, and a text is rejected when its
Mahalanobis distance is beyond the cut.

The estimate is the mean and the regularised covariance, that of the data plus a
fixed floor for each variance (``FLOORS``), of the ``share`` of vectors for which
the determinant is least. It is searched from three starts: quartile ranges, the
covariance of hyperbolic tangents, and that of spatial signs. After
``start_steps`` concentration steps the start with the least determinant goes on
until the determinant stops falling, at most ``max_steps`` more. In a step the
vectors nearest by the present estimate give the next one; as the floors are fixed,
the regularised determinant can't grow, and an estimate that isn't better by
rounding is not taken. A step is two aggregations that combine on the map side (a
quantile sketch, exact for groups below ``accuracy`` rows, and sums), so a source
with a third of all rows costs what its rows cost, in all tasks. The final scatter
is scaled so that the median distance is that of a Gaussian, but never narrower.

Groups smaller than ``min_group`` are pooled by language, and those that are
still too small all together; a pool that is too small rejects nothing.
Without floors a group whose texts all lack symbols would reject the first symbol.

Defined results: a null text has no words and fails the base rules; null
languages and sources are groups like others; repeated rows get equal results; an
empty table stays empty; other columns are ignored, whatever their names. A long
text is one row, whole: a task needs memory for some arrays of its words. Windows
are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES = " \t\n\x0b\f\r"
#: Transformed statistics and the least standard deviation of each.
FLOORS = {"x_length": 0.08, "x_symbols": 0.08, "x_lines": 0.15, "x_repeats": 0.08, "x_words": 0.5}
DIMS = tuple(FLOORS)
#: 50 % point of chi-square with as many degrees of freedom.
_CHI2_HALF = {1: 0.4549, 2: 1.3863, 3: 2.3660, 4: 3.3567, 5: 4.3515, 6: 5.3481}


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("t"))
    rows = rows.withColumn("b", F.btrim("t", F.lit(SPACES)))
    rows = rows.withColumn("words", F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.split("b", r"[ \t\n\x0B\f\r]+")))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.transform(F.slice("words", 1, F.size("words") - 2), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"),
    )
    # The windows found twice or more, by sorting (window, place); a text without them skips that.
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("placed", F.when(again, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    same = lambda x, i: (x["w"] == F.get("placed", i - 1)["w"]) | (x["w"] == F.get("placed", i + 1)["w"])
    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("placed", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    gaps = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """Logarithms of positive statistics, roots of shares that are mostly zero."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "x_length": F.log(chars / words),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        "x_words": F.log(words),
    }


def _attach(rows: DataFrame, table: DataFrame, keys: list[str], few: bool, salts: int) -> DataFrame:
    """``rows`` left-joined with one row a group (and start).

    The table is broadcast only if ``few`` says that its groups were counted to be
    few; otherwise each group is spread over ``salts`` join keys.
    """
    if few:
        return rows.join(F.broadcast(table), keys, "left")
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(spread, [*keys, "__salt"], "left").drop("__salt")


def _distance(dims: tuple[str, ...]) -> Column:
    """Squared Mahalanobis distance from m_* under the inverse factor i_*_*."""
    terms = []
    for a in range(len(dims)):
        z = reduce(lambda s, t: s + t, (F.col(f"i_{a}_{b}") * (F.col(dims[b]) - F.col(f"m_{b}")) for b in range(a + 1)))
        terms.append(z * z)
    return reduce(lambda s, t: s + t, terms)


def _inverse_factor(table: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """From covariances c_a_b to the inverse i_a_b of their Cholesky factor and logdet, a row a group and start."""
    p = len(dims)
    for a in range(p):
        for b in range(a + 1):
            rest = [F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in range(b)]
            left = reduce(lambda s, t: s - t, rest, F.col(f"c_{a}_{b}"))
            value = F.sqrt(F.greatest(left, F.lit(1e-12))) if a == b else left / F.col(f"l_{b}_{b}")
            table = table.withColumn(f"l_{a}_{b}", value)
    for b in range(p):
        for a in range(b, p):
            if a == b:
                value = F.lit(1.0) / F.col(f"l_{a}_{a}")
            else:
                value = -reduce(lambda s, t: s + t, (F.col(f"l_{a}_{k}") * F.col(f"i_{k}_{b}") for k in range(b, a))) / F.col(f"l_{a}_{a}")
            table = table.withColumn(f"i_{a}_{b}", value)
    logdet = reduce(lambda s, t: s + t, (-2 * F.log(f"i_{a}_{a}") for a in range(p)))
    return table.select("g", "k", logdet.alias("logdet"), *(f"m_{a}" for a in range(p)), *(f"i_{a}_{b}" for a in range(p) for b in range(a + 1)))


def _starts(learn: DataFrame, quartiles: DataFrame, few: bool, salts: int) -> DataFrame:
    """Three scatters c_a_b about the medians m_a, a row each (k)."""
    p = len(DIMS)
    wide = quartiles
    for a, d in enumerate(DIMS):
        spread = (F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349
        wide = wide.withColumns({f"m_{a}": F.col(f"q_{a}")[1], f"s_{a}": F.sqrt(spread * spread + FLOORS[d] ** 2)})
    wide = wide.drop(*(f"q_{a}" for a in range(p)))
    z = _attach(learn, wide, ["g"], few, salts).where("m_0 is not null").select("g", *((F.col(d) - F.col(f"m_{a}")).__truediv__(F.col(f"s_{a}")).alias(f"z_{a}") for a, d in enumerate(DIMS)))
    z = z.withColumn("r", F.sqrt(reduce(lambda s, t: s + t, (F.col(f"z_{a}") * F.col(f"z_{a}") for a in range(p)))))
    tangent = [F.tanh(f"z_{a}") for a in range(p)]
    sign = [F.when(F.col("r") > 0, F.col(f"z_{a}") / F.when(F.col("r") > 0, F.col("r"))).otherwise(0.0) for a in range(p)]
    pairs = [(a, b) for a in range(p) for b in range(a + 1)]
    found = z.groupBy("g").agg(*(F.covar_pop(u[a], u[b]).alias(f"{n}_{a}_{b}") for n, u in (("t", tangent), ("u", sign)) for a, b in pairs))
    both = wide.join(found, "g")
    out = None
    for k, n in enumerate(("", "t", "u")):
        at = lambda a, b: F.col(f"s_{a}") * F.col(f"s_{b}") * (F.col(f"{n}_{a}_{b}") if n else F.lit(float(a == b)))  # noqa: B023, E731
        part = both.select("g", F.lit(k).alias("k"), *(f"m_{a}" for a in range(p)), *((at(a, b) + (FLOORS[DIMS[a]] ** 2 if n and a == b else 0.0)).alias(f"c_{a}_{b}") for a, b in pairs))
        out = part if out is None else out.union(part)
    return out


def _moments(rows: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Mean and covariance of each group and start, with the variances' floors."""
    p = len(dims)
    aggs = [F.avg(dims[a]).alias(f"m_{a}") for a in range(p)]
    aggs += [F.covar_pop(dims[a], dims[b]).alias(f"c_{a}_{b}") for a in range(p) for b in range(a + 1)]
    table = rows.groupBy("g", "k").agg(*aggs)
    for a in range(p):
        table = table.withColumn(f"c_{a}_{a}", F.col(f"c_{a}_{a}") + FLOORS[dims[a]] ** 2)
    return table


def _grouped(rows: DataFrame, min_group: int, most: int, salts: int) -> DataFrame:
    """``rows`` with g: their language and source, or the pool that small groups share."""
    key = F.struct("lang", "source")
    rows = rows.withColumn("k", key)
    sizes = rows.where("not base_failed").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.select("k", F.col("k.lang").alias("lang"), "n", (F.col("n") >= min_group).alias("large"))
    pools = own.where("not large").groupBy(F.struct("lang").alias("l")).agg(F.sum("n").alias("pool"))
    own = own.withColumn("l", F.struct("lang")).join(pools, "l", "left")
    tag = lambda *parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    g = F.when(F.col("large"), tag(F.col("k.lang").alias("lang"), F.col("k.source").alias("source"))).when(F.col("pool") >= min_group, tag(F.col("lang"))).otherwise(F.lit("*"))
    groups = materialize(own.select("k", g.alias("g")), "outlier-groups")
    return _attach(rows, groups, ["k"], groups.limit(most + 1).count() <= most, salts).drop("k").withColumn("g", F.coalesce("g", F.lit("*")))


def judge(stats: DataFrame, *, share: float = 0.75, start_steps: int = 2, max_steps: int = 20, tolerance: float = 1e-6, cut: float = 40.0, min_group: int = 50, accuracy: int = 10_000, broadcast_groups: int = 5000, salts: int = 32) -> DataFrame:
    """``stats`` with base_failed, distance (squared, null without an estimate) and kept.

    ``cut`` bounds the squared distance of DIMS dimensions; 40 is beyond all but
    one in ten million vectors of a Gaussian.
    """
    p = len(DIMS)
    rows = stats.withColumn("base_failed", base_failed()).withColumns(_vector())
    rows = materialize(_grouped(rows, min_group, broadcast_groups, salts), "outlier-rows")
    learn = rows.where("not base_failed").select("doc_id", "n_words", "word_chars", "g", *DIMS)
    quartiles = learn.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(d, [0.25, 0.5, 0.75], accuracy).alias(f"q_{a}") for a, d in enumerate(DIMS)))
    quartiles = materialize(quartiles.where(F.col("n") >= min_group).drop("n"), "outlier-quartiles")
    few = quartiles.limit(broadcast_groups + 1).count() <= broadcast_groups
    attach = lambda left, table, *keys: _attach(left, table, ["g", *keys], few, salts)

    def distances(model: DataFrame) -> DataFrame:
        found = attach(learn, model).where("m_0 is not null").withColumn("d", _distance(DIMS))
        return found.select("doc_id", "n_words", "word_chars", "g", "k", *DIMS, "d")

    def step(model: DataFrame) -> DataFrame:
        """One concentration step of every start; the better of both estimates, with the determinant's fall."""
        near = distances(model)
        limits = materialize(near.groupBy("g", "k").agg(F.percentile_approx("d", share, accuracy).alias("limit")), "outlier-limits")
        core = attach(near, limits, "k").where("d <= limit")
        new = _inverse_factor(_moments(core, DIMS), DIMS)
        best = F.min_by(F.struct(*new.columns), F.struct("logdet", "turn"))
        both = model.select(*new.columns).withColumn("turn", F.lit(1)).union(new.withColumn("turn", F.lit(0)))
        both = both.groupBy("g", "k").agg(best.alias("m"), (F.max_by("logdet", "turn") - F.min("logdet")).alias("fall"))
        return materialize(both.select("m.*", "fall"), "outlier-model")

    # what a start's own scatter measures is no subset's determinant: the first step always counts
    model = materialize(_inverse_factor(_starts(learn, quartiles, few, salts), DIMS).withColumn("logdet", F.lit(float("inf"))), "outlier-model")
    for _ in range(start_steps):
        model = step(model)
    best = F.min_by(F.struct(*model.columns), F.struct("logdet", "k"))
    model = materialize(model.groupBy("g").agg(best.alias("m")).select("m.*"), "outlier-model")
    for _ in range(max_steps):
        model = step(model)
        if (model.agg(F.max("fall")).first()[0] or 0.0) < tolerance:
            break
    middle = distances(model).groupBy("g").agg(F.percentile_approx("d", 0.5, accuracy).alias("middle"))
    # Never narrower than the estimate: shares that are mostly zero have a median near zero.
    final = model.drop("k", "logdet", "fall").join(middle.withColumn("scale", F.greatest(F.col("middle") / _CHI2_HALF[p], F.lit(1.0))).drop("middle"), "g")
    final = materialize(final, "outlier-model")
    judged = attach(rows, final).withColumn("distance", _distance(DIMS) / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return judged.select(*stats.columns, "base_failed", "distance", kept.alias("kept"))


def outliers(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """Statistics of each document and whether it is kept."""
    stats = materialize(statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), "outlier-statistics")
    return judge(stats, **options)
