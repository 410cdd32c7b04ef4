"""Quality rules by robust multivariate outliers; DataFrame operations only.

Each document gets counts from its text and from them a vector of transformed statistics.  For each language and source
the minimum covariance determinant is approached by concentration steps: from coordinate-wise medians, the `support`
share of rows with the smallest Mahalanobis distances gives the next mean and covariance, `steps` times.  A ridge on the
diagonal keeps statistics that are constant in half of the rows from making the covariance singular.  A document is
rejected when its squared distance from the final estimate, rescaled so that the median distance of its group is that of
a chi-squared variable, passes `cutoff`.  The Cholesky factor is written out in columns, so all of it is SQL; sums by
group are combined before the shuffle, and the small table of group estimates is joined back.

Groups with fewer than `least_rows` rows share their language's estimate, and languages with fewer rows share one
estimate of all rows; with fewer than that in all, nothing is rejected by distance.

Words: runs of `[^\\x20\\x09-\\x0D]+`.  Null and empty texts have no words and fail the base rule.  Null languages and
sources are groups of their own.  Equal rows get equal verdicts; repeated ids each give a row.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import SPACES, SPACES_RE, free, keep, stored

SUPPORT = 0.75
STEPS = 3
LEAST_ROWS = 50
#: Squared distance, on the scale of a chi-squared variable with four degrees of freedom.
CUTOFF = 35.0
RIDGE = 0.01
#: Median of a chi-squared variable with four degrees of freedom.
MEDIAN_CHI2 = 3.356694
STATISTICS = ("s0", "s1", "s2", "s3")
#: More groups than this are joined by shuffle.
MAX_BROADCAST_GROUPS = 50_000
#: More rejected rows than this (at 24 bytes each) are joined by shuffle.
MAX_BROADCAST_REJECTED = 500_000


def text_counts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keys plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    rows = docs.select(*keys, body.alias("t"), F.when(trimmed != "", F.split(trimmed, SPACES_RE)).otherwise(F.array().cast("array<string>")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    windows = F.when(
        F.size("w") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(5)])),
    )
    rows = rows.select(
        *keys,
        F.size("w").cast("long").alias("n_words"),
        F.coalesce(F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)), F.lit(0)).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    rows = rows.select(
        *keys,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"),
    )
    same = lambda x, j, d: F.coalesce(F.get("ordered", j + d)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("again", F.array_sort(F.transform(F.filter("ordered", lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"])))
    # a window covers five words, or as many as come before the next repeated window
    covered = F.aggregate("again", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("at")), lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["at"])).alias("n"), i.alias("at")))
    return rows.select(*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered["n"], F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def statistics() -> dict[str, Column]:
    """The transformed vector: length, word length, symbol share, and repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "s0": F.log10(F.col("n_words") + F.lit(1.0)),
        "s1": F.log10((F.col("word_chars") + 1) / n) * 2,
        "s2": F.sqrt(F.col("n_symbols") / n),
        "s3": (F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))) + F.sqrt(F.col("n_repeat_words") / n)) / 2,
    }


def _with(rows: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(per) if few else per, "group", "left")


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance from columns m<i>, c<i>_<j>: Cholesky factor and forward substitution in columns."""
    y: list[str] = [f"y{i}" for i in range(p)]
    return sum((F.col(c) * F.col(c) for c in y[1:]), F.col(y[0]) * F.col(y[0]))


def _factor(per: DataFrame, p: int, ridge: float) -> DataFrame:
    """Adds l<i>_<j>, the lower Cholesky factor of covariance c<i>_<j> plus the ridge."""
    for j in range(p):
        square = F.col(f"c{j}_{j}") + F.lit(ridge) - sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        per = per.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(square, F.lit(ridge / 10))))
        if j + 1 < p:
            below = {}
            for i in range(j + 1, p):
                below[f"l{i}_{j}"] = (F.col(f"c{j}_{i}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}")
            per = per.withColumns(below)
    return per


def _measured(rows: DataFrame, per: DataFrame, few: bool, p: int) -> DataFrame:
    """rows plus d2, the squared distance from the estimate of their group; null without one."""
    out = _with(rows, per, few)
    for i in range(p):
        rest = sum((F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", (F.col(STATISTICS[i]) - F.col(f"m{i}") - rest) / F.col(f"l{i}_{i}"))
    return out.select(*rows.columns, _distance(p).alias("d2"))


def robust_distances(rows: DataFrame, use: Column, learn: DataFrame | None = None, support: float = SUPPORT, steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """rows (group, s0 to s3 and others) plus d2, the squared distance from their group's robust estimate, on the chi-squared scale.

    Only rows for which use holds are learned from; rows without a group have no distance.  learn: the rows to learn from
    where they are others, as where a row counts for several groups.
    """
    p = len(STATISTICS)
    learn = (rows if learn is None else learn).where(use & F.col("group").isNotNull()).select("group", *STATISTICS)
    rank = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(1000))
    per = learn.groupBy("group").agg(*[rank(s, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, s in enumerate(STATISTICS)])
    at = lambda i, k: F.get(f"q{i}", F.lit(k))
    start = {f"m{i}": at(i, 1) for i in range(p)} | {f"c{i}_{j}": (F.pow((at(i, 2) - at(i, 0)) / 1.349, 2) if i == j else F.lit(0.0)) for i in range(p) for j in range(i, p)}
    per = keep(_factor(per.select("group", *[c.alias(k) for k, c in start.items()]), p, ridge))
    few = per.count() <= MAX_BROADCAST_GROUPS
    for _ in range(steps):
        measured = _measured(learn, per, few, p)
        edge = keep(measured.groupBy("group").agg(rank("d2", support).alias("edge")))
        core = _with(measured, edge, few).where(F.col("d2") <= F.col("edge"))
        sums = core.groupBy("group").agg(
            *[F.avg(s).alias(f"m{i}") for i, s in enumerate(STATISTICS)],
            *[F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)],
        )
        per = keep(_factor(sums, p, ridge))
    scale = keep(_measured(learn, per, few, p).groupBy("group").agg(rank("d2", 0.5).alias("middle")))
    # the core is narrower than its group: distances are only ever shrunk, to the chi-squared median
    return _with(_measured(rows, per, few, p), scale, few).withColumn("d2", F.col("d2") / F.greatest(F.col("middle") / MEDIAN_CHI2, F.lit(1.0))).drop("middle")


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS, cutoff: float = CUTOFF, **how: float) -> DataFrame:
    """doc_id, the counts of text_counts, base_failed, d2 (null where no estimate applies) and kept."""
    counts = text_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = counts.withColumns(statistics()).withColumns({"failed": base_failed(), "by_lang": F.concat(F.lit("lang\t"), name("lang")), "by_source": F.concat_ws("\t", F.lit("source"), name("lang"), name("source"))})
    # the statistics are a small share of the texts: as a written table they are read again in few partitions
    rows = stored(rows.drop("lang", "source"), "quality-statistics")
    sized = keep(rows.where(~F.col("failed")).groupBy("by_source", "by_lang").agg(F.count("*").alias("n")))
    few = sized.count() <= MAX_BROADCAST_GROUPS
    langs = sized.groupBy("by_lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("by_lang", "of_lang")
    every = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    group = F.when(F.col("n") >= least_rows, F.col("by_source")).when(F.col("n_lang") >= least_rows, F.col("by_lang")).when(F.lit(every >= least_rows), F.lit("all"))
    groups = sized.join(F.broadcast(langs) if few else langs, F.col("by_lang") == F.col("of_lang")).select(F.col("by_source").alias("of_source"), group.alias("group"))
    learn = None
    if groups.where(~F.col("group").startswith("source\t")).limit(1).count():  # the estimates of languages, or of all, learn from all their rows
        used = groups.select(F.col("group").alias("used")).distinct()
        learn = rows.withColumn("group", F.explode(F.array("by_source", "by_lang", F.lit("all")))).join(F.broadcast(used) if few else used, F.col("group") == F.col("used"), "left_semi")
    rows = rows.join(F.broadcast(groups) if few else groups, F.col("by_source") == F.col("of_source"), "left").drop("of_source", "by_source", "by_lang")
    out = robust_distances(rows, ~F.col("failed"), learn, **how)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), "d2", (~F.col("failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", **how: float) -> DataFrame:
    """docs, all columns, without the documents that judge rejects; of rows with one id, those with the rejected text go."""
    name, at = free(("_quality_id", "_quality_at"), docs.columns)
    marked = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("at")).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    bad = stored(judge(marked, **how).where(~F.col("kept")).select(F.col("doc_id.id").alias(name), F.col("doc_id.at").alias(at)).distinct(), "quality-rejected")
    few = bad.count() <= MAX_BROADCAST_REJECTED
    # a short list of rejected rows leaves the texts where they are
    return docs.join(F.broadcast(bad) if few else bad, docs[doc_id].eqNullSafe(F.col(name)) & (F.xxhash64(docs[text]) == F.col(at)), "left_anti")
