"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Per text a statistic vector is made from exact counts; per language and source
a minimum-covariance-determinant estimate of centre and scatter is fitted by
concentration steps over all rows, and a row is rejected when its squared
Mahalanobis distance from its group's estimate is above a chi-square quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import materialize, numbered, text_key

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Statistics of the vector: name -> smallest scale taken for it.  A statistic
#: that is constant in most rows of a group (no symbols at all) would otherwise
#: have a scatter of nothing, and any other value an infinite distance.
FLOORS = {"x_length": 0.1, "x_symbols": 0.1, "x_lines": 0.1, "x_repeats": 0.1}
#: Share of a group's rows that the concentration steps keep.
SUBSET = 0.75
#: Whole that is added to each share's own.
PRIOR = {"chars": 100, "lines": 10, "words": 100}
#: Chi-square with 4 degrees of freedom: the quantile of 0.9999.
CHI_CUT = 23.5127
#: Share of the scatter that the nearest 75 % of a normal sample keep (chi-square, 6 over 4 degrees).
SUBSET_SCATTER = 0.6692
MIN_ROWS = 40
#: A concentration step whose log determinant falls by no more than this is a group's last.
LEAST_FALL = 1e-4
#: Parts into which a group's rows are dealt where they meet its estimate, so that a hot group is no one task.
SALTS = 64


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus its counts as long columns prefixed ``q_``.

    q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_lines and
    q_key, the digest of the text.  A null text has the counts of an empty one.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    d = docs.select(*rest, t.alias("_t"), text_key(text_col).alias("q_key"))
    d = d.select(*rest, "_t", "q_key", F.array_remove(F.split("_t", WORD_BREAK), "").alias("_w"),
                 F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"))
    w = F.col("_w")
    d = d.select(
        *rest, "q_key",
        F.size("_w").cast("long").alias("q_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("q_word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("q_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("q_dup_lines"),
        F.size("_l").cast("long").alias("q_lines"),
        # hashes of the three-word windows
        F.when(F.size("_w") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.xxhash64(F.get(w, i), F.lit(1), F.get(w, i + 1), F.lit(2), F.get(w, i + 2)))).alias("_h"))
    # Every array that a lambda indexes is a column of its own: inside the lambda an expression would be
    # evaluated for each element.
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_h")
    sorted_windows = F.col("_s")
    d = d.withColumn("_at", F.sort_array(F.transform(
        F.filter("_s", lambda x, i: (F.get(sorted_windows, i - 1)["h"] == x["h"])
                 | (F.get(sorted_windows, i + 1)["h"] == x["h"])), lambda x: x["i"]))).drop("_s")
    at = F.col("_at")
    covered = F.transform("_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("q_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_at")


def statistic_vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics of each row; shares are taken as angles, lengths as logarithms.

    A share of few lines or words says little, so every share is drawn to
    zero by adding PRIOR to its whole: one repeated line of four is no sign.
    """

    def angle(part: Column, whole: Column, prior: int) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), part / (whole + prior))))

    return stats.withColumns({
        "x_length": F.log((F.col("q_word_chars") + 1.0) / (F.col("q_words") + 1.0)),
        "x_symbols": angle(F.col("q_symbols"), F.col("q_word_chars"), PRIOR["chars"]),
        "x_lines": angle(F.col("q_dup_lines"), F.col("q_lines"), PRIOR["lines"]),
        "x_repeats": angle(F.col("q_repeat_words"), F.col("q_words"), PRIOR["words"])})


def _meet(rows: DataFrame, per_group: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table of one row per ``key``; rows carry _salt, the table is repeated for each salt."""
    spread = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, [key, "_salt"], how)


def _with_factor(est: DataFrame, names: list[str]) -> DataFrame:
    """Adds the Cholesky factor l_<i>_<j> of the scatter column by column, and its log determinant."""
    k = len(names)
    for i in range(k):
        for j in range(i + 1):
            rest = F.col(f"c_{j}_{i}")
            for p in range(j):
                rest = rest - F.col(f"l_{i}_{p}") * F.col(f"l_{j}_{p}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}")
            est = est.withColumn(f"l_{i}_{j}", value)
    logdet = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(k)), F.lit(0.0)) * 2
    return est.withColumn("logdet", logdet)


def _with_distance(rows: DataFrame, names: list[str], out: str) -> DataFrame:
    """Squared distance from the estimate joined to each row, by forward substitution."""
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m_{i}")
        for p in range(i):
            rest = rest - F.col(f"l_{i}_{p}") * F.col(f"_z{p}")
        rows = rows.withColumn(f"_z{i}", rest / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(names))), F.lit(0.0))
    return rows.withColumn(out, total).drop(*[f"_z{i}" for i in range(len(names))])


def _moments(rows: DataFrame, names: list[str], floors: list[float], scale: float) -> DataFrame:
    """Centre and regularised scatter of each group's rows; scatter is divided by ``scale``."""
    aggs = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)]
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            c = F.covar_pop(a, names[j]) / scale
            aggs.append((c + floors[i] ** 2 if i == j else c).alias(f"c_{i}_{j}"))
    return rows.groupBy("g").agg(*aggs)


def mcd_estimates(rows: DataFrame, names: list[str], floors: list[float], subset: float = SUBSET,
                  least: float = LEAST_FALL) -> DataFrame:
    """Per group ``g`` the centre m_<i> and Cholesky factor l_<i>_<j> of the MCD scatter.

    Starts from coordinatewise medians and median absolute deviations; each
    concentration step takes the ``subset`` share of a group's rows nearest to
    the present estimate and refits on them.  A group goes on for as long as
    its log determinant falls by more than ``least``; as the floors bound it
    from below, every group settles, and keeps its smallest.  Quantiles are
    Spark's bounded sketches (accuracy 10,000), so a group never meets in one
    task.  Rows with a null or non-finite statistic must be left out before.
    """
    k = len(names)
    if "_salt" not in rows.columns:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
    mid = rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{i}") for i, x in enumerate(names)])
    mid = materialize(mid)
    spread = (_meet(rows, mid, "g").groupBy("g")
              .agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"d_{i}")
                     for i, x in enumerate(names)]))
    start = mid.join(spread, "g")
    for i in range(k):
        for j in range(i, k):
            own = F.pow(F.col(f"d_{i}") * 1.4826, 2) + floors[i] ** 2
            start = start.withColumn(f"c_{i}_{j}", own if i == j else F.lit(0.0))
    est = materialize(_with_factor(start, names))
    # the start is no fit, so every group takes a first step whatever its determinant
    est, settled = est.withColumn("logdet", F.lit(float("inf"))), None
    while not est.isEmpty():
        near = _with_distance(_meet(rows, est, "g"), names, "d2").select("g", "_salt", *names, "d2")
        cut = materialize(near.groupBy("g").agg(F.percentile_approx("d2", subset, 10_000).alias("cut")))
        kept = _meet(near, cut, "g").where("d2 <= cut")
        new = _with_factor(_moments(kept, names, floors, SUBSET_SCATTER), names)
        fit = F.struct(*[c for c in new.columns if c != "g"])
        both = materialize(est.select("g", fit.alias("old")).join(new.select("g", fit.alias("new")), "g", "left"))
        falls = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - least, F.lit(False))
        best = F.when(F.col("new.logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old"))
        done = both.where(~falls).select("g", best.alias("best")).select("g", "best.*")
        settled = done if settled is None else settled.unionByName(done)
        est = both.where(falls).select("g", "new.*")
    return settled if settled is not None else est


def grouped(rows: DataFrame, lang_col: str, source_col: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds the group ``g``: language and source; small groups of a language are taken together.

    ``g`` is null where even these have fewer than ``min_rows`` rows: there
    is no estimate then.  A null language or source is a value of its own.
    """
    lang = F.concat(F.lit("l:"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")))
    own = F.concat(lang, F.lit("\x1fs:"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    rows = rows.withColumns({"_lang": lang, "_own": own,
                             "_salt": F.pmod(F.xxhash64("q_key"), F.lit(SALTS)).cast("int")})
    sizes = rows.groupBy("_lang", "_own").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_pooled", F.when(F.col("_n") < min_rows, F.col("_lang")))
    pooled = (sizes.where("_pooled is not null").groupBy("_lang")
              .agg(F.sum("_n").alias("_m")).where(F.col("_m") >= min_rows))
    names = (sizes.join(pooled, "_lang", "left")
             .select("_own", F.when(F.col("_pooled").isNull(), F.col("_own"))
                     .when(F.col("_m").isNotNull(), F.col("_lang")).alias("g")))
    return _meet(rows, materialize(names), "_own").drop("_lang", "_own")


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     min_rows: int = MIN_ROWS, cut: float = CHI_CUT) -> DataFrame:
    """Rows of ``docs`` without the text, plus q_ counts, base_failed, distance2 and kept.

    base_failed: fewer than 50 words, or more than half of the words in
    repeated three-word windows.  Such rows are rejected and take no part in
    the estimates.  Others are rejected where distance2 is above ``cut``; a
    row without an estimate (too few rows) is kept and has a null distance2.
    Null and empty texts fail the base; repeated rows are judged alike; an
    empty table gives an empty one; other columns pass through, whatever their
    names, and the added ones come last.
    """
    carried = [c for c in docs.columns if c != text_col]
    docs, (text_col, lang_col, source_col) = numbered(docs, text_col, lang_col, source_col)
    names, floors = list(FLOORS), list(FLOORS.values())
    failed = (F.col("q_words") < 50) | (F.col("q_repeat_words") * 100 > F.col("q_words") * 50)
    rows = statistic_vector(text_statistics(docs, text_col)).withColumn("base_failed", failed)
    rows = materialize(rows)
    sound = grouped(rows.where("not base_failed").withColumns({"_g_lang": F.col(lang_col), "_g_src": F.col(source_col)}),
                    "_g_lang", "_g_src", min_rows).drop("_g_lang", "_g_src")
    sound = materialize(sound)
    est = mcd_estimates(sound.where("g is not null").select("g", "_salt", *names), names, floors)
    judged = _with_distance(_meet(sound, est, "g", "left"), names, "distance2")
    judged = judged.withColumn("kept", F.coalesce(F.col("distance2") <= cut, F.lit(True)))
    base = rows.where("base_failed").withColumns({"distance2": F.lit(None).cast("double"), "kept": F.lit(False)})
    cols = base.columns
    out = judged.select(*cols).unionByName(base).drop(*names)
    own = [c for c in docs.columns if c != text_col]
    added = [c for c in out.columns if c not in own]
    return out.select(*own, *added).toDF(*carried, *added)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source", min_rows: int = MIN_ROWS, cut: float = CHI_CUT) -> DataFrame:
    """The rows of ``docs`` (all columns) that the verdict keeps.

    Rows equal in id and text share a fate: one rejected rejects all.  Other
    columns pass through, whatever their names.
    """
    names = docs.columns
    docs, (id_col, text_col, lang_col, source_col) = numbered(docs, id_col, text_col, lang_col, source_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    verdicts = quality_verdicts(rows, "text", "lang", "source", min_rows, cut)
    bad = materialize(verdicts.where("not kept").select(F.col("id").alias("_id"), F.col("q_key").alias("_key"))
                      .distinct())
    keyed = docs.withColumn("_text_key", text_key(text_col))
    return (keyed.join(bad, keyed[id_col].eqNullSafe(bad["_id"]) & (keyed["_text_key"] == bad["_key"]), "left_anti")
            .drop("_text_key").toDF(*names))
