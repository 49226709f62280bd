"""Quality rules: fixed rules on text statistics, then robust multivariate outliers per language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, join_once, shingles_of, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Share of a group whose scatter is smallest: the h-subset of the minimum covariance determinant.
SUBSET = 0.75
#: Concentration steps from each start before the best start goes on alone, and the least gain of a further step (in the
#: logarithm of the determinant).
FIRST_STEPS, GAIN = 2, 1e-6
#: Quantiles of chi squared with four degrees of freedom, at SUBSET and at 0.9999 (the cut-off): fixed values.
CHI2_SUBSET, CHI2_CUT = 5.385, 23.51
#: Rows that a group's language weighs in its estimate, and all rows weigh in a language's.
PRIOR_ROWS = 50
#: Least standard deviation of each statistic: below it, differences don't matter. Its square is added to each variance.
FLOORS = (0.06, 0.04, 0.12, 0.05)
DIMS = len(FLOORS)
VECTOR = [f"x{i}" for i in range(DIMS)]
#: Bins of squared distance: this many for each doubling, between 2**LOW and 2**HIGH, and parts of one bin.
PER_OCTAVE, LOW, HIGH, PARTS = 8, -12, 24, 4096


def _with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; ``upper``: capitals and marks."""
    t = F.coalesce(F.col(text), F.lit(""))
    only = lambda kind: F.length(F.regexp_replace(t, f"[^{kind}]+", "")).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumns({"__words": words_of(F.col(text)), "__line": lines})
        .withColumn("__hashes", shingles_of(F.col("__words"), 3))
        .withColumns({
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(t) - only(r"\x20\x09-\x0D"),
            "n_symbols": only(SYMBOLS),
            "upper": only(r"\p{Lu}!"),
            "__lines": F.size("__line").cast("long"),
            "n_dup_lines": (F.size("__line") - F.size(F.array_distinct("__line"))).cast("long"),
            "n_repeat_words": _repeated(F.col("__words"), F.col("__hashes")),
        })
    )


def _repeated(words: Column, hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Where no hash occurs twice there are none. Else each window gets one sortable number: the upper bits of its hash,
    then its place. Of neighbours after sorting that share those bits, the words themselves are compared, so that a
    chance agreement is no repeat; then the words that the windows cover are counted in the order of their places.
    """
    shift = lambda way, x: F.call_function(f"shift{way}", x, bits)
    bits = F.length(F.bin(F.size(words)))
    place = lambda x: x.bitwiseAND(shift("left", F.lit(1).cast("long")) - 1).cast("int")

    def twice(keys: Column) -> Column:
        def same(i: Column) -> Column:
            a, b = F.get(keys, i), F.get(keys, i - 1)
            return reduce(lambda x, j: x & (F.get(words, place(a) + j) == F.get(words, place(b) + j)), range(3), shift("right", a) == shift("right", b))

        pairs = F.filter(F.sequence(F.lit(1), F.size(keys) - 1), same)
        return F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda i: F.array(place(F.get(keys, i - 1)), place(F.get(keys, i)))))))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = lambda places: F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    keyed = F.sort_array(F.transform(hashes, lambda h, i: shift("left", shift("right", h)).bitwiseOR(i.cast("long"))))
    # A one-element array binds the sorted numbers, so that they are made once.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array(keyed), lambda k: covered(twice(k))), F.lit(0)))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, the five statistics, ``base_failed`` and the transformed vector ``x0..x3``.

    Words are runs of other characters than space and \\t to \\r; null texts have none. ``n_repeat_words`` counts
    words in 3-word windows that occur twice or more in the text. The vector doesn't grow with length: log of the
    mean word length, and (as square roots of shares) symbols by characters, repeated lines by lines, and capitals
    and exclamation marks by characters.
    """
    s = _with_statistics(docs, text)
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    vector = (F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))), F.sqrt(F.col("upper") / chars))
    return s.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        *[v.alias(x) for v, x in zip(vector, VECTOR, strict=True)],
    )


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
CENTRES = [f"m{i}" for i in range(DIMS)]
SCATTER = [f"c{i}{j}" for i, j in PAIRS]
FACTORS = [f"l{i}{j}" for i, j in PAIRS]
SUMS = ["k", *[f"s{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in PAIRS]]


def _distance() -> Column:
    """Squared Mahalanobis distance to the centre m, given the Cholesky factor l of the scatter."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * z[k], range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        z.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _factored(fit: DataFrame) -> DataFrame:
    """With the Cholesky factor of the scatter and the logarithm of its determinant; one column builds on the others."""
    for i, j in PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return fit.withColumn("logdet", reduce(lambda a, i: a + 2 * F.log(F.col(f"l{i}{i}")), range(DIMS), F.lit(0.0)))


def _starts(rows: DataFrame) -> DataFrame:
    """Three deterministic starts of each group ``g``, all around the medians: scales from interquartile ranges, with no
    correlations, those of hyperbolic tangents, and those of the directions from the centre. ``n``: rows of the group."""
    q = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in VECTOR])
    scale = [F.greatest((F.get(x, F.lit(2)) - F.get(x, F.lit(0))) / 1.349, F.lit(f)) for x, f in zip(VECTOR, FLOORS, strict=True)]
    middle = cut(q.select("g", "n", *[F.get(x, F.lit(1)).alias(m) for x, m in zip(VECTOR, CENTRES, strict=True)], *[s.alias(f"d{i}") for i, s in enumerate(scale)]))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(DIMS)]
    near = join_once(rows, middle, "g", "n").select("g", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    length = F.sqrt(F.greatest(reduce(lambda a, b: a + b, [F.col(f"z{i}") ** 2 for i in range(DIMS)]), F.lit(1e-12)))
    kinds = {"t": lambda i: F.tanh(f"z{i}"), "u": lambda i: F.col(f"z{i}") / length}
    moments = near.groupBy("g").agg(*[F.avg(of(i) * of(j)).alias(f"{name}{i}{j}") for name, of in kinds.items() for i, j in PAIRS])
    least = F.lit(1e-6)

    def scatter(start: int, name: str | None) -> Column:
        corr = lambda i, j: F.lit(0.0) if name is None else F.col(f"{name}{i}{j}") / F.sqrt((F.col(f"{name}{i}{i}") + least) * (F.col(f"{name}{j}{j}") + least))
        return F.struct(F.lit(start).alias("start"), *[((F.lit(1.0) if i == j else corr(i, j)) * F.col(f"d{i}") * F.col(f"d{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])

    both = middle.join(moments, "g").withColumn("c", F.explode(F.array(scatter(0, None), scatter(1, "t"), scatter(2, "u"))))
    return _factored(both.select("g", "n", *CENTRES, "c.*"))


def _slim(df: DataFrame, tasks: int = 1) -> DataFrame:
    """A small table in no more partitions than the cluster has cores (times ``tasks``), whatever was set for texts."""
    return df.coalesce(max(1, tasks * df.sparkSession.sparkContext.defaultParallelism))


def _meet(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """Each row with each estimate of its group: its squared distance ``d2`` and the bin of that."""
    parts = ["start", *CENTRES, *FACTORS]
    if few:
        met = rows.join(F.broadcast(fit.select("g", *parts)), "g")
    else:
        by_group = fit.groupBy("g").agg(F.collect_list(F.struct(*parts)).alias("__fits"), F.max("n").alias("n"))
        met = join_once(rows, by_group, "g", "n").select("g", *VECTOR, F.explode("__fits").alias("__f")).select("g", *VECTOR, "__f.*")
    bins = F.least(F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**LOW))) * PER_OCTAVE), F.lit(HIGH * PER_OCTAVE))
    return met.select("g", "start", *VECTOR, _distance().alias("d2")).withColumn("bin", bins)


def _step(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """Concentrate: mean and scatter of the h = SUBSET n rows of each group that lie nearest under each estimate.

    Rows are summed by bin of distance; the rows of the bin in which the h-th lies are summed again by finer parts, and
    of rows in one part with the h-th (equally far, to 2e-5 of the distance) each counts for an equal share of what is
    left. So the subset has the weight of h rows exactly, and only sums are shuffled. ``before``: the old determinant;
    ``few``: there are few groups, counted before, whose estimates are broadcast.
    """
    near = F.broadcast if few else (lambda df: df)
    slim = _slim if few else (lambda df: df)
    moments = [F.count("*").cast("double").alias("k"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]
    w = Window.partitionBy("g", "start")
    met = _meet(rows, fit, few)
    coarse = met.groupBy("g", "start", "bin").agg(*moments)
    placed = slim((slim(coarse) if few else cut(coarse)).withColumns({"before": F.sum("k").over(w.orderBy("bin")) - F.col("k"), "h": F.ceil(SUBSET * F.sum("k").over(w))}))
    whole = placed.where(F.col("before") + F.col("k") <= F.col("h"))
    edge = placed.where((F.col("before") < F.col("h")) & (F.col("before") + F.col("k") > F.col("h"))).select("g", "start", "bin", (F.col("h") - F.col("before")).alias("left"))
    low = F.pow(F.lit(2.0), F.col("bin") / PER_OCTAVE)
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor((F.col("d2") / low - 1) / (2 ** (1 / PER_OCTAVE) - 1) * PARTS)))
    fine = slim(met.join(near(edge), ["g", "start", "bin"]).withColumn("part", part).groupBy("g", "start", "left", "part").agg(*moments))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("left") - F.col("before")) / F.col("k")))
    taken = fine.withColumn("before", F.sum("k").over(w.orderBy("part")) - F.col("k")).withColumn("share", share).select("g", "start", *[(F.col(c) * F.col("share")).alias(c) for c in SUMS])
    total = slim(whole.select("g", "start", *SUMS).union(slim(taken)).groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in SUMS]))
    mean = [F.col(f"s{i}") / F.col("k") for i in range(DIMS)]
    scatter = [(F.col(f"s{i}{j}") / F.col("k") - mean[i] * mean[j] + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    made = _factored(total.select("g", "start", *[m.alias(c) for m, c in zip(mean, CENTRES, strict=True)], *scatter))
    return made.join(near(fit.select("g", "start", "n", F.col("logdet").alias("before"))), ["g", "start"])


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """(g, n, m0.., c00.., logdet): the minimum-covariance-determinant estimate of each group of ``rows`` (g, x0..x3).

    From each of the deterministic starts come ``FIRST_STEPS`` concentration steps; the start with the least determinant
    goes on until a step gains no more than ``GAIN``. The scatter is that of the subset plus the squares of ``FLOORS``,
    for the steps and the determinant too, so that a statistic that hardly varies does no harm.
    """
    fit = cut(_starts(rows))
    few = fit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for _ in range(FIRST_STEPS):
        fit = cut(_step(rows, fit, few))
    best = Window.partitionBy("g").orderBy("logdet", "start")
    active, done = fit.withColumn("__at", F.row_number().over(best)).where("__at = 1").drop("__at"), None
    while True:
        fit = cut(_step(rows, active, few))
        ended = fit.where(F.col("logdet") >= F.col("before") - GAIN)
        done = ended if done is None else done.unionByName(ended)
        active = fit.where(F.col("logdet") < F.col("before") - GAIN)
        if active.isEmpty():
            return cut(done.select("g", "n", *CENTRES, *SCATTER, "logdet"))


def _shrunk(own: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """Estimates ``own`` mixed with those of the wider group that their column ``key`` names; it weighs PRIOR_ROWS rows."""
    parts = [*CENTRES, *SCATTER]
    named = wider.select(F.col("g").alias("__g"), *[F.col(c).alias(f"w_{c}") for c in parts])
    n = F.col("n")
    return own.join(named, F.col(key) == F.col("__g")).withColumns({c: (n * F.col(c) + PRIOR_ROWS * F.col(f"w_{c}")) / (n + PRIOR_ROWS) for c in parts}).drop("__g", *[f"w_{c}" for c in parts])


def quality_rules(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Judge every document: ``keys``, the statistics, ``base_failed``, ``distance`` (squared Mahalanobis) and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. The others are grouped by
    language and source (null is a value of its own), by language, and all together; each group has its own
    minimum-covariance-determinant estimate over all its rows. A group's estimate is mixed with its language's, which
    weighs ``PRIOR_ROWS`` rows, and that with the common one, so that a group of a few rows doesn't set its own standard
    and one of many does. ``kept`` is false beyond the cut-off of the Mahalanobis distance.

    Only sums by group and bin of distance are shuffled, so a hot source is no burden. Rows stay rows: repeated ones get
    the same verdict, ties in distance share it, null and blank texts fail, long texts are read whole, an empty table
    gives no rows, other columns are left out.
    """
    name = lambda *c: F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-")) for x in c])
    groups = {"__s": F.concat(F.lit("s:"), name(F.col(lang), F.col(source))), "__l": F.concat(F.lit("l:"), name(F.col(lang)))}
    stats = cut(statistics(docs.withColumns(groups), text, (*keys, *groups)))
    good = ~F.col("base_failed")
    # Vectors take a thirtieth of the room of texts: few tasks each step are enough.
    rows = _slim(stats.where(good), 4).select(F.explode(F.array("__s", "__l", F.lit("all"))).alias("g"), *VECTOR)
    fits = minimum_determinant(rows)
    kind = lambda x: fits.where(F.col("g").startswith(x))
    by_lang = _shrunk(kind("l:").withColumn("__all", F.lit("all")), kind("all"), "__all")
    members = stats.where(good).select("__s", "__l").distinct()
    by_source = _factored(_shrunk(kind("s:").join(members, F.col("g") == F.col("__s")), by_lang, "__l")).select("__s", "n", *CENTRES, *FACTORS)
    # The scatter of the nearest share is too small for the whole; chi squared says by how much.
    judged = join_once(stats, by_source, "__s", "n", "left").withColumn("distance", F.when(good, _distance() / F.lit(CHI2_SUBSET / DIMS)))
    return judged.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (good & F.coalesce(F.col("distance") <= CHI2_CUT, F.lit(False))).alias("kept"))
