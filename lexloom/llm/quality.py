"""Quality rules: base counts of every document, and robust multivariate outliers by language and source.

Each document's statistics are turned into a vector; for each (lang, source) group the minimum-covariance-determinant
centre and scatter are estimated over all the group's rows by concentration steps from several deterministic starts, each
step a distributed aggregation; documents whose squared Mahalanobis distance passes a chi-square point are rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, join_small, map_batches, written

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("x_length", "x_word", "x_symbol", "x_repeat", "x_lines", "x_case", "x_digit", "x_mark")
#: Least spread of each feature: below it, differences don't count as outlying.
FLOORS = (0.25, 0.04, 0.03, 0.12, 0.12, 0.03, 0.08, 0.03)
#: Characters (words, lines) added to a share's denominator, so that a short text's shares tell less.
PRIOR = {"word_chars": 200, "n_words": 30, "n_lines": 5}
#: Squared-distance bins for the distributed quantiles: 32 for each doubling.
BINS = 32.0
#: What a row is grouped by, and the keys of the group of all rows.
KEYS, ALL = ["g_lang", "g_source"], "\x01"
#: Estimates of at most so many groups and starts (under half a kilobyte each) are broadcast.
MOST_GROUPS = 50_000


def _counts():
    space = str.maketrans("", "", WHITE)
    digits, upper, marks = b"0123456789", bytes(range(65, 91)), b"!\"'()*+,-./:;=?@[\\]^_`{}~"

    def repeats(words: list[bytes]) -> int:
        n = len(words)
        if n < 6:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
        k = len(ids)
        with np.errstate(over="ignore"):
            if k < 6000:  # five ids fit one integer exactly
                g = w[:-4].copy()
                for j in range(1, 5):
                    g = g * np.uint64(k) + w[j : n - 4 + j]
            else:  # the first three, then the first three's rank and the rest
                g = (w[:-4] * np.uint64(k) + w[1 : n - 3]).copy()
                for j in range(2, 5):
                    g = np.unique(g, return_inverse=True)[1].astype(np.uint64) * np.uint64(k) + w[j : n - 4 + j]
        order = np.argsort(g, kind="stable")
        s = g[order]
        same = s[1:] == s[:-1]
        if not same.any():
            return 0
        hit = np.zeros(len(g), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())

    def one(text: str | None) -> tuple:
        if not text:
            return (0,) * 9
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        return (
            len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats(words), len(lines),
            len(raw) - len(raw.translate(None, upper)), len(raw) - len(raw.translate(None, digits)), len(raw) - len(raw.translate(None, marks)),
        )

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")

    def apply(cols):
        rows = list(map(one, cols["text"].to_pylist()))
        return {"doc_id": cols["doc_id"], "lang": cols["lang"], "source": cols["source"]} | dict(zip(names, map(list, zip(*rows))))

    return apply


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of each document (columns doc_id, lang, source, then the counts); a null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"))
    return map_batches(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), f"doc_id {kind}, lang string, source string, {counts}", _counts)


def features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / (F.col(b) + PRIOR[b]))
    return stats.withColumns(
        {
            "x_length": F.log1p("n_words"),
            "x_word": F.log((F.col("word_chars") + 5 * PRIOR["n_words"]) / (F.col("n_words") + PRIOR["n_words"])),
            "x_symbol": share("n_symbols", "word_chars"),
            "x_repeat": share("n_repeat_words", "n_words"),
            "x_lines": share("n_dup_lines", "n_lines"),
            "x_case": share("n_upper", "word_chars"),
            "x_digit": share("n_digits", "word_chars"),
            "x_mark": share("n_marks", "word_chars"),
        }
    )


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance sums by group: partial aggregation, so a hot group costs a row for each task."""
    p = range(len(FEATURES))
    x = [F.col(f) for f in FEATURES]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i]) for i in p]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i in p for j in range(i + 1)]).alias("ss"),
    )


def _scatter(n, s, ss) -> tuple[np.ndarray, np.ndarray]:
    p = len(FEATURES)
    c, m = np.array(s) / n, np.zeros((p, p))
    m[np.tril_indices(p)] = np.array(ss) / n
    return c, np.tril(m) + np.tril(m, -1).T - np.outer(c, c)


def _factor(cov: np.ndarray) -> tuple[list[float], float]:
    """The upper factor of the inverse scatter (d2 = |L^T (x - c)|^2) and the scatter's log determinant, floors applied."""
    cov = cov + np.diag(np.square(FLOORS))
    return np.linalg.cholesky(np.linalg.inv(cov)).T[np.triu_indices(len(FEATURES))].tolist(), float(np.linalg.slogdet(cov)[1])


def _solve(shrink_rows: float):
    """From a group's sums and those of all rows (``t_``) to centre, factor and log determinant.

    Both centre and scatter are averaged with those of all rows, which count as ``shrink_rows`` rows.
    """

    def one(n, s, ss, tn, ts, tss):
        (c, cov), (tc, tcov) = _scatter(n, s, ss), _scatter(tn, ts, tss)
        w = n / (n + shrink_rows)
        return (w * c + (1 - w) * tc).tolist(), *_factor(w * cov + (1 - w) * tcov)

    def apply(cols):
        got = [one(*x) for x in zip(*(cols[k].to_pylist() for k in ("n", "s", "ss", "t_n", "t_s", "t_ss")))]
        return {k: cols[k] for k in (*KEYS, "start")} | {"centre": [g[0] for g in got], "factor": [g[1] for g in got], "logdet": [g[2] for g in got]}

    return apply


def _starts():
    """Three first estimates from robust scales: no correlation, that of tanh scores, and that of spatial signs."""

    def apply(cols):
        out = {k: [] for k in (*KEYS, "start", "centre", "factor", "logdet")}
        for *key, middle, spread, n, s, ss in zip(*(cols[k].to_pylist() for k in (*KEYS, "middle", "spread", "n", "s", "ss"))):
            for start in range(3):
                r = np.eye(len(FEATURES))
                if start:
                    cov = _scatter(n, s[start - 1], ss[start - 1])[1]
                    d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                    r = 0.98 * cov / np.outer(d, d) + 0.02 * r
                factor, logdet = _factor(r * np.outer(spread, spread))
                for k, x in zip(out, (*key, start, middle, factor, logdet)):
                    out[k].append(x)
        return out

    return apply


def _distance() -> Column:
    """Squared Mahalanobis distance from the arrays ``centre`` and ``factor``, as one codegen expression."""
    p, at, total = len(FEATURES), 0, None
    d = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    for i in range(p):
        row = None
        for j in range(i, p):
            term = F.col("factor")[at] * d[j]
            row, at = term if row is None else row + term, at + 1
        total = row * row if total is None else total + row * row
    return total


def chi_square(x: float, p: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    terms = np.cumprod([1.0] + [x / 2 / i for i in range(1, p // 2)])
    return float(1 - np.exp(-x / 2) * terms.sum())


def chi_square_point(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9 * high:
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, p) < share else (low, (low + high) / 2)
    return high


def estimates(used: DataFrame, support: float, max_steps: int, shrink_rows: float, settled: float = 0.01) -> DataFrame:
    """(g_lang, g_source, centre, factor, logdet): the minimum-covariance-determinant estimate of each group.

    Of three deterministic starts, each taken two concentration steps, the one of least determinant goes on, until no
    group's log determinant moves by more than ``settled`` or ``max_steps`` are done. All rows together are a group of
    their own, its keys U+0001, towards which the others shrink. Each step is an aggregation; groups meet rows by broadcast.
    """
    scratch = Scratch(used.sparkSession)
    fit = scratch.write(used.unionByName(used.withColumns({k: F.lit(ALL) for k in KEYS})), "quality-fit")
    kind = "g_lang string, g_source string, start int, centre array<double>, factor array<double>, logdet double"

    middle = fit.groupBy(*KEYS).agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q_{f}") for f in FEATURES])
    spread = [F.greatest((F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / 1.349, F.lit(x)) for f, x in zip(FEATURES, FLOORS)]
    middle = scratch.write(middle.select(*KEYS, F.array(*[F.col(f"q_{f}")[1] for f in FEATURES]).alias("middle"), F.array(*spread).alias("spread")), "quality-middle")
    scored = join_small(fit, middle, KEYS, limit=MOST_GROUPS)
    scores = scored.select(*KEYS, *[((F.col(f) - F.col("middle")[i]) / F.col("spread")[i]).alias(f) for i, f in enumerate(FEATURES)])
    length = F.sqrt(sum(F.col(f) * F.col(f) for f in FEATURES) + 1e-12)
    sums = [_moments(scores.select(*KEYS, *[g(F.col(f)).alias(f) for f in FEATURES]), KEYS) for g in (F.tanh, lambda x: x / length)]
    both = sums[0].join(sums[1].select(*KEYS, F.col("s").alias("s2"), F.col("ss").alias("ss2")), KEYS)
    both = both.join(middle, KEYS).select(*KEYS, "middle", "spread", "n", F.array("s", "s2").alias("s"), F.array("ss", "ss2").alias("ss"))
    model = scratch.write(map_batches(both, kind, _starts), "quality-model")

    def step(model: DataFrame, share: float) -> DataFrame:
        by = [*KEYS, "start"]
        rated = join_small(fit, model, KEYS, limit=MOST_GROUPS).select(*by, *FEATURES, _bin(_distance()).alias("bin"))
        limit = scratch.write(_quantile(rated.select(*by, "bin"), by, share).withColumnRenamed("bin", "limit_bin"), "quality-limit")
        sums = scratch.write(_moments(join_small(rated, limit, by, limit=MOST_GROUPS).where("bin <= limit_bin"), by), "quality-sums")
        target = sums.where(F.col("g_lang") == ALL).select("start", *[F.col(c).alias(f"t_{c}") for c in ("n", "s", "ss")])
        return scratch.write(map_batches(sums.join(F.broadcast(target), "start"), kind, lambda: _solve(shrink_rows)), "quality-model")

    for share in (0.5, support):
        model = step(model, share)
    best = model.groupBy(*KEYS).agg(F.min_by(F.struct("centre", "factor", "logdet"), F.struct("logdet", "start")).alias("m"))
    model = scratch.write(best.select(*KEYS, F.lit(0).alias("start"), "m.*"), "quality-model")
    for _ in range(max_steps - 2):
        before, model = model.select(*KEYS, F.col("logdet").alias("before")), step(model, support)
        moved = model.join(before, KEYS).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        if (moved or 0) <= settled:
            break
    # the scatter of the most central rows is too small: the median squared distance tells by how much
    scaled = join_small(fit, model, KEYS, limit=MOST_GROUPS).select(*KEYS, _bin(_distance()).alias("bin"))
    half = _quantile(scaled, KEYS, 0.5).select(*KEYS, (F.pow(2.0, (F.col("bin") + 0.5) / BINS) / chi_square_point(0.5, len(FEATURES))).alias("scale"))
    result = written(model.join(half, KEYS).select(*KEYS, "centre", "factor", "logdet", F.greatest("scale", F.lit(1.0)).alias("scale")), "quality-model")
    scratch.drop()
    return result


def outliers(stats: DataFrame, support: float = 0.75, max_steps: int = 12, tail: float = 1e-6, shrink_rows: float = 50.0) -> DataFrame:
    """``stats`` with ``distance`` (squared, scaled by the group's median) and ``outlier``.

    ``support``: share of a group's rows on which centre and scatter are concentrated. ``tail``: an outlier's squared
    distance is one that the chi-square law gives less often; it is small because the statistics' tails are heavier than
    normal ones. The scatter is scaled up so that the median squared distance is the chi-square median, but never down,
    as the floors are spreads that don't matter. ``shrink_rows``: all rows count as so many rows of each group, so that the
    estimate of a small group passes smoothly into that of all rows. Rows without words are left out of the estimates and
    are never outliers here (the base rule rejects them). A null language or source forms a group of its own.
    """
    rows = features(stats).withColumns({"g_lang": F.coalesce("lang", F.lit("\x00")), "g_source": F.coalesce("source", F.lit("\x00"))})
    model = estimates(rows.where("n_words > 0").select(*KEYS, *FEATURES), support, max_steps, shrink_rows)
    rated = join_small(rows, model, KEYS, "left", limit=MOST_GROUPS).withColumn("distance", _distance() / F.col("scale"))
    cutoff = chi_square_point(1 - tail, len(FEATURES))
    return rated.withColumn("outlier", F.coalesce((F.col("n_words") > 0) & (F.col("distance") > cutoff), F.lit(False))).drop("centre", "factor", "logdet", "scale", *KEYS, *FEATURES)


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BINS).cast("int")


def _quantile(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The bin that holds the quantile, by group: counts by bin first, so a window sees a bounded number of bins."""
    from pyspark.sql import Window

    count = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    run = count.withColumns({"upto": F.sum("c").over(w.orderBy("bin")), "all": F.sum("c").over(w)})
    return run.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("bin"))


def quality_rules(docs: DataFrame, min_words: int = 10, repeat_percent: int = 20, **how) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, the robust ``distance`` and ``kept`` for every row of ``docs``.

    Null and empty texts have no words and fail the base rule. Repeated rows are rated alike, each kept as a row.
    """
    stats = written(statistics(docs), "quality-stats")
    rated = outliers(stats, **how)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("outlier")).alias("kept"), F.coalesce(F.round("distance", 6), F.lit(0.0)).alias("distance"))
