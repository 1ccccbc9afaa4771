"""Quality rules by robust multivariate outliers.

Every document is a vector of transformed statistics (see :data:`STATISTICS`). For each language
and source the minimum covariance determinant estimate gives a centre and a scatter that a
minority of odd documents cannot bend, and documents far from the centre by Mahalanobis distance
are rejected.

Concentration steps start from two robust guesses (medians with squared median deviations, and
the same scaled correlation of spatial signs). In each, a histogram of log distances tells the
radius that holds at least half of the group, and the mean and covariance of the documents within
it are the next guess, until the radius stands still or the determinant falls no more. The better
of the two ends is scaled to the normal distribution and reweighted by all documents within its 97.5 %
quantile.

The estimate of a small group is uncertain, so every language and source has its own estimate
combined with that of its whole language, which counts for ``PRIOR`` documents, and that one
likewise with the estimate of all documents: the posterior mean under a normal inverse Wishart
prior. A group of ten documents thus mostly follows its language and one of ten thousand itself, with
no size at which the rule changes. The estimate of all is combined with a scatter of one, worth
``P`` documents, so that a handful of documents rejects none of its own.

Groups of up to ``LOCAL`` documents are estimated each by one task, from at most so many vectors;
larger ones by aggregations over all tasks, one pass a step: the moments of each histogram bin are
summed, so that the radius and the next guess come from the same rows. Both follow the same steps.
The estimates are rows of tables; nothing of them is collected.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import attached, fresh, mix, slices, small_batches, stored, token_hashes

STATISTICS = ("upper", "symbols", "digits", "word_length", "punctuation", "line_repeats", "word_repeats")
P = len(STATISTICS)
REJECT = 1e-6  # chance that a regular document of a normal group is rejected
PRIOR = 30 * P  # documents that the estimate of a language counts for in that of its sources
LOCAL = 16_384  # vectors of a group, of 64 bytes each, that one task may hold
BINS = 400
NEAR = 8  # bins to both sides of the last radius whose moments are kept apart in a step
FLOOR = 0.1  # least standard deviation of a transformed statistic
BROADCAST_ROWS = 20_000  # tables of groups with more rows (of up to 400 bytes) are joined by a shuffle instead

LETTER, UPPER, DIGIT, SPACE, STOP, SYMBOL = range(6)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            out[c] = UPPER if kind in ("Lu", "Lt") else LETTER
        elif kind[0] == "N":
            out[c] = DIGIT
        elif kind[0] == "Z":
            out[c] = SPACE
    out[[9, 10, 11, 12, 13]] = SPACE
    out[[ord(x) for x in ".,;:'’-"]] = STOP
    return out


def raw_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: characters of each class, words, words that repeat the one before them, lines with
    words, and lines that repeat one of the text."""
    n = len(at) - 1
    out = np.zeros((n, 10), np.float64)
    if not len(data):
        return out
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))[at]  # the texts' bounds in code points
    kind = classes().take(code)
    for k in range(6):
        running = np.cumsum(kind == k, dtype=np.int32)
        out[:, k] = np.diff(np.append(0, running)[edges])
    word, start, bounds = token_hashes(data, at)
    out[:, 6] = np.diff(bounds)
    if not len(word):
        return out
    row = np.repeat(np.arange(n), np.diff(bounds))
    again = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    out[:, 7] = np.bincount(row[1:][again], minlength=n)
    line = np.cumsum(data == 10)[start] + row
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    place = np.arange(len(word)) - np.repeat(first, np.diff(first, append=len(word)))
    whole = np.add.reduceat(mix(word + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    owner = row[first]
    out[:, 8] = np.bincount(owner, minlength=n)
    order = np.lexsort((whole, owner))
    whole, owner = whole[order], owner[order]
    again = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    out[:, 9] = np.bincount(owner[1:][again], minlength=n)
    return out


def transform(counts: np.ndarray) -> np.ndarray:
    """The vectors: logarithms of shares and of the mean word length.

    A share is first shrunk towards a usual value, which weighs like ``pull`` more characters,
    words or lines, so that short texts are not extreme by chance; ``ease`` is added so that the first
    few of what is rare do not count as a multiple of nothing.
    """
    letter, upper, digit, _, stop, symbol, words, stutter, lines, repeats = counts.T
    letters = letter + upper
    visible = letters + digit + stop + symbol

    def share(part: np.ndarray, whole: np.ndarray, usual: float, pull: float, ease: float) -> np.ndarray:
        return np.log(ease + (part + usual * pull) / (whole + pull))

    return np.stack(
        [
            share(upper, letters, 0.03, 400, 0.05),
            share(symbol, visible, 0.0, 200, 0.05),
            share(digit, visible, 0.0, 300, 0.2),
            np.log((letters + 5 * 40) / (words + 40)),
            share(stop, visible, 0.03, 200, 0.05),
            share(repeats, lines, 0.0, 20, 0.3),
            share(stutter, words, 0.0, 50, 0.05),
        ],
        axis=1,
    )


def vectors(column: pa.Array) -> np.ndarray:
    parts = [transform(raw_counts(data, at)) for _, data, at in slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, P))


@F.pandas_udf(ArrayType(DoubleType()))
def statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The vector of each text; null for a null text or one without a visible character."""
    for part in texts:
        column = pa.array(part, pa.string())
        found = vectors(column)
        bare = part.isna().to_numpy() | ~part.fillna("").str.contains(r"\S", regex=True).to_numpy(bool)
        yield pd.Series([None if b else v for v, b in zip(found, bare, strict=True)], dtype=object)


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square(q: float, degrees: int) -> float:
    """The quantile ``q`` of the chi-square distribution, by bisection."""
    lo, hi = 0.0, 10.0
    while gamma_p(degrees / 2, hi / 2) < q and hi < 1e4:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(degrees / 2, mid / 2) < q else (lo, mid)
    return (lo + hi) / 2


def solid(cov: np.ndarray) -> np.ndarray:
    """A covariance with eigenvalues of at least ``FLOOR`` squared."""
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    return (v * np.maximum(w, FLOOR**2)) @ v.T


def edge_of(bin_: int) -> float:
    """The upper end of a histogram bin: squared distances from 1e-4 to 1e8 in equal steps of the logarithm."""
    return 10 ** (-4 + 12 * (bin_ + 1) / BINS)


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_X, _M, _W = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)], [f"w{i}_{j}" for i, j in _PAIRS]
_TERMS = [f"{1 if i == j else 2} * w{i}_{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in _PAIRS]
_DISTANCE = "greatest(0D, " + " + ".join(_TERMS) + ")"  # the squared Mahalanobis distance
_BIN = f"cast(greatest(0, least({BINS - 1}, floor((log10(d + 1e-300) + 4) * {BINS / 12}))) as int)"
_SUMS = ["cast(count(*) as double)", *[f"sum(x{i} - m{i})" for i in range(P)], *[f"sum((x{i} - m{i}) * (x{j} - m{j}))" for i, j in _PAIRS]]
Estimate = tuple[np.ndarray, np.ndarray]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{c} double" for c in names)


_STATE = f"g long, k int, n long, done boolean, det double, bin int, low int, high int, {_doubles([*_M, *_W])}"
_OWN = "g long, n long, mean array<double>, cov array<double>"


def _upper(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in _PAIRS]


def _matrix(upper) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), x in zip(_PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _moments(sums: np.ndarray, mean: np.ndarray) -> Estimate:
    """Mean and covariance from a row of ``_SUMS`` about ``mean``."""
    n, shift = sums[0], sums[1 : P + 1] / sums[0]
    return mean + shift, solid(_matrix(sums[P + 1 :]) / n - np.outer(shift, shift))


def half(n: int) -> int:
    """How many of n documents the estimate rests on; since scatters have a floor, half will do in groups of few too."""
    return (n + 1) // 2


def starts(median: np.ndarray, deviation: np.ndarray, signs: np.ndarray) -> list[Estimate]:
    """The two first guesses, from medians, scaled median deviations and the mean product of signs."""
    spread = np.maximum(deviation, FLOOR)
    scale = np.sqrt(np.maximum(np.diag(signs), 1e-12))
    return [(median, np.diag(spread**2)), (median, solid(signs / np.outer(scale, scale) * np.outer(spread, spread)))]


def scaled(mean: np.ndarray, cov: np.ndarray, bin_: int) -> Estimate:
    """Consistent at the normal distribution: the radius of half the documents is the chi-square median."""
    return (mean, solid(cov * min(1e6, edge_of(bin_) / chi_square(0.5, P)))) if bin_ < BINS - 1 else (mean, cov)


def _products(x: np.ndarray) -> np.ndarray:
    """The ``_SUMS`` of each row of centred vectors by itself."""
    return np.concatenate([np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in _PAIRS], axis=1)], axis=1)


def _squared(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x))


def fit_points(x: np.ndarray) -> Estimate:
    """The reweighted MCD centre and scatter of the rows of an array."""
    n = len(x)
    median = np.sort(x, axis=0)[(n - 1) // 2]
    deviation = np.maximum(1.4826 * np.sort(np.abs(x - median), axis=0)[(n - 1) // 2], FLOOR)
    y = (x - median) / deviation
    y = y / (np.sqrt((y * y).sum(axis=1)) + 1e-12)[:, None]
    ends = []
    for k, (mean, cov) in enumerate(starts(median, deviation, y.T @ y / n)):
        det, last = math.inf, -1
        while True:
            d = _squared(x - mean, cov)
            bins = np.clip(np.floor((np.log10(d + 1e-300) + 4) * (BINS / 12)), 0, BINS - 1).astype(int)
            at = int(np.searchsorted(np.cumsum(np.bincount(bins, minlength=BINS)), half(n)))
            if at == last:
                break
            new, scatter = _moments(_products(x[bins <= at] - mean).sum(axis=0), mean)
            less = float(np.linalg.slogdet(scatter)[1])
            if less > det - 1e-9:
                break
            mean, cov, det, last = new, scatter, less, at
        ends.append((det, k, at, mean, cov))
    _, _, at, mean, cov = min(ends, key=lambda e: e[:2])
    mean, cov = scaled(mean, cov, at)
    near = x[_squared(x - mean, cov) <= chi_square(0.975, P)]
    return _moments(_products(near - mean).sum(axis=0), mean) if len(near) else (mean, cov)


def _key(level: int, *columns: Column) -> Column:
    """The number of a group; nulls are a value of their own."""
    return F.xxhash64(F.lit(level), *[x for c in columns for x in (c.isNull(), F.coalesce(c, F.lit("")))])


def described(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, lang, source, g0, g1, g2, x0..): the documents' vectors and the numbers of their groups
    (all, language, language and source), stored; ``row`` names a column to add with the whole rows."""
    small_batches(docs.sparkSession)
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)] if row else []
    out = docs.select(*whole, F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), source.alias("source"), statistics("text").alias("v"))
    groups = [_key(0).alias("g0"), _key(1, F.col("lang")).alias("g1"), _key(2, F.col("lang"), F.col("source")).alias("g2")]
    return stored(out.select(*([row] if row else []), "doc_id", "lang", "source", *groups, *[F.col("v")[i].alias(f"x{i}") for i in range(P)]), "vectors")


def _by_group(rows: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """Rows joined with a table of one row a group, which has the group's size as ``n``."""
    return rows.join(F.broadcast(table), "g") if groups <= BROADCAST_ROWS else attached(rows, table, "g", "n")


def _local(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    mean, cov = fit_points(rows[_X].to_numpy(np.float64))
    return pd.DataFrame({"g": [key[0]], "n": [len(rows)], "mean": [mean.tolist()], "cov": [_upper(cov)]})


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states that the two starts of each group begin with."""
    for part in batches:
        out = []
        for r in part.to_dict("records"):
            for k, (mean, cov) in enumerate(starts(np.array(r["median"]), np.array(r["deviation"]), _matrix(r["signs"]))):
                out.append((r["g"], k, r["n"], False, math.inf, -1, 0, BINS - 1, *mean.tolist(), *_upper(np.linalg.inv(cov))))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _STATE.split(", ")])


def _advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A concentration step of each state, from the sums of its bins."""
    names = [x.split()[0] for x in _STATE.split(", ")]
    for part in batches:
        out = []
        for r in part.to_dict("records"):
            sums = np.stack(r["sums"]) if r["sums"] is not None and len(r["sums"]) else np.zeros((0, 2 + P + len(_PAIRS)))
            sums = sums[np.argsort(sums[:, 0])]
            at = int(np.searchsorted(np.cumsum(sums[:, 1]), half(int(r["n"]))))
            bin_ = int(sums[at, 0]) if at < len(sums) else BINS
            if bin_ > r["high"] or bin_ <= r["low"] and r["low"] > 0:  # not among the bins looked at apart
                r["low"], r["high"] = 0, BINS - 1
            elif bin_ == r["bin"]:
                r["done"] = True
            else:
                mean, cov = _moments(sums[: at + 1, 1:].sum(axis=0), np.array([r[c] for c in _M]))
                det = float(np.linalg.slogdet(cov)[1])
                if det > r["det"] - 1e-9:
                    r["done"], r["bin"] = True, bin_
                else:
                    r |= {"det": det, "bin": bin_, "low": max(0, bin_ - NEAR), "high": min(BINS - 1, bin_ + NEAR)}
                    r |= dict(zip(_M, mean.tolist(), strict=True)) | dict(zip(_W, _upper(np.linalg.inv(cov)), strict=True))
            out.append(tuple(r[c] for c in names))
        yield pd.DataFrame(out, columns=names)


def _usual(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        for i, r in enumerate(part.to_dict("records")):
            _, cov = scaled(np.zeros(P), np.linalg.inv(_matrix([r[c] for c in _W])), int(r["bin"]))
            part.loc[part.index[i], _W] = _upper(np.linalg.inv(cov))
        yield part


def _reweighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        out = []
        for r in part.to_dict("records"):
            mean, cov = np.array([r[c] for c in _M]), np.linalg.inv(_matrix([r[c] for c in _W]))
            if r["sums"] is not None:
                mean, cov = _moments(np.array(r["sums"]), mean)
            out.append((r["g"], r["n"], mean.tolist(), _upper(cov)))
        yield pd.DataFrame(out, columns=["g", "n", "mean", "cov"])


def _spread(points: DataFrame, groups: int) -> DataFrame:
    """(g, n, mean, cov) of the groups of ``points`` (g, n, x0..) by aggregations."""
    medians = stored(points.groupBy("g").agg(F.first("n").alias("n"), *[F.percentile_approx(x, 0.5, 10000).alias(m) for x, m in zip(_X, _M, strict=True)]), "medians")
    rows = points.drop("n")
    away = [F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 10000).alias(f"d{i}") for i, (x, m) in enumerate(zip(_X, _M, strict=True))]
    spreads = _by_group(rows, medians, groups).groupBy("g").agg(*away)
    spreads = stored(medians.join(spreads, "g").select("g", "n", *_M, *[F.greatest(F.lit(FLOOR), 1.4826 * F.col(f"d{i}")).alias(f"d{i}") for i in range(P)]), "spreads")
    signs = _by_group(rows, spreads, groups).select("g", *[F.expr(f"(x{i} - m{i}) / d{i}").alias(f"y{i}") for i in range(P)])
    signs = signs.withColumn("r", F.expr("sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(P)) + ") + 1e-12"))
    signs = signs.groupBy("g").agg(F.array(*[F.avg(F.expr(f"y{i} * y{j} / (r * r)")) for i, j in _PAIRS]).alias("signs"))
    first = spreads.join(signs, "g").select("g", "n", F.array(*_M).alias("median"), F.array(*[f"d{i}" for i in range(P)]).alias("deviation"), "signs")
    state = stored(first.mapInPandas(_first, _STATE), "states")
    while True:
        live = state.where("not done")
        near = _by_group(rows, live, 2 * groups).withColumn("d", F.expr(_DISTANCE)).withColumn("at", F.expr(_BIN)).where("at <= high")
        sums = near.groupBy("g", "k", F.greatest("at", "low").alias("at")).agg(F.array(*map(F.expr, _SUMS)).alias("sums"))
        sums = sums.groupBy("g", "k").agg(F.collect_list(F.concat(F.array(F.col("at").cast("double")), "sums")).alias("sums"))
        moved = live.join(sums, ["g", "k"], "left").mapInPandas(_advance, _STATE)
        state = stored(moved.unionByName(state.where("done")), "states")
        if state.where("not done").isEmpty():
            break
    better = F.row_number().over(Window.partitionBy("g").orderBy("det", "k"))
    best = stored(state.withColumn("place", better).where("place = 1").drop("place").mapInPandas(_usual, _STATE), "states")
    near = _by_group(rows, best, groups).where(f"{_DISTANCE} <= {chi_square(0.975, P)!r}").groupBy("g").agg(F.array(*map(F.expr, _SUMS)).alias("sums"))
    return best.join(near, "g", "left").mapInPandas(_reweighted, _OWN)


def fit(vectors: DataFrame, local: int = LOCAL) -> DataFrame:
    """(g, n, mean, cov): the reweighted MCD estimate of each group of each level by itself, stored."""
    points = vectors.where("x0 is not null").select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *_X)
    sizes = stored(points.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    groups, large = sizes.agg(F.count("*"), F.count_if(F.col("n") > local)).first()
    sized = _by_group(points, sizes, groups)
    out = sized.where(F.col("n") <= local).groupBy("g").applyInPandas(_local, _OWN)
    if large:
        out = out.unionByName(_spread(sized.where(F.col("n") > local), large))
    return stored(out, "own")


def combined(n: float, mean: np.ndarray, cov: np.ndarray, prior: float, centre: np.ndarray, scatter: np.ndarray) -> Estimate:
    """An estimate of n documents together with a wider one that counts for ``prior`` documents."""
    apart = mean - centre
    total = n + prior
    return (n * mean + prior * centre) / total, solid((n * cov + prior * scatter + n * prior / total * np.outer(apart, apart)) / total)


def _levels(prior: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                estimate = (np.array(r["mean0"]), np.eye(P))
                for level, weight in ((0, P), (1, prior), (2, prior)):
                    estimate = combined(r[f"n{level}"], np.array(r[f"mean{level}"]), _matrix(r[f"cov{level}"]), weight, *estimate)
                out.append((r["g2"], r["n2"], *estimate[0].tolist(), *_upper(np.linalg.inv(estimate[1]))))
            yield pd.DataFrame(out, columns=["g", "n", *_M, *_W])

    return run


def estimates(vectors: DataFrame, prior: float = PRIOR, local: int = LOCAL) -> DataFrame:
    """(g, n, m0.., w0_0..): the parameters that each language and source is judged by, stored."""
    own = fit(vectors, local)
    out = vectors.where("x0 is not null").select("g0", "g1", "g2").distinct()
    for level in range(3):
        out = out.join(own.select(F.col("g").alias(f"g{level}"), *[F.col(c).alias(f"{c}{level}") for c in ("n", "mean", "cov")]), f"g{level}")
    return stored(out.mapInPandas(_levels(prior), f"g long, n long, {_doubles([*_M, *_W])}"), "estimates")


def judged(vectors: DataFrame, reject: float, prior: float, local: int) -> DataFrame:
    """The rows of ``vectors`` that are kept, with ``distance`` and ``cutoff``."""
    table = estimates(vectors, prior, local)
    rows = vectors.withColumnRenamed("g2", "g")
    cutoff = chi_square(1 - reject, P)
    found = _by_group(rows.where("x0 is not null"), table, table.count()).withColumn("distance", F.expr(_DISTANCE)).where(F.col("distance") <= cutoff)
    bare = rows.where("x0 is null").withColumn("distance", F.lit(None).cast("double"))
    kept = [c for c in rows.columns if c != "g"]
    return found.select(*kept, "distance").unionByName(bare.select(*kept, "distance")).withColumn("cutoff", F.lit(cutoff))


def regular(docs: DataFrame, reject: float = REJECT, prior: float = PRIOR, local: int = LOCAL) -> DataFrame:
    """(doc_id, lang, source, distance, cutoff) of the documents that are kept.

    A document goes if its squared distance exceeds the chi-square quantile 1 - ``reject``. Each
    language and source is judged by its own estimate, however few documents it has.
    Defined cases: a null text, and one without a visible character, has no vector and is kept
    with a null distance; null languages and sources are groups of their own; equal statistics get
    equal distances, so ties go together; repeated rows count as often as they come; a group of one
    repeated text has a scatter of ``FLOOR``; an empty table gives an empty result; other columns
    play no part.
    """
    return judged(described(docs), reject, prior, local).select("doc_id", "lang", "source", "distance", "cutoff")


def keep_regular(docs: DataFrame, reject: float = REJECT, prior: float = PRIOR, local: int = LOCAL) -> DataFrame:
    """The documents without the outliers; columns stay as they are.

    As :func:`regular`, but the vectors are stored beside the rows, so that they are computed once
    and no text is shuffled.
    """
    row = fresh(docs.columns, "row")
    return judged(described(docs, row), reject, prior, local).select(f"{row}.*")
