"""Quality of documents: kernel ridge scores from random Fourier features, calibrated.

One pass turns every whole text into a short row of statistics: shares of kinds of
characters, lengths and shapes of words, how often words and lines repeat, how mixed
neighbouring words are.  Standardised statistics go through random Fourier features, whose products
approximate a Gaussian kernel; the fit is ridge regression on them.  Every partition
adds up its part of the normal equations and Spark sums the parts; the driver solves
one system of ``FEATURES`` unknowns.  Documents of one fold stay out of the fit: their
scores and labels, summed in ``BINS`` bins, give the isotonic calibration.

Labels enter as the weighted mean of their document, so bad and good documents weigh the
same in the fit (classes are unequal), and the calibration restores probabilities.

Defined results: every row gets a score, also null and empty texts (their statistics are
zero); repeated rows get equal scores; several labels of one id count as their mean;
labels without id or value are ignored; without any label, or with labels of one kind
only, every score is the mean label (0.5 without labels); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.functions.storage import materialise
from marketframe.llm.common import pick, table
from marketframe.llm.registry import query
from marketframe.llm.tokens import rows_of

#: Random Fourier features, kernel width in standard deviations, ridge, seed of the draws.
FEATURES = 384
WIDTH = 3.0
RIDGE = 1e-3
SEED = 7
#: Folds of the labelled documents; the first stays out of the fit.
FOLDS = 5
#: Bins of the calibration.
BINS = 2000
#: Score from which a document counts as good.
GOOD = 0.3

STATISTICS = (
    "upper", "letters", "digits", "spaces", "stops", "other_marks", "beyond",
    "words", "word_mean", "word_spread", "long_words", "distinct", "neighbours",
    "shouted", "marked", "wordless", "lines", "line_mean", "repeated_lines", "commonest",
)


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 upper, 1 lower, 2 digit, 3 space, 4 .,;:'\" and -, 5 other, 6 not ASCII."""
    kind = np.full(256, 5, dtype=np.intp)
    for chars, k in (
        (range(65, 91), 0),
        (range(97, 123), 1),
        (range(48, 58), 2),
        (b" \t\n\r\x0b\x0c", 3),
        (b".,;:'\"-()", 4),
        (range(128, 256), 6),
    ):
        kind[list(chars)] = k
    return kind


_KIND = _kinds()
_MARKED = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]").search


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; zeros where there is nothing to measure."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=7)
    upper, lower, digits, spaces, stops, other, beyond = (counts / len(raw)).tolist()
    words = raw.split()
    if not words:
        return [upper, upper + lower + beyond, digits, spaces, stops, other, beyond] + [0.0] * (
            len(STATISTICS) - 7
        )
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        upper,
        upper + lower + beyond,
        digits,
        spaces,
        stops,
        other,
        beyond,
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 20).mean()),
        # distinct words fall with length; against the square root they compare
        len(seen) / n**0.85,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(_MARKED(w) is not None for w in words) / n,
        sum(not w.isalpha() and not re.search(rb"[A-Za-z0-9\x80-\xff]", w) for w in words) / n,
        float(np.log1p(len(lines))),
        float(np.log1p(n / len(lines))),
        1.0 - len(set(lines)) / len(lines),
        max(seen.values()) / n,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        found = [statistics(t) for (t,) in rows_of(iter([batch.select(["text"])]), "text")]
        values = np.array(found, dtype=np.float64).reshape(-1, len(STATISTICS))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [ids, flat.cast(pa.list_(pa.float64()))], names=["doc_id", "stats"]
        )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` of every row."""
    picked = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return picked.mapInArrow(_measured, "doc_id long, stats array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether the document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Standardisation, random features, ridge weights and calibration steps."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray] | None
    base: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        frequencies = draw.normal(scale=1.0 / WIDTH, size=(stats.shape[1], FEATURES - 1))
        shifts = draw.uniform(0.0, 2.0 * np.pi, size=FEATURES - 1)
        # far outliers say no more than eight deviations
        inner = np.clip((stats - self.centre) / self.scale, -8.0, 8.0) @ frequencies
        waves = np.sqrt(2.0 / (FEATURES - 1)) * np.cos(inner + shifts)
        return np.hstack([np.ones((len(stats), 1)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        raw = self.raw(stats)
        if self.steps is None:
            return np.clip(raw, 0.0, 1.0)
        return np.interp(raw, *self.steps)


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(STATISTICS))


def _equations(model: Model, bad: float, good: float):
    """Partition sums of the normal equations: one row per unknown, right side last."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z, y = model.features(_matrix(part)), part.column("quality").to_numpy()
                # each kind of label weighs one half
                weight = y / good + (1.0 - y) / bad
                total += (z * weight[:, None]).T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_pydict(
            {
                "unknown": pa.array(np.arange(FEATURES), pa.int32()),
                "part": pa.array(list(total), pa.list_(pa.float64())),
            }
        )

    return sums


def _add(key, rows):
    parts = rows["part"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    # sums do not depend on the order in which parts arrive
    parts = parts[np.lexsort(parts.T[::-1])]
    return pa.table(
        {"unknown": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([parts.sum(axis=0)])}
    )


def isotonic(values: np.ndarray, sums: np.ndarray, counts: np.ndarray):
    """Non-decreasing means of ``sums / counts`` along ``values``: pool adjacent violators."""
    pools: list[list[float]] = []
    for v, s, c in zip(values.tolist(), sums.tolist(), counts.tolist()):
        pools.append([s, c, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, last = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += c2
            pools[-1][3] = last
    return pools


def calibration(values: np.ndarray, sums: np.ndarray, counts: np.ndarray):
    """Points of the calibrated score: a rising line between flat pools.

    Each pool's mean is drawn towards the overall mean by one observation, so no score
    is 0 or 1, and scores inside flat stretches still rise by a millionth.
    """
    pools = isotonic(values, sums, counts)
    base = sums.sum() / counts.sum()
    x, y = [], []
    for s, c, first, last in pools:
        mean = (s + base) / (c + 1.0)
        x += [first, last] if last > first else [first]
        y += [mean, mean] if last > first else [mean]
    x, y = np.array(x), np.maximum.accumulate(np.array(y))
    rise = (x - x[0]) / max(x[-1] - x[0], 1e-12)
    return np.concatenate([[x[0] - 10.0], x, [x[-1] + 10.0]]), np.concatenate(
        [[0.0], y * (1.0 - 2e-6) + 1e-6 * (1.0 + rise), [1.0]]
    )


def _histogram(model: Model):
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw, y = model.raw(_matrix(part)), part.column("quality").to_numpy()
                # ridge scores of 0/1 labels lie around this range
                place = np.clip((raw + 0.5) / 2.0 * BINS, 0, BINS - 1).astype(np.intp)
                for row, weight in enumerate((raw, y, np.ones(len(raw)))):
                    total[row] += np.bincount(place, weights=weight, minlength=BINS)
        yield pa.RecordBatch.from_pydict(
            {
                "bin": pa.array(np.arange(BINS), pa.int32()),
                **{n: pa.array(total[i]) for i, n in enumerate(("raw", "good", "seen"))},
            }
        )

    return bins


def train(stats: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Model learned from the rows of ``stats`` with a label where ``usable`` holds.

    ``stats`` is the result of ``measured``; ``labels`` has ``doc_id`` and ``quality``.
    """
    known = (
        pick(labels, doc_id="doc_id", quality="quality")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg("quality").alias("quality"))
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS))
    rows = materialise(
        stats.filter(usable).join(known, "doc_id").select("stats", "quality", fold.alias("fold")),
        "quality-rows",
    )
    fitted = rows.filter("fold > 0")
    columns = [F.get("stats", F.lit(i)) for i in range(len(STATISTICS))]
    facts = fitted.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("quality"), F.lit(0.0)).alias("good"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in columns]).alias("spread"),
    ).first()
    n, good = facts["n"], facts["good"]
    empty = np.zeros(len(STATISTICS))
    if not n or good <= 0 or good >= n:
        return Model(empty, empty + 1.0, None, None, good / n if n else 0.5)
    spread = np.array(facts["spread"])
    # a rounded sum may differ between runs in its last digits
    centre, scale = np.round(facts["mean"], 9), np.round(np.where(spread > 1e-6, spread, 1.0), 9)
    model = Model(centre, scale, None, None, good / n)
    parts = (
        fitted.select("stats", "quality")
        .mapInArrow(_equations(model, n - good, good), "unknown int, part array<double>")
        .groupBy("unknown")
        .applyInArrow(_add, "unknown int, part array<double>")
        .orderBy("unknown")
        .toArrow()
    )
    system = np.array(parts["part"].to_pylist())
    model.weights = np.linalg.solve(
        system[:, :-1] + RIDGE * np.eye(FEATURES), system[:, -1]
    )
    found = (
        rows.filter("fold = 0")
        .select("stats", "quality")
        .mapInArrow(_histogram(model), "bin int, raw double, good double, seen double")
        .groupBy("bin")
        .agg(*[F.sum(c).alias(c) for c in ("raw", "good", "seen")])
        .filter("seen > 0")
        .orderBy("bin")
        .toPandas()
    )
    if len(found):
        raw, hits, seen = (found[c].to_numpy() for c in ("raw", "good", "seen"))
        model.steps = calibration(raw / seen, hits, seen)
    return model


def scorer(model: Model):
    """A column function: statistics -> score."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = [np.empty(0)]
            for at in range(0, len(part), 2048):
                some = part.slice(at, 2048)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                out.append(model.score(flat.reshape(len(some), len(STATISTICS))))
            yield pa.array(np.concatenate(out))

    return score


@query("op12_fourier_quality")
def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(measured(table(spark, sf_dir, "documents")), "statistics")
    model = train(stats, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return stats.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("stats")).alias("score")
    ).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
