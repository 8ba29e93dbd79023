"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and everything but letters becomes one space; n-grams of one
to three characters are hashed to a fixed number of features.  Document frequencies
are counted over all training texts.  The weights are fitted on a bounded sample
(``SAMPLE`` texts per language, chosen by a hash of id and text) by follow-the-regularised-
leader with elastic-net penalties: each round, every shard of the sample continues
from the common state and the states' changes are averaged.  A fifth of the sample is
left out of the fit and sets the temperature that makes the scores calibrated.
Everything runs on the executors; the driver sees document frequencies by feature,
the model, and one loss per candidate temperature.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing could be learned; texts of any length are read as a whole, in
sections; repeated rows get equal results; an empty table gives no rows; equal scores
go to the first language in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.functions.storage import materialise
from marketframe.llm.common import column, pick, table
from marketframe.llm.registry import query
from marketframe.llm.tokens import rows_of

UNKNOWN = "und"
#: Hashed features, and characters read at once.
FEATURES = 1 << 16
SECTION = 1 << 20
#: Texts per language that the fit may see, shards and rounds of the fit.
SAMPLE = 1000
SHARDS = 6
ROUNDS = 3
#: Part of the sample left out of the fit, for the temperature.
CALIBRATION = 5
#: Follow-the-regularised-leader: step, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 0.1, 2e-3, 1e-3
TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(5.0), 45))

#: What sums over tasks count in: whole numbers add up alike in any order.
UNIT = float(1 << 32)

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_SALT = np.array([0x27D4EB2F, 0x165667B1, 0x2545F491], dtype=np.uint32)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with one space for all between letters."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint32)
    # a space stays where it is the first after a letter
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, points, np.uint32(32))[keep]
    return np.concatenate([np.array([32], dtype=np.uint32), out])


def features_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all n-grams and how often each occurs."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for at in range(0, len(points), SECTION):
        for n in (1, 2, 3):
            part = points[at : at + SECTION + n - 1]
            total = len(part) - n + 1
            if total <= 0:
                continue
            mixed = np.full(total, _SALT[n - 1], dtype=np.uint32)
            for k in range(n):
                mixed += part[k : k + total] * _MIX[k]
            mixed ^= mixed >> np.uint32(15)
            mixed *= _MIX[0]
            counts += np.bincount(mixed >> shift, minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; term frequency counts by its logarithm."""
    values = (1.0 + np.log(counts)) * idf[found]
    norm = np.sqrt(values @ values)
    return values / norm if norm > 0 else values


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        points = letters_of(text)
        if not len(points) or not self.languages:
            return None
        found, counts = features_of(points)
        return weighted(found, counts, self.idf) @ self.weights[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        logits = self.logits(text)
        if logits is None:
            return UNKNOWN, 0.0
        shares = softmax(logits / self.temperature)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader state of all features and classes."""

    def __init__(self, classes: int):
        self.z = np.zeros((FEATURES, classes))
        self.n = np.zeros((FEATURES, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, found: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(found)
        error = softmax(values @ w)
        error[label] -= 1.0
        gradient = values[:, None] * error
        square = gradient * gradient
        n = self.n[found]
        self.z[found] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * w
        self.n[found] = n + square


def held_out(doc_id: Column) -> Column:
    """Whether the document's language may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frequency = np.zeros(FEATURES + 1, dtype=np.int64)
    for (text,) in rows_of(batches, "text"):
        points = letters_of(text)
        if len(points):
            frequency[features_of(points)[0]] += 1
            frequency[FEATURES] += 1
    found = np.flatnonzero(frequency)
    yield pa.RecordBatch.from_pydict(
        {"feature": pa.array(found, pa.int64()), "docs": pa.array(frequency[found], pa.int64())}
    )


def _sampled(idf: np.ndarray):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = "text", "label", "fold", "shard", "place"
        for text, label, fold, shard, place in rows_of(batches, *columns):
            points = letters_of(text)
            if len(points):
                found, counts = features_of(points)
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array([label], pa.int32()),
                        "fold": pa.array([fold], pa.int32()),
                        "shard": pa.array([shard], pa.int64()),
                        "place": pa.array([place], pa.int64()),
                        "found": pa.array([found.astype("<i4").tobytes()], pa.binary()),
                        "vals": pa.array(
                            [weighted(found, counts, idf).astype("<f4").tobytes()], pa.binary()
                        ),
                    }
                )

    return vectors


def _examples(batches: Iterator[pa.RecordBatch]):
    for label, found, values in rows_of(batches, "label", "found", "vals"):
        yield label, np.frombuffer(found, "<i4"), np.frombuffer(values, "<f4").astype(float)


def _continue(z: np.ndarray, n: np.ndarray):
    def fit(rows: pa.Table) -> pa.Table:
        state = Leader(z.shape[1])
        state.z[:], state.n[:] = z, n
        for label, found, values in _examples(rows.sort_by("place").to_batches()):
            state.learn(found, values, label)
        moved = np.flatnonzero((state.n != n).any(axis=1))
        whole = lambda now, before: pa.array(
            np.rint((now[moved] - before[moved]) * UNIT).astype(np.int64).ravel()
        )
        return pa.table(
            {
                "feature": pa.array(np.repeat(moved, z.shape[1]), pa.int64()),
                "label": pa.array(np.tile(np.arange(z.shape[1]), len(moved)), pa.int32()),
                "z": whole(state.z, z),
                "n": whole(state.n, n),
            }
        )

    return fit


def _losses(weights: np.ndarray):
    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others = (np.zeros(len(TEMPERATURES), dtype=np.int64) for _ in range(2))
        seen = 0
        for label, found, values in _examples(batches):
            logits = values @ weights[found]
            losses = -np.log(
                np.maximum(softmax(logits[None, :] / TEMPERATURES[:, None]), 1e-300)
            )
            rest = np.delete(losses, label, axis=1).sum(axis=1) / max(1, len(logits) - 1)
            own += np.rint(losses[:, label] * UNIT).astype(np.int64)
            others += np.rint(rest * UNIT).astype(np.int64)
            seen += 1
        yield pa.RecordBatch.from_pydict(
            {
                "place": pa.array(np.arange(len(TEMPERATURES)), pa.int32()),
                "own": pa.array(own),
                "others": pa.array(others),
                "seen": pa.array(np.full(len(TEMPERATURES), seen), pa.int64()),
            }
        )

    return losses


def train(
    docs: DataFrame,
    usable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
) -> Model:
    """Model learned from rows of ``docs`` where ``usable`` holds and the language is known."""
    rows = (
        docs.filter(usable)
        .select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"), column(docs, lang).alias("lang"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    )
    by_language = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(by_language)
    idf = np.zeros(FEATURES)
    weights = np.zeros((FEATURES, max(1, len(languages))))
    if not languages:
        return Model([], idf, weights)
    counted = (
        rows.select("text")
        .mapInArrow(_frequencies, "feature long, docs long")
        .groupBy("feature")
        .agg(F.sum("docs").alias("docs"))
        .toPandas()
    )
    frequency = np.zeros(FEATURES + 1)
    frequency[counted["feature"].to_numpy()] = counted["docs"].to_numpy()
    idf = np.log((1.0 + frequency[FEATURES]) / (1.0 + frequency[:FEATURES])) + 1.0

    # hashes of id and text, so the sample does not depend on where rows lie
    hashed = lambda salt, n: F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(n))
    place = hashed(1, 1 << 30)
    label, chosen = F.lit(None).cast("int"), F.lit(False)
    for i, name in enumerate(languages):
        share = min(1.0, sample / by_language[name])
        label = F.when(F.col("lang") == name, i).otherwise(label)
        chosen = F.when(F.col("lang") == name, place < int(share * (1 << 30))).otherwise(chosen)
    fold = hashed(2, CALIBRATION).cast("int")
    shard, order = hashed(3, SHARDS), F.xxhash64("doc_id", "text", F.lit(4))
    examples = materialise(
        rows.filter(chosen)
        .select(
            "text",
            label.alias("label"),
            fold.alias("fold"),
            shard.alias("shard"),
            order.alias("place"),
        )
        .repartition(SHARDS, "place")
        .mapInArrow(
            _sampled(idf), "label int, fold int, shard long, place long, found binary, vals binary"
        ),
        "language-sample",
    )
    fitted = examples.filter("fold > 0")
    state = Leader(len(languages))
    shards = max(1, fitted.select("shard").distinct().count())
    for _ in range(ROUNDS):
        moved = (
            fitted.groupBy("shard")
            .applyInArrow(_continue(state.z, state.n), "feature long, label int, z long, n long")
            .groupBy("feature", "label")
            .agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
            .toPandas()
        )
        at = moved["feature"].to_numpy(), moved["label"].to_numpy()
        state.z[at] += moved["z"].to_numpy() / (UNIT * shards)
        state.n[at] += moved["n"].to_numpy() / (UNIT * shards)
    weights = state.weights()
    loss = (
        examples.filter("fold = 0")
        .mapInArrow(_losses(weights), "place int, own long, others long, seen long")
        .groupBy("place")
        .agg(*[F.sum(c).alias(c) for c in ("own", "others", "seen")])
        .orderBy("place")
        .toPandas()
    )
    temperature = 1.0
    if len(loss) and loss["seen"].iloc[0]:
        # n examples without a mistake still leave a chance of about 1 / n (Platt's targets)
        doubt = 1.0 / (loss["seen"] + 2.0)
        smoothed = (1.0 - doubt) * loss["own"] + doubt * loss["others"]
        temperature = float(TEMPERATURES[int(np.argmin(smoothed.to_numpy()))])
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), temperature)


def predictor(model: Model):
    """A column function: text -> struct of ``lang`` and ``score``."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            found = []
            for at in range(0, len(part), 256):
                found += [model.predict(t) for t in part.slice(at, 256).to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["lang", "score"],
            )

    return predict


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    out = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        predictor(model)(F.col("text")).alias("found"),
    )
    return out.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
