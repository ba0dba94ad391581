"""Quality classifier by positive-unlabelled learning.

Only trusted good documents carry labels; the rest of the corpus is unlabelled. A first classifier of positives against
unlabelled rows orders the corpus; the class prior is read off the histograms of its scores over all rows; the final
classifier minimises the non-negative unbiased risk for that prior. Inputs are shares and densities of a text's
characters, words and lines, cut into bins, so the model is additive and its scores are probabilities. Borders of bins,
risks, gradients and the prior are sums over all rows that may be learned from; no row is left out of a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, combine, is_small, text_batches, to_python, word_hashes, written

BINS, SCORE_BINS = 16, 200
#: Evaluations of the risk and its gradient over all rows, for the first classifiers and the final one.
FIRST_STEPS, FINAL_STEPS = 40, 60
#: Weight decay of the first classifiers and, as its negatives weigh less, of the final one.
DECAY, FINAL_DECAY = 5e-4, 3e-5
#: Steps and gradients that a search direction is made of.
MEMORY = 10

FEATURES = (
    "words", "word_length", "upper", "digits", "bars", "symbols", "shouts", "stops", "commas", "words_a_line", "distinct_words",
    "same_neighbours", "repeated_trigrams", "repeated_lines", "non_ascii", "capital_words", "longest_word", "other_marks",
)

_KIND = {k: np.isin(np.arange(256), list(v)) for k, v in {"digits": b"0123456789", "bars": b"|", "symbols": b"#*$%&<>", "shouts": b"!?", "stops": b".", "commas": b",", "marks": b"@=+~^{}[]()_/\\\"':;-"}.items()}
_KIND |= {"upper": np.isin(np.arange(256), np.arange(65, 91)), "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]), "high": np.arange(256) >= 128}


def _distinct(x: np.ndarray) -> int:
    return len(np.unique(x))


def features(text: str | None) -> list[float]:
    """Numbers that describe a text, of FEATURES; a null or wordless text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    h, start, stop = word_hashes(raw)
    n = len(h)
    if not n:
        return [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    count = {k: int(by[v].sum()) for k, v in _KIND.items()}
    size, letters = len(raw), max(1, count["letter"] + count["high"])
    lines = raw.split(b"\n")
    tri = combine(h, 3)
    firsts = np.frombuffer(raw, np.uint8)[start]
    return [
        float(np.log1p(n)), float((stop - start).mean()), count["upper"] / letters, count["digits"] / size, count["bars"] / n, count["symbols"] / n, count["shouts"] / n,
        count["stops"] / n, count["commas"] / n, float(np.log1p(n / len(lines))), _distinct(h) / n ** 0.85, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        1 - _distinct(tri) / len(tri), 1 - len(set(lines)) / len(lines), count["high"] / letters, float(_KIND["upper"][firsts].mean()),
        float(np.log1p((stop - start).max())), count["marks"] / n,
    ]


def _hot(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins that the features fall in."""
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1).astype(np.uint8)


def _cells(x: np.ndarray) -> np.ndarray:
    """The first 16 bits of non-negative single floats: ordered, and as fine as a 128th of a number."""
    return np.maximum(x.astype(np.float32), np.float32(0)).view(np.uint32) >> 16


def _edges(cells: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Borders of BINS + 1 bins at most from the filled cells of each feature, in order, and their rows: quantiles of the rows and, as most rows may share one value, of the cells."""
    cut = np.linspace(0, 1, BINS // 2 + 2)[1:-1]
    out = []
    for cell, n in cells:
        between = (cell[1:].astype(np.uint32) << 16).view(np.float32).astype(float)
        if not len(between):
            out.append(between)
            continue
        at = np.searchsorted(np.cumsum(n), cut * n.sum()).clip(0, len(between) - 1)
        out.append(np.unique(np.concatenate([between[at], np.quantile(between, cut, method="nearest")])))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Weights of a model: one for each bin of each feature, and a constant.
SIZE = len(FEATURES) * (BINS + 1) + 1
_OFFSET = np.arange(len(FEATURES)) * (BINS + 1)


def values(theta: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return theta[:-1][hot + _OFFSET].sum(1) + theta[-1]


def score(theta: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return _sigmoid(values(theta, hot))


def sums(theta: np.ndarray, hot: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, final: bool) -> np.ndarray:
    """Losses and gradients summed over rows that stand for so many positive and unlabelled rows: of positives and of unlabelled rows the loss, then of both the gradient.

    For the final classifier the loss is the score (the sigmoid loss as a negative), else the logistic loss of positives as such and of unlabelled rows as negatives.
    """
    g = values(theta, hot)
    s = _sigmoid(g)
    if final:
        loss = [positive @ s, unlabelled @ s]
        slope = [positive * s * (1 - s), unlabelled * s * (1 - s)]
    else:
        loss = [positive @ np.logaddexp(0, -g), unlabelled @ np.logaddexp(0, g)]
        slope = [positive * (s - 1), unlabelled * s]
    at = (hot + _OFFSET).ravel()
    grad = [np.append(np.bincount(at, np.repeat(d, hot.shape[1]), SIZE - 1), d.sum()) for d in slope]
    return np.concatenate([loss, *grad])


def risk(theta: np.ndarray, total: np.ndarray, positives: float, unlabelled: float, prior: float | None) -> tuple[float, np.ndarray]:
    """Risk and gradient from ``sums`` over all rows. With a prior, the non-negative risk of Kiryo and others (2017) with the sigmoid loss; without, positives against unlabelled rows."""
    (p, u), gp, gu = total[:2], total[2 : 2 + SIZE] / positives, total[2 + SIZE :] / unlabelled
    p, u = p / positives, u / unlabelled
    if prior is None:
        f, grad, decay = p + u, gp + gu, DECAY
    else:
        # As negatives: unlabelled rows minus the positives among them; where that is below 0 it is pushed up.
        # The sigmoid loss is bounded, so sure positives differ little and the difference is known well.
        rest, decay = u - prior * p, FINAL_DECAY
        sign = 1 if rest >= 0 else -1
        f, grad = prior * (1 - p) + abs(rest), -prior * gp + sign * (gu - prior * gp)
    return f + decay / 2 * float(theta[:-1] @ theta[:-1]), grad + np.append(decay * theta[:-1], 0)


def minimised(x: np.ndarray, steps: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Quasi-Newton search: yields the weights at which it needs the risk and gradient, and returns the best ones."""
    f, g = yield x
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    left = steps - 1
    while left > 0:
        q, parts = g.copy(), []
        for s, y in reversed(moves):
            parts.append(s @ q / (s @ y))
            q -= parts[-1] * y
        if moves:
            q *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])
        else:
            q /= max(np.abs(g).max(), 1e-12)
        for (s, y), a in zip(moves, reversed(parts), strict=True):
            q += s * (a - y @ q / (s @ y))
        t, better = 1.0, False
        while left > 0 and not better:
            new = x - t * q
            fn, gn = yield new
            left -= 1
            better = fn <= f - 1e-4 * t * (g @ q)
            t /= 2 if t > 0.1 else 4
        if fn >= f:
            break
        s, y = new - x, gn - g
        if s @ y > 1e-10:
            moves = [*moves, (s, y)][-MEMORY:]
        x, f, g = new, fn, gn
    return x


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from both kinds' histograms of scores (ascending bins).

    Above a score at which hardly any negative is left, the unlabelled share of rows is the prior times the positive
    share: the least such ratio, with a margin for chance, bounds and estimates the prior.
    """
    p, u = positive[::-1].cumsum() / max(positive.sum(), 1), unlabelled[::-1].cumsum() / max(unlabelled.sum(), 1)
    margin = np.sqrt(np.log(200) / 2 / max(positive.sum(), 1)) + np.sqrt(np.log(200) / 2 / max(unlabelled.sum(), 1))
    ok = p > 0.05
    at = np.argmin(((u + margin) / np.maximum(p, 1e-9))[ok])
    return float(np.clip((u[ok] / p[ok])[at], 0.05, 0.99))


def _half() -> Column:
    """A row's half, 0 or 1, by a hash of its id."""
    return F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)).cast("int")


@dataclass
class Corpus:
    """Rows (hot, half, p, u): bins, half, and the numbers of positive and of all rows that have them; here if they are few, else by a job for each sum."""

    table: DataFrame
    here: tuple[np.ndarray, ...] | None

    @staticmethod
    def of(table: DataFrame, limit: int) -> Corpus:
        rows = table.toPandas() if is_small(table, limit) else None
        return Corpus(table, None if rows is None else Corpus.columns(rows["hot"].tolist(), rows["half"], rows["p"], rows["u"]))

    @staticmethod
    def columns(hot, half, p, u) -> tuple[np.ndarray, ...]:
        return np.frombuffer(b"".join(hot), np.uint8).reshape(-1, len(FEATURES)).astype(np.int64), np.asarray(half), np.asarray(p, float), np.asarray(u, float)

    def summed(self, f: Callable[..., np.ndarray]) -> np.ndarray:
        """Sum over all rows of a function of their columns."""
        if self.here is not None:
            return f(*self.here)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    part = f(*Corpus.columns(b.column("hot").to_pylist(), *(b.column(c).to_numpy() for c in ("half", "p", "u"))))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["slot", "value"])

        rows = self.table.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()  # one row for each number of the sum
        out = np.zeros(len(rows))
        for r in rows:
            out[r["slot"]] = r["value"]
        return out

    def fitted(self, starts: list[np.ndarray], halves: list[int | None], counts: list[tuple[float, float]], prior: float | None, steps: int) -> list[np.ndarray]:
        """Models fitted side by side, each on the rows outside its half."""
        searches = [minimised(x, steps) for x in starts]
        asked, found = {i: next(s) for i, s in enumerate(searches)}, list(starts)
        while asked:
            now = dict(asked)

            def all_sums(hot, half, p, u, now=now):
                return np.concatenate([sums(x, hot, p * (half != halves[i]), u * (half != halves[i]), prior is not None) for i, x in now.items()])

            total = self.summed(all_sums).reshape(len(now), -1)
            for (i, x), part in zip(now.items(), total, strict=True):
                try:
                    asked[i] = searches[i].send(risk(x, part, *counts[i], prior))
                except StopIteration as end:
                    found[i] = end.value
                    del asked[i]
        return found


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Rows with crc32(id as text) mod ``folds`` = ``fold`` are held out: neither their labels nor their texts are learned
    from. Of the others, rows labelled 1 are positives, and all are the unlabelled corpus; every one of them is in the
    borders of bins, the prior and the risk. Rows of equal bins are counted; their table is summed on the driver if it
    has at most ``limit`` bytes, else by a job for each step. Null, empty and wordless texts are scored by zero
    features. Without positives every score is the prior's upper bound 0.99. Repeated rows get equal results; of
    repeated labels an id is positive if any is 1.
    """
    source = to_python(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    source = source.withColumn("held_out", F.coalesce(F.crc32(F.col("id").cast("string")) % folds == fold, F.lit(False)))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct().withColumn("positive", F.lit(True))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "held_out", "x"])

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, len(FEATURES))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(FEATURES), 1 << 15), np.int64)
        for b in batches:
            if b.num_rows:
                for j, c in enumerate(_cells(numbers(b)).T):
                    n[j] += np.bincount(c, minlength=1 << 15)
        j, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(c, pa.int32()), pa.array(n[j, c])], ["feature", "cell", "n"])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hot = _hot(numbers(b), edges)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in hot], pa.binary()), b.column("half"), b.column("positive")], ["hot", "half", "positive"])

    plain = source.mapInArrow(run, f"id {kind}, held_out boolean, x binary")
    rows = written(plain.join(trusted, "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)) & ~F.col("held_out")), "features")
    learned = rows.where("not held_out").withColumn("half", _half())
    # At most 2 ** 15 rows for each feature, whatever the number of texts.
    cells = learned.select("x").mapInArrow(counted, "feature int, cell int, n long").groupBy("feature", "cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    edges = _edges([(c["cell"].to_numpy(), c["n"].to_numpy()) for c in (cells[cells["feature"] == j] for j in range(len(FEATURES)))])
    by_bins = learned.mapInArrow(binned, "hot binary, half int, positive boolean").groupBy("hot", "half").agg(F.count_if("positive").alias("p"), F.count("*").alias("u"))
    corpus = Corpus.of(written(by_bins, "bins"), limit)

    n = corpus.summed(lambda hot, half, p, u: np.array([[p[half == k].sum(), u[half == k].sum()] for k in (0, 1)]).ravel()) if len(cells) else np.zeros(4)
    n = n.reshape(2, 2)
    if not n[:, 0].sum():
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit(0.99).alias("score"), F.lit(1).alias("predicted"))
    zero, whole = np.zeros(SIZE), tuple(n.sum(0))
    # Each half of the rows is scored by a model of the other half, so no row's score knows that row.
    apart = bool(n[:, 0].all())
    first = corpus.fitted([zero, zero], [0, 1], [tuple(n[1]), tuple(n[0])], None, FIRST_STEPS) if apart else corpus.fitted([zero], [None], [whole], None, FIRST_STEPS) * 2

    def histogram(hot, half, p, u):
        at = np.minimum(np.where(half == 0, score(first[0], hot), score(first[1], hot)) * SCORE_BINS, SCORE_BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at, w, SCORE_BINS) for w in (p, u)])

    hist = corpus.summed(histogram).reshape(2, SCORE_BINS)
    prior = class_prior(hist[0], hist[1])
    # The final search begins between the first models, moved from the odds of labels to those of the prior.
    start = (first[0] + first[1]) / 2
    start[-1] += np.log(2 * prior)
    model = corpus.fitted([start], [None], [whole], prior, FINAL_STEPS)[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score(model, _hot(numbers(b), edges)), pa.float64())], ["id", "held_out", "score"])

    return rows.select("id", "held_out", "x").mapInArrow(scored, f"id {kind}, held_out boolean, score double").select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
