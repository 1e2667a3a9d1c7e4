"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; the unlabelled set is all
documents, whatever their labels, which are not looked at. A linear scorer over
binned surface statistics of whole texts is fitted in two steps:

1. positives against unlabelled on one half of both sets; on the other half
   the class prior is the least ratio, over thresholds, of unlabelled to
   positive tail mass, with a confidence term;
2. Newton's steps to the least prior x R_p(+) + max(0, R_u(-) - prior x R_p(-)).

The positives are a sample bounded by a parameter. The unlabelled documents are
counted by distinct bins, and every step sums over these counts where they are: one
row of sums a task reaches the driver, so that sums are over all documents and no
step depends on how many there are. A caller may ask for a fit on the driver instead,
by gradient descent (upwards where that part is negative) over at most ``max_bins``
rows of bins, made coarser until there are so few.

Defined results: null text counts as empty; empty texts get a score like any
other; labels of ids without a document and null labels and ids are left out; an
id labelled 1 anywhere is a positive, whatever other labels it has; of several
texts of a positive id the one whose statistics come first counts, while every
row counts on the unlabelled side; without positives every score is 0.5;
repeated rows and ids, null ids among them, are scored row by row; an empty
table gives no rows; texts of any length are read whole; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, pieces, release, sampled

#: Statistics and the edges of their bins.
EDGES: dict[str, tuple[float, ...]] = {
    "words": (1, 3, 8, 20, 50, 100, 300, 1000, 3000),
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "bangs": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2),
    "bars": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9),
    "digits": (0.002, 0.01, 0.03, 0.08, 0.2, 0.4),
    "points": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "echoes": (0.01, 0.05, 0.1, 0.2, 0.4, 0.8),
    "variety": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7),
    "length": (2, 3, 4, 5, 6, 8, 12, 20),
    "lines": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "high": (0.01, 0.05, 0.1, 0.2, 0.4),
}
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_HIGH = bytes(range(0xC0, 0x100))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda kinds: len(raw) - len(raw.translate(None, kinds))
    upper, lower = count(_UPPER), count(_LOWER)
    return [
        len(words),
        count(b"#*$%&<>@~^_") / size,
        count(b"!?") / size,
        count(b"|") / size,
        upper / max(1, upper + lower),
        count(_DIGITS) / size,
        count(b".,;:") / size,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        size / n,
        raw.count(b"\n") / n,
        count(_HIGH) / size,
    ]


def bins(stats: np.ndarray) -> np.ndarray:
    """Rows of statistics -> in each statistic, how many of its edges are reached."""
    return np.column_stack([np.searchsorted(np.array(edges), stats[:, k], side="right") for k, edges in enumerate(EDGES.values())]).astype(np.uint8)


_SIZES = [len(edges) for edges in EDGES.values()]
_FIRST = np.cumsum([1, *_SIZES[:-1]])


class Binned:
    """Rows of bins as 0/1 features (a constant, then the edges reached), with how often each row is there."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray | None = None):
        self.codes = [np.ascontiguousarray(codes[:, k]) for k in range(len(_SIZES))]
        self.counts = np.ones(len(codes)) if counts is None else counts.astype(np.float64)
        self.total = float(self.counts.sum())

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.full(len(self.counts), w[0])
        for c, at, n in zip(self.codes, _FIRST, _SIZES):
            out += np.concatenate([[0.0], np.cumsum(w[at : at + n])])[c]
        return out

    def mean(self, x: np.ndarray) -> float:
        return float(x @ self.counts) / self.total

    def mean_features(self, x: np.ndarray) -> np.ndarray:
        """The mean of x times features."""
        x = x * self.counts
        sums = [np.bincount(c, x, n + 1)[::-1].cumsum()[::-1][1:] for c, n in zip(self.codes, _SIZES)]
        return np.concatenate([[x.sum()], *sums]) / self.total


@dataclass
class PuModel:
    weights: np.ndarray
    prior: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return _sigmoid(Binned(bins(stats)).dot(self.weights))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(p: Binned, u: Binned, prior: float | None, steps: int, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights. prior None: plain logistic loss of positives against unlabelled, halves weighted equally."""
    w, m, v = (np.zeros(1 + sum(_SIZES)) for _ in range(3))
    for t in range(1, steps + 1):
        xp, xu = p.dot(w), u.dot(w)
        sp, su = _sigmoid(xp), _sigmoid(xu)
        up, uu, pu = -p.mean_features(1 - sp), u.mean_features(su), p.mean_features(sp)  # gradients of R_p(+), R_u(-), R_p(-)
        if prior is None:
            g = (up + uu) / 2
        else:
            risk = u.mean(np.log1p(np.exp(np.clip(xu, -30, 30)))) - prior * p.mean(np.log1p(np.exp(np.clip(xp, -30, 30))))
            g = prior * up + (uu - prior * pu) if risk >= 0 else prior * pu - uu
        g = g + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * 0.2
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, counts: np.ndarray | None = None) -> float:
    """Least upper bound on the positives' share over thresholds of held-out scores; counts: how often each unlabelled score is there."""
    counts = np.ones(len(unlabelled)) if counts is None else counts
    total = counts.sum()
    x, weight = np.concatenate([positive, unlabelled]), np.concatenate([np.ones(len(positive)), counts])
    cuts = np.unique(np.quantile(x, np.linspace(0, 0.99, 100), weights=weight, method="inverted_cdf"))
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(total))
    qp = np.array([(positive >= c).mean() for c in cuts])
    qu = np.array([counts[unlabelled >= c].sum() / total for c in cuts])
    ok = qp > 0.05
    best = np.argmin((qu[ok] + slack) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.999))


def fit_bins(positive: np.ndarray, halves: list[tuple[np.ndarray, np.ndarray]], steps: int = 400) -> PuModel:
    """From the positives' bins and, for two halves of the unlabelled rows, distinct bins and their counts."""
    codes, counts = (np.concatenate(x) for x in zip(*halves))
    if not len(positive) or not len(codes):
        return PuModel(np.zeros(1 + sum(_SIZES)), 0.5)
    prior = 0.5
    if len(positive) >= 4 and all(n.sum() >= 2 for _, n in halves):
        w = _descend(Binned(positive[::2]), Binned(*halves[0]), None, steps)
        prior = estimate_prior(Binned(positive[1::2]).dot(w), Binned(*halves[1]).dot(w), counts=halves[1][1].astype(np.float64))
    return PuModel(_descend(Binned(positive), Binned(codes, counts), prior, steps), prior)


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> PuModel:
    """From rows of statistics, each counted once."""
    u = bins(unlabelled.reshape(-1, len(EDGES)))
    return fit_bins(bins(positive.reshape(-1, len(EDGES))), [(x, np.ones(len(x))) for x in (u[::2], u[1::2])], steps)


def _statistics_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["id", "stats"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<double>")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """half, bins (a byte for each statistic), n: all rows of docs by their bins, in halves by the id's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes = bins(np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(EDGES)))
            yield pa.RecordBatch.from_arrays([batch.column("half"), pa.array([c.tobytes() for c in codes], pa.binary())], ["half", "bins"])

    rows = docs.select((F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 2).cast("int").alias("half"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "half int, bins binary").groupBy("half", "bins").agg(F.count(F.lit(1)).alias("n"))


def bounded(counts: DataFrame, most: int) -> DataFrame:
    """The counts with bins rounded down to multiples of 2, 4, ... of their numbers until at most ``most`` rows are left; every document stays counted."""
    counts, step = cut(counts), 1
    while counts.count() > most:
        step *= 2

        def coarser(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8) // step * step
                yield pa.RecordBatch.from_arrays([batch.column("half"), pa.array([c.tobytes() for c in codes.reshape(-1, len(EDGES))], pa.binary()), batch.column("n")], ["half", "bins", "n"])

        before, counts = counts, cut(counts.mapInArrow(coarser, "half int, bins binary, n long").groupBy("half", "bins").agg(F.sum("n").alias("n")))
        release(before)
    return counts


#: Of the distributed fit: the penalty on weights, most Newton steps, the change of weights under which they end, and halvings of the weight of the part under max.
L2, ROUNDS, STILL, HALVINGS = 2e-2, 30, 1e-6, 10


def _features(codes: np.ndarray) -> np.ndarray:
    """Rows of bins as a 0/1 matrix: a constant, then the edges reached."""
    return np.hstack([np.ones((len(codes), 1)), *[codes[:, k : k + 1] > np.arange(n)[None, :] for k, n in enumerate(_SIZES)]]).astype(np.float64)


def _codes(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, len(EDGES))


def _moments(counts: DataFrame, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of all counted rows: how many, the mean loss as negatives, its gradient and its Hessian. A task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, g, h = 0.0, 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in pieces(batches, 4096):
            x, n = _features(_codes(batch)), batch.column("n").to_numpy().astype(np.float64)
            z = x @ w
            s = _sigmoid(z)
            total += n.sum()
            loss += n @ np.logaddexp(0, z)
            g += (n * s) @ x
            h += (x * (n * s * (1 - s))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[total, loss], g, h.ravel()]).tobytes()], pa.binary())], ["m"])

    sums = [np.frombuffer(m) for m in counts.mapInArrow(run, "m binary").toArrow().column("m").to_pylist()]
    m = np.sum(sums, axis=0) if sums else np.zeros(2 + len(w) + len(w) ** 2)
    n = max(1.0, m[0])
    return m[0], m[1] / n, m[2 : 2 + len(w)] / n, m[2 + len(w) :].reshape(len(w), -1) / n


def _newton(positive: np.ndarray, counts: DataFrame, prior: float | None) -> np.ndarray:
    """The weights of least risk, over all counts where they are; prior None: the plain loss, as in _descend().

    With the part under max, the risk is the greater of two convex ones, since the difference of both losses is linear.
    So its least value has that part weighted by 1 if it stays positive, else by the weight in [0, 1] that makes it zero:
    that weight is found by halving, and for each the weights by Newton's steps from the last ones. Weights are rounded,
    so that the order of sums leaves no trace.
    """
    x = _features(positive)

    def at(w: np.ndarray, share: float):
        z = x @ w
        s = _sigmoid(z)
        plus, minus = np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean()
        up, pu, hp = -((1 - s) @ x) / len(x), (s @ x) / len(x), (x * (s * (1 - s))[:, None]).T @ x / len(x)
        _, loss, g, h = _moments(counts, w)
        if prior is None:
            part, value, g, h = 1.0, (plus + loss) / 2, (up + g) / 2, (hp + h) / 2
        else:
            part = loss - prior * minus
            value, g, h = prior * plus + share * part, prior * up + share * (g - prior * pu), (1 - share) * prior * hp + share * h
        return value + L2 / 2 * (w @ w), part, g + L2 * w, h + L2 * np.eye(len(w))

    def least(w: np.ndarray, share: float) -> tuple[np.ndarray, float]:
        value, part, g, h = at(w, share)
        for _ in range(ROUNDS):
            step = np.linalg.solve(h, g)
            if np.abs(step).max() < STILL:
                break
            new = at(w - step, share)
            while new[0] > value and np.abs(step).max() >= STILL:
                step = step / 2
                new = at(w - step, share)
            w = w - step
            value, part, g, h = new
        return w, part

    w, part = least(np.zeros(x.shape[1]), 1.0)
    low, high = 0.0, 1.0
    for _ in range(HALVINGS if part < 0 else 0):
        share = (low + high) / 2
        w, part = least(w, share)
        low, high = (share, high) if part >= 0 else (low, share)
    return np.round(w, 5)


def _prior(positive: np.ndarray, counts: DataFrame, w: np.ndarray) -> float:
    """estimate_prior() over the positives' scores as thresholds; unlabelled rows are counted between them in tasks."""
    scores = np.round(_features(positive) @ w, 9)
    cuts = np.unique(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cuts) + 1)
        for batch in pieces(batches, 4096):
            at = np.searchsorted(cuts, np.round(_features(_codes(batch)) @ w, 9), "right")
            n += np.bincount(at, batch.column("n").to_numpy(), len(cuts) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["m"])

    n = np.sum([np.frombuffer(m) for m in counts.mapInArrow(run, "m binary").toArrow().column("m").to_pylist()], axis=0)
    return estimate_prior(scores, np.concatenate([[cuts[0] - 1], cuts]), counts=n)


def fit_counts(positive: np.ndarray, counts: DataFrame) -> PuModel:
    """From the positives' bins and all rows of counted(), which stay where they are: the driver has sums only, so no number of rows changes the way."""
    counts = cut(counts)
    first, second = (counts.where(F.col("half") == k) for k in (0, 1))
    sizes = {r["half"]: r["n"] for r in counts.groupBy("half").agg(F.sum("n").alias("n")).collect()}  # two rows
    if not len(positive) or not sizes:
        return PuModel(np.zeros(1 + sum(_SIZES)), 0.5)
    prior = 0.5
    if len(positive) >= 4 and all(sizes.get(k, 0) >= 2 for k in (0, 1)):
        prior = _prior(positive[1::2], second, _newton(positive[::2], first, None))
    model = PuModel(_newton(positive, counts, prior), prior)
    release(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 6_000, seed: str = "quality", max_bins: int | None = None) -> PuModel:
    """``labels`` has only rows that may be learnt from; of these only those of value 1 are used. The unlabelled side is all of docs, as counts by their bins.

    These stay in tasks, by fit_counts(); with ``max_bins`` at most so many rows of coarser bins are fitted on the driver instead.
    """
    lab = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(id_col).distinct()
    chosen = sampled(lab, id_col, max_positive, seed).select(F.col(id_col).alias("_id"))
    # Bounded by the sample's size: an id has one row after the aggregate.
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id")
    got = _statistics_of(picked, "_id", "_text").groupBy("id").agg(F.min("stats").alias("stats")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["stats"]))
    positive = bins(np.array([r["stats"] for r in got], np.float64).reshape(-1, len(EDGES)))
    positive = positive[np.random.default_rng(3).permutation(len(positive))]
    if not len(positive):
        return fit_bins(positive, [(positive, np.ones(0))] * 2)
    all_rows = counted(docs, id_col, text_col)
    if max_bins is None:
        return fit_counts(positive, all_rows)
    all_rows = bounded(all_rows, max_bins).toArrow().sort_by([("half", "ascending"), ("bins", "ascending")])
    half, n, codes = all_rows.column("half").to_numpy(), all_rows.column("n").to_numpy(), _codes(all_rows)
    return fit_bins(positive, [(codes[half == k], n[half == k]) for k in (0, 1)])


def score(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            stats = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(EDGES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(stats), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
