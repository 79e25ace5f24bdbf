"""Document quality from a linear-chain conditional random field over lines.

Each line is a position of the chain with state good (1) or bad (0).  Its
features are surface statistics of the line and of its two neighbours.  The
forward and backward passes give the marginal probability that a line is good;
a document's score is the mean of these, weighted by the lines' lengths.

Training has document labels only, so every line of a fitted document carries its
document's label.  Chains of one document alone would teach that labels never change
within a text; the fitted chains are therefore spliced, of stretches of a few lines of
documents of both labels in turn, with features of the neighbours they have there.  So
a junk line among good ones is known by itself, and its neighbours by theirs.

Defined results: a null text scores like an empty one, which has a single empty
line; texts of any length are read whole.  Labels that are null are not learnt from;
where a document has several labels, each counts.  With no usable labels, or with
those of one kind only, every score is 0.5.  A score of exactly GOOD counts as good.
Repeated rows are scored alike; an empty table gives an empty result.  Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds the fit: about so many labelled documents are read whole, in chains of FIT_LINES lines; if these are more than FIT_CHAINS a document on
#: average, a share of them is chosen by hash, evenly over all documents and all parts of a text.
FIT_DOCS, FIT_LINES, FIT_CHAINS = 2000, 24, 2
#: Share of the score from which a document counts as good.
GOOD = 0.3

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BLANK, _POINT, _REST = range(8)
_KIND = np.full(256, _REST, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[list(b"#*$%&|<>@^~=+\\/_{}[]")] = _SYMBOL
_KIND[list(b"!?")] = _BANG
_KIND[list(b" \t\x0b\x0c\r\n")] = _BLANK
_KIND[list(b".,;:")] = _POINT
#: Own features of a line.
OWN = 14


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' lengths in bytes plus one."""
    lines = text.split(b"\n")
    n = len(lines)
    size = np.fromiter(map(len, lines), np.int64, n)
    x = np.frombuffer(text, np.uint8)
    line = np.repeat(np.arange(n), size + 1)[: len(x)]  # a line's newline counts to it
    count = np.bincount(line * 8 + _KIND[x], minlength=8 * n).reshape(n, 8).astype(float) if len(x) else np.zeros((n, 8))
    split = [w.split() for w in lines]
    words = np.fromiter(map(len, split), np.float64, n)
    kinds = np.fromiter((len(set(w)) for w in split), np.float64, n)
    seen: dict[bytes, int] = {}
    again = np.fromiter((float(seen.setdefault(v, i) != i and bool(w)) for i, (v, w) in enumerate(zip(lines, split, strict=True))), np.float64, n)
    letters = count[:, _UPPER] + count[:, _LOWER] + count[:, _REST]
    held, many = np.maximum(words, 1), np.maximum(size, 1)
    out = np.empty((n, OWN), np.float32)
    upper, symbol, bang, fresh = count[:, _UPPER] / np.maximum(count[:, _UPPER] + count[:, _LOWER], 1), count[:, _SYMBOL] / held, count[:, _BANG] / held, kinds / held
    out[:, 0] = np.minimum(upper, 1)
    out[:, 1] = np.minimum(symbol, 3)
    out[:, 2] = np.minimum(bang, 3)
    out[:, 3] = np.where(words >= 8, 1 - fresh, 0)
    out[:, 4] = np.minimum(count[:, _DIGIT] / many, 1)
    out[:, 5] = np.minimum(letters / held / 10, 3)
    out[:, 6] = np.minimum(count[:, _POINT] / held, 2)
    out[:, 7] = np.log1p(words) / 5
    out[:, 8] = again
    out[:, 9] = upper > 0.5
    out[:, 10] = symbol > 0.3
    out[:, 11] = bang > 0.5
    out[:, 12] = (words >= 8) & (fresh < 0.5)
    out[:, 13] = words == 0
    return out, size + 1


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A line's features beside those of the line before and the line after (zeros at the ends), and a constant."""
    n = len(own)
    out = np.zeros((n, 3 * OWN + 1), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[:, -1] = 1
    return out


@dataclass
class Model:
    """weights: log odds of good by feature; move: log potential of going from a state to the next line's state."""

    weights: np.ndarray
    move: np.ndarray

    def marginals(self, unary: list[float]) -> list[float]:
        """Probability of good for each line, by forward and backward messages kept as log odds."""
        (bb, bg), (gb, gg) = np.exp(self.move).tolist()

        def through(odds: float, b_to_b: float, b_to_g: float, g_to_b: float, g_to_g: float) -> float:
            e = math.exp(min(max(odds, -40.0), 40.0))
            return math.log((b_to_g + e * g_to_g) / (b_to_b + e * g_to_b))

        n, ahead = len(unary), []
        message = 0.0
        for u in unary:
            ahead.append(message)
            message = through(message + u, bb, bg, gb, gg)
        out, message = [0.0] * n, 0.0
        for i in range(n - 1, -1, -1):
            odds = min(max(ahead[i] + unary[i] + message, -40.0), 40.0)
            out[i] = 1 / (1 + math.exp(-odds))
            message = through(unary[i] + message, bb, gb, bg, gg)
        return out

    def score(self, text: bytes) -> tuple[float, int, int]:
        """A document's quality, its lines, and its lines more likely bad than good."""
        own, size = line_features(text)
        p = np.array(self.marginals((with_neighbours(own) @ self.weights).tolist()))
        return float(min(1.0, max(0.0, p @ size / size.sum()))), len(p), int((p < 0.5).sum())


def spliced(chains: list[tuple[np.ndarray, int]], longest: int = 6, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same lines dealt anew: chains of own features of FIT_LINES lines or more, in which stretches of 1 to `longest` lines of both labels take turns, and each line's label."""
    rng = np.random.default_rng(seed)
    heaps: list[list[np.ndarray]] = [[], []]
    for x, y in chains:
        at = 0
        while at < len(x):
            n = int(rng.integers(1, longest + 1))
            heaps[y].append(x[at : at + n])
            at += n
    orders = [rng.permutation(len(h)) for h in heaps]
    if not all(heaps):
        return []
    out, rows, labels = [], [], []
    for i in range(max(map(len, heaps))):  # the smaller heap is dealt again
        for y in (i % 2, 1 - i % 2):
            part = heaps[y][orders[y][i % len(heaps[y])]]
            rows.append(part)
            labels.append(np.full(len(part), y))
        if sum(map(len, rows)) >= FIT_LINES:
            out.append((np.concatenate(rows), np.concatenate(labels)))
            rows, labels = [], []
    return out


def train(chains: list[tuple[np.ndarray, int | np.ndarray]], steps: int = 300, penalty: float = 2e-3) -> Model | None:
    """Maximise the chains' conditional log likelihood by Adam; gradients come from forward and backward passes over all chains at once.

    A chain is its lines' features and the label of all lines, or an array of them.  Lines of both labels weigh alike in sum.
    """
    chains = [(x, np.broadcast_to(y, len(x))) for x, y in chains if len(x)]
    if len({int(v) for _, y in chains for v in (y.min(), y.max())}) < 2:
        return None
    n, most = len(chains), max(len(x) for x, _ in chains)
    x = np.zeros((n, most, chains[0][0].shape[1]), np.float32)
    mask, y = np.zeros((n, most), bool), np.zeros((n, most), np.int64)
    for i, (rows, label) in enumerate(chains):
        x[i, : len(rows)], mask[i, : len(rows)], y[i, : len(rows)] = rows, True, label
    share = np.array([label.mean() for _, label in chains])  # of good lines in a chain
    good = share.mean()
    each = (share * 0.5 / good + (1 - share) * 0.5 / (1 - good)) / n
    flat, lines = x[mask], np.repeat(np.arange(n), mask.sum(1))
    both = mask[:, 1:]
    moves = np.stack([((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum(1) @ each for a in (0, 1) for b in (0, 1)]).reshape(2, 2)
    w, move = np.zeros(x.shape[2]), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    for step in range(1, steps + 1):
        u = np.zeros((n, most))
        u[mask] = flat @ w
        node = np.stack([np.zeros_like(u), u], 2)
        fore, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fore[:, 0] = node[:, 0]
        for t in range(1, most):
            v = fore[:, t - 1, :, None] + move
            top = v.max(1)
            fore[:, t] = np.where(mask[:, t, None], node[:, t] + top + np.log(np.exp(v - top[:, None]).sum(1)), fore[:, t - 1])
        z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        for t in range(most - 2, -1, -1):
            v = move + (node[:, t + 1] + back[:, t + 1])[:, None, :]
            top = v.max(2)
            back[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(v - top[..., None]).sum(2)), back[:, t + 1])
        p = np.exp(fore[..., 1] + back[..., 1] - z[:, None])
        grad_w = flat.T @ ((p[mask] - y[mask]) * each[lines]) + penalty * w
        pair = np.exp(fore[:, :-1, :, None] + move + (node + back)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        grad_m = np.einsum("ntij,n->ij", pair, each) - moves + penalty * move
        for k, (value, grad) in enumerate(((w, grad_w), (move, grad_m))):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            value -= 0.08 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(w, move)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs: int = FIT_DOCS) -> Model | None:
    """Fit on about `docs` labelled documents (a bounded sample), in chains of FIT_LINES lines from all over their texts, about docs * FIT_CHAINS at most."""
    usable = common.bounded_sample(labelled.where(F.col(label_col).isin(0, 1)), id_col, docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    chains = usable.agg(F.sum(F.ceil(lines / FIT_LINES))).first()[0] or 0
    limit = 1 << 32 if chains <= docs * FIT_CHAINS else (docs * FIT_CHAINS << 32) // int(chains)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, label = [], []
            for text, y in zip(common.binary(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                x = line_features(text or b"")[0]
                seed = zlib.crc32(text or b"")
                for at in range(0, len(x), FIT_LINES):
                    if zlib.crc32(b"%d" % at, seed) < limit:
                        made.append(x[at : at + FIT_LINES].tobytes())
                        label.append(y)
            yield pa.record_batch([pa.array(made, pa.binary()), pa.array(label, pa.int32())], ["x", "y"])

    got = common.map_arrow(usable.select(F.col(text_col).cast("string"), F.col(label_col).cast("int")), rows, "x binary, y int").toArrow()
    chains = [(np.frombuffer(x, np.float32).reshape(-1, OWN), y) for x, y in zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True)]
    return train([(with_neighbours(x), y) for x, y in spliced(chains)])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_lines and n_bad_lines for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model  # travels with the function: its size is fixed
        for batch in batches:
            out = [own.score(text or b"") if own else (0.5, 1, 0) for text in common.binary(batch.column(1))]
            score, lines, bad = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= GOOD) for s in score], pa.int32()), pa.array(lines, pa.int64()), pa.array(bad, pa.int64())], ["doc_id", "score", "predicted", "n_lines", "n_bad_lines"])

    return common.map_arrow(common.id_and_text(docs, id_col, text_col), run, "doc_id long, score double, predicted int, n_lines long, n_bad_lines long")


def held_out(id_col: str = "doc_id") -> Column:
    """The rows the query never learns from."""
    return F.coalesce(common.remainder(id_col, 5) == 0, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    chosen = common.bounded_sample(labels.where(~held_out() & F.col("quality").isin(0, 1)), "doc_id", FIT_DOCS)
    model = fit(docs.join(F.broadcast(chosen), "doc_id"))  # FIT_DOCS bounds the broadcast
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")
