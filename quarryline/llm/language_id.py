"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  One binary classifier per bit, a
logistic regression over hashed byte n-grams, says how strongly a text leans to
that bit.  Decoding weighs each bit's logistic loss by how reliable the bit is
and picks the language whose codeword costs least.  A text whose two
cheapest codewords cost nearly the same is flagged as ambiguous.

A fifth of the fitted texts is kept aside at first.  How often a bit is right there is
its weight, and the cost gap that all but PLAIN of these texts exceed, which are of one language
each, is the limit under which a text is ambiguous.  Then the classifiers learn from all.

Defined results: a null text, an empty one and one without any letter give
``und`` with score 0.  A text of any length is read whole.  Of codewords that cost
the same the first language by name is given, and the text is ambiguous.  Repeated
rows are scored alike, each on its own.  An empty table gives an empty result; a training table without usable rows gives
``und`` everywhere.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
#: Width of the hashed n-gram space.
WIDTH = 4096
#: Bounds the fit: about so many labelled rows are read, whatever the table's size, and about LEAST of each language that has fewer among them.
FIT_ROWS, LEAST = 2000, 20
#: Of each fitted row, so many short snippets are fitted as well, so that short texts are known too.
SNIPPETS = 3
#: Texts kept aside that may be flagged as ambiguous, as a share; the limit (in nats a bit) where fewer than LEAST are kept aside.
PLAIN, AMBIGUOUS = 0.005, 0.02
#: Steps of the fit without, and then with, what is kept aside.
STEPS, MORE_STEPS = 120, 40

_LATIN = re.compile("[A-Za-z]")
_BLANK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; digits and fractions of any script are none."""
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def features(text: bytes) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte 2-, 3- and 4-grams of the lower-cased letters."""
    letters = b" " + _BLANK.sub(b" ", text.decode("utf-8", "replace").lower().encode()) + b" "
    x = np.frombuffer(letters, np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    four = three[:-1] * np.uint32(269) + x[3:]
    spread = np.uint32(2654435761)
    out = np.zeros(WIDTH)
    for gram, salt in ((two, 1), (three, 2), (four, 3)):
        if len(gram):
            out += np.bincount(((gram + np.uint32(salt)) * spread) >> np.uint32(20), minlength=WIDTH)
    out = np.sqrt(out)
    return (out / max(np.sqrt(out @ out), 1e-9)).astype(np.float32)


def _packed(x: np.ndarray) -> bytes:
    """A vector's places that are not zero, and what is there: few, so little goes to the driver."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float16).tobytes()


def _unpack(packed, out: np.ndarray) -> None:
    n = len(packed) // 4
    out[np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed, np.float16, n, 2 * n)


def codewords(n_classes: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each class.  Few classes get the exhaustive code, more the widest of random codes."""
    if n_classes < 2:
        return np.ones((n_classes, 1))
    if n_classes <= 5:
        bits = range(1, 2 ** (n_classes - 1))
        return np.array([[1 if c == 0 or not b >> (c - 1) & 1 else -1 for b in bits] for c in range(n_classes)], float)
    rng, length, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n_classes))), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n_classes, length))
        agree = code @ code.T - 2 * length * np.eye(n_classes)
        apart = (length - agree.max()) / 2
        if np.abs(code.sum(0)).max() < n_classes and apart > best[0]:
            best = (apart, code)
    return best[1] if best[1] is not None else rng.choice([-1.0, 1.0], (n_classes, length))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    limit: float = AMBIGUOUS

    def costs(self, lean: np.ndarray) -> np.ndarray:
        """The weighted loss of every language's codeword, from what each bit's classifier says of one text, or of several."""
        return np.logaddexp(0, -self.code * lean[..., None, :]) @ self.trust

    def gaps(self, lean: np.ndarray) -> np.ndarray:
        """How much more the second cheapest codeword costs, for each of several texts."""
        two = np.partition(self.costs(lean), 1, axis=1)
        return two[:, 1] - two[:, 0]

    def score(self, x: np.ndarray) -> tuple[str, float, bool]:
        """The language, how probable it is against the others, and whether it is ambiguous."""
        cost = self.costs(x @ self.weights + self.bias)
        order = np.argsort(cost, kind="stable")
        share = np.exp(-(cost - cost[order[0]]) * len(self.trust))
        gap = cost[order[1]] - cost[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / share.sum()), bool(gap < self.limit)


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model | None:
    """Fit on about `rows` labelled rows (a bounded sample) with some of every language, so that each has a codeword.  Features are made on the executors; the driver gets fixed-width vectors."""
    labelled = training.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    own = labelled.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    usable = common.sample_of_each(own, "k", "l", "t", rows, LEAST)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, xs, whole, aside = [], [], [], []
            for key, text, lang in zip(batch.column(0).to_pylist(), common.binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                rng = np.random.default_rng((key or 0) & 0xFFFF_FFFF)
                parts = [text]
                for size in (2, 5, 12)[: SNIPPETS if words else 0]:
                    at = int(rng.integers(0, max(1, len(words) - size + 1)))
                    parts.append(b" ".join(words[at : at + size]))
                apart = zlib.crc32(text) % 5 == 0
                for k, part in enumerate(parts):
                    langs.append(lang)
                    xs.append(_packed(features(part)))
                    whole.append(k == 0)
                    aside.append(apart)
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(xs, pa.binary()), pa.array(whole, pa.bool_()), pa.array(aside, pa.bool_())], ["lang", "x", "whole", "aside"])

    got = common.map_arrow(usable.select("k", "t", "l"), vectors, "lang string, x binary, whole boolean, aside boolean").toArrow()
    if not got.num_rows:
        return None
    labels, whole, aside = got.column("lang").to_pylist(), *(np.array(got.column(c).to_pylist()) for c in ("whole", "aside"))
    x = np.zeros((got.num_rows, WIDTH), np.float32)
    for i, row in enumerate(v for batch in got.to_batches() for v in batch.column("x")):
        _unpack(row.as_buffer(), x[i])
    del got, row
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]].astype(np.float32)
    weights, bias = _descend(x, y, ~aside if (~aside).any() else aside, np.zeros((WIDTH, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), STEPS)
    lean, judged = x @ weights + bias, aside if aside.any() else ~aside
    right = ((np.sign(lean[judged]) == y[judged]).sum(0) + 1) / (judged.sum() + 2)
    trust = np.log(right / (1 - right)).clip(1e-3)
    model = Model(languages, code, weights, bias, trust / trust.sum())
    plain = lean[aside & whole]
    limit = float(np.quantile(model.gaps(plain), PLAIN)) if len(plain) >= LEAST and len(languages) > 1 else AMBIGUOUS
    weights, bias = _descend(x, y, np.ones(len(y), bool), weights, bias, MORE_STEPS)
    return Model(languages, code, weights.astype(float), bias.astype(float), model.trust, limit)


def _descend(x: np.ndarray, y: np.ndarray, rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient descent on the logistic loss of the chosen rows."""
    share = (rows / rows.sum()).astype(np.float32)[:, None]  # the others weigh nothing, so that x is not copied
    past_w, past_b = weights, bias
    for step in range(steps):
        mix = np.float32(step / (step + 3))
        at_w, at_b = weights + mix * (weights - past_w), bias + mix * (bias - past_b)
        slope = -y * share / (1 + np.exp(np.clip(y * (x @ at_w + at_b), -30, 30)))
        past_w, past_b = weights, bias
        weights, bias = at_w - np.float32(8.0) * (x.T @ slope + np.float32(1e-6) * at_w), at_b - np.float32(8.0) * slope.sum(0)
    return weights, bias


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """lang_pred, score and ambiguous, or what `out` calls them, for every row of docs; `keep` names columns to carry along."""
    carried = [common.quoted(c) for c in keep or []]
    schema = docs.select(*carried).schema if carried else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.no_worker_state()
        own = model  # travels with the function: its size is fixed
        for batch in batches:
            rows: list[tuple[str, float, bool]] = []
            for text in common.binary(batch.column(batch.num_columns - 1)):
                if own is None or not text or not has_letter(text.decode("utf-8", "replace")):
                    rows.append((UNDETERMINED, 0.0, False))
                else:
                    rows.append(own.score(features(text)))
            lang, score, unsure = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch(
                [*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                [*(f"c{i}" for i in range(len(columns))), "lang_pred", "score", "ambiguous"],
            )

    names = [f"c{i}" for i in range(len(carried))]
    fields = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(schema or []))
    put = common.map_arrow(docs.select(*(c.alias(n) for c, n in zip(carried, names, strict=True)), common.quoted(text_col).cast("string").alias("t")), run, f"{fields}lang_pred string, score double, ambiguous boolean")
    return put.select(*(F.col(n).alias(c) for n, c in zip(names, keep or [], strict=True)), *(F.col(c).alias(o) for c, o in zip(("lang_pred", "score", "ambiguous"), out, strict=True)))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows the query never learns from."""
    return common.remainder(id_col, 4) == 2


def op2(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
