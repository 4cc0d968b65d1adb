"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are relative frequencies of letter-centred byte trigrams of the
lower-cased text, hashed. A linear machine's margin is then the mean weight over
the text's trigrams, read in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import in_slices, small
from factloom.session import prepare

#: Hashed features; scale of the frequencies; rows of each language that the model learns from (expected number).
FEATURES, SCALE, ROWS_PER_LANGUAGE = 4096, 30.0, 500
#: Weight of the squared norm and steps of the machine's fitting.
PENALTY, STEPS = 1e-4, 150
#: Family of common language codes; another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
}
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_MIX = np.random.default_rng(11).integers(0, FEATURES, (3, 256), dtype=np.int32)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), f"of {lang}")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each trigram of all texts in a row, and where each text ends."""
    parts = [t.lower().encode().translate(_TABLE) for t in texts]
    raw = np.frombuffer(b"  " + b"  ".join(parts) + b"  ", np.uint8)
    mid = raw[1:-1] != 0x20
    codes = (_MIX[0][raw[:-2]] ^ _MIX[1][raw[1:-1]] ^ _MIX[2][raw[2:]])[mid]
    ends = np.cumsum([len(p) + 2 for p in parts])
    return codes, np.cumsum(mid)[np.minimum(ends, len(mid)) - 1] if len(parts) else ends


@dataclass
class Model:
    """Weights (machines x features), biases, and what each machine decides."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        codes, ends = _codes(texts)
        starts = np.r_[0, ends[:-1]]
        n = ends - starts
        out = np.zeros((len(texts), len(self.weights)))
        full = n > 0
        for k, w in enumerate(self.weights):
            if full.any():
                out[full, k] = np.add.reduceat(w[codes], starts[full]) / n[full]
        return out * SCALE + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the product of both steps' logistic margins."""
        texts = [t or "" for t in texts]
        m = self.margins(texts)
        langs, scores = [], []
        for i, t in enumerate(texts):
            if not self.families or not _LETTER.search(t):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            f = int(np.argmax(m[i, : len(self.families)])) if len(self.families) > 1 else 0
            least = float(m[i, f]) if len(self.families) > 1 else 9.0
            score = 1 / (1 + np.exp(-4 * least))
            names = self.languages[self.families[f]]
            votes, worst = dict.fromkeys(names, 0), dict.fromkeys(names, 9.0)
            for k, (a, b) in enumerate(self.pairs, len(self.families)):
                if a in votes:
                    x = float(m[i, k])
                    votes[a if x >= 0 else b] += 1
                    worst[a], worst[b] = min(worst[a], x), min(worst[b], -x)
            best = max(names, key=lambda c: (votes[c], worst[c]))
            langs.append(best)
            scores.append(float(score / (1 + np.exp(-4 * worst[best]))))
        return langs, scores


def linear_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps; y is 1 or -1, both sides weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1 / (PENALTY + 2 * float((share * (np.square(x).sum(axis=1) + 1)).sum()))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w, b
    for t in range(STEPS):
        g = share * np.maximum(0, 1 - y * (x @ vw + vb)) * y
        nw, nb = vw * (1 - rate * PENALTY) + 2 * rate * (g @ x), vb + 2 * rate * float(g.sum())
        k = t / (t + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def fit(train: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from (text, lang); rows without either are left out.

    About ``rows_per_language`` rows of each language, chosen by a hash of
    ``pick`` (a column of ``train``) and the text, are read whole; only their
    hashed frequencies, FEATURES numbers at most a row, come to the driver.
    """
    prepare(train.sparkSession)
    rows = train.filter("text is not null and lang is not null").select("pick", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], {}, [], np.zeros((0, FEATURES), np.float32), np.zeros(0))
    unit = F.pmod(F.xxhash64("pick", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, rows_per_language / n))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at, weight = [], []
            for t in b.column("text").to_pylist():
                codes, _ = _codes([t])
                n = np.bincount(codes, minlength=FEATURES)
                at.append(i := np.flatnonzero(n).astype(np.int16))
                weight.append((n[i] / max(1, len(codes))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([a.tobytes() for a in weight], pa.binary())], names=["lang", "at", "weight"])

    got = rows.filter(unit < share[F.col("lang")]).mapInArrow(run, "lang string, at binary, weight binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["weight"])))
    x = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["weight"], np.float32) * SCALE
    langs = np.array([r["lang"] for r in got])
    names = sorted(set(langs.tolist()))
    families = sorted({family_of(c) for c in names})
    languages = {f: [c for c in names if family_of(c) == f] for f in families}
    pairs = [p for f in families for p in combinations(languages[f], 2)]
    kinds = np.array([family_of(c) for c in langs])
    machines = []
    for f in families:
        machines.append(linear_svm(x, np.where(kinds == f, 1, -1).astype(np.float32)) if len(families) > 1 else (np.zeros(FEATURES, np.float32), 0.0))
    for a, b in pairs:
        own = (langs == a) | (langs == b)
        machines.append(linear_svm(x[own], np.where(langs[own] == a, 1, -1).astype(np.float32)))
    return Model(families, languages, pairs, np.array([w for w, _ in machines], np.float32), np.array([b for _, b in machines]))


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if the model has learnt no language. Repeated rows stay; a null
    doc_id stays null; an empty table gives no rows; other columns aren't read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, langs, scores = [t or "" for t in b.column("text").to_pylist()], [], []
            for lo, hi in in_slices(texts):
                x, y = model.predict(texts[lo:hi])
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Model:
    """Learn from the documents that aren't held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("pick"), "text", "lang"))


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.0) -> DataFrame:
    """Keep the rows whose predicted language isn't ``und`` and whose score is ``least_score`` or more.

    All columns pass unchanged; each row is decided by its own text, so repeated
    or null doc_ids do no harm. Nulls and empty tables as in ``predict_languages``.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, keep = [t or "" for t in b.column("text").to_pylist()], []
            for lo, hi in in_slices(texts):
                keep += [lang != UNDETERMINED and score >= least_score for lang, score in zip(*model.predict(texts[lo:hi]), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
