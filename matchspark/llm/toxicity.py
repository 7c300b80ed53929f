"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words in lower case without outer punctuation; a word also counts under its first 4, 5 and 6 letters, so
rare forms share evidence. Log-odds of toxic against clean use an informative Dirichlet prior in proportion to the
counts of the whole corpus, ``PRIOR`` times as heavy as the labelled tokens (a text counts a word once, near copies count as one text); features count only if their toxic share is no chance
(``CHANCE`` over all features tested); a word scores by its most certain one, every other word costs ``GAP``. A linear scan finds all maximal-scoring segments of a text
(Ruzzo-Tompa). A segment's bits are lambda * S - ln(K * n), its extreme-value significance among n tokens; the bits
of all significant segments are summed and turned into a probability by a logistic curve fitted on labelled rows.

Labels are read from at most ``labelled_rows`` rows (the smallest hashes of the id), whose lexicon is bounded with
them; corpus counts cover every text. Empty and NULL texts get the score of a text without passages. Several labels
of one id count as toxic if one is. Without labels of both kinds every score is 0. NULL ids can't have labels.
"""

from __future__ import annotations

import json
import math
import re
import string
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm import common
from matchspark.llm.merging import BLANK, WordCoder

LABELLED_ROWS = 150_000
GAP = 0.1
CHANCE = 0.01
PRIOR = 0.2
PREFIXES = (4, 5, 6)
UNIT = 1000
MINIMA = 3
_BLANKS = re.compile("[\x09-\x0d ]+")
_OUTER = string.punctuation + "¡¿«»„“”‘’…–—"


def features(word: str) -> list[str]:
    w = word.lower().strip(_OUTER)
    return [w, *[f"{w[:k]}*" for k in PREFIXES if len(w) > k]] if w else []


class Words(WordCoder):
    """Numbers for each word, from a dictionary of features; a subclass says which."""

    remember = 300_000

    def __init__(self, model: str) -> None:
        self.model = json.loads(model)
        super().__init__()

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = BLANK[data] | (data == 255)
        return np.flatnonzero(~blank & np.r_[True, blank[:-1]]), np.flatnonzero(np.r_[blank[1:], True] & ~blank) + 1

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.numbers(features(w.decode("utf-8", "surrogatepass"))) for w in words]
        return np.array([x for f in found for x in f], np.int64), np.array([len(f) for f in found], np.int64)


class FeatureNumbers(Words):
    """Numbers of the known features of a word; 0 stands for the word itself."""

    def numbers(self, found: list[str]) -> list[int]:
        return [0, *[self.model[f] for f in found if f in self.model]]


class WordScores(Words):
    """One score for each word, in thousandths: that of its most certain feature, else 0."""

    def numbers(self, found: list[str]) -> list[int]:
        known = [self.model[f] for f in found if f in self.model]
        return [round(max(known)[1] * UNIT) if known else 0]


@dataclass
class Model:
    """Scores of toxic features with their certainty, constants of the segment statistics, and the logistic curve."""

    lexicon: dict[str, tuple[float, float]]
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = -30.0


def training_labels(labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id and toxic of the rows to learn from: crc32 of the id as text is no multiple of 5."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
    once = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    texts = common.texts(docs)
    chosen = _weighted(texts, common.stored(training_labels(labels, labelled_rows)))
    known = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight")
    counted = known.mapInArrow(_label_counts, "feature string, toxic_n double, clean_n double").groupBy("feature")
    totals = counted.agg(F.sum("toxic_n").alias("toxic_n"), F.sum("clean_n").alias("clean_n"))
    totals = common.stored(totals)
    sums = {r["feature"]: r for r in totals.filter("feature = ''").collect()}.get("")
    if sums is None or not sums["toxic_n"] or not sums["clean_n"]:
        return Model({})
    n1, n0 = sums["toxic_n"], sums["clean_n"]
    leaning = totals.filter((F.col("feature") != "") & (F.col("toxic_n") >= 3) & (F.col("toxic_n") * n0 > 2 * F.col("clean_n") * n1))
    tested = max(1, totals.filter("toxic_n > 0").count())
    rows = [r for r in leaning.collect() if surprise(r["toxic_n"], r["clean_n"], n1 / (n1 + n0)) >= math.log(tested / CHANCE)]
    numbers = {r["feature"]: k + 1 for k, r in enumerate(rows)}
    everywhere = _corpus_counts(texts, numbers)
    tokens, prior = max(1, everywhere.get(0, 1)), PRIOR * (n1 + n0)
    lexicon = {}
    for r in rows:
        weight = max(prior * everywhere.get(numbers[r["feature"]], 0) / tokens, 0.01)
        y1, y0 = r["toxic_n"] + weight, r["clean_n"] + weight
        odds = math.log(y1 / (n1 + prior - y1)) - math.log(y0 / (n0 + prior - y0))
        z = odds / math.sqrt(1 / y1 + 1 / y0)
        lexicon[r["feature"]] = (z, odds)
    model = Model(lexicon)
    if lexicon:
        _segment_statistics(model, known)
        _curve(model, known)
    return model


def words_of(text: str) -> list[str]:
    """Words between ASCII blanks, as the scoring cuts them."""
    return [w for w in _BLANKS.split(text) if w]


def signature(text: str) -> int:
    """Joint hash of the minima of the text's pairs of neighbouring words."""
    words = words_of(text.lower())
    pairs = {" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words)
    least = [min((xxhash.xxh3_64_intdigest(p, seed) for p in pairs), default=0) for seed in range(MINIMA)]
    return xxhash.xxh3_64_intdigest(" ".join(map(str, least))) >> 1


def _weighted(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labelled rows with weights that let a group of near copies count about once: one by the rows with the same
    ``MINIMA`` smallest hashes of two neighbouring words, each under a seed of its own. A single common pair of words does
    not make texts alike; texts without two words weigh as those with the same words."""

    def run(batches):
        for batch in batches:
            least = [signature(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(least, pa.int64())], ["doc_id", "toxic", "least"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = common.stored(texts.join(F.broadcast(chosen), "doc_id").mapInArrow(run, f"doc_id {kind}, toxic int, least bigint"))
    sizes = marked.groupBy("least", "toxic").agg((1 / F.count(F.lit(1))).alias("weight"))
    return common.stored(marked.join(sizes, ["least", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("weight").alias("weight")))


def surprise(toxic: float, clean: float, base: float) -> float:
    """Minus the logarithm of a bound on the chance of so large a toxic share (Chernoff)."""
    n = toxic + clean
    out = 0.0
    for k, p in ((toxic, base), (clean, 1 - base)):
        out += k * math.log(k / n / p) if k else 0.0
    return out if toxic > base * n else 0.0


def _label_counts(batches):
    for batch in batches:
        toxic, clean = {}, {}
        for text, label, weight in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "weight")], strict=True):
            into = toxic if label else clean
            words = set(words_of(text))
            into[""] = into.get("", 0) + weight * len(words)
            for f in {f for w in words for f in features(w)}:
                into[f] = into.get(f, 0) + weight
        # a feature without a toxic count in this batch may have one elsewhere, so all are told
        names = list(dict.fromkeys([*toxic, *clean]))
        arrays = [pa.array([c.get(n, 0.0) for n in names], pa.float64()) for c in (toxic, clean)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *arrays], ["feature", "toxic_n", "clean_n"])


def _corpus_counts(texts: DataFrame, numbers: dict[str, int]) -> dict[int, int]:
    """Occurrences of each numbered feature in all texts, and of all words under 0."""
    spec = texts.sparkSession.sparkContext.broadcast(json.dumps(numbers))

    def run(batches):
        total = np.zeros(len(numbers) + 1, np.int64)
        for batch in (part for batch in batches for part in common.by_bytes(batch)):
            flat, _ = common.coder(FeatureNumbers, spec.value).encode(batch.column("text").to_pylist())
            total += np.bincount(flat, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["number", "n"])

    counts = texts.select("text").mapInArrow(run, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n"))
    return {r["number"]: r["n"] for r in counts.collect()}  # at most one row for each feature of the sample


def _scored(texts: DataFrame, model: Model, fn, schema: str) -> DataFrame:
    spec = texts.sparkSession.sparkContext.broadcast(json.dumps(model.lexicon))
    return texts.mapInArrow(partial(_run_scored, spec=spec, fn=fn), schema)


def _run_scored(batches, spec, fn):
    for batch in (part for batch in batches for part in common.by_bytes(batch)):
        texts = batch.column("text").to_pylist()
        flat, counts = common.coder(WordScores, spec.value).encode(texts)
        edges = np.r_[0, np.cumsum(counts)]
        at = np.flatnonzero(flat)
        owner = np.searchsorted(edges, at, side="right") - 1
        hits = [([], [])] * len(texts)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(first.tolist(), np.r_[first[1:], len(at)].tolist() if len(first) else [], strict=True):
            doc = int(owner[a])
            hits[doc] = ((at[a:b] - edges[doc]).tolist(), (flat[at[a:b]] / UNIT).tolist())
        yield from fn(batch, texts, counts.tolist(), hits)


def segments(places: list[int], scores: list[float], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end, score) of a text in which the words not named score -gap.

    The linear scan of Ruzzo and Tompa; each candidate links to the nearest one before it that starts lower.
    """
    out: list[list] = []  # first, end, sum before, sum after, link
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= gap * (place - last - 1)
        k = [place, place + 1, total, total + score, -1]
        total, last = total + score, place
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= k[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= k[3]:
                k[4] = j
                out.append(k)
                break
            k[0], k[2] = out[j][0], out[j][2]
            link = out[j][4]
            del out[j:]
            j = link
    return [(a, b, after - before) for a, b, before, after, _ in out]


def _segment_statistics(model: Model, known: DataFrame) -> None:
    """Karlin-Altschul rate from the scores of words in clean labelled texts: sum of p * exp(rate * score) = 1."""

    def run(batch, texts, counts, hits):
        values, sizes = np.unique(np.concatenate([np.array(s) for _, s in hits] or [np.zeros(0)]), return_counts=True)
        names = ["score", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[values, 0.0]), pa.array(np.r_[sizes, sum(counts) - sizes.sum()].astype(np.int64))], names)

    clean = known.filter("toxic = 0").select("text")
    rows = _scored(clean, model, run, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    seen = {r["score"]: r["n"] for r in rows}
    plain = max(1, seen.pop(0.0, 1))
    top = float(np.median([s for _, s in model.lexicon.values()]))
    scores = np.array([-GAP, *seen, top])
    share = np.array([plain, *seen.values(), 1], float)
    share /= share.sum()
    low, high = 0.0, 100.0 / max(scores.max(), GAP)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if (share * np.exp(np.minimum(mid * scores, 600))).sum() > 1 else (mid, high)
    model.rate = max(low, 1e-3)
    model.scale = float(share[scores > 0].sum())


def bits(model: Model, score: float, words: int) -> float:
    """lambda * S - ln(K * n): minus the logarithm of the expected number of such segments by chance."""
    return model.rate * score - math.log(max(model.scale * max(words, 1), 1e-12))


def evidence(model: Model, found: list[tuple[int, int, float]], words: int) -> float:
    return math.log1p(sum(max(0.0, bits(model, s, words)) for _, _, s in found))


def _curve(model: Model, known: DataFrame) -> None:
    """Logistic curve on the evidence, fitted on its histogram by label with a weak prior."""

    def run(batch, texts, counts, hits):
        x = [round(evidence(model, segments(*h), n), 2) for h, n in zip(hits, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic"), batch.column("weight")], ["x", "toxic", "weight"])

    table = _scored(known, model, run, "x double, toxic int, weight double").groupBy("x").agg(
        F.sum(F.col("toxic") * F.col("weight")).alias("n1"), F.sum((1 - F.col("toxic")) * F.col("weight")).alias("n0")
    )
    rows = table.collect()  # one row for each hundredth of the evidence
    x = np.array([r["x"] for r in rows])
    n1, n0 = np.array([r["n1"] for r in rows], float), np.array([r["n0"] for r in rows], float)
    design, beta = np.c_[x, np.ones_like(x)], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n1 - (n1 + n0) * p) - 0.1 * beta
        curvature = (design * ((n1 + n0) * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.intercept = max(0.0, float(beta[0])), float(beta[1])


PASSAGES = "array<struct<first_word:int,end_word:int,score:double,p_value:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and the significant passages (p below .05) of every text, in words."""

    def run(batch, texts, counts, hits):
        scores, passages = [], []
        for words, h in zip(counts, hits, strict=True):
            found = segments(*h)
            value = model.slope * evidence(model, found, words) + model.intercept
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, value)))))
            told = [(a, b, s, -math.expm1(-math.exp(-bits(model, s, words)))) for a, b, s in found]
            passages.append([dict(zip(("first_word", "end_word", "score", "p_value"), t)) for t in told if t[3] < 0.05])
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scored(common.texts(docs), model, run, f"doc_id {kind}, score double, passages {PASSAGES}")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The same columns of the rows that score below the threshold; one pass, nothing is shuffled."""
    spec = docs.sparkSession.sparkContext.broadcast(json.dumps(model.lexicon))
    common.ship(docs.sparkSession)

    def clean(batch, texts, counts, hits):
        values = [model.slope * evidence(model, segments(*h), n) + model.intercept for n, h in zip(counts, hits, strict=True)]
        yield batch.filter(pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) < threshold for v in values]))

    return docs.mapInArrow(partial(_run_scored, spec=spec, fn=clean), docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of passages of every row."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


