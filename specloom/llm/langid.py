"""Language identification: TF-IDF character n-grams, sparse multinomial logistic regression, temperature.

Features: letters lower-cased, all else one space; n-grams of 1 to 3 characters hashed into ``2^bits`` bins; the weight
of a bin is its share of the text's n-grams times its inverse document frequency. Document frequencies are counted
over every learned document. The regression is trained with follow-the-regularised-leader (per-coordinate rates,
L1 and L2 penalties: the elastic net) on a bounded sample of labelled rows, and a held-back part of that sample sets
the temperature. A text is scored in linear time without its own feature table: the sum of bin weights over all n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import fold_of, release_memory, slices

GRAM_PRIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each character of the basic plane its lower-case letter, or a space for a non-letter."""
    if not _folded:
        table = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def gram_bins(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins of all n-grams of all texts, number of them per text). Texts stand between two spaces."""
    joined = "".join([f" {t} " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    c = np.where(codes < 1 << 16, folded()[np.minimum(codes, 0xFFFF)], codes)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (owner[1:] != owner[:-1])
    c, owner = c[keep], owner[keep]
    shift = np.uint32(32 - bits)
    one = c * GRAM_PRIMES[0]
    bins, owners = [one[c != 32]], [owner[c != 32]]
    two = one[:-1] * GRAM_PRIMES[1] ^ (c[1:] + np.uint32(1)) * GRAM_PRIMES[2]
    same = owner[1:] == owner[:-1]
    bins.append(two[same])
    owners.append(owner[1:][same])
    three = two[:-1] * GRAM_PRIMES[1] ^ (c[2:] + np.uint32(7)) * GRAM_PRIMES[0]
    same = owner[2:] == owner[:-2]
    bins.append(three[same])
    owners.append(owner[2:][same])
    h = np.concatenate(bins)
    h = (h ^ (h >> np.uint32(15))) * GRAM_PRIMES[2]
    order = np.concatenate(owners)
    return (h >> shift).astype(np.int64), order


def batches_of(texts: pa.Array) -> Iterator[tuple[slice, list[str]]]:
    values = texts.to_pylist()
    for s in slices([len(t or "") for t in values]):
        yield s, [t or "" for t in values[s]]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # bins x languages, inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float
    bits: int
    known: np.ndarray  # for each bin whether a learned language uses it
    strange: float  # share of other n-grams that a text of a learned language may have
    least: float  # probability that a text of a learned language reaches

    def fits(self, texts: list[str], probability: np.ndarray, least: float | None = None) -> np.ndarray:
        """Whether each text may be of a learned language: by the probability of its best one and by its share of strange n-grams."""
        bins, owner = gram_bins(texts, self.bits)
        count, odd = np.bincount(owner, minlength=len(texts)), np.bincount(owner[~self.known[bins]], minlength=len(texts))
        return (probability >= (self.least if least is None else least)) & (odd <= SPARE + self.strange * count)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        bins, owner = gram_bins(texts, self.bits)
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        z = np.stack([np.bincount(owner, self.weights[:, k][bins], len(texts)) for k in range(len(self.languages))], 1)
        return softmax((z / count[:, None] * SCALE + self.bias) / self.temperature)


#: Shares of n-grams are small numbers; this brings the inputs near one.
SCALE = 100.0
#: So many n-grams of any text may be strange (a name, a short text).
SPARE = 12


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple], targets: np.ndarray, bins: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.5, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with per-coordinate rates for multinomial logistic loss: (weights, bias).

    ``rows`` are (bins, values); the last coordinate is the bias, without penalties.
    """
    z, n = np.zeros((bins + 1, classes)), np.zeros((bins + 1, classes))
    l1s, l2s = np.full((bins + 1, 1), l1), np.full((bins + 1, 1), l2)
    l1s[-1] = l2s[-1] = 0

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1s[at], 0.0, -(zi - np.sign(zi) * l1s[at]) / ((beta + np.sqrt(n[at])) / alpha + l2s[at]))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], bins), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[targets[i]] -= 1
            g = x[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    w = weights(np.arange(bins + 1))
    return w[:-1], w[-1]


def temperature_of(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss, by a grid that narrows over its logarithm.

    Targets are (n + 1) / (n + 2) and not 1, so that a part without errors doesn't make every score 1.
    """
    low, high = -3.0, 5.0
    slack = 1 / (len(targets) + 2)

    def loss(t: float) -> float:
        log = np.log(softmax(logits / np.exp(t)) + 1e-300)
        own = log[np.arange(len(targets)), targets]
        others = (log.sum(1) - own) / max(1, log.shape[1] - 1)
        return -((1 - slack) * own + slack * others).mean()

    for _ in range(4):
        grid = np.linspace(low, high, 13)
        best = int(np.argmin([loss(t) for t in grid]))
        low, high = grid[max(0, best - 1)], grid[min(12, best + 1)]
    return float(np.exp((low + high) / 2))


def known_bins(vectors: list[tuple], targets: np.ndarray, bins: int, classes: int, common: float = 0.01) -> np.ndarray:
    """Bins that at least a hundredth of the learned rows of some language hold, so that a rare language counts like a frequent one."""
    known = np.zeros(bins, bool)
    for k in range(classes):
        own = [vectors[i][0] for i in np.flatnonzero(targets == k)]
        if own:
            known |= np.bincount(np.concatenate(own), minlength=bins) >= max(1, common * len(own))
    return known


def bounds_of(counts: list[tuple], known: np.ndarray, probability: np.ndarray, targets: np.ndarray, classes: int) -> tuple[float, float]:
    """(share of strange n-grams, probability) that bound a learned language, from held-back rows; ``counts`` are (bins, counts).

    The share is twice what all but a hundredth of a language's rows show beyond ``SPARE``, at least a tenth (addresses, codes, quoted words); the probability
    lies halfway between chance and the lowest of the rows. Without held-back rows only chance is asked for.
    """
    chance = 1 / classes
    if not counts:
        return 1.0, chance
    n = np.array([c.sum() for _, c in counts])
    odd = np.array([c[~known[at]].sum() for at, c in counts])
    share = np.maximum(0, odd - SPARE) / np.maximum(n, 1)
    usual = max(np.quantile(share[targets == k], 0.99) for k in np.unique(targets))
    return float(max(0.1, 2 * usual)), float((chance + probability.min()) / 2)


def smallest_hashes(drawn: DataFrame, n_rows: dict[str, int], each: int) -> dict[str, int]:
    """For each language of ``drawn`` (lang, h) the ``each``-th smallest hash, or the largest where it has fewer rows.

    Hashes are even, so only those below a bound set from the language's number of rows are ranked: about twice ``each``,
    however many rows it has. A language that shows too few below its bound (equal keys) is asked again with a larger one.
    """
    border, share = {}, {k: (2 * each + 1000) / n for k, n in n_rows.items()}
    while share:
        bound = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(min(v, 1) * (2**64 - 1)) - 2**63).cast("long"))])
        low = drawn.where(F.col("h") <= bound[F.col("lang")])
        ranked = low.select("lang", "h", F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("r")).where(F.col("r") <= each)
        for r in ranked.groupBy("lang").agg(F.max("h").alias("h"), F.count("h").alias("n")).collect():
            if r["n"] >= min(each, n_rows[r["lang"]]):
                border[r["lang"]] = r["h"]
        share = {k: 4 * v for k, v in share.items() if k not in border}
    return border


def fit_language_model(rows: DataFrame, sample: int = 4000, bits: int = 15, seed: int = 3, **ftrl_options) -> LanguageModel | None:
    """Learn from ``rows`` (key, text, lang). Document frequencies use all rows with a language; the regression at most
    ``sample`` rows, as many of each language as fit, those with the smallest hash of (key, language).
    None if no row has a language."""
    spark = rows.sparkSession
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    drawn = labelled.select("lang", F.xxhash64("key", "lang", F.lit(seed)).alias("h"))
    n_rows = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    languages = sorted(n_rows)
    if not languages:
        return None
    each = max(1, sample // len(languages))
    border = smallest_hashes(drawn, n_rows, each)
    size = 1 << bits

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(size, np.int64), 0
        for b in batches:
            for _, texts in batches_of(b.column(0)):
                bins, owner = gram_bins(texts, bits)
                seen = np.zeros((64, size), bool)
                for first in range(0, len(texts), 64):
                    inside = (owner >= first) & (owner < first + 64)
                    seen[:] = False
                    seen[owner[inside] - first, bins[inside]] = True
                    total += seen.sum(0)
                docs += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*total[at], docs], pa.int64())], names=["bin", "n"])
        release_memory()

    summed = labelled.select("text").mapInArrow(counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # a row for each bin at most
    frequency = np.zeros(size + 1)
    frequency[summed["bin"].to_numpy()] = summed["n"].to_numpy()
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).to_pylist()
            found = [np.unique(gram_bins([t], bits)[0], return_counts=True) for t in values]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<i4").tobytes() for f in found], pa.binary())], names=["lang", "h", "bins", "counts"])

    h = F.xxhash64("key", "lang", F.lit(seed))
    border_of = F.create_map(*[x for k, v in border.items() for x in (F.lit(k), F.lit(v))])
    some = labelled.select("lang", "text", h.alias("h")).where(F.col("h") <= border_of[F.col("lang")])
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text", "h")
    table = some.mapInArrow(features, "lang string, h long, bins binary, counts binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])  # ``sample`` rows of at most 2^bits bins each
    targets = np.array([languages.index(x) for x in table["lang"].to_pylist()])
    vectors, raw = [], []
    for at, n in zip(table["bins"].to_pylist(), table["counts"].to_pylist()):
        at, n = np.frombuffer(at, "<i4"), np.frombuffer(n, "<i4")
        raw.append((at, n))
        vectors.append((at, n / max(1, n.sum()) * SCALE * idf[at]))
    held = np.arange(len(vectors)) % 5 == 4
    learn = [v for v, x in zip(vectors, held) if not x]
    w, bias = ftrl(learn, targets[~held], size, len(languages), seed=seed, **ftrl_options)
    logits = np.array([v @ w[at] + bias for (at, v), x in zip(vectors, held) if x])
    temperature = temperature_of(logits, targets[held]) if held.any() else 1.0
    known = known_bins(learn, targets[~held], size, len(languages))
    best = softmax(logits / temperature).max(1) if held.any() else np.ones(0)
    strange, least = bounds_of([r for r, x in zip(raw, held) if x], known, best, targets[held], len(languages))
    return LanguageModel(languages, w * idf[:, None], bias, temperature, bits, known, strange, least)


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text", reject: bool = False, least: float | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; ``und`` and 0.0 for a text that is null or has no letter, or
    without a model; with ``reject`` also for one that fits no learned language (``LanguageModel.fits``; ``least`` takes the place of
    the learned probability). All columns stay; clashing ones are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).rlike(r"\p{L}").alias("_letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            letters = [bool(x) for x in b.column(len(keep)).to_pylist()]
            for s, texts in batches_of(b.column(place)) if model else ():
                p = model.probabilities(texts)
                best = p.argmax(1)
                fits = model.fits(texts, p.max(1), least) if reject else np.ones(len(texts), bool)
                for i, k in enumerate(best):
                    if letters[s.start + i] and fits[i]:
                        names[s.start + i], scores[s.start + i] = model.languages[k], p[i, k]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(names), pa.array(scores)], names=[*keep, "lang_pred", "score"])
        release_memory()

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = 4000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows outside fold ``held``.

    Languages, sources and ids are no inputs of a prediction. A null id has the fold of the empty text; repeated
    rows are predicted each; an empty table gives no rows; extra columns are left out.
    """
    out = fold_of(doc_id, folds) == held
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), out.alias("out"))
    model = fit_language_model(rows.where(~F.col("out")).drop("out"), sample)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    return predict_languages(plain, model).drop("text")


def keep_known_languages(docs: DataFrame, least: float | None = None, folds: int = 4, held: int = 2, sample: int = 4000) -> DataFrame:
    """The rows of ``docs`` whose text fits a learned language, by two bounds that held-back rows set: the calibrated probability of the
    best language (``least`` overrides it) and the share of n-grams that no learned language uses. The second tells a foreign
    text also where one or two languages are learned and a probability cannot.

    Null texts and texts without a letter go, and every row where no row has a language. Repeated rows are each decided alike; a null id has
    the fold of the empty text; an empty table gives none; the columns stay, extra ones with them.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), "text", "lang", (fold_of("doc_id", folds) == held).alias("out"))
    model = fit_language_model(rows.where(~F.col("out")).drop("out"), sample)
    # a text passes to Python once: it is left out of the other columns, which go along as one
    others = [c for c in docs.columns if c != "text"]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text"))
    named = predict_languages(given, model, reject=True, least=least)
    return named.where(F.col("lang_pred") != "und").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
