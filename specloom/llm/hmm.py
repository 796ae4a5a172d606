"""LM scoring with a hidden Markov language model over words.

A word is emitted in two steps: a latent state emits a word class, the class emits the word by its smoothed
share of the class. Classes are the ``frequent`` most common training tokens (each its own class), the end of a
text, and ``hashed`` classes for all other words by a hash of their last two bytes and length, so
the tables that travel to the tasks are states x classes numbers whatever the corpus is. Each class keeps
one share for words never seen, so probabilities sum to one over known words and unseen slots.

Jobs: (1) every task cuts its texts into blocks, numbers the words of a block and writes the ids
and the block's dictionary with counts; (2) counts of a word are summed over all blocks and sent back to the blocks
that hold it; (3) blocks are rewritten as class sequences beside the unigram score, documents of like length in one task; (4) each
Baum-Welch round sums expected counts per task, then over tasks; (5) the scaled forward recursion scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import cut, fold_of

BLOCK_TOKENS = 6_000_000
END = b"\n"  # no word holds white space
TOKENS_SCHEMA = "block long, kind int, doc_id long, learned boolean, ids binary, word binary, local int, n_learned long"
CLASS_SCHEMA = "task int, doc_id long, learned boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.split and bytes.lower do."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_key(word: bytes) -> bytes:
    """The word, or for one of over 64 bytes its 128-bit digest, so that a key's size is bounded."""
    if len(word) <= 64:
        return word
    from hashlib import blake2b

    return b"\n" + blake2b(word, digest_size=16).digest()


def number_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, learned, text) to blocks: kind 0 a document's local ids (``local``: its tokens, ``n_learned``: its place in
    the block), kind 1 a dictionary entry (``local``: the id, ``n_learned``: its training count)."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32

    class Numbers(dict):
        def __missing__(self, key):
            self[key] = n = len(self)
            return n

    local = Numbers()
    total, docs = 0, []

    def flush() -> pd.DataFrame:
        d, l, sizes, i = zip(*docs)
        n, m = len(docs), len(local)
        taught = [np.frombuffer(x, "<u4") for x, learned in zip(i, l) if learned]
        seen = np.bincount(np.concatenate(taught), minlength=m) if taught else np.zeros(m, np.int64)
        frame = {
            "block": block, "kind": np.repeat([0, 1], [n, m]).astype("int32"),
            "doc_id": pd.array([*d, *[None] * m], "Int64"), "learned": pd.array([*l, *[None] * m], "boolean"),
            "ids": [*i, *[None] * m], "word": [*[None] * n, *map(word_key, local)],
            "local": np.concatenate([sizes, np.arange(m)]).astype("int32"), "n_learned": np.concatenate([np.arange(n), seen]).astype("int64"),
        }
        return pd.DataFrame(frame)

    for b in batches:
        for d, learned, text in zip(b["doc_id"].tolist(), b["learned"].tolist(), b["text"].tolist()):
            found = words(text)
            found.append(END)
            ids = np.fromiter(map(local.__getitem__, found), "<u4", len(found))
            docs.append((None if pd.isna(d) else int(d), bool(learned), len(ids), ids.tobytes()))
            total += len(ids)
            if total >= BLOCK_TOKENS:
                yield flush()
                block, total, docs = block + 1, 0, []
                local.clear()
    if docs:
        yield flush()


def vocabulary(tokens: DataFrame, frequent: int, hashed: int) -> DataFrame:
    """(word, c, class): training counts over all blocks. Class 0 is the end; 1..frequent the commonest words
    (ties by the word), the rest by a hash of ending and length."""
    counted = tokens.where("kind = 1").groupBy("word").agg(F.sum("n_learned").alias("c"))
    known = counted.where(F.col("c") > 0)
    top = known.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(frequent)
    own = top.select(F.col("word").alias("w"), F.row_number().over(Window.orderBy(F.desc("c"), "word")).alias("own"))
    shape = F.xxhash64(F.right(F.hex("word"), F.lit(4)), F.least(F.length("word"), F.lit(12)))
    other = F.lit(1 + frequent) + F.pmod(shape, F.lit(hashed)).cast("int")
    kind = F.when(F.col("word") == F.lit(END), 0).otherwise(F.coalesce("own", other))
    return counted.join(own, counted["word"] == own["w"], "left").select("word", "c", kind.cast("int").alias("class"))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    @classmethod
    def drawn(cls, share: np.ndarray, states: int, seed: int) -> "Model":
        """A start that breaks the states' symmetry: class shares times seeded noise, sticky moves."""
        rng = np.random.default_rng(seed)
        emit = (share + 1e-7) * rng.gamma(1.0, 1.0, (states, len(share)))
        move = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * (0.7 - 0.3 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> "Model":
        """Smoothed by the shares of the corpus, so that no class has probability 0 in a state."""
        emit = emit + 20.0 * (share + 1e-9)
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def padded(sequences: list[np.ndarray], cells: int = 3_000_000, most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length side by side: (their places, lengths, ids time x sequence)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        n = int(max(1, min(most, cells // max(1, lengths[order[at]]))))
        take = order[at:at + n]
        ids = np.zeros((lengths[take[0]], len(take)), np.uint16)
        for j, i in enumerate(take):
            ids[:lengths[i], j] = sequences[i]
        yield take, lengths[take], ids
        at += n


def windows(lengths: np.ndarray, steps: int, states: int, window: int | None, cells: int = 250_000) -> list[tuple[int, int, int]]:
    """(first, end, sequences that reach it): windows of steps whose states fit the processor's cache; lengths descend."""
    width = window or max(1, min(1024, cells // (len(lengths) * states)))
    return [(t, min(steps, t + width), int(np.searchsorted(-lengths, -t, side="left"))) for t in range(0, steps, width)]


def filtered(model: Model, ids: np.ndarray, lengths: np.ndarray, a: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """One window of the scaled forward recursion, states x time x sequence: emissions, filtered states, scales and the places
    behind a sequence's end. There every state emits with 1, so that scales stay 1 and nothing is learned or lost."""
    steps, n = ids.shape
    emit = np.take(model.emit, ids, axis=1)
    over = np.arange(first, first + steps)[:, None] >= lengths
    if over.any():
        emit[:, over] = 1.0
    states, scales, ahead = np.empty_like(emit), np.empty((steps, n)), np.ascontiguousarray(model.move.T)
    for t in range(steps):
        now = (ahead @ a if first + t else a) * emit[:, t]
        np.add.reduce(now, 0, out=scales[t])
        a = np.divide(now, scales[t], out=states[:, t])
    return emit, states, scales, over


def forward(model: Model, ids: np.ndarray, lengths: np.ndarray, window: int | None = None) -> tuple[np.ndarray, list]:
    """Scaled forward recursion over time x sequence ids, longest first: natural log likelihoods, and the
    filtered states before each window (to go back from without storing them all)."""
    steps, n = ids.shape
    total, held = np.zeros(n), []
    a = np.repeat(model.start[:, None], n, 1)
    for first, end, m in windows(lengths, steps, len(model.start), window):
        held.append(a[:, :m].copy())
        _, states, scales, over = filtered(model, ids[first:end, :m], lengths[:m], held[-1], first)
        total[:m] += np.where(over, 0.0, np.log(scales)).sum(0)
        a = states[:, -1]
    return total, held


def expected(model: Model, ids: np.ndarray, lengths: np.ndarray, counts: tuple, window: int | None = None) -> float:
    """Add the Baum-Welch expected counts of the sequences to ``counts`` (start, move, emit); log likelihood.

    Filtered states are kept at window borders and redone window by window on the way back, so memory is
    window x sequences x states for any length. Moves of a window are counted as one product.
    """
    start, move, emitted = counts
    k, width = model.emit.shape
    steps, n = ids.shape
    total, held = forward(model, ids, lengths, window)
    back = np.ones((k, n))
    for (first, end, m), before in zip(reversed(windows(lengths, steps, k, window)), reversed(held)):
        here = ids[first:end, :m]
        now, states, scales, over = filtered(model, here, lengths[:m], before, first)
        now /= scales
        posts, b = np.empty_like(states), back[:, :m]
        for t in range(end - first - 1, -1, -1):
            np.multiply(states[:, t], b, out=posts[:, t])
            later = np.multiply(now[:, t], b, out=now[:, t])
            if first + t:
                b = model.move @ later
        back[:, :m] = b
        if over.any():
            now[:, over], posts[:, over] = 0.0, 0.0
        if first:
            move += model.move * (before @ now[:, 0].T)
        else:
            start += posts[:, 0].sum(1)
        move += model.move * (states[:, :-1].reshape(k, -1) @ now[:, 1:].reshape(k, -1).T)
        seen = here.ravel()
        for j in range(k):
            emitted[j] += np.bincount(seen, posts[j].ravel(), width)
    return float(total.sum())


def dealt_by_length(texts: DataFrame, per_task: int = 4_000_000) -> tuple[int, list[tuple[float, int, int]]]:
    """(tasks, rows of (least token count, first task, number of tasks)): documents of like length share tasks of about
    ``per_task`` tokens, so that no task has a few long ones alone. The driver gets one row for each step of a quarter in length."""
    step = F.floor(F.log2("size") * 3)
    found = sorted(tuple(r) for r in texts.groupBy(step.alias("step")).agg(F.sum("size")).collect())
    per_task = max(1, min(per_task, sum(n for _, n in found) // texts.sparkSession.sparkContext.defaultParallelism))
    borders, first, held = [], 0, 0
    for step, n in found:
        if not borders or held + n > per_task:  # short steps share a task
            first += borders[-1][2] if borders else 0
            borders.append((float(step), first, max(1, round(n / per_task))))
            held = n
        else:
            held += n
    return (borders[-1][1] + borders[-1][2] if borders else 1), borders


def fit(classes: DataFrame, share: np.ndarray, states: int, warm_rounds: int, warm_docs: int, rounds: int, seed: int, settled: float) -> Model:
    """Baum-Welch from seeded noise: each round sums the counts of every learned document, until a round adds less than ``settled``
    of the log likelihood, ``rounds`` at most. On request ``warm_rounds`` over about ``warm_docs`` documents (smallest hash of the id) come first."""
    width = len(share)
    learned = classes.where("learned")

    def round_over(data: DataFrame, model: Model) -> tuple[Model, float]:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, log = (np.zeros(states), np.zeros((states, states)), np.zeros((states, width))), 0.0
            for b in batches:
                texts = [np.frombuffer(x, "<u2") for x in b["classes"]]
                for _, lengths, ids in padded(texts):
                    log += expected(model, ids, lengths, sums)
            flat = np.concatenate([sums[0], sums[1].ravel(), sums[2].ravel(), [log]])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"i": at.astype("int64"), "v": flat[at]})

        flat = np.zeros(states + states * states + states * width + 1)
        for r in data.select("classes").mapInPandas(count, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r["i"]] = r["v"]  # states x classes numbers, whatever the corpus
        a, b = states, states + states * states
        return Model.of_counts(flat[:a], flat[a:b].reshape(states, states), flat[b:-1].reshape(states, width), share), flat[-1]

    model = Model.drawn(share, states, seed)
    if warm_rounds:
        n = max(1, learned.count())
        near = int(min(1.0, warm_docs / n) * (1 << 20)) + 1
        some = learned.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < near).select("classes")
        some = cut(some.repartition(8))
        for _ in range(warm_rounds if some.limit(1).count() else 0):
            model, _ = round_over(some, model)
    before = -np.inf
    for _ in range(rounds):
        model, log = round_over(learned, model)
        if log - before < settled * abs(log):
            break
        before = log
    return model


def hmm_scores(docs: DataFrame, folds: int = 7, held: int = 2, states: int = 8, frequent: int = 2000, hashed: int = 512,
               warm_rounds: int = 0, warm_docs: int = 1000, rounds: int = 12, seed: int = 7, settled: float = 1e-3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text; learn from the documents outside fold ``held``.

    Rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts hold the end
    alone; repeated rows are scored and learned each; a null id has the fold of the empty text; an empty table gives
    no rows, and a corpus without learned documents scores all words as unseen. Extra columns are left out.
    """
    if 1 + frequent + hashed > 1 << 16:
        raise ValueError("classes do not fit 16 bits")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold_of(doc_id, folds) != held).alias("learned"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tokens = cut(rows.mapInPandas(number_words, TOKENS_SCHEMA))
    vocab = cut(vocabulary(tokens, frequent, hashed))
    sizes = vocab.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect()  # a row for each class
    width = 1 + frequent + hashed
    mass, kinds = np.zeros(width), np.zeros(width)
    for r in sizes:
        mass[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    total, distinct = mass.sum(), kinds.sum()
    # a class of one known word has no unseen slot; hashed classes have one
    slots = np.where(np.arange(width) <= frequent, 0.0, 1.0)
    below = np.maximum(mass + slots * (kinds + 1), 1.0)
    rare = np.log10(total + distinct + 1)
    entries = tokens.where("kind = 1").select("block", "word", "local").join(vocab, "word").select("block", "local", "c", "class")

    def encode(texts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        c, kind = np.zeros(len(entries)), np.zeros(len(entries), np.int64)
        at = entries["local"].to_numpy()
        c[at], kind[at] = entries["c"].to_numpy(), entries["class"].to_numpy()
        base, known = np.log10(c + 1) - rare, c > 0
        inner = np.where(slots[kind] > 0, np.log10(c + 1) - np.log10(below[kind]), 0.0)
        ids = [np.frombuffer(x, "<u4") for x in texts["ids"]]
        return pd.DataFrame({
            "task": texts["task"], "doc_id": texts["doc_id"].astype("Int64"), "learned": texts["learned"], "n_tokens": [len(x) for x in ids], "n_known": [int(np.count_nonzero(known[x])) for x in ids],
            "base_score": [float(base[x].sum()) for x in ids], "inner": [float(inner[x].sum()) for x in ids], "classes": [kind[x].astype("<u2").tobytes() for x in ids]})

    texts = tokens.where("kind = 0")
    tasks, borders = dealt_by_length(texts.select(F.col("local").alias("size")))
    step, place, task = F.floor(F.log2("local") * 3), F.xxhash64("block", "n_learned"), F.lit(0)
    for least, first, n in borders:
        task = F.when(step >= least, F.lit(first) + F.pmod(place, F.lit(n)).cast("int")).otherwise(task)
    texts = texts.select(F.col("block").alias("text_block"), "doc_id", "learned", "ids", task.alias("task"))
    coded = texts.groupBy("text_block").cogroup(entries.groupBy("block")).applyInPandas(encode, CLASS_SCHEMA)
    classes = cut(coded.repartitionById(tasks, F.col("task")).drop("task"))
    share = mass / total if total else np.full(width, 1 / width)
    model = fit(classes, share, states, warm_rounds, warm_docs, rounds, seed, settled) if total else Model.drawn(share, states, seed)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b))
            for take, lengths, ids in padded([np.frombuffer(x, "<u2") for x in b["classes"]]):
                out[take] = forward(model, ids, lengths)[0] / np.log(10)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": ~b["learned"].astype(bool), "n_tokens": b["n_tokens"], "n_known": b["n_known"], "train_tokens": int(total),
                                "base_score": b["base_score"], "score": out + b["inner"].to_numpy()})

    return classes.mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
