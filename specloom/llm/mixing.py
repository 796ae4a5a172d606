"""Mixing to target weights by soft membership, in DataFrame functions only.

A Bernoulli naive Bayes classifier, counted from a labelled table, gives every document posteriors over domains. Then
nonnegative rates (expected copies of a document) are found whose expected tokens per domain match the targets:
least squares by projected gradient. A gradient needs only the residual of each domain, so a step is one aggregation
over a narrow table, and the driver holds one number per domain and step.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, shared_path, unit_hash

#: Domains of a row of ``labels`` and the share of tokens each is to have in a mixture.
TARGETS = {"good": 0.95, "plain": 0.04, "toxic": 0.01}


def domain_of_labels() -> Column:
    """toxic, else by quality; a null label counts as 0, rows with both null have no domain."""
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.coalesce(F.col("quality"), F.lit(0))
    return F.when(F.col("toxic").isNull() & F.col("quality").isNull(), None).when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("plain")


def mix_words(text: Column) -> Column:
    """Runs between white space and sentence marks, lower-cased; the first and last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?\"'()]+")


@dataclass
class DomainModel:
    domains: list[str]
    words: list[str]
    base: list[float]  # for each domain the log of its share and of all words being absent
    present: list[list[float]]  # for each word and domain what its presence adds


def fit_domains(docs: DataFrame, labelled: DataFrame, rows: int = 20_000, words: int = 256, doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DomainModel:
    """Naive Bayes on the presence of telling words, learned from at most ``rows`` rows of ``labelled`` (doc_id, domain), those
    with the smallest hash. The ``words`` words of most evidence make the model, so it has words x domains numbers.
    Without labelled documents there is one domain, ``none``.
    """
    drawn = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "domain").distinct()
    drawn = cut(drawn.orderBy(F.xxhash64("_id", "domain", F.lit(seed)), "_id", "domain").limit(rows))
    known = docs.join(drawn, docs[doc_id] == drawn["_id"]).select("domain", F.array_distinct(mix_words(F.col(text))).alias("w"))
    known = cut(known)
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes)
    if not domains:
        return DomainModel(["none"], [], [0.0], [])
    total = sum(sizes.values())
    held = known.select("domain", F.explode("w").alias("word")).where("word <> ''")
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    share = F.col("n") / total
    # smoothed towards the word's share in all documents; evidence is the log ratio times the documents that bear it
    odds = [F.log((F.col(f"n{i}") + 4 * share) / ((sizes[d] + 4) * share)) for i, d in enumerate(domains)]
    # only words that a domain has more often: what is rarer in one mostly tells how long its documents are
    evidence = F.greatest(*[o * F.col(f"n{i}") for i, o in enumerate(odds)], F.lit(0.0))
    strongest = F.greatest(*odds, F.lit(0.0))
    best = counts.where((F.col("n") >= 5) & (strongest > 1.2)).orderBy(F.desc(evidence), "word").limit(words).collect()
    base = [log(sizes[d] / total) for d in domains]
    present = []
    for r in best:
        p = [(r[f"n{i}"] + 4 * r["n"] / total) / (sizes[d] + 4 + 1e-9) for i, d in enumerate(domains)]
        p = [min(max(x, 1e-9), 1 - 1e-6) for x in p]
        base = [b + log(1 - x) for b, x in zip(base, p)]
        present.append([log(x) - log(1 - x) for x in p])
    return DomainModel(domains, [r["word"] for r in best], base, present)


def with_posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and posteriors (an array in the order of the model's domains). Row by row, no shuffle."""
    k = len(model.domains)
    words = docs.withColumn("_w", mix_words(F.col(text)))
    edges = (F.get("_w", F.lit(0)) == "").cast("int") + ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    listed = F.array(*[F.lit(w) for w in model.words]).cast("array<string>")
    weights = F.create_map(*[c for w, row in zip(model.words, model.present) for c in (F.lit(w), F.array(*[F.lit(x) for x in row]))]) if model.words else None
    found = words.withColumn("n_tokens", (F.size("_w") - edges).cast("long")).withColumn("_f", F.array_intersect("_w", listed)).drop("_w")

    def evidence(j: int) -> Column:
        base = F.lit(float(model.base[j]))
        return F.aggregate("_f", base, lambda a, w: a + F.get(F.element_at(weights, w), F.lit(j))) if model.words else base

    scored = found.withColumn("_s", F.array(*[evidence(j) for j in range(k)])).drop("_f")
    scored = scored.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("posteriors", F.transform("_e", lambda x: x / total)).drop("_s", "_e")


def rate_after(steps: list[list[float]], k: int) -> Column:
    """A document's rate after projected gradient steps from 1; each step lists the scaled residual of each domain."""
    if not steps:
        return F.lit(1.0)
    listed = F.lit([x for s in steps for x in s]).cast("array<double>")
    p = F.col("posteriors")
    dot = lambda i: sum((F.get(p, F.lit(j)) * F.get(listed, i * k + j) for j in range(k)), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), lambda r, i: F.greatest(F.lit(0.0), r - dot(i)))


def fit_rates(table: DataFrame, targets: list[float], steps: int = 60, tolerance: float = 1e-4) -> list[list[float]]:
    """Steps of projected gradient descent for min over r >= 0 of the sum over domains of ((sum of r n p - T) / T)^2, from r = 1.

    ``table`` has n_tokens and posteriors. In the metric weighted by n the gradient of a document is its posteriors times
    the weighted residuals; each domain's
    step is one over its row sum of the Gram matrix sum n p p', which bounds the eigenvalues, and settles in tens of rounds.
    """
    k = len(targets)
    p = [F.get("posteriors", F.lit(j)) for j in range(k)]
    n = F.col("n_tokens").cast("double")
    scale = [1 / max(t, 1.0) for t in targets]
    gram = table.agg(*[F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    g = [[gram[f"g{i}_{j}"] for j in range(k)] for i in range(k)]
    out: list[list[float]] = []
    for _ in range(steps):
        r = rate_after(out, k)
        now = table.select(r.alias("r"), n.alias("n"), *[p[j].alias(f"p{j}") for j in range(k)]).agg(
            *[F.coalesce(F.sum(F.col("r") * F.col("n") * F.col(f"p{j}")), F.lit(0.0)).alias(f"t{j}") for j in range(k)]).first()
        residual = [now[f"t{j}"] - targets[j] for j in range(k)]
        if max(abs(x) * s for x, s in zip(residual, scale)) <= tolerance:
            break
        out.append([x / max(1e-9, sum(g[j])) for j, x in enumerate(residual)])
    return out


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, growth: float = 1.0, steps: int = 60, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_tokens, posteriors and rate, and the domains' names in the order of the posteriors.

    ``weights``: share of tokens of each domain (missing domains 0; scaled to sum 1). ``growth``: tokens of the mixture over those of
    ``docs``. Texts without words have the priors and no weight in the fit. Null texts are
    empty; a null id is never labelled; repeated rows count each; an empty table gives an empty result;
    other columns stay (the text only ``with_text``), clashing ones are replaced. The scored rows are written once and read for each step.
    """
    weights = TARGETS if weights is None else weights
    model = fit_domains(docs, labelled, doc_id=doc_id, text=text)
    domains = model.domains
    plain = docs.drop("n_tokens", "posteriors", "rate")
    path = shared_path(docs.sparkSession, "mix")
    scored = with_posteriors(plain, model, text)
    scored = scored if with_text else scored.drop(text)
    scored.write.parquet(path)
    table = docs.sparkSession.read.schema(scored.schema).parquet(path)
    tokens = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    whole = sum(weights.get(d, 0.0) for d in domains) or 1.0
    targets = [growth * tokens * weights.get(d, 0.0) / whole for d in domains]
    found = fit_rates(table.select("n_tokens", "posteriors"), targets, steps) if tokens else []
    return table.withColumn("rate", rate_after(found, len(domains))), domains


def sample_mixture(mixed: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """Rows as often as their rates say: the whole part, and one more with the fraction's probability,
    drawn by a hash of (id, text), so the same rows on any layout."""
    draw = unit_hash(F.col(doc_id).cast("string"), F.col(text), F.lit(seed))
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return mixed.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")
