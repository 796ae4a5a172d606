"""Ranking features and status rules as Column expressions. NULL means unknown, never false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions import vocab as V
from specloom.functions.text import _col, words


def recency(col, year: int) -> Column:
    """1 for this year falling to 0 after ten; 0.5 when the date is missing or unreadable."""
    c = F.trim(_col(col))
    amended = F.coalesce(F.year(F.try_to_date(c, "yyyy-MM-dd")), F.substring(c, 1, 4).try_cast("int"))
    elapsed = F.greatest(F.lit(0.0), F.lit(float(year)) - amended)
    return F.when(amended.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1.0 - elapsed / 10.0))


def category_match(query, category, lexicon: dict[str, list[str]] | None = None) -> Column:
    """How well the query's words fit the record's category against the best other category."""
    lexicon = lexicon or V.CATEGORY_LEXICON
    q = F.array_distinct(F.split(F.lower(F.trim(_col(query))), r"\s+"))
    counts = {name: F.size(F.array_intersect(q, words(ws))) for name, ws in lexicon.items()}
    c = _col(category)
    out = F.lit(0.5)
    for name, own in counts.items():
        others = [n for other, n in counts.items() if other != name]
        best = F.greatest(*others) if len(others) > 1 else reduce(lambda a, b: a, others, F.lit(0))
        share = F.least(F.lit(1.0), own / (own + best + 1e-6) * 0.7 + 0.3)
        out = F.when(c == name, F.when(own == 0, F.lit(0.2)).otherwise(share)).otherwise(out)
    return out


def keyword_overlap(query, keywords) -> Column:
    """Share of keywords found in the query; a phrase with 60 % of its words present counts half."""
    q, kws = F.lower(_col(query)), _col(keywords)

    def value(kw: Column) -> Column:
        low = F.lower(kw)
        ws = F.split(F.trim(low), r"\s+")
        present = F.size(F.filter(ws, lambda w: (F.length(w) > 2) & (F.instr(q, w) > 0)))
        partial = (F.size(ws) > 1) & (present >= F.size(ws) * 0.6)
        return F.when(F.instr(q, low) > 0, 1.0).when(partial, 0.5).otherwise(0.0)

    total = F.aggregate(F.transform(kws, value), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(kws), F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total / F.size(kws)))


def fallback_score(dense, bm25, cross) -> Column:
    return _col(dense) * 0.3 + _col(bm25) * 0.2 + _col(cross) * 0.5


def confidence_band(similarity, data_confidence) -> Column:
    """Match strength, capped by the trust in the record's own data."""
    s, trust = _col(similarity), F.coalesce(_col(data_confidence), F.lit("high"))
    band = F.when(s >= 0.55, "high").when(s >= 0.35, "medium").otherwise("low")
    return (F.when((trust == "low") & (band == "high"), "medium").when(trust == "low", "low")
            .when((trust == "medium") & (band == "high"), "medium").otherwise(band))


def verification(source_url, checked_at, as_of) -> Column:
    """Struct(verified, reason): checked within 365 days of ``as_of``, stale, never checked, or no source."""
    at, url = _col(checked_at), _col(source_url)
    fresh = F.date_diff(_col(as_of), at) <= 365
    return F.struct(
        F.coalesce(fresh, F.lit(False)).alias("verified"),
        F.when(fresh, F.lit(None).cast("string")).when(at.isNotNull(), "stale_check")
        .when(F.coalesce(url, F.lit("")) != "", "unchecked_source").otherwise("no_provenance").alias("reason"))


def certification_status(scheme, mandatory, checked) -> Column:
    """mandatory / voluntary where an order is recorded, no_qco_identified where someone looked, else unknown."""
    return (F.when(_col(scheme).isNotNull() & (F.coalesce(_col(mandatory), F.lit(True))), "mandatory")
            .when(_col(scheme).isNotNull(), "voluntary")
            .when(F.coalesce(_col(checked), F.lit(False)), "no_qco_identified").otherwise("unknown"))


def valid_interaction(action, chosen, corrected) -> Column:
    """An accept names what was chosen, a correction what it was corrected to."""
    def present(c):
        return F.coalesce(F.trim(_col(c)) != "", F.lit(False))
    a = _col(action)
    return F.coalesce(F.when(a == "correct", present(corrected)).when(a == "accept", present(chosen))
                      .when(a == "reject", F.lit(True)).otherwise(F.lit(False)), F.lit(False))
