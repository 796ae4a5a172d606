"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions import vocab as V


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def found(col, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL instead of an empty string when nothing matched."""
    return F.nullif(F.regexp_extract(_col(col), pattern, group), F.lit(""))


def tokens(col, variant: str = "alnum") -> Column:
    """Token array: ``alnum``, ``stop`` (alnum without stop words) or ``hyphen``."""
    low = F.lower(_col(col))
    if variant == "hyphen":
        return F.regexp_extract_all(low, F.lit(r"(?U)\b([a-z0-9\-]+)\b"), F.lit(1))
    base = F.regexp_extract_all(low, F.lit(r"([a-zA-Z0-9]+)"), F.lit(1))
    if variant == "alnum":
        return base
    if variant == "stop":
        return F.filter(base, lambda t: ~t.isin(V.STOPWORDS))
    raise ValueError(f"unknown tokeniser {variant}")


def clean_ws(col) -> Column:
    """Form feeds and whitespace runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(col), r"\s+", " "))


def clean_lines(col) -> Column:
    """Whitespace clean-up that keeps the line structure."""
    c = F.regexp_replace(_col(col), r"\r\n|\r", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_ocr(col, legacy: bool = True) -> Column:
    """Scanner damage: rejoin words broken over lines, drop ``~``, ``|`` is I.

    ``legacy`` also removes every hyphen inside a word, which is what stored corpora were built
    with; without it only broken lines are joined.
    """
    c = F.regexp_replace(_col(col), r"(\w)-\s*\n\s*(\w)", "$1$2")
    if legacy:
        c = F.regexp_replace(c, r"(\w)-(\w{2,})", "$1$2")
    c = F.regexp_replace(c, r"\r\n|\r", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.translate(c, "|~�", "I")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# Windows-1252 code points above U+00FF and the byte each one stands for
_CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_DAMAGE = r"Ã|â€|Â|\x{fffd}"


def repair_mojibake(col, rounds: int = 3) -> Column:
    """Undo UTF-8 read as Windows-1252; a round is kept only if it leaves fewer damage markers."""
    current = _col(col)
    source, target = "".join(_CP1252), "".join(_CP1252.values())
    for _ in range(rounds):
        narrow = F.translate(current, source, target)
        one_byte = F.when(~narrow.rlike(r"[^\x{0000}-\x{00ff}]"), narrow)
        redecoded = F.try_validate_utf8(F.encode(one_byte, "ISO-8859-1").cast("string"))
        better = F.regexp_count(redecoded, F.lit(_DAMAGE)) < F.regexp_count(current, F.lit(_DAMAGE))
        current = F.when(F.coalesce(better, F.lit(False)), redecoded).otherwise(current)
    return current


def smart_title(col) -> Column:
    """Title case for all-capital titles; acronyms stay upper, connectives lower."""
    c = _col(col)

    def cased(word: Column, i: Column) -> Column:
        core = F.regexp_replace(word, "[^A-Za-z]", "")
        return (
            F.when(F.upper(core).isin(V.ACRONYMS), F.upper(word))
            .when((i > 0) & F.lower(core).isin(V.LOWERCASE_WORDS), F.lower(word))
            .otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2)))))
        )

    recased = F.array_join(F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), cased), " ")
    all_upper = (c == F.upper(c)) & c.rlike("[A-Z]")
    return F.when(all_upper, recased).otherwise(c)


def clean_title(col) -> Column:
    """Drop an edition year left in front of a title."""
    return F.trim(F.regexp_replace(_col(col), r"^\s*(?:18|19|20)\d{2}\s*[:\-]\s*", ""))


def archive_title(col) -> Column:
    """Drop a leading number and the bilingual marker from a catalogue title."""
    c = F.trim(F.regexp_replace(_col(col), r"^IS\s*[\d.\-]+\s*:\s*", ""))
    c = F.trim(F.regexp_replace(c, r"(?i)\(\s*Bi-?Lingual\s*\)", ""))
    return F.regexp_replace(c, r"\s{2,}", " ")


def plausible_title(col) -> Column:
    c = _col(col)
    return (
        (F.length(c) >= 8)
        & ~F.ltrim(c).rlike(r"^[(~\-\[]")
        & (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 2)
        & ~c.rlike(r"(?i)^\(?\s*Reaffirmed[^)]*\)?$")
    )


def usable_text(col, min_chars: int = 60, max_noise: float = 0.05) -> Column:
    """Long enough, and under five percent of characters outside printable ASCII."""
    c = _col(col)
    noise = F.regexp_count(c, F.lit(r"[^\x20-\x7E]"))
    return (F.length(c) >= min_chars) & (noise / F.greatest(F.length(c), F.lit(1)) < max_noise)


def tidy_scope(col) -> Column:
    """Cut a scope that ran into the next clause, then leading clause numbers."""
    c = F.split(_col(col), r"(?i)\s+\d+\s+(?:REFERENCES?|TERMINOLOGY|DEFINITIONS?|NORMATIVE|GENERAL|REQUIREMENTS?)\b", 2)[0]
    c = F.split(c, r"\s+[*f†]\s*(?=[A-Z])", 2)[0]
    return F.trim(F.regexp_replace(c, r"^[.\s]*\d+(\.\d+)*\s*", ""))


def keywords(title, scope, n: int = 10) -> Column:
    text = F.lower(F.concat(_col(title), F.lit(" "), F.substring(_col(scope), 1, 300)))
    found_words = F.regexp_extract_all(text, F.lit(r"([a-zA-Z][a-zA-Z-]{3,})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found_words, lambda w: ~w.isin(V.KEYWORD_STOP))), 1, n)


def query_from_title(col, key, templates=None, max_words: int = 9) -> Column:
    """A request someone might type for a title; empty when too little is left.

    The template is picked by the hash of ``key`` so the draw is repeatable.
    """
    templates = templates or V.QUERY_TEMPLATES
    c = F.regexp_replace(_col(col), V.TITLE_NOISE, " ")
    c = F.regexp_replace(c, r"[-—:,()]+", " ")
    ws = F.slice(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), 1, max_words)
    edge = "|".join(V.QUERY_EDGE_WORDS)
    core = F.lower(F.array_join(ws, " "))
    core = F.regexp_replace(core, rf"^(?:(?:{edge})(?: |$))+", "")
    core = F.regexp_replace(core, rf"(?:(?:^| )(?:{edge}))+$", "")
    core = F.trim(core)
    pick = F.pmod(F.xxhash64(_col(key)), F.lit(len(templates)))
    made = F.lit(None).cast("string")
    for i, template in enumerate(templates):
        before, after = template.split("{}")
        made = F.when(pick == i, F.concat(F.lit(before), core, F.lit(after))).otherwise(made)
    enough = (F.length(core) >= 8) & (F.size(F.split(core, " ")) >= 2)
    return F.when(enough, made).otherwise(F.lit(""))


def detect_script(col) -> Column:
    c = _col(col)
    out = F.lit("en")
    for name, lo, hi in reversed(V.SCRIPTS):
        out = F.when(c.rlike(f"[{lo}-{hi}]"), F.lit(name)).otherwise(out)
    return out


def is_latin(col) -> Column:
    c = _col(col)
    latin = F.regexp_count(c, F.lit("[A-Za-z]"))
    return latin >= F.greatest(F.lit(3.0), F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]")) * 0.5)


def has_marking(col) -> Column:
    # bound once: spelled out in every branch of the or, the text would be built and lowered once a phrase
    return F.exists(F.array(F.lower(_col(col))), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in V.MARKING_PHRASES]))


def evidence_terms(col, traceable) -> Column:
    """Evidence wording in a text whose certification data is not traceable, sorted and distinct."""
    hits = F.regexp_extract_all(F.lower(_col(col)), F.lit(V.EVIDENCE_PATTERN), F.lit(0))
    empty = F.array().cast("array<string>")
    return F.when(_col(traceable), empty).otherwise(F.array_sort(F.array_distinct(hits)))


def spec_section(col, limit: int = 4000) -> Column:
    """Struct(heading, section): text under the first recognised heading, in order of preference."""
    c = _col(col)
    low = F.lower(c)
    start = F.lit(None).cast("int")
    for pattern in reversed(V.SPEC_HEADINGS):
        start = F.when(low.rlike(pattern), F.length(F.split(low, pattern, 2)[0]) + 1).otherwise(start)
    rest = c.substr(start, F.lit(limit))
    tail = rest.substr(F.lit(201), F.lit(limit))
    kept = F.split(tail, r"\n\s*(?:\d+\.\s+[A-Z]|[A-Z][A-Z\s]{12,}\n)", 2)[0]
    section = F.concat(rest.substr(F.lit(1), F.lit(200)), kept)
    heading = F.trim(F.split(c.substr(start, F.lit(80)), "\n")[0])
    return F.struct(heading.alias("heading"), section.alias("section"))


def spec_units(col) -> Column:
    """Paragraphs that describe goods; without any, prose that is not boilerplate; else the text."""
    section = spec_section(col)["section"]
    source = F.coalesce(section, _col(col))
    lines = F.transform(F.split(source, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")))
    units = F.transform(F.split(F.array_join(lines, "\n"), r"\n{2,}"), lambda u: F.trim(F.translate(u, "\n", " ")))
    units = F.filter(units, lambda u: u != "")
    plain = F.filter(units, lambda u: ~u.rlike(V.UNIT_BOILERPLATE))
    technical = F.filter(
        plain, lambda u: (F.length(u) > 12) & (u.rlike(V.TECHNICAL_HINT) | u.rlike(V.LINE_ITEM_PATTERN))
    )
    prose = F.filter(plain, lambda u: F.length(u) > 25)
    return F.when(F.size(technical) > 0, technical).when(F.size(prose) > 0, prose).otherwise(F.array(source))


def classify(text, rules=None) -> Column:
    """First sector rule whose pattern occurs in the text, else NULL."""
    low = F.lower(_col(text))
    out = F.lit(None).cast("string")
    for sector, pattern in reversed(rules or V.SECTOR_RULES):
        out = F.when(low.rlike("(?i)" + pattern), F.lit(sector)).otherwise(out)
    return out


def readable_month(col) -> Column:
    """'2013-05' reads 'May 2013'; other text is unchanged."""
    c = _col(col)
    month = F.element_at(words(V.MONTHS), F.regexp_extract(c, r"^[^-]*-(\d{2})$", 1).try_cast("int"))
    known = c.rlike(r"^[^-]*-(?:0[1-9]|1[0-2])$")
    return F.when(known, F.concat(month, F.lit(" "), F.split(c, "-")[0])).otherwise(c)


def content_hash(*cols: str) -> Column:
    """First 16 hex digits of the SHA-256 of the fields as JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256), 1, 16)


def json_list(col) -> Column:
    return F.from_json(_col(col), "array<string>")
