"""Standard numbers and citations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import vocab as V
from specloom.functions.text import _col, found


def normalize_number(col, variant: str = "colon") -> Column:
    """``colon``: one spelling per edition; ``upper``: the same in capitals; ``sep``: any separator
    before a four-digit year becomes a colon."""
    c = _col(col)
    if variant == "sep":
        c = F.regexp_replace(F.upper(F.trim(c)), r"[/:\-]\s*(\d{4})", ":$1")
        c = F.regexp_replace(c, r"^IS\s*", "IS ")
        return F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.regexp_replace(c, r"(?i)\(\s*part\s*", "(Part ")
    c = F.regexp_replace(c, r"\s*\)", ")")
    c = F.regexp_replace(c, r"\s*:\s*", ":")
    return F.upper(c) if variant == "upper" else c


_PREFIX = r"(?i)\bI\.?\s?S\.?\s*[:\-]?\s*(\d{2,6})\b"
_TOKEN = r"(?i)(?:PART|PT|SECTION|SEC)\s*[:.\-]?\s*\d{1,3}\b|\d{1,6}\b"


def canonical_number(col) -> Column:
    """``IS base[-part[-section]][:year]`` from free text, NULL when there is no number.

    Tagged numbers fill their own slot; untagged ones fill year (1900-2099, four digits), part and
    section in that order, and any further number is ignored.
    """
    c = _col(col)
    base = F.regexp_extract(c, _PREFIX, 1).try_cast("int")
    rest = F.coalesce(F.get(F.split(c, _PREFIX, 2), F.lit(1)), F.lit(""))
    tags = F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0))
    empty = F.lit(None).cast("int")
    start = F.struct(empty.alias("part"), empty.alias("section"), empty.alias("year"))

    def step(state: Column, token: Column) -> Column:
        digits = F.regexp_extract(token, r"(\d+)$", 1)
        n = digits.cast("int")
        is_part = token.rlike(r"(?i)^(?:PART|PT)")
        is_section = token.rlike(r"(?i)^SEC")
        bare = ~is_part & ~is_section
        year = bare & (F.length(digits) == 4) & n.between(1900, 2099) & state["year"].isNull()
        part = is_part | (bare & ~year & state["part"].isNull())
        section = is_section | (bare & ~year & ~part & state["section"].isNull())
        return F.struct(
            F.when(part, n).otherwise(state["part"]).alias("part"),
            F.when(section, n).otherwise(state["section"]).alias("section"),
            F.when(year, n).otherwise(state["year"]).alias("year"))

    s = F.aggregate(tags, start, step)
    part = F.when(s["part"].isNotNull(), F.concat(F.lit("-"), s["part"])).otherwise("")
    section = F.when(s["part"].isNotNull() & s["section"].isNotNull(), F.concat(F.lit("-"), s["section"])).otherwise("")
    year = F.when(s["year"].isNotNull(), F.concat(F.lit(":"), s["year"])).otherwise("")
    return F.when(base.isNotNull(), F.concat(F.lit("IS "), base, part, section, year))


def parse_number(col) -> Column:
    """Struct(base, part, section) of a stored number; a trailing ``-N`` of one or two digits is a part."""
    c = _col(col)
    part = F.coalesce(found(c, V.PART_PATTERN), found(c, r"\d{2,5}\s*[-–]\s*(\d{1,2})\b"))
    return F.struct(found(c, r"(\d{2,5})").alias("base"), part.alias("part"), found(c, V.SECTION_PATTERN).alias("section"))


def review_number(col) -> Column:
    """Struct(base, part, year) of a number as review tables print it (``IS 12661 : Part 1 : 1988``)."""
    c = _col(col)
    pattern = (r"(?i)IS(?:/(?:IEC|ISO))?(?:\s+TR)?\s*(\d{2,5})(?:\s*[-–]\s*(\d{1,3}))?(?:\s*:\s*Part\s*(\d+))?"
               r"(?:\s*:\s*((?:18|19|20)\d{2}))?")
    return F.struct(found(c, pattern, 1).alias("base"),
                    F.coalesce(found(c, pattern, 3), found(c, pattern, 2)).alias("part"),
                    found(c, pattern, 4).try_cast("int").alias("year"))


def archive_number(col) -> Column:
    """Struct(base, part, year) of an archive number (``IS 875 (Part 3):1987``)."""
    c = _col(col)
    pattern = r"(?i)IS\s*(?:/\s*(?:IEC|ISO))?\s*(\d{2,5})(?:\s*\(\s*Part\s*(\d+)[^)]*\))?(?:\s*:\s*((?:18|19|20)\d{2}))?"
    return F.struct(found(c, pattern, 1).alias("base"), found(c, pattern, 2).alias("part"),
                    found(c, pattern, 3).try_cast("int").alias("year"))


def family_key(col, mode: str = "parts") -> Column:
    """Family of an edition: ``parts`` gives ``base|part|section``, ``prefix`` the text before the colon."""
    c = _col(col)
    if mode == "prefix":
        return F.upper(F.trim(F.regexp_replace(F.split(c, ":", 2)[0], r"\s+", " ")))
    pattern = r"(?i)^IS(?:/IEC|/ISO)?\s*(\d{2,5})(?:\s*\(\s*Part\s*(\d+)(?:\s*/\s*Sec(?:tion)?\.?\s*(\d+))?[^)]*\))?"
    t = F.trim(c)
    return F.when(t.rlike(pattern), F.concat_ws("|", *[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)]))


def extract_citations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per citation: (key, pos, raw, base, part, section, year, start, end).

    A citation ends after all text between citations up to it and all citations up to and including
    it, so spans follow from the lengths of the matches and of the gaps around them.
    """
    # one pass of the pattern puts a mark around each citation, so the pieces are gap, citation, gap, …; a mark that the text
    # itself holds becomes another control character, of the same length and as foreign to the pattern
    marked = F.regexp_replace(F.replace(F.col(text), F.lit("\x01"), F.lit("\x02")), V.CITATION_PATTERN, "\x01$0\x01")
    pieces = docs.select(key, F.split(marked, "\x01", -1).alias("_pieces"))
    many = F.size("_pieces") > 33
    even = F.sequence(F.lit(0), F.greatest(F.size("_pieces") - 1, F.lit(0)), F.lit(2))
    steps = F.transform(even, lambda i: F.length(F.get("_pieces", i)) + F.coalesce(F.length(F.get("_pieces", i + 1)), F.lit(0)))
    # a few citations are measured from the front; for many there are running sums in two levels, whole blocks of sqrt(n) citations
    # and the rest, so that n citations cost n * sqrt(n) steps
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_pieces") / 2)).cast("int"))
    stepped = pieces.select(key, "_pieces", F.when(many, steps).alias("_steps"), size.alias("_size"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_steps")), F.col("_size"))
    summed = stepped.withColumn("_blocks", F.when(many, F.transform(starts, lambda at: total(F.slice("_steps", at, F.col("_size"))))))
    sized = summed.withColumn("_before", F.when(many, F.transform("_blocks", lambda _, b: total(F.slice("_blocks", F.lit(1), b)))))

    def end(i: Column) -> Column:
        block = F.floor(i / F.col("_size")).cast("int")
        far = F.get("_before", block) + total(F.slice("_steps", block * F.col("_size") + 1, i - block * F.col("_size") + 1))
        return F.when(many, far).otherwise(F.length(F.array_join(F.slice("_pieces", F.lit(1), i * 2 + 2), "")))

    spans = F.transform(F.filter("_pieces", lambda _, i: i % 2 == 1), lambda raw, i: F.struct(raw.alias("raw"), end(i).alias("end")))
    # the outer form keeps the optimizer from repeating the pattern in an inferred filter
    rows = sized.select(key, F.posexplode_outer(spans).alias("pos", "_c")).filter(F.col("pos").isNotNull()).select(
        key, "pos", "_c.raw", (F.col("_c.end") - F.length("_c.raw")).alias("start"), "_c.end")
    tail = F.regexp_extract("raw", V.CITATION_PATTERN, 3)
    rows = rows.withColumn("_tail", tail)
    year = found("_tail", V.YEAR_PATTERN).cast("int")
    marked = found("_tail", V.PART_PATTERN)
    dash = F.when(year.isNull(), found("_tail", r"^\s*[-–]\s*(\d{1,2})\b"))
    return rows.select(
        key, "pos", "raw", F.regexp_extract("raw", V.CITATION_PATTERN, 2).alias("base"),
        F.coalesce(marked, dash).alias("part"), found("_tail", V.SECTION_PATTERN).alias("section"),
        year.alias("year"), "start", "end")


def line_items(docs: DataFrame, key: str, text: str, min_chars: int = 4) -> DataFrame:
    """One row per line item: (key, line, item, start, end); the bullet is left out of text and span."""
    breaks = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    c, pair = F.col(text), F.lit("\r\n")
    # a break is one character wide; only where a pair of them makes one break are the breaks themselves looked at
    seps = F.when(F.contains(c, pair), F.regexp_extract_all(c, F.lit(rf"(\r\n|{breaks})"), F.lit(1)))
    cut = docs.select(key, F.split(F.replace(c, pair, F.lit("\n")), breaks, -1).alias("_lines"), F.coalesce(seps, F.array().cast("array<string>")).alias("_seps"))
    widths = F.zip_with("_lines", "_seps", lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(1)))
    sized = cut.select(key, "_lines", widths.alias("_w"))
    space = F.lit(" \t\n\x0b\f\r")

    def bare(line: Column) -> Column:
        return F.btrim(F.regexp_replace(F.btrim(line, space), V.BULLET_PREFIX, ""), space)

    # the item is made before the rows are, so that no filter on it repeats the pattern
    placed = F.transform("_lines", lambda line, i: F.struct(
        line.alias("raw"), F.aggregate(F.slice("_w", F.lit(1), i), F.lit(0), lambda a, n: a + n).alias("before"), bare(line).alias("item")))
    rows = sized.select(key, F.posexplode_outer(placed).alias("line", "_s")).filter(F.length("_s.item") >= min_chars).select(
        key, "line", "_s.raw", "_s.before", "_s.item")
    start = F.col("before") + F.instr("raw", F.col("item")) - 1
    return rows.select(key, "line", "item", start.alias("start"), (start + F.length("item")).alias("end"))


def item_id_fields(col) -> Column:
    """Struct(number, part, section, year) of an archive id ``gov.in.is.N[.part[.section]].year``; NULL if malformed."""
    c = F.lower(F.trim(_col(col)))
    ok = r"^gov\.in\.is\.(\d+)((?:\.\d+)*)\.((?:18|19|20)\d{2})$"
    middle = F.split(F.regexp_extract(c, ok, 2), r"\.")
    return F.when(c.rlike(ok), F.struct(
        F.regexp_extract(c, ok, 1).alias("number"), F.nullif(F.get(middle, F.lit(1)), F.lit("")).alias("part"),
        F.nullif(F.get(middle, F.lit(2)), F.lit("")).alias("section"), F.regexp_extract(c, ok, 3).cast("int").alias("year")))


def item_id(number, part, section, year) -> Column:
    return F.concat_ws(".", F.lit("gov.in.is"), *[_col(x).cast("string") for x in (number, part, section, year)])


def make_id(*parts) -> Column:
    """``IS_number[_part[_section]][_year]``; missing parts are skipped."""
    return F.concat_ws("_", F.lit("IS"), *[_col(p).cast("string") for p in parts])


def format_citation(number, year, amendments) -> Column:
    """What to paste into a tender: number, edition and the latest amendment (array of struct(no, date))."""
    latest = F.array_max(_col(amendments))
    base = F.concat(_col(number), F.lit(":"), _col(year))
    note = F.concat(F.lit(", incorporating Amendment No. "), latest["no"], F.lit(" ("),
                    F.coalesce(latest["date"], F.lit("n.d.")), F.lit(")"))
    return F.concat(base, F.coalesce(note, F.lit("")))


def counted_citation(number, count, latest_no, latest_date) -> Column:
    """Citation text when the amendment count is known: names the latest one, or only states the count."""
    num, n, no, date = _col(number), _col(count), _col(latest_no), _col(latest_date)
    dated = F.coalesce(F.concat(F.lit(", "), date), F.lit(""))
    single = F.concat(num, F.lit(", incorporating Amendment No. "), no,
                      F.coalesce(F.concat(F.lit(" ("), date, F.lit(")")), F.lit("")))
    many = F.concat(num, F.lit(", incorporating all "), n, F.lit(" amendments, latest (Amendment No. "), no, dated, F.lit(")"))
    bare = F.concat(num, F.lit(", incorporating all "), n, F.when(n == 1, " published amendment").otherwise(" published amendments"))
    return (F.when(n.isNull() | (n == 0), num).when(no.isNull(), bare).when(n == 1, single).otherwise(many))


def normalize_relation(col) -> Column:
    """Upper-case relation name with underscores; NULL when it is not an allowed type."""
    name = F.translate(F.upper(F.trim(_col(col))), " -", "__")
    return F.when(name.isin(V.RELATION_ALLOWED), name)
