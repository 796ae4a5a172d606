import random
import re

from pyspark.sql import functions as F

from specloom.functions import extract as E
from specloom.functions import numbers as N
from specloom.functions import scoring as S
from specloom.functions import text as X
from specloom.functions import vocab as V


def test_mojibake_rounds(spark):
    def damage(p):
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in p.encode())
    rows = [(damage(damage("Acid — Specification")), "Acid — Specification"), ("Café société", "Café société"), (damage("naïve – coût"), "naïve – coût"), ("plain text", "plain text"), ("€ only", "€ only")]
    df = spark.createDataFrame(rows, ["bad", "good"]).select(X.repair_mojibake("bad").alias("r"), "good")
    assert all(r.r == r.good for r in df.collect())


def test_ocr_variants(one):
    assert one(X.clean_ocr("t"), t="mater-\nial well-known | ~x") == "material wellknown I x"
    assert one(X.clean_ocr("t", legacy=False), t="mater-\nial well-known") == "material well-known"


def test_script_and_title(one):
    assert one(X.detect_script("t"), t="पीने का पानी") == "hi"
    assert one(X.is_latin("t"), t="पीने का पानी ab") is False
    assert one(X.smart_title("t"), t="PVC PIPES FOR THE WATER") == "PVC Pipes for the Water"
    assert one(X.smart_title("t"), t="Already Mixed") == "Already Mixed"
    assert one(X.plausible_title("t"), t="( Reaffirmed 2002 )") is False
    assert one(X.readable_month("t"), t="2013-05") == "May 2013"
    assert one(X.readable_month("t"), t="2013") == "2013"


def model_canonical(raw):
    m = re.search(r"(?i)\bI\.?\s?S\.?\s*[:\-]?\s*(\d{2,6})\b", raw)
    if not m:
        return None
    part = section = year = None
    for t in re.finditer(r"(?i)(PART|PT|SECTION|SEC)\s*[:.\-]?\s*(\d{1,3})\b|(\d{1,6})\b", raw[m.end():]):
        if t.group(1):
            if t.group(1).upper() in ("PART", "PT"):
                part = int(t.group(2))
            else:
                section = int(t.group(2))
        elif len(t.group(3)) == 4 and 1900 <= int(t.group(3)) <= 2099 and year is None:
            year = int(t.group(3))
        elif part is None:
            part = int(t.group(3))
        elif section is None:
            section = int(t.group(3))
    out = f"IS {int(m.group(1))}"
    if part is not None:
        out += f"-{part}" + (f"-{section}" if section is not None else "")
    return out + (f":{year}" if year is not None else "")


def test_canonical_number_against_model(spark):
    rng = random.Random(7)
    bits = ["IS", "I.S.", " ", ":", "-", "/", "Part", "Pt.", "Sec", "(", ")", "2011", "1987", "3", "12", "10322", "456", "x"]
    raws = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    got = spark.createDataFrame([(r,) for r in raws], ["r"]).select("r", N.canonical_number("r").alias("c")).collect()
    assert [(r.r, r.c) for r in got] == [(r.r, model_canonical(r.r)) for r in got]


def test_citation_spans_against_re(spark):
    rng = random.Random(3)
    bits = ["IS 456:2000", "IS/IEC 60034-1", "BIS 10322 (Part 5/Sec 3) : 2013", "is 2062", "IS 875 (Part 3)", "é text – ", "\n", "ISO 9001", "IS 12-2011", " and ", "x", "IS 5"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), ["doc", "text"])
    got = sorted((r.doc, r.start, r.end, r.raw) for r in N.extract_citations(df, "doc", "text").collect())
    want = sorted((i, m.start(), m.end(), m.group(0)) for i, t in enumerate(texts) for m in re.finditer(V.CITATION_PATTERN, t))
    assert got == want


def test_citation_fields(spark):
    df = spark.createDataFrame([(1, "IS/IEC 60034-1, IS 10322 (Part 5/Sec 3):2013 and IS 456-2000")], ["doc", "text"])
    rows = [(r.base, r.part, r.section, r.year) for r in N.extract_citations(df, "doc", "text").orderBy("pos").collect()]
    assert rows == [("60034", "1", None, None), ("10322", "5", "3", 2013), ("456", None, None, 2000)]


def test_line_items(spark):
    text = "1. Steel bars\r\n\n  - copper wire\n(a) xy\nplain line"
    rows = N.line_items(spark.createDataFrame([(1, text)], ["doc", "text"]), "doc", "text").collect()
    assert [(r.item, text[r.start:r.end]) for r in rows] == [(x, x) for x in ("Steel bars", "copper wire", "plain line")]


def model_annex(block, own):
    out, base = [], None
    pat = r"(?i)\(\s*Part\s*(?P<p>\d+)[^)]*\)\s*:\s*(?P<py>(?:18|19|20)\d{2})|\b(?P<d>\d{3,5})\s*:\s*(?P<dy>(?:18|19|20)\d{2})\b|\b(?P<b>\d{3,5})\b"
    pat = pat.replace(r"\d{2})\b|\b(?P<b>", r"\d{2})|\b(?P<b>")
    for m in re.finditer(pat, block):
        if m["p"]:
            ref = (base, m["p"], int(m["py"])) if base else None
        elif m["d"]:
            ref, base = (m["d"], None, int(m["dy"])), None
        else:
            ref, base = None, m["b"]
        if ref and ref[0] != own and ref not in out:
            out.append(ref)
    return out


def test_annex_references_against_model(spark):
    rng = random.Random(11)
    bits = ["3025", "15302 : 2002", "(Part 1) : 1987", "(Part 22 sec 1) : 1999", "Title of it", "100", "100 : 1990", "1622 : 1981"]
    blocks = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(200)]
    rows = [(i, "x LIST OF REFERRED INDIAN STANDARDS " + b + " ANNEX B 777 : 1999") for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, ["i", "t"]).select("i", E.annex_references("t", F.lit("100")).alias("r"))
    for r in df.collect():
        assert [tuple(x) for x in r.r] == model_annex(blocks[r.i], "100")


def test_scores(one):
    assert one(S.recency("d", 2024), d="2019-05-01") == 0.5
    assert one(S.recency("d", 2024), d="soon") == 0.5
    assert one(S.recency("d", 2024), d="2030") == 1.0
    assert one(S.keyword_overlap("q", F.array(F.lit("copper wire"), F.lit("pvc"))), q="Wire of copper") == 0.25
    assert one(S.category_match("q", F.lit("Cement & Building Materials")), q="portland cement pipe") > 0.7
    assert one(S.category_match("q", F.lit("none such")), q="pipe") == 0.5
    assert one(S.certification_status(F.lit(None), F.lit(None), F.lit(None))) == "unknown"
    assert one(S.confidence_band("s", F.lit("low")), s=0.9) == "medium"


def test_pluggable_models(spark):
    from specloom.functions.encode import encoder_udf, pair_scorer_udf
    df = spark.createDataFrame([("ab", "abc"), (None, "x")], ["q", "d"])
    vec = encoder_udf(lambda: lambda texts: [[float(len(x)), 1.0] for x in texts])
    score = pair_scorer_udf(lambda: lambda qs, ds: [float(len(q) + len(d)) for q, d in zip(qs, ds)])
    rows = df.select(vec("q").alias("v"), score("q", "d").alias("s")).collect()
    assert [(r.v, r.s) for r in rows] == [([2.0, 1.0], 5.0), ([0.0, 1.0], 1.0)]
