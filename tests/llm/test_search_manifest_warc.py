"""Lexical search, the Merkle manifest and the WARC archive against brute force, with odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import lexical, merkle, warc

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rank string, tree string, i long, digest string, record string, item string"
WORDS = "the of Straße ÉCOLE 12 x9 norm steel pipe water A-b c_d 漢字 naïve".split()


def odd_rows(n: int = 90) -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(d, " ".join(rng.choice(WORDS, rng.integers(1, 40))), ["en", "de", None, "a", "", "é"][min(5, int(rng.exponential(0.8)))], f"s{d % 3}", int(d % 11), "r", "t", 1, "d", "x", "y") for d in range(n)]
    same = (1000, "water pipe", "en", "s", 5, "r", "t", 1, "d", "x", "y")
    odd = [same, same, same, (1000, "water pipe pipe", "en", "s", 5, *same[5:]), (1001, None, None, None, None, *same[5:]), (1002, "", "", "", 0, *same[5:]), (None, "water", "en", "s", 1, *same[5:]),
           (None, None, None, None, None, *same[5:]), (1003, "!!! ... \x00", "de", "s", 2 ** 63 - 1, *same[5:]), (1004, "pipe " * 30_000, "xx", "s", 3, *same[5:]), (2 ** 62, "steel", "en", "s", 3, *same[5:])]
    return rows + odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k):
    counted = [(d, Counter(brute_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        asked, scores = Counter(brute_terms(text)), []
        for d, c, size in counted:
            m = 25 + 75 * size * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        for rank, (s, d) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if d == math.inf else d, -s] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"vocabulary": 5, "tile_items": 2, "tile_terms": 3, "block": 7}])
def test_lexical_search_equals_brute_force(spark, docs, empty, options):
    items = [(1, "steel water pipe pipe"), (2, None), (3, ""), (4, "NAÏVE naïve École 漢字"), (4, "norm"), (None, "x9 12 unknownword"), (5, "pipe " * 400 + "the of"), (6, " ".join(WORDS)), (7, "water")]
    asked = spark.createDataFrame([(*x, "r") for x in items], "item_id long, text string, doc_id string").repartition(3)
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = lexical.rank_documents(docs, asked, k=6, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_ranking(given, items, 6)
    assert lexical.rank_documents(empty, asked, **options).collect() == []
    assert lexical.rank_documents(docs, asked.limit(0), **options).collect() == []


def test_tiles_split_weights_at_the_bound():
    weights = {0: {0: 25, 3: 4, 7: 9}, 1: {3: 10, 5: 1}, 2: {9: 0}}
    tiles = lexical.item_tiles(weights, tile_items=2, tile_terms=10, bound=10)
    summed = Counter()
    for group in tiles:
        for tile in group:
            assert (tile.weights.sum(1) <= 10).all()
            for row, item in enumerate(tile.items.tolist()):
                for c, i in enumerate(tile.columns.tolist()):
                    summed[item, i] += int(tile.weights[row, c])
    assert {k: v for k, v in summed.items() if v} == {(item, i): w for item, part in weights.items() for i, w in part.items() if w}
    assert lexical.BOUND * lexical.TOP_IMPACT < 2 ** 53
    scores = np.array([5, 9, 9, 9, 0, 9])
    assert [x.tolist() for x in lexical.best(scores, np.array([1, 8, 4, 6, 2, 3]), 2)] == [[9, 9], [3, 4]]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((i % 2, level[j] if j < len(level) else ""))
        i //= 2
    return out


def brute_manifest(rows):
    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    trees = {}
    for d, text, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        changed = n + 1 if hit and n is not None else n
        trees.setdefault(lang, []).append((d, leaf((d, source, lang, n, text)), leaf((d, source, lang, changed, text))))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[name] = brute_tree([x[1] for x in trees[name]])
    upper = brute_tree([built[n][-1][0] for n in names])
    root, out = upper[-1][0], Counter()
    for u, name in enumerate(names):
        for i, (d, first, claimed) in enumerate(trees[name]):
            steps = way(built[name], i) + way(upper, u)
            at = claimed
            for right, beside in steps:
                at = sha(beside, at) if right else sha(at, beside)
            out[d, first, built[name][-1][0], root, sha(*[s for _, s in steps]), at, at == root] += 1
    return out


@pytest.mark.parametrize("band", [4, 1, 3])
def test_manifest_equals_brute_force(docs, empty, band):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect() if r["n_chars"] != 2 ** 63 - 1]
    given = docs.where("n_chars is null or n_chars < 9223372036854775807")
    got = merkle.verified_manifest(given, claimed=merkle.changed_leaf(merkle.FIELDS), band=band).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(rows)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)
    assert merkle.verified_manifest(empty, band=band).collect() == []


def test_manifest_of_one_row_and_of_wider_runs(spark, docs):
    one = docs.where("doc_id = 1004")
    row = merkle.verified_manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == sha()
    assert merkle.verified_manifest(docs).where("not verified").count() == 0
    wide = merkle.verified_manifest(docs, arity=3, band=2).collect()
    assert len(wide) == docs.count() and all(r["verified"] for r in wide)


def test_nodes_are_nested_intervals(docs):
    _, nodes = merkle.manifest(docs)
    rows = nodes.collect()
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r["tree"], []).append(r)
    for tree in by_tree.values():
        labels = {(r["level"], r["lo"], r["hi"]) for r in tree}
        assert len(labels) == len(tree)
        roots = [r for r in tree if r["up_lo"] is None]
        assert len(roots) == 1 and roots[0]["lo"] == 0
        for r in tree:
            if r["up_lo"] is not None:
                assert (r["level"] + 1, r["up_lo"], r["up_hi"]) in labels and r["up_lo"] <= r["lo"] < r["hi"] <= r["up_hi"]


PAGES = "page_id long, url string, html string, record string, digest string, size long, body string"


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>{i % 20}</p>\r\n\r\nWARC/1.1\r\n{'é' * (i % 7)}") for i in range(60)]
    big = "".join(f"<div>{i} 漢字</div>\r\n" for i in range(9000))
    rows += [(100, "http://a b\n\x7f", None), (101, None, ""), (102, "u", big), (103, "u", big), (104, "u", big + "!"), (105, "u", "a" * 2000), (106, "u", "b" * 2001), (None, "u", "<p>3</p>"), (None, None, "alone"),
             (107, "u", "twice"), (107, "v", "twice"), (107, "u", "twice"), (-5, "u", "minus"), (108, "u", "<p>\x00\r\n")]
    return rows


def brute_pages(rows, least):
    full = [(p, (h or "").encode()) for p, _, h in rows]
    out, used = Counter(), set()
    top = {}
    for p, h in full:
        if len(h) >= least:
            top[h] = max(top.get(h, -math.inf), -math.inf if p is None else p)
    for p, h in full:
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        first = len(h) < least or (top[h] == (-math.inf if p is None else p) and h not in used)
        if first and len(h) >= least:
            used.add(h)
        refers = None if first or top[h] == -math.inf else int(top[h])
        out[p, len(h), digest, "response" if first else "revisit", refers] += 1
    return out


@pytest.mark.parametrize("least,chunk", [(0, 1000), (0, 256 << 10), (12, 1000)])
def test_archive_round_trip(spark, least, chunk):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "r", "d", 1, "b") for r in rows], PAGES).repartition(4)
    got = warc.round_trip(pages, least=least, chunk_bytes=chunk)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == brute_pages(rows, least)
    assert warc.round_trip(pages.limit(0)).collect() == []


def parse_stream(data):
    """A plain WARC reader: (headers, block) of each record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, data[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4
        assert data[at - 4:at] == b"\r\n\r\n"


def test_parts_are_warc_streams_and_damage_is_found(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "r", "d", 1, "b") for r in rows], PAGES)
    path = str(tmp_path / "a")
    warc.write_archive(pages, path, chunk_bytes=1000)
    table = spark.read.parquet(path)
    assert table.agg(F.max(F.length("data"))).first()[0] < 2000
    seen = []
    for (part,) in table.select("part").distinct().collect():
        for fields, block in parse_stream(b"".join(warc.export_part(spark, path, part))):
            seen.append(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "response":
                body = block.partition(b"\r\n\r\n")[2]
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert fields["WARC-Refers-To"] and block == b""
    assert len(seen) == len(set(seen)) == len(rows)
    long = F.col("record").startswith("urn:page:104:")
    for damaged in (table.where(~(long & (F.col("chunk") == 3))), table.where(~(long & F.col("last"))), table.where(~(long & (F.col("chunk") == 0))),
                    table.withColumn("data", F.when(long & (F.col("chunk") == 5), F.reverse(F.hex("data")).cast("binary")).otherwise(F.col("data")))):
        with pytest.raises(Exception, match="missing|stands where|digest|does not end"):
            warc.read_records(damaged).collect()
