"""PII replaced by keyed surrogates of the same type.

(1) Detected entities become distinct (kind, norm) rows; ``norm`` is what mentions of one entity share (digits of a phone
number, a lower-case address, a name without its title). (2) A surrogate norm is drawn from a keyed hash of (kind, norm, attempt).
Entities whose surrogate another entity has too, or that some real entity has as its norm, try again; all but the smallest
norm of a clash move on, until none is left. (3) Each mention is written in its own format: separators, case, digit
groups, title and script stay. So one entity has one surrogate everywhere, and two entities never share one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, row_key

#: Titles that tell a gender, and given names by script and gender. Surrogates are drawn from the names.
TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Г-н": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Г-жа": "f", "Dr": "", "Prof": ""}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Bianca Clara Diana Elena Frida Greta Hanna Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Кирилл Максим Николай Олег Павел".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Мария Наталья Ольга Полина".split(),
}
SYLLABLES = {"latin": "ba den fo gar hel ko lin mar nov or pel ros sen tal ver win zan dor mil kes".split(), "cyrillic": "ба ден фо гар хел ко лин мар нов ор пел рос сен тал вер вин зан дор мил кес".split()}
GENDER = {name.casefold(): g for (_, g), names in GIVEN.items() for name in names}
#: Words in lower case that stand inside names and stay.
PARTICLES = frozenset("van von der den de del della di da dos du la le el al bin ibn ter ten zu zur af av".split())

TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ")"
CAPITAL = "[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Lu", "Lt")) + "]"
LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
#: A part of a name: initials, or a capital and letters with inner capitals, hyphens and apostrophes (a closing 's is none of it).
PART = rf"(?!{TITLE}(?!{LETTER}))(?:{CAPITAL}\.(?:-?{CAPITAL}\.)*|(?:[dl]['’])?{CAPITAL}{LETTER}*(?:['’\-](?!s(?!{LETTER})){LETTER}+)*)"
SMALL = "(?:" + "|".join(sorted(PARTICLES)) + rf")(?!{LETTER})"
LED = rf"(?:{SMALL}[ \u00a0]+){{0,3}}{PART}"
TOKEN = re.compile(rf"(?<!\w)(?:{SMALL}|{PART})")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "key": r"AKIA[0-9A-Z]{16}",
    "secret": r"(?<![A-Za-z])(?i:token|password|passwd|secret|api_key|apikey)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{8,}",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)",
    "name": rf"(?<!\w)(?:{TITLE}(?:\.[ \u00a0]*|[ \u00a0]+))+(?P<who>{LED}(?:(?:[ \u00a0]+|(?<=\.)){LED})*)",
}
DETECT = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: A cheap pre-test, from what each pattern can't do without: a digit, an @, or one of these.
MAYBE = re.compile(r"[\d@]|AKIA|(?i:token|password|passwd|secret|api_?key)\s*[=:]|" + TITLE + r"[. \u00a0]")
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def parts_of(name: str) -> list[str]:
    """The parts of a name without their case."""
    return [unicodedata.normalize("NFC", m[0]).casefold().replace("’", "'") for m in TOKEN.finditer(name)]


def mentions(text: str | None) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, norm, mention) of each entity, in order. Of a secret only the value is the entity. A name found
    by its title is also found without, whole or by one of its words."""
    if not text or not MAYBE.search(text):
        return
    found = list(titled(text))
    names = {norm: tuple(norm.split(" ")[1:]) for _, _, kind, norm, _ in found if kind == "name"}
    yield from sorted([*found, *untitled(text, names, found)]) if names else found


def untitled(text: str, names: dict[str, tuple], found: list[tuple]) -> Iterator[tuple[int, int, str, str, str]]:
    """Mentions of ``names`` outside of what is ``found``: the longest at each place; of a word of several names, the one alone, else the first."""
    known: dict[tuple, str] = {}
    for norm, parts in names.items():
        known.setdefault(parts, norm)
    for norm, parts in names.items():
        for part in reversed(parts):
            if part not in PARTICLES and not part.endswith(".") and len(part) > 1:
                known.setdefault((part,), norm)
    longest = max(map(len, known))
    tokens, at = [], 0
    for m in TOKEN.finditer(text):
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        if at == len(found) or m.end() <= found[at][0]:
            tokens.append((m.start(), m.end(), parts_of(m[0])[0]))
    i = 0
    while i < len(tokens):
        n = 1
        while n < longest and i + n < len(tokens) and not text[tokens[i + n - 1][1]:tokens[i + n][0]].strip(" \u00a0"):
            n += 1
        while n and tuple(t[2] for t in tokens[i:i + n]) not in known:
            n -= 1
        if n:
            start, end = tokens[i][0], tokens[i + n - 1][1]
            yield start, end, "name", known[tuple(t[2] for t in tokens[i:i + n])], text[start:end]
        i += max(1, n)


def titled(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    for m in DETECT.finditer(text):
        kind, start, found = m.lastgroup, m.start(), m[0]
        if kind == "secret":
            value = re.search(r"[A-Za-z0-9_\-]+$", found)
            start, found = start + value.start(), value[0]
        elif kind == "name":
            who, parts = m["who"], parts_of(m["who"])
            told = [TITLES[t] for t in re.findall(TITLE, text[m.start():m.start("who")]) if TITLES[t]]
            yield m.start("who"), m.end(), kind, " ".join([told[0] if told else GENDER.get(parts[0], "m"), *parts]), who
            continue
        digits = re.sub(r"\D", "", found)
        if kind == "phone" and not 7 <= len(digits) <= 15:
            continue
        norm = digits if kind in ("card", "ssn", "phone") else found.lower() if kind == "email" else found
        yield start, start + len(found), kind, norm, found


def stream(key: bytes, kind: str, norm: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from blake2b(f"{kind}\0{norm}\0{attempt}\0{block}".encode("utf-8", "replace"), key=key, digest_size=64).digest()
        block += 1


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate norm: as long, of the same character classes, valid where the original is."""
    draw = stream(key, kind, norm, attempt)
    pick = lambda of: of[(next(draw) << 8 | next(draw)) % len(of)]
    if kind == "ip":
        return ".".join(str(int(pick(range(10)))) if len(o) == 1 else str(pick(range(10, 100))) if len(o) == 2 else str(pick(range(100, 256))) for o in norm.split("."))
    if kind in ("card", "phone", "ssn"):
        body = "".join(pick(DIGITS) for _ in norm[1:])
        out = norm[0] + body
        return out[:-1] + luhn_digit(out[:-1]) if kind == "card" and norm[-1] == luhn_digit(norm[:-1]) else out
    if kind == "name":
        gender, *parts = norm.split(" ")
        script = "cyrillic" if re.match("[А-Яа-яЁё]", parts[0]) else "latin"
        words = [i for i, part in enumerate(parts) if part not in PARTICLES and not part.endswith(".")]
        out = []
        for i, part in enumerate(parts):
            if part.endswith("."):
                out.append("".join(pick(GIVEN[script, gender])[0].casefold() if c.isalpha() else c for c in part))
            elif i not in words:
                out.append(part)
            elif i == words[-1]:  # longer after many clashes
                out.append("".join(pick(SYLLABLES[script]) for _ in range(3 + attempt // 5)))
            else:
                out.append(pick([g.casefold() for g in GIVEN[script, gender] if g.casefold() != part]))
        return " ".join([gender, *out])
    if kind == "key":
        return "AKIA" + "".join(pick(UPPER + DIGITS) for _ in norm[4:])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", norm):
        return "".join(pick(HEX) for _ in norm)
    local, at, domain = norm.partition("@")
    swap = lambda s: "".join(pick(LOWER) if c in LOWER else pick(UPPER) if c in UPPER else pick(DIGITS) if c in DIGITS else c for c in s)
    if not at:
        return swap(norm)
    host, _, top = domain.rpartition(".")
    return f"{swap(local)}@{swap(host)}.{top}"


def written(kind: str, mention: str, replacement: str, norm: str = "") -> str:
    """The surrogate norm in the mention's format. A name may be mentioned by some parts of its ``norm``."""
    if kind == "name":
        said, real, new = parts_of(mention), norm.split(" ")[1:], iter(replacement.split(" ")[1:])
        if len(said) < len(real):
            new = iter(replacement.split(" ")[1 + real.index(said[0]):])
        return TOKEN.sub(lambda m: cased(next(new), m[0]), mention)
    if kind in ("card", "phone", "ssn"):
        digits = iter(replacement)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "email":
        return "".join(r.upper() if c.isupper() else r for c, r in zip(mention, replacement)) if len(mention) == len(replacement) else replacement
    return replacement


def cased(part: str, like: str) -> str:
    if like in PARTICLES:
        return part
    return part.upper() if like.isupper() and len(like) > 1 else part.capitalize()


def entity_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, norm): the distinct entities of each document that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, kind, norm) for k, t in zip(b.column(0).to_pylist(), b.column(1)) for kind, norm in sorted({(kind, norm) for _, _, kind, norm, _ in mentions(t.as_py())})]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["key", "kind", "norm"])

    return docs.select(row_key(doc_id, text).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, kind string, norm string")


def resolve(entities: DataFrame, key: bytes, rounds: int = 30) -> DataFrame:
    """(kind, norm, attempt): which draw each entity takes so that no two share a surrogate and none is a real entity."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, norms, tries = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([surrogate(key, k, n, t) for k, n, t in zip(kinds, norms, tries)], pa.string())], names=["kind", "norm", "attempt", "to"])

    now = entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        drawn = cut(now.mapInArrow(draw, "kind string, norm string, attempt int, to string"))
        # a clash is settled between the two norms alone: the least keeps its draw
        held = drawn.groupBy("kind", "to").agg(F.min("norm").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        taken = drawn.select(F.col("kind").alias("tk"), F.col("norm").alias("tn"))
        marked = drawn.join(held.select(F.col("kind").alias("hk"), F.col("to").alias("ht"), "least"), (F.col("kind") == F.col("hk")) & (F.col("to") == F.col("ht")), "left")
        marked = marked.join(taken, (F.col("kind") == F.col("tk")) & (F.col("to") == F.col("tn")), "left")
        again = F.coalesce(F.col("norm") != F.col("least"), F.lit(False)) | F.col("tn").isNotNull()
        now = cut(marked.select("kind", "norm", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")))
        if not now.where("again").limit(1).count():
            return now.drop("again")
        now = now.drop("again")
    raise RuntimeError("surrogates still clash; a kind has about as many entities as its format allows")


def replace_pii(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, n_entities (mentions replaced) and kinds (comma-joined).

    Null texts stay null, with 0 and an empty list; texts without entities are unchanged; repeated rows are rewritten alike; an empty
    table gives no rows; other columns stay and clashing ones are replaced. Only entities that needed another draw are
    joined back to documents, as rows.
    """
    found = cut(entity_table(docs, doc_id, text))
    moved = resolve(found, key).where(F.col("attempt") > 0).select(F.col("kind").alias("k"), F.col("norm").alias("n"), "attempt")
    redrawn = cut(found.join(moved, (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("n"))).groupBy(F.col("key").alias("_k")).agg(
        F.collect_set(F.struct("kind", "norm", "attempt")).alias("_redrawn")))
    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", n_entities int, kinds string"
    none = F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>")
    if redrawn.limit(1).count():
        ready = base.withColumn("_key", row_key(doc_id, text)).join(redrawn, F.col("_key") == F.col("_k"), "left").select(*keep, "_redrawn")
    else:
        ready = base.withColumn("_redrawn", none)
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, redo in zip(b.column(place), b.column(len(keep)).to_pylist()):
                t, tries = t.as_py(), {(r["kind"], r["norm"]): r["attempt"] for r in redo or ()}
                out, at, seen, n = [], 0, set(), 0
                for start, end, kind, norm, mention in mentions(t):
                    who = (kind, norm, tries.get((kind, norm), 0))
                    if who not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[who] = surrogate(key, *who)
                    out += [t[at:start], written(kind, mention, known[who], norm)]
                    at, n = end, n + 1
                    seen.add(kind)
                texts.append("".join([*out, t[at:]]) if out else t)
                counts.append(n)
                kinds.append(",".join(sorted(seen)))
            columns = [pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names=[*keep, "n_entities", "kinds"])

    return ready.mapInArrow(run, schema)
