"""Operators on typed reference graphs kept as edge tables (source_id, target_id, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import vocab as V
from specloom.functions.scoring import verification
from specloom.operators.corpus import family_leaders
from specloom.operators.ranking import alone, exact_rank, salted_join, spread_join, tasks_for
from specloom.session import cut_lineage

EdgeTypes = list[tuple[str, str, bool]]


def _names(types: EdgeTypes, *directions: str) -> list[str]:
    return [n for n, d, member in types if member and d in directions]


def orient(edges: DataFrame, types: EdgeTypes = V.EDGE_TYPES) -> DataFrame:
    """(node, next, type, role): every step a walk may take.

    Direction is applied once here: outgoing types from source to target, incoming ones backwards,
    the rest both ways. Known types that are no cluster membership are left out; unknown types are
    walked both ways under the unclassified role. A step may be repeated.
    """
    kind = F.col("type")
    unknown = ~kind.isin([n for n, _, _ in types])
    role = F.when(unknown, V.UNCLASSIFIED).otherwise(kind)
    ahead = edges.filter(kind.isin(_names(types, "outgoing", "either")) | unknown).select(
        F.col("source_id").alias("node"), F.col("target_id").alias("next"), "type", role.alias("role"))
    back = edges.filter(kind.isin(_names(types, "incoming", "either")) | unknown).select(
        F.col("target_id").alias("node"), F.col("source_id").alias("next"), "type", role.alias("role"))
    return ahead.unionByName(back)


def joined(names: Column) -> Column:
    """Names as one string, far smaller than an array: \\x00 stands between them; inside a name it is \\x01a, and \\x01 is \\x01b. NULL is \\x01n."""
    safe = lambda x: F.replace(F.replace(x, F.lit("\x01"), F.lit("\x01b")), F.lit("\x00"), F.lit("\x01a"))
    return F.array_join(F.transform(names, lambda x: F.coalesce(safe(x), F.lit("\x01n"))), "\x00")


def parted(text: Column) -> Column:
    """The names of a ``joined`` string."""
    back = lambda x: F.replace(F.replace(x, F.lit("\x01a"), F.lit("\x00")), F.lit("\x01b"), F.lit("\x01"))
    names = F.split(text, "\x00", -1)
    return F.when(F.contains(text, F.lit("\x01")), F.transform(names, lambda x: F.when(x != "\x01n", back(x)))).otherwise(names)


def neighbour_lists(steps: DataFrame, chunk: int = 1024) -> DataFrame:
    """(node, n, lists): the steps of a node in rows of about ``chunk``; a list is ``joined`` role, type and names. ``steps`` are
    dealt by node, so nothing is shuffled here; the lists are written."""
    sized = steps.join(steps.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_slots")), "node")
    names = sized.filter(F.col("next").isNotNull()).groupBy("node", F.pmod(F.xxhash64("next"), F.col("_slots")).alias("_slot"), "role", "type").agg(
        F.count("next").alias("n"), F.sort_array(F.collect_list("next")).alias("names"))
    return cut_lineage(names.groupBy("node", "_slot").agg(
        F.sum("n").alias("n"), F.collect_list(joined(F.concat(F.array("role", "type"), "names"))).alias("lists")).drop("_slot"))


def dealt(steps: DataFrame) -> DataFrame:
    """``steps`` written and read back by node, in tasks of a fixed number of steps."""
    steps = cut_lineage(steps)
    return steps.repartition(tasks_for(steps.sparkSession, steps.count()), "node")


def candidates(frontier: DataFrame, lists: DataFrame, known: DataFrame | None = None, most: int = 4_000_000) -> list[DataFrame]:
    """The steps from ``frontier(request, path)``'s last nodes as (request, next, path, role, type), and each ``known(request, node)``, if
    given, as ``next`` with an empty path.

    Whole lists go through the shuffle, a row for each node of a request, and are spread out behind it, where all rows of a
    request already share a task. Requests of more than ``most`` candidates are the second frame; their
    candidates are spread out first and dealt by (request, next), so that none fills a task.
    """
    spark = frontier.sparkSession
    ends = frontier.select("request", "path", F.element_at("path", -1).alias("node"))
    weights = cut_lineage(ends.join(lists.select("node", "n"), "node").groupBy("request").agg(F.sum("n").alias("n")))
    n = tasks_for(spark, weights.agg(F.sum("n")).first()[0] or 0)
    large = weights.filter(F.col("n") > most).select("request")
    rows = ends.join(lists, "node").select("request", "path", "lists")
    if known is not None:
        seen = F.array(joined(F.array(F.lit(""), F.lit(""), "node")))
        none = F.array().cast(frontier.schema["path"].dataType)
        rows = rows.unionByName(known.select("request", none.alias("path"), seen.alias("lists")))

    def spread_out(df: DataFrame) -> DataFrame:
        each = df.select("request", "path", F.explode("lists").alias("l")).select("request", "path", parted(F.col("l")).alias("l"))
        return each.select("request", "path", F.get("l", F.lit(0)).alias("role"), F.get("l", F.lit(1)).alias("type"),
                           F.explode(F.slice("l", F.lit(3), F.size("l"))).alias("next"))

    if large.isEmpty():
        return [spread_out(rows.repartition(n, "request"))]
    return [spread_out(rows.join(large, "request", "left_anti").repartition(n, "request")),
            spread_out(rows.join(large, "request", "left_semi")).repartition(n, "request", "next")]


def expand(seeds: DataFrame, steps: DataFrame, hops: int, most: int = 4_000_000) -> DataFrame:
    """Nodes reached from each request's seeds: (request, node, hop, path, role, type).

    ``seeds(request, node)``. Every node appears once per request, at its shortest hop; between
    equally short ways the smallest path wins. Visited nodes have the empty path, so one aggregate per hop
    (``candidates``) both finds the smallest way and leaves out what was reached before. Each hop's result but the
    last is written, so neither lineage nor recomputation grows with the hop count.
    """
    best = dealt(steps.select("node", "next", "role", "type")).groupBy("node", "next").agg(F.min(F.struct("role", "type")).alias("b")).select("node", "next", "b.role", "b.type")
    lists = neighbour_lists(best)
    frontier = seeds.select("request", F.array("node").alias("path"))
    visited = [seeds.select("request", "node")]
    found = []
    for hop in range(1, hops + 1):
        reached = candidates(frontier, lists, reduce(DataFrame.unionByName, visited), most)
        ways = [r.groupBy("request", "next").agg(F.min(F.struct("path", "role", "type")).alias("b")) for r in reached]
        fresh = reduce(DataFrame.unionByName, ways).filter(F.size("b.path") > 0)
        layer = fresh.select("request", F.col("next").alias("node"), F.lit(hop).alias("hop"),
                             F.concat("b.path", F.array("next")).alias("path"), "b.role", "b.type")
        if hop < hops:
            layer = cut_lineage(layer)
        found.append(layer)
        visited.append(layer.select("request", "node"))
        frontier = layer.select("request", "path")
    return reduce(DataFrame.unionByName, found)


def unmapped_types(paths: DataFrame) -> DataFrame:
    return paths.filter(F.col("role") == V.UNCLASSIFIED).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def resolve_chain(std: DataFrame, successors: DataFrame) -> DataFrame:
    """All editions on the way from each record to its current ones: (start, node, hop, state).

    ``std(id, status)``, ``successors(id, successor)``. An active record is its own current edition.
    From the others every named successor is visited once, at its fewest hops; states are ``active`` (an end),
    ``passed`` (followed further) and ``unknown`` (named but not held). Branches and cycles are fine.

    The reach doubles in every round, so a chain of n editions takes about log2(n) + 1 written layers: an edition more than
    ``h`` and at most ``2h`` hops away lies at most ``h`` hops behind one that is exactly ``h`` away, and both ways are
    already known. Only editions at ``h`` hops are extended, so along a chain every pair is formed once.
    """
    status = std.select(F.col("id").alias("node"), "status")
    own = std.filter(F.col("status") == "active").select(
        F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hop"), F.lit("active").alias("state"))
    old = std.filter(F.col("status") != "active").select(F.col("id").alias("start")).distinct()
    state = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "active", "active").otherwise("passed")
    named = successors.select(F.col("id").alias("start"), F.col("successor").alias("node")).distinct().filter(F.col("start") != F.col("node"))
    first = named.join(old, "start", "left_semi").join(status, "node", "left")
    layers, half = [cut_lineage(first.select("start", "node", F.lit(1).alias("hop"), state.alias("state")))], 1
    while True:
        known = reduce(DataFrame.unionByName, layers)
        edge = layers[-1].filter((F.col("hop") == half) & (F.col("state") == "passed")).select("start", F.col("node").alias("middle"))
        behind = known.select(F.col("start").alias("middle"), "node", F.col("hop").alias("more"), "state")
        longer = salted_join(edge, behind.join(edge.select("middle").distinct(), "middle", "left_semi"), ["middle"], "start", 4)
        nearest = longer.filter(F.col("start") != F.col("node")).groupBy("start", "node", "state").agg((F.min("more") + half).alias("hop"))
        layer = cut_lineage(nearest.join(known.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "hop", "state"))
        if layer.isEmpty():
            return own.unionByName(known)
        layers.append(layer)
        half *= 2


def first_active(chain: DataFrame) -> DataFrame:
    """(id, current): the nearest active edition of every record that has one."""
    nearest = F.min(F.struct("hop", "node"))
    return chain.filter(F.col("state") == "active").groupBy(F.col("start").alias("id")).agg(nearest.alias("m")).select(
        "id", F.col("m.node").alias("current"))


def supersession(std: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop of supersession per record: (id, successor, n_successors, n_predecessors)."""
    e = edges.filter(F.col("type") == "SUPERSEDED_BY")
    ahead = e.groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("successor"), F.count(F.lit(1)).alias("n_successors"))
    back = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_predecessors"))
    return std.select("id").join(ahead, "id", "left").join(back, "id", "left").fillna(0, ["n_successors", "n_predecessors"])


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, type, direction): each edge seen from its source (forward) and its target (inverse), in one pass."""
    ahead = F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "type", F.lit("forward").alias("direction"))
    back = F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "type", F.lit("inverse").alias("direction"))
    return edges.select(F.explode(F.array(ahead, back)).alias("w")).select("w.*")


def grouped_allied(edges: DataFrame, std: DataFrame) -> DataFrame:
    """Neighbours of every record with their summary: (id, type, direction, other, number, title, status)."""
    about = std.select(F.col("id").alias("other"), "number", "title", "status")
    return both_ways(edges).join(about, "other")


def allied_counts(edges: DataFrame, std: DataFrame, types: list[str]) -> DataFrame:
    """Neighbours per record and relation type; the named types are present even when empty."""
    counted = grouped_allied(edges, std).groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    named = std.select("id", F.explode(F.array(*[F.lit(x) for x in types])).alias("type")).withColumn("n", F.lit(0))
    return counted.unionByName(named).groupBy("id", "type").agg(F.sum("n").alias("n"))


def group_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges of each source in reading order (relation type order, then target) with their position."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("type")).cast("int"), F.lit(0))
    known = edges.withColumn("type_no", place).filter(F.col("type_no") > 0)
    return exact_rank(known, ["source_id"], ["type_no", "target_id"], "position").drop("type_no")


def related(std: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """(id, part, other, outside_corpus): held dependencies, references outside the corpus, referrers.

    ``references(id, number)`` are numbers read from documents; one that names no forward neighbour is
    kept as outside the corpus. Referrers are listed only for records that are held.
    """
    about = std.select(F.col("id").alias("other"), F.col("number").alias("n"))
    ahead = both_ways(edges).filter("direction = 'forward'").join(about, "other").select(
        "id", F.lit("depends_on").alias("part"), "other", "n").distinct()
    back = both_ways(edges).filter("direction = 'inverse'").join(about, "other").join(std.select("id"), "id", "left_semi").select(
        "id", F.lit("referenced_by").alias("part"), "other").distinct()
    outside = references.select("id", "number").distinct().join(
        ahead.select("id", F.col("n").alias("number")), ["id", "number"], "left_anti").select(
        "id", F.lit("outside_corpus").alias("part"), F.col("number").alias("other"))
    rows = [ahead.drop("n"), back, outside]
    return reduce(DataFrame.unionByName, rows).withColumn("outside_corpus", F.col("part") == "outside_corpus")


def researched(std: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """(id, researched): whether anyone recorded a relation of the record; false is not 'stands alone'."""
    seen = edges.select(F.col("source_id").alias("id")).unionByName(references.select("id")).distinct()
    return std.select("id").join(seen.withColumn("_s", F.lit(True)), "id", "left").select(
        "id", F.coalesce("_s", F.lit(False)).alias("researched"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is not held, and which end: (source_id, target_id, type, missing)."""
    held = nodes.select(F.col("id").alias("_id")).distinct()
    out = [edges.join(held, F.col(side) == F.col("_id"), "left_anti").withColumn("missing", F.lit(side))
           for side in ("source_id", "target_id")]
    return out[0].unionByName(out[1])


def overlap_pairs(edges: DataFrame, members: DataFrame, kind: str = "OVERLAPS_SCOPE_WITH") -> DataFrame:
    """Unordered overlap pairs (a < b) with both ends in ``members(id)``."""
    e = edges.filter(F.col("type") == kind)
    for side in ("source_id", "target_id"):
        e = e.join(members.select(F.col("id").alias(side)), side, "left_semi")
    return e.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def incident_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch a given id, as one equi-join over both directions instead of an OR join, in tasks of a fixed number of edges."""
    plain = cut_lineage(edges.select("source_id", "target_id", "type"))
    n = tasks_for(plain.sparkSession, 2 * plain.count())
    ways = both_ways(plain).withColumn("_salt", F.pmod(F.xxhash64("other"), F.lit(4)).cast("int")).repartition(n, "id", "_salt")
    held = ids.select("id").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(3)))).repartition(n, "id", "_salt")
    return ways.join(held, ["id", "_salt"], "left_semi").drop("_salt")


def rules_for(std: DataFrame, rules: DataFrame) -> DataFrame:
    """Certification rules that name a record's number or its category: (id, rule_id), each pair once.

    The pairs grow with records x rules of a category, so they are not sorted out afterwards: a record and a rule of
    one row each meet at most once, and only the pairs of ids with several rows are made distinct.
    """
    one, more = alone(std.select("id", "number", "category"), ["id"])
    by = F.when(F.col("standard_number").isNull(), F.col("category"))
    one_rule, more_rules = alone(rules.select("rule_id", "standard_number", by.alias("_c")), ["rule_id"])

    def pairs(s: DataFrame, r: DataFrame) -> DataFrame:
        by_number = spread_join(s, r.withColumnRenamed("standard_number", "number").filter(F.col("number").isNotNull()), ["number"], "id")
        by_category = spread_join(s, r.withColumnRenamed("_c", "category").filter(F.col("category").isNotNull()), ["category"], "id")
        return by_number.select("id", "rule_id").unionByName(by_category.select("id", "rule_id"))

    rest = pairs(more, one_rule).unionByName(pairs(one, more_rules)).unionByName(pairs(more, more_rules))
    return pairs(one, one_rule).unionByName(rest.distinct())


def build_edges(references: DataFrame, corpus: DataFrame, curated: DataFrame) -> DataFrame:
    """Normative edges from document references: (source_id, target_id, type, origin), curated ones first.

    ``references(base, part, ref_base, ref_part)``, ``corpus(id, base, part, status, edition_year)``,
    ``curated(source_id, target_id, type)``. Both ends resolve to the active, then newest edition;
    self references and repeats are dropped and curated pairs are not duplicated.
    """
    pick = best_edition(corpus, ["base", "part"])
    src = pick.select(F.col("base").alias("_b"), F.coalesce("part", F.lit("")).alias("_p"), F.col("pick").alias("source_id"))
    dst = pick.select(F.col("base").alias("_rb"), F.coalesce("part", F.lit("")).alias("_rp"), F.col("pick").alias("target_id"))
    refs = references.select(F.col("base").alias("_b"), F.coalesce("part", F.lit("")).alias("_p"), F.col("ref_base").alias("_rb"),
                             F.coalesce("ref_part", F.lit("")).alias("_rp")).distinct()
    made = refs.join(src, ["_b", "_p"]).join(dst, ["_rb", "_rp"]).filter("source_id <> target_id").select("source_id", "target_id").distinct()
    made = made.join(curated.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
    return curated.select("source_id", "target_id", "type").withColumn("origin", F.lit("curated")).unionByName(
        made.select("source_id", "target_id", F.lit("normative_reference").alias("type"), F.lit("extracted_from_annex").alias("origin")))


def best_edition(corpus: DataFrame, by: list[str]) -> DataFrame:
    """(by…, pick): the active edition with the latest year, else the latest of all; ties by id."""
    states = corpus.withColumn("_active", F.coalesce(F.col("status") == "active", F.lit(False)).cast("int"))
    years = states.groupBy(*by, "_active", "edition_year").agg(F.min("id").alias("_id"))
    return years.groupBy(*by).agg(F.max_by("_id", F.struct("_active", F.coalesce("edition_year", F.lit(0)))).alias("pick"))


def import_edges(rows: DataFrame, std: DataFrame, existing: DataFrame, types: EdgeTypes = V.EDGE_TYPES) -> DataFrame:
    """Outcome of each distinct imported edge: inserted, exists, dangling or invalid, and whether its type is mapped."""
    names = [n for n, _, _ in types]
    held = std.select(F.col("id").alias("_id"), F.lit(True).alias("_h")).distinct()
    cols = ["source_id", "target_id", "type"]
    r = rows.select(*cols).distinct()
    r = r.join(held.withColumnsRenamed({"_id": "source_id", "_h": "_s"}), "source_id", "left")
    r = r.join(held.withColumnsRenamed({"_id": "target_id", "_h": "_t"}), "target_id", "left")
    r = r.join(existing.select(*cols).distinct().withColumn("_e", F.lit(True)), cols, "left")
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in cols])
    outcome = (F.when(blank, "invalid").when(F.col("_s").isNull() | F.col("_t").isNull(), "dangling")
               .when(F.col("_e").isNotNull(), "exists").otherwise("inserted"))
    return r.select(*cols, outcome.alias("outcome"), F.col("type").isin(names).alias("mapped"))


def category_of(std: DataFrame, edges: DataFrame, strategy: str = "property") -> DataFrame:
    """(id, category) from the record's own property and its BELONGS_TO edge, in the order of the strategy."""
    linked = edges.filter(F.col("type") == "BELONGS_TO").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("_edge"))
    first, second = ("category", "_edge") if strategy == "property" else ("_edge", "category")
    return std.select("id", "category").join(linked, "id", "left").select("id", F.coalesce(first, second).alias("category"))


def union_amendments(table: DataFrame, graph: DataFrame) -> DataFrame:
    """Amendments of both sources, one per (id, number, date); the table's summary wins."""
    both = table.withColumn("_p", F.lit(0)).unionByName(graph.withColumn("_p", F.lit(1)))
    return both.groupBy("id", "amendment_number", "date_issued").agg(F.min_by("summary", F.struct("_p", "summary")).alias("summary"))


def graph_amendments(edges: DataFrame, std: DataFrame) -> DataFrame:
    """Amendments recorded as AMENDED_BY neighbours that carry a readable date."""
    about = std.select(F.col("id").alias("target_id"), F.col("number").alias("amendment_number"),
                       F.try_to_date("last_amended", "yyyy-MM-dd").alias("date_issued"), F.col("title").alias("summary"))
    return edges.filter(F.col("type") == "AMENDED_BY").join(about, "target_id").filter(F.col("date_issued").isNotNull()).select(
        F.col("source_id").alias("id"), "amendment_number", "date_issued", "summary")


def version_status(std: DataFrame, amendments: DataFrame, as_of: Column) -> DataFrame:
    """Current edition (one hop), state, amendment count and latest date, and how far the data is verified.

    ``std(id, number, status, superseded_by, source_url, checked_at)``.
    """
    numbers = std.select(F.col("id").alias("superseded_by"), F.col("number").alias("_next"))
    counts = amendments.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("date_issued").alias("latest_amendment"))
    v = verification("source_url", "checked_at", as_of)
    return std.join(numbers, "superseded_by", "left").join(counts, "id", "left").select(
        "id", F.coalesce("_next", "number").alias("current_edition"), (F.col("status") == "active").alias("is_current"),
        F.col("_next").alias("superseded_by"), (F.col("status") == "withdrawn").alias("withdrawn"),
        F.coalesce("_n", F.lit(0)).alias("n_amendments"), "latest_amendment", v["verified"].alias("data_verified"),
        v["reason"].alias("verification_reason"))


def amendment_status(std: DataFrame, researched_counts: DataFrame, amendments: DataFrame) -> DataFrame:
    """(id, checked, count, latest_no, latest_date): count stays NULL when nobody has looked."""
    latest = amendments.groupBy("id").agg(F.max(F.struct("no", "date")).alias("_l"))
    r = researched_counts.select("id", "count").withColumn("_c", F.lit(True))
    return std.select("id", "number").join(r, "id", "left").join(latest, "id", "left").select(
        "id", "number", F.coalesce("_c", F.lit(False)).alias("checked"), "count",
        F.when(F.col("_c"), F.col("_l.no")).alias("latest_no"), F.when(F.col("_c"), F.col("_l.date")).alias("latest_date"))


def edge_type_report(edges: DataFrame, types: EdgeTypes = V.EDGE_TYPES) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("mapped", F.col("type").isin([n for n, _, _ in types]))


def ego_nodes(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Undirected neighbourhood of each root: (request, node, hop)."""
    steps = both_ways(edges).select(F.col("id").alias("node"), F.col("other").alias("next"), "type", F.col("type").alias("role"))
    return expand(roots, steps, depth).select("request", "node", "hop").unionByName(roots.select("request", "node", F.lit(0).alias("hop")))


def ego_network(roots: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhood of each root: nodes (request, node, hop) and edges with both ends inside."""
    plain = cut_lineage(edges.select("source_id", "target_id", "type"))
    nodes = cut_lineage(ego_nodes(roots, plain, depth))
    steps = plain.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), "type", F.lit("edge").alias("role"))
    ends = plain.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    own = ends.select("node", F.col("node").alias("next"), F.lit(None).cast("string").alias("type"), F.lit("self").alias("role"))
    lists = neighbour_lists(dealt(steps.unionByName(own)))  # a node's list names the node, so each member brings its own mark
    members = cut_lineage(nodes.select("request", "node").distinct()).select("request", F.array("node").alias("path"))
    inside = F.bool_or(F.col("role") == "self").over(Window.partitionBy("request", "next"))
    met = reduce(DataFrame.unionByName, [c.withColumn("_in", inside) for c in candidates(members, lists)])
    kept = met.filter(F.col("_in") & (F.col("role") == "edge"))
    return nodes, kept.select("request", F.element_at("path", 1).alias("source_id"), F.col("next").alias("target_id"), "type")


def selection_gaps(selection: DataFrame) -> DataFrame:
    """Gaps in each project's selection: (project, rule, severity, code), one row per superseded item.

    ``selection(project, code, title, role, version)``.
    """
    electric = F.concat("code", F.lit(" "), "title").rlike("(?i)cable|conductor|wiring|electr|luminaire|transformer")

    def has(role: str) -> Column:
        return F.coalesce(F.bool_or(F.col("role") == role), F.lit(False)).alias(role)

    flags = selection.groupBy("project").agg(*[has(r) for r in ("primary", "test", "safety", "installation")], F.bool_or(electric).alias("electric"))
    none = F.lit(None).cast("string")

    def gap(df: DataFrame, rule: str, severity: str, code: Column = none) -> DataFrame:
        return df.select("project", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), code.alias("code"))

    return reduce(DataFrame.unionByName, [
        gap(flags.filter(~F.col("primary")), "no_primary", "critical"),
        gap(flags.filter(~F.col("test")), "no_test_method", "warn"),
        gap(flags.filter(F.col("electric") & ~F.col("safety") & ~F.col("installation")), "electrical_without_safety", "warn"),
        gap(selection.filter(F.col("version") == "superseded"), "superseded_selected", "critical", F.col("code"))])


def clause_fragments(selection: DataFrame) -> DataFrame:
    """Tender clauses of each project as ordered fragments: (project, clause, position, fragment).

    Fragments of one clause join without a separator, clauses with a blank line. A clause exists for
    each role that has items, numbered in the order of roles; position 0 closes the sentence, so no
    project's items are ever gathered into one row. ``selection(project, code, role, amendment)``.
    """
    parts = [("primary", "The item shall conform in all respects to ", " and ", "."),
             ("test", "Type and routine tests shall follow ", ", ", ", with certificates from an accredited laboratory for each lot."),
             ("safety", "The item shall also comply with ", ", ", "."),
             ("installation", "Installation shall follow ", ", ", "."),
             ("certification", "The item shall carry a valid mark under ", ", ", "; state the licence number in the bid.")]
    roles = [p[0] for p in parts]
    place = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role")).cast("int")
    rows = selection.withColumn("_no", place).filter(F.col("_no") > 0)
    present = rows.groupBy("project").agg(*[F.max(F.when(F.col("role") == r, 1).otherwise(0)).alias(f"_{r}") for r in roles])
    rows = exact_rank(rows, ["project", "role"], ["code"], "position").join(present, "project")
    clause, lead, glue, close = F.lit(0), F.lit(""), F.lit(""), F.lit("")
    for i, (role, start, sep, end) in enumerate(parts):
        here = F.col("role") == role
        clause = F.when(here, sum((F.col(f"_{r}") for r in roles[: i + 1]), F.lit(0))).otherwise(clause)
        lead, glue, close = (F.when(here, F.lit(v)).otherwise(x) for v, x in ((start, lead), (sep, glue), (end, close)))
    rows = rows.select("project", clause.alias("clause"), "position", "code", "amendment", lead.alias("lead"), glue.alias("glue"), close.alias("close"))
    name = F.concat("code", F.coalesce(F.concat(F.lit(" including "), "amendment"), F.lit("")))
    opened = F.concat(F.col("clause"), F.lit(". "), F.col("lead"), name)
    items = rows.select("project", "clause", "position", F.when(F.col("position") == 1, opened).otherwise(F.concat("glue", name)).alias("fragment"))
    ends = rows.filter("position = 1").select("project", "clause", F.lit(0).cast("bigint").alias("position"), F.col("close").alias("fragment"))
    return items.unionByName(ends)


def newest_of(std: DataFrame, by: str) -> DataFrame:
    return family_leaders(std, [by])
