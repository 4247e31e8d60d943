"""Signed incidence of nodes, edges and cells as coordinate tables (row, col, val), and the Laplacians made of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.session import discard, staged


def b1(edges: DataFrame, edge: str = "edge") -> DataFrame:
    """(row, col, val): -1 at an edge's source, +1 at its target; a loop's entries cancel."""
    ends = F.inline(F.array(F.struct(F.col("src").alias("row"), F.lit(-1).alias("val")), F.struct(F.col("dst").alias("row"), F.lit(1).alias("val"))))
    return edges.select(F.col(edge).alias("col"), ends).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def b2_cells(edges: DataFrame, boundary: DataFrame, edge: str = "edge") -> DataFrame:
    """(row, col, val): +1 where a cell's arc follows an edge, -1 where it runs against one. boundary: (cell, src, dst). The aligned edge is preferred, of several the least; an arc without any edge raises."""
    ways = edges.select(edge, F.inline(F.array(F.struct("src", "dst", F.lit(1).alias("val")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("val")))))
    best = ways.join(boundary.select("src", "dst").distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min(F.struct((-F.col("val")).alias("against"), F.col(edge).alias("edge"))).alias("way"))
    met = boundary.join(best, ["src", "dst"], "left")
    row = F.coalesce(F.col("way.edge"), F.raise_error(F.lit("a cell has an arc without an edge")).cast(dict(edges.dtypes)[edge]))
    return met.select(row.alias("row"), F.col("cell").alias("col"), (-F.col("way.against")).alias("val")).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product, without zeros."""
    return a.select(F.col("row").alias("r"), F.col("col").alias("k"), F.col("val").alias("x")).join(b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("val").alias("y")), "k").groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("x") * F.col("y")).alias("val")).where("val <> 0")


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


#: A row of more entries than PART is dealt into parts of about as many; an entry meets the others of up to GROUP parts in one place; a task makes about MADE pairs.
PART, GROUP, MADE = 128, 32, 20_000_000


def edge_pairs(one: DataFrame, marked: DataFrame, part: int = PART, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """B1' B1 as (row, col, val) in two parts without a common entry: pairs of columns of which at most one is marked, and pairs of marked ones. one: B1, at most two entries a column; marked: distinct (col).

    Two columns that share a row meet there, and those that share two meet at the lesser, so every pair is made once, whole, and what is made needn't be gathered again: only the entries cross the network, never the pairs.
    """
    end = F.struct("row", "val")
    few = F.when(F.col("n") <= 2, F.col("a")).otherwise(F.raise_error(F.lit("a column has more than two entries")).cast("struct<row:string,val:bigint>"))
    ends = one.select("col", F.col("row").cast("string").alias("row"), F.col("val").cast("bigint").alias("val")).groupBy("col").agg(F.count("*").alias("n"), F.min(end).alias("a"), F.max(end).alias("b"))
    known = marked.select("col", F.lit(True).alias("mark"))
    ends = staged(ends.select("col", few.alias("a"), F.when(F.col("n") > 1, F.col("b")).alias("b")).join(known, "col", "left").fillna(False, ["mark"]), "ends")
    at = lambda i, j: F.struct(F.col(i)["row"].alias("r"), F.col(i)["val"].alias("x"), F.col(j)["row"].alias("o"), F.col(j)["val"].alias("y"))
    entry = ends.select("col", "mark", F.inline(F.when(F.col("b").isNull(), F.array(at("a", "b"))).otherwise(F.array(at("a", "b"), at("b", "a")))))
    return entry_pairs(entry, ~(F.col("mark") & F.col("mark_b")), part, group), entry_pairs(entry.where("mark"), F.lit(True), part, group)


def entry_pairs(entry: DataFrame, more: Column, part: int, group: int) -> DataFrame:
    """(row, col, val): the pairs of columns that share a row, of entries (r, x) of col with the column's other entry (o, y), if any. more: on mark and mark_b, which pairs are wanted.

    Only columns with the same other row can share two. Large rows are therefore dealt into parts by the other row: within a part each pair is looked at; across parts nothing is left to ask of a pair, so an entry meets whole arrays of columns
    with one value and mark. Tasks are as many as the pairs need: a row of n entries sends each to n / (part * group) places.
    """
    def other(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_b" for c in names})

    def met(a: DataFrame, *keys: str) -> DataFrame:
        b = other(a.select(*keys, "col", "mark", "x", "o", "y"), "col", "mark", "x", "o", "y")
        twice = F.coalesce(F.col("o") == F.col("o_b"), F.lit(False))
        val = F.col("x") * F.col("x_b") + F.when(twice, F.col("y") * F.col("y_b")).otherwise(F.lit(0))
        kept = a.join(b, list(keys)).where(more & (~twice | (F.col("r") < F.col("o"))))
        return kept.select(F.col("col").alias("row"), F.col("col_b").alias("col"), val.alias("val")).where("val <> 0")

    large = staged(entry.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") > part), "large-rows")
    made = large.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0]
    if made is None:
        return met(entry, "r")
    parts = F.ceil(F.col("n") / part).cast("int").alias("parts")
    place = F.pmod(F.xxhash64(F.coalesce("o", F.col("col").cast("string"))), F.col("parts")).cast("int")
    entry = entry.join(large.select("r", parts), "r", "left").fillna(1, ["parts"]).withColumn("p", place)
    tasks = max(int(entry.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(made) // MADE))
    split = entry.where("parts > 1")
    groups = F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / group).cast("int"))
    ones = split.select("r", "p", "col", "mark", "x", F.explode(groups).alias("g")).repartition(tasks, "r", "g")
    many = split.select("r", F.floor(F.col("p") / group).cast("int").alias("g"), "p", "mark", "x", "col").repartition(tasks, "r", "g").groupBy("r", "g", "p", "mark", "x").agg(F.collect_list("col").alias("cols"))  # about as many as a part has
    across = ones.join(other(many, "p", "mark", "x").hint("merge"), ["r", "g"]).where(more & (F.col("p") != F.col("p_b"))).select(F.col("col").alias("row"), "cols", (F.col("x") * F.col("x_b")).alias("val")).where("val <> 0")
    return met(entry.repartition(tasks, "r", "p"), "r", "p").unionByName(across.select("row", F.explode("cols").alias("col"), "val"))


def laplacians(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L0 = B1 B1', L1 = B1' B1 + B2 B2', L2 = B2' B2. Of L1 only pairs of edges that both lie on cells are summed up by pair, as the others have no part in B2 B2'."""
    apart, met = edge_pairs(one, two.select(F.col("row").alias("col")).distinct())
    sums = met.unionByName(product(two, transposed(two))).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")
    return product(one, transposed(one)), apart.unionByName(sums), product(transposed(two), two)


def residual(edges: DataFrame, group: str) -> DataFrame:
    """Nodes of a group where -1 at sources and +1 at targets don't cancel: none if the edges close."""
    ends = F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(-1).alias("val")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("val"))))
    return edges.select(group, ends).groupBy(group, "node").agg(F.sum("val").alias("val")).where("val <> 0")


def subdivided(events: DataFrame) -> DataFrame:
    """(event_id, place, src, dst): each event as a path of four segments through a port on either side of it."""
    e = F.col("event_id").cast("string")
    stops = F.array(F.concat(F.lit("account:"), "src"), F.concat(F.lit("out:"), e), F.concat(F.lit("event:"), e), F.concat(F.lit("in:"), e), F.concat(F.lit("account:"), "dst"))
    return events.select("event_id", stops.alias("s")).select("event_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("place"), F.col("s")[i].alias("src"), F.col("s")[i + 1].alias("dst")))).alias("place", "src", "dst"))


def b2_simplicial(edges: DataFrame, triangles: DataFrame, by: tuple[str, ...] = (), edge: str = "edge", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, row, col, val), keep being of by: +1, -1, +1 where a triangle u < v < w holds the edges (u, v), (u, w), (v, w). edges: (by, u, v, edge) with u < v, triangles: (by, u, v, w, cell). A loop, an edge that comes twice or a face without an edge raises."""
    kind = dict(edges.dtypes)[edge]
    fault = F.when(F.col("u") >= F.col("v"), F.raise_error(F.lit("an edge isn't oriented")).cast(kind)).when(F.col("_n") > 1, F.raise_error(F.lit("an edge comes twice")).cast(kind)).otherwise(F.col("_edge"))
    known = edges.groupBy(*by, "u", "v").agg(F.count("*").alias("_n"), F.min(edge).alias("_edge")).select(*by, "u", "v", fault.alias("row"))
    face = lambda a, b, sign: F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(sign).alias("val"))
    faces = triangles.select(*by, F.col("cell").alias("col"), F.inline(F.array(face("u", "v", 1), face("u", "w", -1), face("v", "w", 1))))
    met = faces.join(known, [*by, "u", "v"], "left")
    return met.select(*keep, F.coalesce("row", F.raise_error(F.lit("a triangle has a face without an edge")).cast(kind)).alias("row"), "col", "val")


def by_event(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, val): B1 with a column for each event, so that parallel events stay apart; loops have no entries."""
    return events.where("src <> dst").select(*by, F.col("event_id").alias("col"), F.inline(F.array(F.struct(F.col("src").alias("row"), F.lit(-1).alias("val")), F.struct(F.col("dst").alias("row"), F.lit(1).alias("val"))))).select(*by, "row", "col", "val")


def fans(boundary: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, place, a, b, c): each polygon as triangles around its first corner. boundary: (cell, place, src)."""
    corners = boundary.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("place", "src")))["src"].alias("p"))  # as many as a cell has corners
    return corners.where(F.size("p") >= 3).select(cell, F.inline(F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.struct(i.alias("place"), F.col("p")[0].alias("a"), F.col("p")[i].alias("b"), F.col("p")[i + 1].alias("c")))))


def port_fan(chosen: DataFrame, key: str) -> DataFrame:
    """(key, face, a, b, segment, spoke_a, spoke_b): a candidate's cycle filled from a centre of its own. chosen: its events (key, place, event_id, src, dst) in the order of the walk, places from 0.

    The perimeter runs from account to account through the three ports of each event; face i lies between its vertices i and i + 1, a and b, and the centre. A spoke runs from the centre to a vertex of the
    perimeter and is made by the first face that needs it, so spoke i is that of vertex i. A walk that isn't closed raises.
    """
    steps = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "src", "dst"))).alias("w"))  # as many as a candidate has events
    n = F.size("w")
    closed = F.forall(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("w")[i]["dst"] == F.col("w")[(i + 1) % n]["src"]), lambda x: x)
    port = lambda kind, x: F.concat(F.lit(f"{kind}:"), x.cast("string"))
    around = F.flatten(F.transform("w", lambda x: F.array(port("account", x["src"]), port("out", x["event_id"]), port("event", x["event_id"]), port("in", x["event_id"]))))
    ring = F.when(F.coalesce(closed, F.lit(False)), around).otherwise(F.raise_error(F.lit("a walk isn't closed")).cast("array<string>"))
    corners = steps.select(key, ring.alias("p"), F.transform("w", lambda x: x["event_id"]).alias("events"))
    m = F.size("p")
    spoke = lambda i: F.concat(F.lit("spoke:"), i.cast("string"))
    face = lambda i: F.struct(i.alias("face"), F.col("p")[i].alias("a"), F.col("p")[(i + 1) % m].alias("b"), F.concat(F.col("events")[F.floor(i / 4).cast("int")].cast("string"), F.lit("/"), (i % 4).cast("string")).alias("segment"), spoke(i).alias("spoke_a"), spoke((i + 1) % m).alias("spoke_b"))
    return corners.select(key, F.inline(F.transform(F.sequence(F.lit(0), m - 1), face)))


def fan_incidence(faces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(B1, B2) of port_fan() as (key, row, col, val): segments run with their event from a to b, spokes out of the centre; a face follows its segment and spoke a and runs against spoke b."""
    entry = lambda row, col, val: F.struct(row.alias("row"), col.alias("col"), F.lit(val).alias("val"))
    c = F.col
    one = faces.select(key, F.inline(F.array(entry(c("a"), c("segment"), -1), entry(c("b"), c("segment"), 1), entry(F.lit("centre"), c("spoke_a"), -1), entry(c("a"), c("spoke_a"), 1))))
    face = c("face").cast("string")
    two = faces.select(key, F.inline(F.array(entry(c("segment"), face, 1), entry(c("spoke_a"), face, 1), entry(c("spoke_b"), face, -1))))
    return one, two


def fan_open(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, open): entries of B1 B2 that aren't zero, for the candidates that have one. Both sides are dealt by (key, col): a fan's rows are many times the table that they are made of, whose size a planner goes by when it chooses to broadcast."""
    met = one.withColumnRenamed("val", "x").join(two.select(key, F.col("row").alias("col"), F.col("col").alias("face"), F.col("val").alias("y")).hint("merge"), [key, "col"])
    return met.groupBy(key, "row", "face").agg(F.sum(F.col("x") * F.col("y")).alias("v")).where("v <> 0").groupBy(key).agg(F.count("*").alias("open"))


def hasse(one: DataFrame, two: DataFrame) -> DataFrame:
    """(cell, rank0, rank1, pairs): a cell's nodes, its edges, and the signed pairs of both with the ranks above them, in order."""
    faces = two.select(F.col("col").alias("cell"), F.col("row").alias("edge"), F.col("val").alias("up"))
    ends = faces.join(one.select(F.col("col").alias("edge"), F.col("row").alias("node"), "val"), "edge")
    text = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    return ends.groupBy("cell").agg(
        F.sort_array(F.collect_set("node")).alias("rank0"),
        F.sort_array(F.collect_set("edge")).alias("rank1"),
        F.sort_array(F.array_union(F.collect_set(text("node", "edge", "val")), F.collect_set(text("edge", "cell", "up")))).alias("pairs"),
    )  # as many as a cell has corners and sides


def rank_of_incidence(nodes: DataFrame, stars: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, nodes, edges, components, rank, betti1): the rank of B1 is that over GF(2) too, nodes less components. nodes: (by, node), stars: (by, node, root) of those that aren't roots, edges: (by)."""
    n = nodes.groupBy(*by).agg(F.count("*").alias("nodes"))
    joined = stars.groupBy(*by).agg(F.count("*").alias("rank"))
    e = edges.groupBy(*by).agg(F.count("*").alias("edges"))
    out = n.join(e, by, "left").join(joined, by, "left").fillna(0, ["edges", "rank"])
    return out.select(*by, "nodes", "edges", (F.col("nodes") - F.col("rank")).alias("components"), "rank", (F.col("edges") - F.col("rank")).alias("betti1"))


def closure_forms(edges: DataFrame, boundary: DataFrame, salt: str = "order") -> DataFrame:
    """(form, cells, open) for three ways of checking that cells close: the product B1 B2; the ends of each cell's arcs summed without either matrix; and the product after nodes, edges and cells have been renamed in another order. A form's open cells are those with an entry that isn't zero; a difference between forms raises. edges: (src, dst, edge), boundary: (cell, src, dst)."""
    def counted(form: str, open_: DataFrame) -> DataFrame:
        return boundary.agg(F.count_distinct("cell").alias("cells")).join(open_.agg(F.count_distinct("col").alias("open"))).select(F.lit(form).alias("form"), "cells", "open")

    other = lambda c: F.concat(F.md5(F.concat_ws(":", F.lit(salt), F.col(c).cast("string"))), F.lit("|"), F.col(c).cast("string"))
    moved = edges.select(other("src").alias("src"), other("dst").alias("dst"), other("edge").alias("edge")), boundary.select(other("cell").alias("cell"), other("src").alias("src"), other("dst").alias("dst"))
    forms = [
        ("product", product(b1(edges), b2_cells(edges, boundary))),
        ("ends", residual(boundary, "cell").select(F.col("cell").alias("col"))),
        ("renamed", product(b1(moved[0]), b2_cells(*moved))),
    ]
    told = staged(forms_union([counted(n, x.select("col")) for n, x in forms]), "closure")
    if told.select("cells", "open").distinct().count() != 1:
        raise ValueError(f"the forms differ: {[tuple(r) for r in told.collect()]}")
    return told


def forms_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def lifted(nodes: DataFrame, edges: DataFrame, one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, nodes, edges, b1, b2): a candidate's whole lift as one row, arrays in order and matrices as coordinates. nodes: (key, node, ...), edges: (key, edge, ...), one, two: (key, row, col, val). A key that has edges or entries but no nodes raises."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))  # as many as a candidate has

    out = rows(nodes, "nodes")
    for df, name in ((edges, "edges"), (one, "b1"), (two, "b2")):
        out = out.join(rows(df, name), key, "full")
    bad = F.col("nodes").isNull()
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])).alias(c)
    good = F.when(bad, F.raise_error(F.lit("a lift without nodes")).cast(dict(out.dtypes)["nodes"])).otherwise(F.col("nodes"))
    return out.select(key, good.alias("nodes"), *(empty(c) for c in ("edges", "b1", "b2")))


def consistent(views: list[DataFrame], key: str, label: str) -> DataFrame:
    """The views of one thing joined on its key, with one label; a key that a view lacks, or has twice, or labels that differ, raise."""
    rows = views[0].select(key, label).withColumn("_v", F.lit(0))
    for i, v in enumerate(views[1:], 1):
        rows = rows.unionByName(v.select(key, label).withColumn("_v", F.lit(i)))
    seen = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("_v").alias("views"), F.count_distinct(label).alias("labels"), F.count(label).alias("given"), F.min(label).alias(label))
    good = (F.col("n") == len(views)) & (F.col("views") == len(views)) & (F.col("labels") <= 1) & F.col("given").isin(0, len(views))
    out = seen.select(key, F.when(good, F.col(label)).otherwise(F.raise_error(F.lit("the views of a key don't agree")).cast(dict(views[0].dtypes)[label])).alias(label))
    for v in views:
        out = out.join(v.drop(label), key, "left")  # so that a key that a view lacks is still there to raise
    return out


#: A prime beyond any torsion that is likely: the rank modulo it is that over the rationals unless it divides an elementary divisor.
LARGE_PRIME = (1 << 31) - 1
COLUMN = "block long, settled boolean, rows array<long>, vals array<long>"
COLUMN_SCHEMA = pa.schema([("block", pa.int64()), ("settled", pa.bool_()), ("rows", pa.list_(pa.int64())), ("vals", pa.list_(pa.int64()))])


def reduced(columns: Iterator[tuple[bool, dict[int, int]]], first: int, modulus: int) -> Iterator[tuple[bool, dict[int, int]]]:
    """The columns of a block of rows, from `first` on, reduced by their lowest entries: (True, column) for each lowest row that one holds, (False, column) for those that go on to blocks of lesser rows. Columns that hold a row already come as (True, column)."""
    held: dict[int, dict[int, int]] = {}
    for settled, own in sorted(columns, key=lambda x: not x[0]):
        if settled:
            held[max(own)] = own
            continue
        while own and (low := max(own)) >= first:
            if not (other := held.get(low)):
                inverse = pow(own[low], -1, modulus)
                held[low] = {r: v * inverse % modulus for r, v in own.items()}
                own = {}
                break
            times = own[low]
            for r, v in other.items():
                if x := (own.get(r, 0) - times * v) % modulus:
                    own[r] = x
                else:
                    own.pop(r, None)
        if own:
            yield False, own
    yield from ((True, c) for c in held.values())


def peeled(cells: DataFrame, by: tuple[str, ...] = (), most_rounds: int = 30) -> tuple[list[DataFrame], DataFrame]:
    """([(by, rank)], rest): columns that have a row to themselves, as faces with a free edge do, are taken off and counted, again and again while they are at least one for a hundred entries. The rank of (by, row, col, val) is their number and the rank of the rest."""
    cells, counts = staged(cells, "entries"), []
    for _ in range(most_rounds):
        lone = staged(cells.groupBy(*by, "row").agg(F.count("*").alias("n"), F.min("col").alias("col")).where("n = 1").select(*by, "col").distinct(), "free-columns")
        n = lone.count()
        if n * 100 <= cells.count():
            break
        counts.append(lone.groupBy(*by).agg(F.count("*").alias("rank")))
        before, cells = cells, staged(cells.join(lone, [*by, "col"], "left_anti"), "entries")
        discard(before)
    return counts, cells


def ranks(entries: DataFrame, by: tuple[str, ...] = (), modulus: int = LARGE_PRIME, block_rows: int = 4096) -> DataFrame:
    """(by, rank): the rank of each group's matrix (by, row, col, val) modulo a prime. Groups without an entry are left out.

    Columns with a row to themselves are counted first (peeled). The rows of the others are numbered and cut into blocks. A round reduces the columns whose lowest entry lies in a block against those that hold one there, in a task for each block;
    what falls below goes to an earlier block in the next round. Rounds are as many as the blocks that a column falls through. A column holds at most as many entries as
    its group has rows, which for boundaries fills up slowly.
    """
    by = tuple(by)
    cells = entries.select(*by, "row", "col", (F.pmod(F.col("val").cast("bigint"), F.lit(modulus))).alias("val")).where("val <> 0")
    apart, cells = peeled(cells, by)
    numbered = staged(with_ordinal(cells.select(*by, "row").distinct(), [*by, "row"], "place"), "rows")
    columns = cells.join(numbered, [*by, "row"]).groupBy(*by, "col").agg(F.collect_list("place").alias("rows"), F.collect_list("val").alias("vals"))  # as many as a column has entries
    block = lambda rows: F.floor(F.array_max(rows) / block_rows)
    new = staged(columns.select(block("rows").alias("block"), F.lit(False).alias("settled"), "rows", "vals"), "columns")

    def run(key, rows):
        at = key[0].as_py()
        given = ((s, dict(zip(r, v, strict=True))) for s, r, v in zip(*(rows.column(c).to_pylist() for c in ("settled", "rows", "vals")), strict=True))
        out = [{"block": at if s else max(c) // block_rows, "settled": s, "rows": list(c), "vals": list(c.values())} for s, c in reduced(given, at * block_rows, modulus)]
        return pa.Table.from_pylist(out, COLUMN_SCHEMA)

    held = None
    while new.take(1):
        busy = new.select("block").distinct()
        met = new if held is None else new.unionByName(held.join(busy, "block", "left_semi"))
        done = staged(met.groupBy("block").applyInArrow(run, COLUMN), "reduced")
        idle = None if held is None else held.join(busy, "block", "left_anti")
        settled = done.where("settled") if idle is None else done.where("settled").unionByName(idle)
        held, new = staged(settled, "held"), staged(done.where("NOT settled"), "columns")
        discard(done)
    if held is None:
        rest = numbered.groupBy(*by).agg(F.count("*").alias("rank")).limit(0)
    else:
        rest = held.select(F.array_max("rows").alias("place")).join(numbered, "place").groupBy(*by).agg(F.count("*").alias("rank"))
    return forms_union([rest, *apart]).groupBy(*by).agg(F.sum("rank").alias("rank")) if apart else rest


def betti_of_faces(nodes: DataFrame, edges: DataFrame, triangles: DataFrame, stars: DataFrame, by: tuple[str, ...], modulus: int = LARGE_PRIME) -> DataFrame:
    """(by, beta0, beta1, beta2) of complexes of nodes (by, node), edges (by, u, v, edge) with u < v and triangles (by, u, v, w, cell); stars: (by, node, root) of the nodes that aren't the least of their component."""
    by = tuple(by)
    triangles = staged(triangles, "triangles")
    counts = rank_of_incidence(nodes, stars, edges, list(by))
    faces = triangles.groupBy(*by).agg(F.count("*").alias("faces"))
    rank = ranks(b2_simplicial(edges, triangles, by, keep=by), by, modulus).withColumnRenamed("rank", "rank2")
    out = counts.join(faces, list(by), "left").join(rank, list(by), "left").fillna(0, ["faces", "rank2"])
    return out.select(*by, F.col("components").alias("beta0"), (F.col("betti1") - F.col("rank2")).alias("beta1"), (F.col("faces") - F.col("rank2")).alias("beta2"))
