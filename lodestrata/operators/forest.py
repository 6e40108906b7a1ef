"""Merge forests of clouds of any size, by ranges of levels.

A cloud's births and relations are cut into ranges of about ``LOT`` along their levels, a level never in two.  What a range does
depends on the past only through the components that its relations meet, so the components at the start of every range are
found first, by halving: the relations of the earlier half contract what the later half meets, then both halves are halved
again, all of them in the same jobs.  After log2(ranges) rounds every range is solved on its own, and nodes that live
across ranges are looked up in the last range before that touched their component.

Rows carry what enters (the points of facets that were in no node before), so that a forest is linear in its input; :func:`covered` adds up.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import exact
from .cloud import facets, numbered
from .graph import components
from .lineage import cut, release

#: Births and relations of a range.
LOT = 200_000

FOREST = "cloud long, node long, num long, den long, kind string, q int, children string, entered string, facets string"
_PARTIAL = "cloud long, rng long, what string, seq long, num long, den long, kind string, q int, ref string, children array<string>, label string, entered string, facets string"
_KEY = ("q", "hi", "lo")


def _text(label) -> object:
    return F.array_join(label, ",")


def _ranged(rows: DataFrame, lot: int) -> tuple[DataFrame, int]:
    """``rows`` with the range ``rng`` of their level, and how many bits number the ranges."""
    largest = rows.groupBy("cloud").count().agg(F.max("count")).first()[0] or 0
    if largest <= lot:
        return rows.withColumn("rng", F.lit(0).cast("long")), 0
    placed = numbered(rows, "cloud", *(f"k{c}" for c in _KEY))
    first = placed.groupBy("cloud", "num", "den").agg(F.floor(F.min("id") / lot).cast("long").alias("rng"))
    out = cut(placed.drop("id").join(first, ["cloud", "num", "den"]), "ranged")
    return out, int(out.agg(F.max("rng")).first()[0]).bit_length()


def _contracted(rel: DataFrame, bits: int) -> DataFrame:
    """Relations with the components that their ends belong to at the start of their range, and whether these are old."""
    rel = rel.withColumns({"old_u": F.lit(False), "old_v": F.lit(False)})
    for shift in range(bits - 1, -1, -1):
        left = F.shiftright("rng", shift).bitwiseAND(F.lit(1).cast("long")) == 0
        half = F.struct("cloud", F.shiftright("rng", shift + 1).alias("part"))
        edges = cut(rel.where(left & (F.col("u") != F.col("v"))).select(half.alias("cloud"), "u", "v").distinct(), "halves")
        ends = edges.select("cloud", F.explode(F.array("u", "v")).alias("node")).distinct()
        found = components(ends, edges).select(F.col("cloud.cloud").alias("cloud"), F.col("cloud.part").alias("part"), "node", "component")
        late = rel.where(~left).withColumn("part", F.shiftright("rng", shift + 1))
        for e in "uv":
            late = late.join(found.select("cloud", "part", F.col("node").alias(e), F.col("component").alias("to")), ["cloud", "part", e], "left")
            late = late.withColumns({e: F.coalesce("to", e), f"old_{e}": F.col(f"old_{e}") | F.col("to").isNotNull()}).drop("to")
        halved = cut(rel.where(left).unionByName(late.drop("part")), "contracted")
        release(rel, edges)
        rel = halved
    return rel


def _solve(table: pa.Table, reduced: bool, schema: pa.Schema) -> pa.Table:
    """One range of a cloud: all births and relations of a level together, against the components frozen before it."""
    rows = table.to_pylist()
    cloud, rng = rows[0]["cloud"], rows[0]["rng"]
    for r in rows:
        r["level"] = Fraction(r["num"], r["den"])
    rows.sort(key=lambda r: (r["level"], r["what"]))  # births first
    root: dict[str, str] = {}
    node: dict[str, str] = {}  # of a component, by its least facet
    waiting: dict[str, list[str]] = {}  # facets that are in no node yet
    out, made, k = [], 0, 0

    def find(x: str, old: bool = False) -> str:
        if x not in root:
            root[x] = x
            if old:
                node[x] = f"x{x}"
            else:
                waiting[x] = [x]
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while k < len(rows):
        level, batch = rows[k]["level"], []
        while k < len(rows) and rows[k]["level"] == level:
            batch.append(rows[k])
            k += 1
        prior: dict[str, set[str]] = {}
        met, joined = {}, set()

        def touch(x: str, old: bool = False) -> str:
            r = find(x, old)
            if r not in prior:
                prior[r] = {node[r]} if r in node else set()
            met[r] = None
            return r

        for r in batch:
            a = touch(r["u"], r["old_u"])
            if r["what"] == "birth":
                continue
            b = touch(r["v"], r["old_v"])
            joined.add(a)
            if a != b:
                low, high = min(a, b), max(a, b)
                root[high] = low
                prior[low] = prior[low] | prior.pop(high)
                waiting[low] = waiting.pop(low, []) + waiting.pop(high, [])
        joined = {find(x) for x in joined}
        for top in sorted({find(x) for x in met}):
            if reduced and "," in top and top not in joined:
                continue
            was = sorted(prior[top])
            ref = was[0] if len(was) == 1 else f"n{made}"
            made += len(was) != 1
            node[top] = ref
            new = sorted(waiting.pop(top, ()))
            points = sorted({int(p) for f in new for p in f.split(",")})
            kind = ("birth", "growth")[len(was)] if len(was) < 2 else "merge"
            out.append((cloud, rng, "row", len(out), level.numerator, level.denominator, kind, len(was), ref, was if len(was) > 1 else [], None, ",".join(map(str, points)), " ".join(new)))
    out += [(cloud, rng, "state", None, None, None, None, None, ref, None, label, None, None) for label, ref in node.items() if root[label] == label]
    return pa.Table.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _resolved(solved: DataFrame) -> DataFrame:
    """``cloud, rng, ref, at, n``: for each reference to an earlier range, which node of which range it is."""
    state = solved.where("what = 'state'").select("cloud", "label", "rng", "ref", F.col("rng").alias("at"))
    known = cut(state, "states")
    while known.where("ref LIKE 'x%'").limit(1).count():
        known = cut(_look_up(known, known), "states")
    return known


def _look_up(asked: DataFrame, known: DataFrame) -> DataFrame:
    """References of ``asked`` (ref, at) replaced by those of the last state of that component before ``at``."""
    old = asked.where("ref LIKE 'x%'").withColumn("label_", F.expr("substring(ref, 2)"))
    k = known.select("cloud", F.col("label").alias("label_"), F.col("rng").alias("rng_"), F.struct("ref", "at").alias("to"))
    keys = [c for c in asked.columns if c not in ("ref", "at")]
    found = old.join(k, ["cloud", "label_"]).where("rng_ < at").groupBy(*keys).agg(F.max_by("to", "rng_").alias("to")).select(*keys, "to.ref", "to.at")
    return asked.where("ref NOT LIKE 'x%'").unionByName(found)


def merge_forest(found_facets: DataFrame, cofaces: DataFrame, reduced: bool = True, lot: int = LOT) -> DataFrame:
    """The merge forest of one order: births, growths (q = 1, no new node) and merges, with the nodes that a merge ends
    (``children``), and the facets that enter with the row with their points (``facets``, ``entered``).

    All relations of one exact level act at once.  ``reduced`` leaves out components of a single facet (for
    order 1 singletons are all there are, and stay).  Nodes are numbered within their cloud.  A task holds a range of about
    ``lot`` births and relations; only a single level of more than that makes a larger one.
    """
    key = F.expr(exact.level_key("num", "den"))
    f = F.col("f")
    star = cofaces.select("cloud", "num", "den", facets(F.col("label")).alias("f"))
    star = star.select("cloud", "num", "den", F.lit("relation").alias("what"), _text(f[0]).alias("u"), F.explode(F.slice(f, F.lit(2), F.size(f) - 1)).alias("v")).withColumn("v", _text("v"))
    born = found_facets.select("cloud", "num", "den", F.lit("birth").alias("what"), _text("label").alias("u"), F.lit(None).cast("string").alias("v"))
    rows = born.unionByName(star).withColumn("key", key).select("cloud", "num", "den", "what", "u", "v", *(F.col(f"key.{c}").alias(f"k{c}") for c in _KEY))
    ranged, bits = _ranged(rows, lot)
    ranged = ranged.drop(*(f"k{c}" for c in _KEY))
    births = ranged.where("what = 'birth'").withColumns({"old_u": F.lit(False), "old_v": F.lit(False)})
    rel = _contracted(ranged.where("what = 'relation'"), bits)
    if bits:  # single facets that are nodes of their own and were born in an earlier range
        for e in "uv":
            since = births.where(F.lit(not reduced) | ~F.col("u").contains(",")).select("cloud", F.col("u").alias(e), F.col("rng").alias("since"))
            rel = rel.join(since, ["cloud", e], "left").withColumn(f"old_{e}", F.col(f"old_{e}") | F.coalesce(F.col("since") < F.col("rng"), F.lit(False))).drop("since")
    schema = to_arrow_schema(StructType.fromDDL(_PARTIAL))
    solved = births.unionByName(rel).groupBy("cloud", "rng").applyInArrow(lambda table: _solve(table, reduced, schema), _PARTIAL)
    solved = cut(solved, "ranges")
    out = solved.where("what = 'row'")
    made = out.where("q <> 1").groupBy("cloud", "rng").agg(F.count("*").alias("n"))
    base = made.select("cloud", F.col("rng").alias("at"), (F.sum("n").over(Window.partitionBy("cloud").orderBy("rng")) - F.col("n")).alias("base"))
    refs = out.select("cloud", "rng", "seq", F.posexplode(F.when(F.col("q") > 1, F.concat(F.array("ref"), "children")).otherwise(F.array("ref"))).alias("place", "ref"), F.col("rng").alias("at"))
    if bits:
        refs = _look_up(refs, _resolved(solved))
    nodes = refs.join(base, ["cloud", "at"]).withColumn("node", F.col("base") + F.expr("substring(ref, 2)").cast("long"))
    own = nodes.where("place = 0").select("cloud", "rng", "seq", "node")
    below = nodes.where("place > 0").groupBy("cloud", "rng", "seq").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("ended"))
    out = out.join(own, ["cloud", "rng", "seq"]).join(below, ["cloud", "rng", "seq"], "left")
    return out.select("cloud", "node", "num", "den", "kind", "q", F.coalesce("ended", F.lit("")).alias("children"), "entered", "facets")


def covered(forest: DataFrame) -> DataFrame:
    """A forest with all points that each row's component covers (``covered``), which may be quadratic in the forest: a cloud at
    a time.  For one level use :func:`forest_cut`."""
    names = [c for c in forest.columns if c not in ("entered", "facets")]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        held: dict[int, set[int]] = {}
        order = sorted(range(len(rows)), key=lambda i: Fraction(rows[i]["num"], rows[i]["den"]))
        text = [""] * len(rows)
        for i in order:
            r = rows[i]
            own = held.setdefault(r["node"], set())
            for c in filter(None, r["children"].split(",")):
                own |= held.pop(int(c))
            own.update(map(int, filter(None, r["entered"].split(","))))
            text[i] = ",".join(map(str, sorted(own)))
        return table.drop_columns(["entered"]).append_column("covered", pa.array(text, pa.string()))

    schema = forest.select(*names, F.col("entered").alias("covered")).schema
    return forest.select(*names, "entered").groupBy("cloud").applyInArrow(run, schema)


def forest_cut(forest: DataFrame, num: int, den: int = 1, closed: bool = True) -> DataFrame:
    """Nodes alive at a level with what they cover then: ``cloud, node, covered``; components of the rows up to it."""
    upto = cut(forest.where(f"num * {den} {'<=' if closed else '<'} {num} * den"), "upto")
    ends = upto.where("children <> ''").select("cloud", "node", F.explode(F.split("children", ",")).alias("child"))
    # The latest node of a tree is the one that no other ends: nodes are numbered along the levels.
    tops = components(upto.select("cloud", (-F.col("node")).alias("node")), ends.select("cloud", (-F.col("node")).alias("u"), (-F.col("child").cast("long")).alias("v")))
    p = upto.select("cloud", (-F.col("node")).alias("node"), F.explode(F.split("entered", ",")).alias("p")).join(tops, ["cloud", "node"])
    return p.where("p <> ''").groupBy("cloud", (-F.col("component")).alias("node")).agg(F.array_join(F.array_sort(F.collect_set(F.col("p").cast("long"))), ",").alias("covered"))
