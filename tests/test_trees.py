"""Trees by intervals and by doubling against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import flatten, inherit, intervals, layout, resolve

ITEMS = "path string, seq int, node_id string, level int, node_type string"


def plain_tree(items):
    """Children lists by the rules of a layout: conditions, renamings and 77 apart from the others."""
    roots, kids, opened = [], {}, []
    for _, _, node, level, kind in items:
        kids[node] = []
        if level == 88:
            (kids[opened[-1][0]] if opened else roots).append(node)
            continue
        if level == 66:
            group = next((n for n, _, k in reversed(opened) if k == "GROUP"), None)
            (kids[group] if group else roots).append(node)
            continue
        while opened and (opened[-1][1] >= level or level == 77):
            opened.pop()
        (kids[opened[-1][0]] if opened else roots).append(node)
        opened.append((node, level, kind))
    return roots, kids


def plain_places(items):
    roots, kids = plain_tree(items)
    out, n = {}, 0

    def visit(node, parent, depth):
        nonlocal n
        enter, n = n, n + 1
        for k in kids[node]:
            visit(k, node, depth + 1)
        out[node] = (parent, depth, enter, n - 1)

    for r in roots:
        visit(r, None, 0)
    return out


def random_file(name, n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        level = r.choice([1, 5, 5, 10, 10, 15, 20, 25, 49, 66, 77, 88, 88])
        kind = {88: "CONDITION", 66: "RENAMES"}.get(level, r.choice(["GROUP", "ELEMENTARY"]))
        rows.append((name, i, f"{name}:{i}", level, kind))
    return rows


def test_places(spark):
    files = [random_file(f"f{k}", 150, k) for k in range(12)] + [[("one", 0, "one:0", 88, "CONDITION")], [("two", 0, "two:0", 66, "RENAMES"), ("two", 1, "two:1", 1, "GROUP")]]
    want = {node: v for rows in files for node, v in plain_places(rows).items()}
    every = [r for rows in files for r in rows]
    random.Random(0).shuffle(every)
    got = intervals.numbered(spark.createDataFrame(every, ITEMS).repartition(3))
    assert {r.node_id: (r.parent_id, r.depth, r.enter, r.leave) for r in got.collect()} == want


def test_no_items(spark):
    none = spark.createDataFrame([], ITEMS)
    assert intervals.numbered(none).count() == 0 and intervals.older_tree(none.drop("node_type")).count() == 0


def test_counts_marks_and_search(spark):
    rows = random_file("f", 200, 7) + random_file("g", 100, 8)
    kids = plain_tree(rows[:200])[1] | plain_tree(rows[200:])[1]
    below = lambda n: [x for k in kids[n] for x in [k, *below(k)]]
    nodes = spark.createDataFrame(rows, ITEMS)
    nodes = nodes.join(intervals.numbered(nodes).drop("path"), "node_id").cache()
    level = {r[2]: r[3] for r in rows}
    tens = {r.node_id: r.tens for r in intervals.below(nodes, tens=F.col("level") == 10).collect()}
    assert tens == {n: sum(level[x] == 10 for x in below(n)) for n in kids}
    marked = {n for n in kids if level[n] == 5}
    want = marked | {x for n in marked for x in below(n)}
    assert {r.node_id for r in intervals.inside(nodes, F.col("level") == 5).where("inside").collect()} == want
    hits = {r[2] for r in rows if r[1] % 41 == 3}
    kept = {n for n in kids if n in hits or hits & set(below(n))}
    assert {r.node_id for r in intervals.search(nodes, F.col("seq") % 41 == 3).collect()} == kept
    assert sorted(r.place for r in intervals.walk(nodes).where("path = 'f'").collect()) == list(range(1, 201))


def test_a_file_of_a_hundred_thousand_items(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit("BIG.cpy").alias("path"), (F.col("id") + 1).cast("int").alias("line_no"), F.expr("""
      CASE WHEN id = 0 THEN '01 RECORD.' WHEN id % 100 = 1 THEN concat(' 05 GROUP-', id, '.') WHEN id % 10 = 5 THEN concat('  88 IS-', id, ' VALUE 1.')
           ELSE concat('  10 F', id, ' PIC X(2).') END""").alias("text"))  # fmt: skip
    nodes = layout.tree(layout.declarations(lines)).withColumn("byte_length", F.lit(2)).cache()
    top = nodes.where("level = 1").first()
    assert nodes.count() == n and (top.enter, top.leave) == (0, n - 1)
    stats = resolve.structure(nodes).where("level = 1").first()
    assert stats.is_group and stats.leaves == nodes.where("level = 10").count()
    assert intervals.search(nodes, F.col("name") == "F99999").count() == 3


@pytest.mark.parametrize("depth", [1, 2, 9, 300])
def test_doubling_on_a_chain(spark, depth):
    rows = [(str(i), str(i - 1) if i else None, i + 1) for i in range(depth)]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, n int")
    got = inherit.handed_down(
        nodes, names=inherit.path_of(F.col("node_id")), total=inherit.total(F.col("n")), last=inherit.nearest(F.when(F.col("n") % 5 == 1, F.col("n"))), four=inherit.any_of(F.col("n") == 4)).collect()
    assert len(got) == depth
    for r in got:
        assert r.names == [str(i) for i in range(r.n)] and r.total == r.n * (r.n + 1) // 2
        assert r.last == (r.n - 1) // 5 * 5 + 1 and r.four == (r.n >= 4)


def test_doubling_on_odd_trees(spark):
    schema = "node_id string, parent_id string, n int"
    lost = spark.createDataFrame([("a", "nowhere", 2), ("b", "a", 3)], schema)
    assert {r.node_id: r.p for r in inherit.handed_down(lost, p=inherit.product(F.col("n"))).collect()} == {"a": 2, "b": 6}
    assert inherit.handed_down(lost.limit(0), p=inherit.product(F.col("n"))).count() == 0
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], schema)
    with pytest.raises(ValueError, match="below itself"):
        inherit.handed_down(ring, p=inherit.product(F.col("n")))


def lines_of(spark, text):
    rows = [("A.cpy", i + 1, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "path string, line_no int, text string")


def test_flat_columns_of_nested_repetition(spark):
    source = "01 R.\n 05 A PIC X(2).\n 05 G OCCURS 3 TIMES.\n  10 B PIC 9(3).\n  10 H OCCURS 2 TIMES.\n   15 C PIC X(4).\n  10 FILLER PIC X.\n 05 D PIC X.\n66 N RENAMES A.\n 88 Z VALUE 1."
    rows = {r.name: r for r in flatten.flattened(layout.layout(lines_of(spark, source))).collect()}
    # what a group's items take is repeated with them, then the group repeats it again
    b, c, d = rows["R_G_B"], rows["R_G_H_C"], rows["R_D"]
    assert (b.offset, b.length, b.occurs, c.offset, c.occurs) == (2, 3, 3, 2 + 3 * 3, 2)
    assert d.offset == 2 + 3 * (3 * 3 + 2 * (2 * 4) + 3 * 1) and d.source_hierarchy == "R"
    assert sorted(rows) == ["R_A", "R_D", "R_G_B", "R_G_H_C"]


def test_flat_columns_of_nothing(spark):
    assert flatten.flattened(layout.layout(lines_of(spark, "no declaration"))).count() == 0


def test_bytes_come_from_the_pass_that_numbers(spark):
    source = "01 R.\n 05 A PIC X(4).\n 05 B REDEFINES A.\n  10 C PIC 9(5) COMP.\n   88 Z VALUE 1.\n  10 D PIC X(2) OCCURS 1 TO 3 TIMES DEPENDING ON N.\n66 N2 RENAMES A.\n 05 A PIC X(6).\n 05 E REDEFINES A PIC X.\n 05 G OCCURS 2 TIMES.\n  10 H PIC X.\n77 L PIC X."
    nodes = layout.layout(lines_of(spark, source))
    got = {(r.seq, r.name): (r.byte_length, r.span_min, r.span_max, r.relative_offset, r.absolute_offset) for r in nodes.collect()}
    assert got == {
        (1, "R"): (12, 12, 12, 0, 0), (2, "A"): (4, 4, 4, 0, 0), (3, "B"): (10, 10, 10, 0, 0), (4, "C"): (4, 4, 4, 0, 0), (5, "Z"): (0, 0, 0, 0, 0), (6, "D"): (2, 2, 6, 4, 4),
        (7, "N2"): (0, 0, 0, 10, 10), (8, "A"): (6, 6, 6, 4, 4), (9, "E"): (1, 1, 1, 4, 4), (10, "G"): (1, 2, 2, 10, 10), (11, "H"): (1, 1, 1, 0, 10), (12, "L"): (1, 1, 1, 12, 12),
    }
    # one pass for all depths: nothing but the declarations is put down
    assert nodes._jdf.queryExecution().logical().toString().count("MapInArrow") == 1
