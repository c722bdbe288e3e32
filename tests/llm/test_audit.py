"""The filter audit against removing documents one by one, for every order."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from penprint.llm import audit


def test_intervals_are_the_orders_in_the_dictionary():
    for filters in (1, 2, 3, 5):
        orders = list(permutations(range(filters)))
        gone = Counter()
        for mask, step, start, end in audit.intervals(filters):
            for rank in range(start, end):
                gone[mask, rank] = step if (mask, rank) not in gone else 99
        assert gone == {(m, r): next(s for s, f in enumerate(order, 1) if m >> f & 1) for m in range(1, 1 << filters) for r, order in enumerate(orders)}


def plain(docs, labels, conditions):
    """Rows of the audit by applying every order from left to right. ``docs``: id, text, part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = [(i, t or "", p or "") for i, t, p in docs]
    failing = []
    for i, text, part in docs:
        fails = {name for name, holds in conditions.items() if holds(text)}
        if i is not None and any(j is not None and j < i and other == text for j, other, _ in docs):
            fails.add("E")
        failing.append((i, part, fails))
    names = [*conditions, "E"]
    out = []
    for part in {p for _, p, _ in failing}:
        own = [(i, f) for i, p, f in failing if p == part]
        rows, shapley = [], Counter()
        for order in permutations(names):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                             sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name))
        out += [(*row[:-1], shapley[row[-1]]) for row in rows]
    return out


CONDITIONS = {
    "A": lambda t: len(t.split()) < 200,
    "B": lambda t: 100 * len(set(t.split())) < 50 * len(t.split()),
    "C": lambda t: 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
    "D": lambda t: any(c in "#$%&*|" for c in t),
}


def test_audit_of_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, many, "a"), (2, many, "a"), (3, many, "b"), (4, None, "a"), (5, "", None), (6, "", ""), (7, "AB c\td\x0be f", "a"), (8, "x " * 300, "b"), (8, "x " * 300, "b"),
        (9, many + " #", "c"), (10, many.upper(), "c"), (None, many, "c"), (None, "odd", "c"), (11, "É" * 10 + "   " + "ß|", "b"), (12, "y" * 200_000, "a")]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (8, 0, 0), (8, 1, 0), (99, 1, 1), (None, 1, 1), (7, None, None), (4, 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'z' AS part", "2 AS n")
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    conditions = audit.quality_conditions(F.coalesce(F.col("text"), F.lit("")))
    got = audit.filter_audit(df, named, conditions).collect()
    # Of the plain version's white space only the ASCII kind occurs in these texts, but for one blank that joins nothing.
    assert Counter(map(tuple, got)) == Counter(plain(docs, labels, CONDITIONS | {"A": lambda t: len(t.replace(" ", "n").split()) < 200}))
    none = audit.filter_audit(df.limit(0), named.limit(0), conditions)
    assert none.count() == 0 and none.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_a_document_of_a_hot_text_is_a_copy_of_the_first_alone(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    masks = audit.failure_masks(df, {}, "E")
    assert {tuple(r) for r in masks.groupBy("part", "mask").count().collect()} == {("0", 0, 1), ("0", 1, 1499), ("1", 1, 1500)}
