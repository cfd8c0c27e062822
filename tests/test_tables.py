"""Rules, facts and laws of keyed tables."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bagwright.functions.domains import RuleError, enum
from bagwright.functions.expressions import any_, count, div, floor_, hashed, lift, max_, mean, mod, now, sum_, to_real
from bagwright.operators.table import cond, disjoint, disjointness_check, evaluate, folds, row
from bagwright.operators.validation import grouped_folds, stratified_folds, temporal_folds
from bagwright.sources.stores import apply_deltas, bag_source, conforms, insert, materialise, outlives, references, store, update, validate

XY = enum("x", "y")


@pytest.fixture(scope="module")
def bag(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 3), float(rng.randint(0, 9)), rng.random() < 0.5, rng.choice("xy")) for k in range(12) for _ in range(rng.randint(0, 3))]
    return bag_source(spark.createDataFrame(rows, "k int, a int, b double, f boolean, e string"), ["k"], domains={"e": XY}).assume()


@pytest.fixture(scope="module")
def single(spark):
    return store(spark.createDataFrame([(1, 5, "x", None), (2, 7, "y", 3), (3, 9, "x", 4)], "k int, a int, e string, o int"), ["k"], domains={"e": XY}, optional=("o",))


def rows(t):
    return Counter(map(tuple, t.to_df().collect()))


def test_laws_of_split_and_bind(bag):
    a, b = bag.split(lambda k: k.k < 5)
    assert disjoint(a.type, b.type) and not disjoint(a.type, bag.type)
    assert rows(a.bind(b)) == rows(bag) and a.bind(b) is bag
    assert rows(a) + rows(b) == rows(bag)
    assert rows(a.select("a").bind(b.select("a"))) == rows(b.select("a").bind(a.select("a")))
    f = lambda t: t.extend_key("e").group_map(lambda k, g: row(s=sum_(g.a), n=count(g.b)))
    assert rows(f(a).bind(f(b))) == rows(f(bag))
    assert f(a).bind(f(b)).type.singletons
    # Grouping doesn't distribute over an overlapping bind, nor a smaller key over a split.
    assert rows(f(bag.bind(bag))) != rows(f(bag).bind(f(bag)))
    g = lambda t: t.extend_key("e").assume(complete=True).shrink_key("k").group_map(lambda k, g: row(n=count(g.a)))
    assert rows(g(a).bind(g(b))) != rows(g(bag))
    assert not disjoint(g(a).type, g(b).type)


def test_map_forms(single, bag):
    assert rows(single.map(lambda k, r: r)) == rows(single)
    twice = single.map(lambda k, r: (row(v=r.a), row(v=-r.a)))
    assert not twice.type.singletons and twice.df.count() == 6
    guarded = single.map(lambda k, r: cond(r.a > 5, (row(v=r.a), row(v=lift(0))), row(v=k.k)))
    assert rows(guarded) == Counter([(1, 1), (2, 7), (2, 0), (3, 9), (3, 0)])
    one = single.map(lambda k, r: cond(r.e == "x", row(v=r.a), row(v=r.a * 2)))
    assert one.type.singletons and rows(one) == Counter([(1, 5), (2, 14), (3, 9)])
    assert rows(single.map(lambda k, r: cond(r.o.is_known(), lambda own: row(v=own.o + 1), row(v=0)))) == Counter([(1, 0), (2, 4), (3, 5)])
    assert not single.filter(lambda k, r: r.o.is_known()).type.field("o").optional
    assert rows(single.map(lambda k, r: row(v=r.o.default(0)))) == Counter([(1, 0), (2, 3), (3, 4)])


def test_groups(single, bag, spark):
    got = bag.group_map(lambda k, g: row(m=mean(g.b), top=max_(g.a), some=any_(g.f), has=lift("x").is_in(g.e)))
    want = {}
    for k, a, b, f, e in bag.df.collect():
        want.setdefault(k, []).append((a, b, f, e))
    assert {r[0]: r[1:] for r in map(tuple, got.df.collect())} == {k: (sum(x[1] for x in v) / len(v), max(x[0] for x in v), any(x[2] for x in v), any(x[3] == "x" for x in v)) for k, v in want.items()}
    plan = single.group_map(lambda k, g: row(s=sum_(g.a), n=count(g.a))).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    whole = bag_source(spark.createDataFrame([], "a int"), [])
    assert whole.group_map(lambda k, g: row(n=count(g.a))).df.count() == 0
    assert rows(bag.group_map(lambda k, g: row(v=to_real(g.a)))) == rows(bag.map(lambda k, r: row(v=to_real(r.a))))
    assert rows(bag.distinct()) == Counter(dict.fromkeys(rows(bag), 1))


def test_joins(single, bag):
    right = single.map(lambda k, r: row(z=r.a))
    left = bag.select("a").left_join(right, lambda k, r: k.k)
    assert left.type.field("z").optional and left.df.count() == bag.df.count()
    inner = bag.select("a").inner_join(right, lambda k, r: k.k)
    assert rows(inner) + rows(bag.select("a").anti_join(right, lambda k, r: k.k).map(lambda k, r: row(a=r.a, z=lift(0)))) != rows(left)
    assert inner.df.count() + bag.anti_join(right, lambda k, r: k.k).df.count() == left.df.count()
    many = single.select("a").left_join(bag.select("b"), lambda k, r: k.k)
    assert not many.type.singletons


def test_shapes(spark):
    t = store(spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "k int, x double, y double"), ["k"], optional=("y",), complete=True)
    long = t.unpivot("x", "y")
    assert rows(long) == Counter([(1, "x", 2.0), (1, "y", None), (2, "x", 3.0), (2, "y", 4.0)])
    assert rows(long.pivot_index("name", "value")) == rows(t)
    assert rows(long.shrink_key("name").pivot("name", "value")) == rows(t)
    other = t.map(lambda k, r: row(x=r.x))
    tagged = other.tagged_bind(other, "one", "two")
    assert rows(tagged.tagged_split("one")) == rows(other)


REJECTED = [
    lambda s, b: b.map(lambda k, r: ()),
    lambda s, b: b.map(lambda k, r: row(k=r.a)),
    lambda s, b: b.map(lambda k, r: cond(r.f, row(v=r.a), row(w=r.a))),
    lambda s, b: b.map(lambda k, r: cond(r.f, row(v=r.a), row(v=r.b))),
    lambda s, b: b.map(lambda k, r: row(v=r.a + r.b)),
    lambda s, b: b.map(lambda k, r: row(v=r.a / r.a)),
    lambda s, b: b.map(lambda k, r: row(v=r.e < "y")),
    lambda s, b: b.map(lambda k, r: row(v=r.b == 1.0)),
    lambda s, b: b.map(lambda k, r: row(v=r.e == "z")),
    lambda s, b: b.map(lambda k, r: row(v=r.nothing)),
    lambda s, b: b.filter(lambda k, r: r.a),
    lambda s, b: s.map(lambda k, r: row(v=r.o + 1)),
    lambda s, b: b.group_map(lambda k, g: row(v=g.a + 1)),
    lambda s, b: b.group_map(lambda k, g: row(v=g.a, n=count(g.a))),
    lambda s, b: b.group_map(lambda k, g: row(k=count(g.a))),
    lambda s, b: b.group_map(lambda k, g: row(v=sum_(g.e))),
    lambda s, b: s.group_map(lambda k, g: row(v=sum_(g.o))),
    lambda s, b: b.group_map(lambda k, g: row(v=sum_(k.k))),
    lambda s, b: b.split(lambda k: k.a > 1),
    lambda s, b: b.split(lambda k: k.k),
    lambda s, b: b.bind(s),
    lambda s, b: b.left_join(b, lambda k, r: k.k),
    lambda s, b: b.left_join(s.select("e").map(lambda k, r: row(q=r.e)), lambda k, r: r.b),
    lambda s, b: b.extend_key(),
    lambda s, b: b.extend_key("b"),
    lambda s, b: s.extend_key("o"),
    lambda s, b: b.extend_key("k"),
    lambda s, b: b.shrink_key("k"),
    lambda s, b: b.select("e", "a").pivot("e", "a"),
    lambda s, b: s.unpivot("a"),
    lambda s, b: s.pivot_index("e", "a"),
    lambda s, b: b.completeness_check(lambda t: False),
    lambda s, b: evaluate(b, b, lambda d: 0, lambda m, d: 0),
    lambda s, b: disjointness_check(b, b),
    lambda s, b: references(b, "a", s),
    lambda s, b: conforms(s, s.type.field("a"), b.type.field("b")),
]


@pytest.mark.parametrize("pipeline", REJECTED, ids=range(len(REJECTED)))
def test_rejected(pipeline, single, bag):
    with pytest.raises(RuleError):
        pipeline(single, bag)


def test_sources(spark, single, bag):
    assert validate(single) is single
    twice = store(spark.createDataFrame([(1, "x"), (1, "q")], "k int, e string"), ["k"], domains={"e": XY})
    with pytest.raises(RuleError, match="no variant"):
        validate(twice)
    with pytest.raises(RuleError, match="share the key"):
        validate(store(twice.df.select("k"), ["k"]))
    with pytest.raises(RuleError, match="missing"):
        validate(store(spark.createDataFrame([(None, 1)], "k int, a int"), ["k"]))
    assert materialise(single, "made_store") and not materialise(single, "made_store")
    changed = apply_deltas(single.select("a"), spark.createDataFrame([(1, 5, -1), (9, 9, 2)], "k long, a long, weight long"))
    assert rows(changed) == Counter({(2, 7): 1, (3, 9): 1, (9, 9): 2})
    for train, test in folds(single, 2, lambda k: k.k):
        assert evaluate(train, test, lambda d: d.count(), lambda m, d: m + d.count()) == 3


def test_declared_facts(spark, single, bag):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "k long, j long, a long")
    t = store(df, ["k", "j"], complete_over=("j",))
    assert rows(t.shrink_key("j").group_map(lambda k, g: row(n=count(g.a)))) == Counter({(1, 2): 1, (2, 1): 1})
    bad = [
        lambda: t.shrink_key("k"),
        lambda: store(df, ["k", "j"], complete_over=("a",)),
        lambda: insert(t, spark.createDataFrame([(9, 9, 9)], "k long, j long, a long")).shrink_key("j"),
        lambda: t.bind(store(df, ["k", "j"])).shrink_key("j"),
    ]
    for f in bad:
        with pytest.raises(RuleError):
            f()
    a, b, c = (store(df.filter(f"k = {k}"), ["k", "j"], block=("cohort", str(k))) for k in (1, 2, 3))
    other = store(df, ["k", "j"], block=("region", "1"))
    assert disjoint(a.type, b.type) and a.bind(b).type.singletons
    assert disjoint(a.bind(b).type, c.type) and not disjoint(a.bind(b).type, b.type)
    assert not disjoint(a.type, a.type) and not disjoint(a.type, other.type) and not disjoint(a.type, t.type)
    x, y = a.split(lambda k: k.j < 2)
    assert disjoint(x.type, y.type) and disjoint(x.type, b.type) and evaluate(x, b, lambda d: d.count(), lambda m, d: m + d.count()) == 2
    assert rows(bag_source(df.select("k", "a"), ["k"]).cardinality(single)) == Counter({(1, 2): 1, (2, 1): 1, (3, 0): 1})
    for f in (lambda: bag.cardinality(bag), lambda: t.cardinality(single), lambda: single.cardinality(single, "k")):
        with pytest.raises(RuleError):
            f()
    assert single.map(lambda k, r: row(t=now())).df.distinct().count() <= 3 and single.map(lambda k, r: row(late=now() < dt.datetime(2020, 1, 1))).df.filter("late").isEmpty()


def test_folds(spark, bag):
    rng = random.Random(5)
    # Half of all rows in one stratum, one stratum missing, one of a single row; the keys are texts and numbers.
    data = [(i, f"w{i % 7}", rng.choice(["a", "a", "b", None]), i % 5, i) for i in range(300)] + [(900, "w", "lone", 0, 900)]
    t = store(spark.createDataFrame(data, "k long, w string, s string, g long, day long"), ["k", "w"], optional=("s",))
    everything = rows(t)
    for parts in (1, 4, 4096):
        made = stratified_folds(t, 3, "s", parts=parts)
        sizes = [Counter(r.s for r in test.df.collect()) for _, test in made]
        for s in ("a", "b", None, "lone"):
            n = [x[s] for x in sizes]
            assert max(n) - min(n) <= 1 and sum(n) == sum(1 for d in data if d[2] == s)
        for train, test in made:
            assert disjoint(train.type, test.type) and rows(train) + rows(test) == everything
            assert evaluate(train, test, lambda d: d.count(), lambda m, d: m + d.count()) == len(data)
    groups = [(({r.g for r in a.df.collect()}), {r.g for r in b.df.collect()}) for a, b in grouped_folds(t, 3, "g")]
    assert all(not a & b and a | b == set(range(5)) for a, b in groups)
    timed = temporal_folds(t, "day", 100, 200)
    assert [(a.df.count(), b.df.count()) for a, b in timed] == [(100, 100), (200, 101)] and all(disjoint(a.type, b.type) for a, b in timed)
    empty = store(t.df.limit(0), ["k", "w"], optional=("s",))
    assert all(not rows(a) and not rows(b) for a, b in stratified_folds(empty, 2, "s"))
    bad = [
        lambda: stratified_folds(bag, 2, "a"),
        lambda: stratified_folds(t, 1, "s"),
        lambda: stratified_folds(t, 2),
        lambda: grouped_folds(t, 2),
        lambda: grouped_folds(t, 2, "s"),
        lambda: grouped_folds(t, 2, "g", number=lambda k: k.k),
        lambda: temporal_folds(t, "day"),
        lambda: temporal_folds(t, "day", 5, 5),
        lambda: temporal_folds(t, "w", "a"),
    ]
    for f in bad:
        with pytest.raises(RuleError):
            f()


def test_intervals(spark, tmp_path):
    from bagwright.streaming.windows import join_valid

    uses = spark.createDataFrame([(1, "c", 5), (2, "c", 9), (3, "d", 1), (4, None, 1), (5, "c", None), (6, "none", 3)], "id long, of string, at long")
    terms = spark.createDataFrame([("c", 0, 9), ("c", 9, 12), ("d", 0, None), ("e", 0, 2)], "of string, since long, until long")
    view = lambda df, how: join_valid(df, terms, ["of"], "at", "since", "until", how)
    assert {(r.id, r.since) for r in view(uses, "inner").collect()} == {(1, 0), (2, 9), (3, 0)}
    assert {(r.id, r.since) for r in view(uses, "left").collect()} == {(1, 0), (2, 9), (3, 0), (4, None), (5, None), (6, None)}
    uses.write.parquet(str(tmp_path / "in"))
    q = view(spark.readStream.schema(uses.schema).parquet(str(tmp_path / "in")), "left").writeStream.format("memory").queryName("valid_uses").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("valid_uses").collect()} == {tuple(r) for r in view(uses, "left").collect()}
    with pytest.raises(ValueError):
        join_valid(uses, terms.withColumn("id", F.lit(1)), ["of"], "at", "since", "until")
    ends = store(terms.filter("since = 0").select("of", "since", "until"), ["of"], optional=("until",))
    held = store(uses.filter("id IN (1, 3, 4)"), ["id"], optional=("of", "at"))
    assert outlives(held, "of", "at", ends, "since", "until") is held
    for k in (2, 5, 6):
        with pytest.raises(RuleError, match="no key"):
            outlives(store(uses.filter(f"id IN (1, {k})"), ["id"], optional=("of", "at")), "of", "at", ends, "since", "until")


def test_stream(spark, tmp_path):
    from bagwright.streaming.windows import latest, windowed

    spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:50:00", 2.0), (2, "2024-01-01 02:00:00", 3.0), (2, "2024-01-03 00:00:00", 4.0)], "u int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    view = lambda d: windowed(d, "ts", "1 hour", ["u"], [F.sum("v").alias("s")], late="1 hour")
    q = view(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    closed = {tuple(r) for r in spark.table("closed").collect()}
    assert closed and closed < {tuple(r) for r in view(batch).collect()}  # the last window is still open
    q = latest(stream, ["u"], "ts", "v").writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.u: r.v for r in spark.table("newest").collect()} == {1: 2.0, 2: 4.0}


def test_large_deltas_and_ingestion(spark, single, bag):
    changed = apply_deltas(single.select("a"), spark.createDataFrame([(1, 5, 200_000), (9, 9, 131_072)], "k long, a long, weight long"))
    assert changed.df.groupBy("k").count().filter("k IN (1, 9)").agg(F.sum("count")).first()[0] >= 331_072
    t = store(spark.createDataFrame([(1, 2), (3, 4)], "k long, a long"), ["k"], checked=True)
    with pytest.raises(RuleError, match="share the key"):
        insert(t, spark.createDataFrame([(1, 9)], "k long, a long"))
    with pytest.raises(RuleError, match="share the key"):
        store(spark.createDataFrame([(1, 2), (1, 4)], "k long, a long"), ["k"], checked=True)
    grown = insert(t, spark.createDataFrame([(5, 6)], "k long, a long"))
    assert rows(update(grown, lambda k, r: k.k > 2, a=lambda k, r: r.a * 10)) == Counter({(1, 2): 1, (3, 40): 1, (5, 60): 1})
    with pytest.raises(RuleError, match="ties"):
        bag.ordered("a", before=("lag", "a"))
    for bad in (lambda r: floor_(r.a), lambda r: div(r.a, 0), lambda r: mod(r.a, r.a)):
        with pytest.raises(RuleError):
            t.map(lambda k, r, bad=bad: row(x=bad(r)))
    parts = t.map(lambda k, r: row(part=hashed(4, k.k, r.a))).df.collect()
    assert all(0 <= r.part < 4 for r in parts)


def test_stream_operators(spark, tmp_path):
    """Rows, joins with a fixed side, splits and binds on a stream give what the batch gives; so does a refreshed view."""
    from bagwright.streaming.windows import refreshed

    spark.createDataFrame([(i, i % 3, float(i)) for i in range(40)], "k long, g long, v double").repartition(4).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    names = store(spark.createDataFrame([(0, "a"), (1, "b")], "g long, name string"), ["g"])

    def pipeline(df):
        t = store(df, ["k"]).map(lambda k, r: cond(r.v > 3.0, row(g=r.g, v=r.v * 2.0), ()))
        even, odd = t.split(lambda k: mod(k.k, 2) == 0)
        halves = even.map(lambda k, r: row(g=r.g, v=r.v + 1.0)).bind(odd)
        return halves.left_join(names, lambda k, r: r.g).df

    q = pipeline(stream).writeStream.format("memory").queryName("rows_of_stream").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = Counter(tuple(r) for r in pipeline(batch).collect())
    assert Counter(tuple(r) for r in spark.table("rows_of_stream").collect()) == want and len(want) == 36
    view, saved, batches = (lambda df: df.groupBy("g").agg(F.sum("v").alias("s"))), {}, []

    def save(changes, batch_id):
        batches.append(batch_id)
        saved.update({r.g: r.s for r in changes.collect()})

    q = refreshed(stream, view, save, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert saved == {r.g: r.s for r in view(batch).collect()} and len(batches) > 1
