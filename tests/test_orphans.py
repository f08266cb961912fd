import datetime as dt

from pyspark.sql import functions as F

from basinweave.operators import orphans as O

T = [dt.datetime(2024, m, 1) for m in range(1, 7)]


def tables(spark, refs, ents):
    r = spark.createDataFrame(refs, "triple_id string, ref string, created_at timestamp, to_key string")
    e = spark.createDataFrame(ents, "id string, created_at timestamp, refs string")
    return O.reference_rows(r, "triples", "triple_id", F.col("ref"), "created_at", O.ENTITY_KEY), O.existence_rows(e, "id", "created_at")


A, B, C = "cap-0123456789", "wld-aaaaaaaaaa", "src-ffffffffff"


def test_missing_late_and_clean(spark):
    refs = [
        ("t1", A, T[2], "x"), ("t2", f" {A.upper()}\t", T[0], "x"), ("t3", B, T[1], "x"), ("t3", B, T[1], "x"), ("t4", "literal", T[1], "x"), ("t5", None, T[1], "x"), ("t6", " ", T[1], "x"),
        ("t7", C, None, "x"), (None, C, T[1], "x"), ("t8", A, T[1], "x"), ("t9", A, None, "x"),
    ]
    ents = [(A, T[3], "x"), (A.upper() + " ", T[1], "x"), (None, T[0], "x")]
    got = {tuple(r) for r in O.orphan_references(*tables(spark, refs, ents)).collect()}
    assert got == {("triples", "2024-01", "t2", A, "late"), ("triples", "2024-02", "t3", B, "missing"), ("triples", None, "t7", C, "missing")}
    assert O.orphan_references(*tables(spark, [], ents)).count() == 0
    assert O.orphan_references(*tables(spark, refs, [])).where("reason != 'missing'").count() == 0


def test_deltas_merge(spark):
    refs, exists = tables(spark, [("t1", A, T[2], "x"), ("t2", B, T[2], "x")], [(A, T[0], "x")])
    state = O.key_state(O.reference_deltas(refs).unionByName(O.existence_deltas(exists)))
    assert [r.to_key for r in O.orphan_keys(state).collect()] == [B]
    _, more = tables(spark, [], [(B, T[0], "x")])
    state = O.merge_state(state, O.existence_deltas(more))
    assert O.orphan_keys(state).count() == 0
    state = O.merge_state(state, O.existence_deltas(exists, -1))
    assert [r.to_key for r in O.orphan_keys(state).collect()] == [A]
    state = O.merge_state(state, O.reference_deltas(refs, -1))
    assert O.orphan_keys(state).count() == 0


def test_hot_key(spark):
    refs = spark.range(30000).select(F.concat(F.lit("t"), "id").alias("triple_id"), F.lit(B).alias("ref"), F.lit(T[0]).alias("created_at"))
    rows = O.reference_rows(refs, "triples", "triple_id", F.col("ref"), "created_at", O.ENTITY_KEY)
    found = O.orphan_references(rows, tables(spark, [], [(A, T[0], "x")])[1])
    assert O.orphan_counts(found).first()["refs"] == 30000


def test_deltas_that_are_taken_back(spark):
    """A key created early, deleted and created again late is late for the references between; a withdrawn reference makes none late."""
    day = lambda m, d=1: dt.datetime(2024, m, d)
    ref = spark.createDataFrame([("t", "r1", "k", day(5)), ("t", "r2", "j", day(6))], "tbl string, from_key string, to_key string, ref_at timestamp")
    gone = spark.createDataFrame([("t", "r0", "j", day(1))], "tbl string, from_key string, to_key string, ref_at timestamp")
    made = lambda rows: spark.createDataFrame(rows, "to_key string, created_at timestamp")
    state = O.timed_state(O.reference_deltas(ref.unionByName(gone)).unionByName(O.existence_deltas(made([("k", day(1)), ("j", day(3))]))))
    state = O.merge_state(state, O.existence_deltas(made([("k", day(1))]), -1).unionByName(O.reference_deltas(gone, -1)))
    missing = {tuple(r)[2:] for r in O.orphan_references(ref, made([]), state).collect()}
    assert missing == {("r1", "k", "missing")}
    state = O.merge_state(state, O.existence_deltas(made([("k", day(9))])))
    found = O.orphan_references(ref, made([]), state).collect()
    full = O.orphan_references(ref, made([("k", day(9)), ("j", day(3))])).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in full} == {("t", "2024-05", "r1", "k", "late")}
