import datetime

from pyspark.sql import functions as F

from corpusloom.operators.delivery import REPLY_ORDER, MessageStore, deduplicated_replies, message_identifier, repeated_identifiers

SCHEMA = "topic_name string, topic_partition int, msg_offset long, msg_key string, headers map<string,string>, correlation_id string, replied_at timestamp, batch_id string, copies int"
T = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def row(n, cid=None, key=None, headers=None, at=0, batch="b"):
    return ("t", 0, n, key, headers, cid, T + datetime.timedelta(seconds=at) if at is not None else None, batch, 9)


def test_identifier_places_and_copies(spark):
    df = rows(spark, [row(1, " a\n", at=5), row(2, None, "a", at=3), row(3, " ", "", {"correlation_id": " a "}, at=4, batch="c"), row(4, "b"), row(5), row(5), row(6, "", " ", {})])
    kept = deduplicated_replies(df)
    assert kept.columns[-2:] == ["message_id", "copies_1"]  # the input has a column copies
    got = sorted((r["message_id"] or "", r["msg_offset"], r["copies_1"]) for r in kept.collect())
    assert got == [("", 5, 1), ("", 5, 1), ("", 6, 1), ("a", 2, 3), ("b", 4, 1)]
    assert [tuple(r) for r in repeated_identifiers(df).collect()] == [("a", 3)]


def test_empty_table(spark):
    assert deduplicated_replies(rows(spark, [])).count() == 0


def state(store):
    return sorted((r["identifier"] or "", r["copies"], r["item"]["msg_offset"], r["item"]["batch_id"]) for r in store.compacted().collect())


def new_store(spark):
    return MessageStore(spark, message_identifier(F.col("correlation_id"), F.col("msg_key"), F.col("headers")), REPLY_ORDER, buckets=3)


def test_upserts_are_idempotent_and_hot_keys_collapse(spark):
    data = [row(i, "hot" if i % 3 else f"k{i}", at=None if i == 1 else i) for i in range(300)]
    data += [row(400 + i // 2) for i in range(10)] + [row(i, "hot", at=i, batch="again") for i in range(0, 300, 7)] + [row(2, "hot", at=2)]
    df = rows(spark, data)
    one, two, three = (new_store(spark) for _ in range(3))
    one.upsert(df)
    for part in (df.filter("msg_offset % 2 = 1"), df, df.filter("msg_offset % 2 = 0")):
        two.upsert(part)
    first = state(three_times(three, df))
    kept = state(one)
    assert kept == state(two) == first
    assert ("hot", 200 + 43 + 1, 0, "again") in kept
    assert sum(1 for r in kept if not r[0]) == 10 and len(kept) == 101 + 10
    for s in (one, two, three):
        s.drop()


def three_times(store, df):
    """The same batch again after a compaction, and again before one."""
    store.upsert(df)
    store.compact()
    store.upsert(df)
    store.upsert(df)
    return store


def test_sorted_runs_are_merged_without_a_shuffle_or_a_sort(spark):
    df = rows(spark, [row(i, f"k{i % 70}", at=i) for i in range(200)])
    store = new_store(spark)
    store.upsert(df)
    store.upsert(df)
    for kind in ("messages", "deliveries"):
        plan = store._planned(lambda: store.merged(kind, *[t for t, _ in store.runs[kind]])._jdf.queryExecution().executedPlan().toString())  # noqa: B023
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    store.compact()
    assert [len(r) for r in store.runs.values()] == [1, 1]
    own = {table for runs in store.runs.values() for table, _ in runs}
    assert own <= {t.name for t in spark.catalog.listTables()}
    store.drop()
    assert not own & {t.name for t in spark.catalog.listTables()}


def test_equal_splits_of_the_query(spark):
    from corpusloom.operators.delivery import reply_store

    df = rows(spark, [row(i, f"k{i % 20}" if i % 5 else None, at=i, batch=f"b{i % 6}") for i in range(100)])
    states = []
    for runs in (1, 2, 5):
        store = reply_store(df, runs)
        states.append(state(store))
        store.drop()
    assert states[0] == states[1] == states[2]
