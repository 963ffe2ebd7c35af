"""Keyed state: golden cases and a seeded model."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import chain, keyed, merge, visibility
from tidelog.plans.envelope import enveloped
from tidelog.plans.errors import KeyLimitExceeded, MissingTarget, StaleCursor, UsageError, VersionMismatch, classify
from tidelog.operators.scan import blocks

PUT, OP, DEL = "PUT", "OP", "TOMBSTONE"


def log(spark, rows, value="string"):
    df = spark.createDataFrame([(i, k, kind, v) for i, (kind, k, v) in enumerate(rows)], f"sequence long, key long, kind string, value {value}")
    return enveloped(df.withColumn("record_ord", F.col("sequence")).withColumn("block_id", F.lit(1).cast("long")))


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns or ("key", "value")) for r in df.collect())


def test_merge_folds_operations_and_tombstones(spark):
    base = log(spark, [(PUT, 1, "base"), (PUT, 2, "delete-me")])
    delta = log(spark, [(OP, 1, "renamed"), (DEL, 2, None), (PUT, 3, "new")])
    assert pairs(merge.merge(base, delta)) == [(1, "renamed"), (3, "new")]


def test_a_later_shard_wins_with_a_lower_sequence(spark):
    base = log(spark, [(PUT, 9, str(i)) for i in range(5)])
    assert pairs(merge.merge(base, log(spark, [(DEL, 9, None)]))) == []


def test_materialized_and_latest_differ(spark):
    one = log(spark, [(PUT, 10, "put"), (OP, 10, "after-op"), (PUT, 11, "x"), (DEL, 11, None)])
    assert pairs(keyed.materialize_last(one)) == [(10, "after-op")]
    assert pairs(keyed.latest(one)) == [(10, "put")]


def test_a_tombstone_hides_but_history_stays(spark):
    one = log(spark, [(PUT, 12, "a"), (DEL, 12, None)])
    assert pairs(keyed.latest(one)) == [] and keyed.history(one).count() == 1
    wanted = spark.createDataFrame([(12,), (13,)], "key long")
    assert pairs(keyed.lookup(one, wanted), "key", "state") == [(12, "Tombstone"), (13, "Missing")]


def test_compact_copies_one_block_only(spark):
    one = log(spark, [(PUT, 20, "a"), (OP, 20, "after-op"), (PUT, 21, "b"), (DEL, 21, None), (PUT, 22, "final"), (PUT, 5, "other")])
    one = one.withColumn("target_block_id", F.when(F.col("key") == 5, 2).otherwise(1))
    assert pairs(merge.compact(one, 1)) == [(20, "after-op"), (22, "final")]


def test_a_replacement_keeps_its_sequence(spark):
    one = log(spark, [(PUT, 1, "old"), (PUT, 1, "newer")])
    assert pairs(keyed.latest(merge.replace_at(one, 1, 0, value="replaced"))) == [(1, "newer")]
    assert pairs(keyed.latest(merge.replace_fixed(one, 0, 99, value="fixed"))) == [(1, "fixed")]
    with pytest.raises(UsageError):
        merge.replace_at(one, 1, 0, key=2)


def test_orphans(spark):
    one = log(spark, [(OP, 1, "x"), (PUT, 2, "y"), (DEL, 2, None), (OP, 2, "z")])
    with pytest.raises(MissingTarget):
        keyed.materialize_last(one)
    assert pairs(keyed.materialize_last(one, orphans="skip")) == []
    assert pairs(keyed.orphans_of(one), "sequence") == [(0,), (3,)]


def test_key_limit_counts_tombstoned_keys(spark):
    one = log(spark, [(PUT, 1, "a"), (PUT, 2, "b"), (DEL, 2, None)])
    merge.guard_keys(one, 2)
    with pytest.raises(KeyLimitExceeded):
        merge.merge(one, key_limit=1)


def test_versions_and_null_keys_are_refused(spark):
    one = log(spark, [(PUT, 1, "a")]).withColumn("block_version", F.lit(2))
    with pytest.raises(Exception) as e:
        blocks(one, 1, 1).collect()
    assert classify(e.value)[0] == VersionMismatch.domain
    with pytest.raises(Exception, match="a key is null"):
        keyed.latest(log(spark, [(PUT, None, "a")])).collect()


def test_chains_cross_tombstones_and_skip_operations(spark):
    one = log(spark, [(PUT, 1, "a"), (OP, 1, "b"), (DEL, 1, None), (PUT, 1, "c")])
    got = {r["record_ord"]: r["prev_same_key"] for r in chain.walk(chain.key_chain(one), "prev_same_key").collect()}
    assert got == {0: None, 2: 0, 3: 2}


def test_dead_records_are_visible_until_defragmented(spark):
    one = merge.mark_dead(log(spark, [(PUT, i, "a") for i in range(6)]), F.col("record_ord") == 2)
    assert one.count() == 6 and one.where("is_dead").count() == 1
    links = {r["record_ord"]: r["prev_same_block"] for r in merge.defragment(one).collect()}
    assert links == {0: None, 1: 0, 3: 1, 4: 3, 5: 4}


def test_no_marker_means_nothing_is_visible(spark):
    one = log(spark, [(PUT, 1, "a"), ("COMMIT", None, None), (PUT, 2, "b")])
    assert visibility.committed(one).count() == 2
    assert visibility.committed(one.where("kind <> 'COMMIT'")).count() == 0


def test_snapshots_only_go_forward(spark):
    one = log(spark, [(PUT, 1, "a"), (PUT, 1, "b")]).withColumn("generation", F.col("sequence"))
    s = visibility.Snapshot(one, 0)
    assert s.read().count() == 1 and not s.is_current()
    assert s.follow(1).count() == 1 and s.is_current()
    with pytest.raises(StaleCursor):
        s.follow(0)
    s.release()
    with pytest.raises(StaleCursor):
        s.latest()
    assert s.read().count() == 2


def test_model(spark):
    rnd = random.Random(3)
    rows, live, state = [], set(), {}
    for _ in range(400):
        k = rnd.randrange(12)
        kind = rnd.choice([PUT, OP, OP, DEL]) if k in live else PUT
        v = float(rnd.randrange(100))
        rows.append((kind, k, v))
        if kind == PUT:
            state[k], _ = v, live.add(k)
        elif kind == OP:
            state[k] += v
        else:
            live.discard(k)
            state.pop(k)
    one = log(spark, rows, "double")
    assert pairs(keyed.materialize_sum(one)) == sorted(state.items())
    assert pairs(keyed.materialize_fold(one, lambda s, v: s + v)) == sorted(state.items())


def test_empty_log(spark):
    none = log(spark, [(PUT, 1, "a")]).limit(0)
    for df in (keyed.latest(none), keyed.materialize_last(none), chain.key_chain(none), visibility.committed(none), merge.defragment(none)):
        assert df.count() == 0
