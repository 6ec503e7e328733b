"""The bulk upsert against a walk row by row, and the versioned store it is written to."""

import random

import pytest

from briarlake.operators import store, upserts
from briarlake.operators.versions import StaleWrite, VersionedStore
from briarlake.scratch import Scratch

STORED = "id long, revision long, identity string, value string"
INCOMING = "seq long, id long, revision long, identity string, value string"


def walked(stored, incoming, require_existing=False):
    """(seq to (disposition, holder), id to (revision, identity, value)) of one row after the other."""
    leads, holder = {}, {}
    for i, r, k, v in sorted(stored):
        leads[i] = (r, k, v)
        if k is not None:
            holder.setdefault(k, i)
    out = {}
    for seq, i, r, k, v in sorted(incoming):
        if i not in leads and require_existing:
            out[seq] = ("missing", None)
        elif k is not None and holder.get(k, i) != i:
            out[seq] = ("duplicate", holder[k])
        elif i in leads and r is not None and r != leads[i][0]:
            out[seq] = ("conflict", None)
        else:
            out[seq] = ("updated" if i in leads else "created", None)
            holder = {a: b for a, b in holder.items() if b != i}
            leads[i] = (leads[i][0] + 1 if i in leads else 1, k, v)
            if k is not None:
                holder[k] = i
    return out, leads


def run(spark, stored, incoming, **how):
    a, b = spark.createDataFrame(stored, STORED), spark.createDataFrame(incoming, INCOMING)
    found, leads = upserts.bulk_upsert(a, b, Scratch(spark, "t"), **how)
    table = upserts.written_leads(a, b, leads, ["value"])
    rows = found.collect()
    assert len(rows) == len(incoming)
    return {r.seq: (r.disposition, r.holder) for r in rows}, {r.id: (r.revision, r.identity, r.value) for r in table.collect()}


@pytest.mark.parametrize(("seed", "how"), [(1, {"few": 0}), (2, {"rounds": 0, "few": 0}), (3, {"require_existing": True, "few": 20}), (4, {"rounds": 1, "few": 0}), (5, {"require_existing": True})])
def test_random_batches_against_a_walk(spark, seed, how):
    """Few ids and identities: conflicts, repeats of an id, identities that move, are released and taken again."""
    draw = random.Random(seed)
    key = lambda: draw.choice([None, *"abcdefgh"])
    stored = [(k, draw.randrange(1, 4), key(), f"s{k}") for k in range(12)]
    incoming = [(n * 3, draw.randrange(20), draw.choice([None, None, 1, 2, 3, 4]), key(), f"n{n}") for n in range(150)]
    assert run(spark, stored, incoming, **how) == walked(stored, incoming, how.get("require_existing", False))


def test_a_conflict_holds_no_identity(spark):
    stored = [(1, 3, "a", "old")]
    incoming = [(1, 1, 2, "b", "stale"), (2, 2, None, "b", "new")]
    assert run(spark, stored, incoming)[0] == {1: ("conflict", None), 2: ("created", None)}


def test_whole_groups_settle_in_few_rounds(spark):
    """A third of the rows share an identity, a third an id without revisions, a third are stale."""
    stored = [(k, 5, f"own{k}", "s") for k in range(50)]
    incoming = [(3 * n, 1000 + n, None, "hot", "x") for n in range(400)] + [(3 * n + 1, 7, None, "own7", f"v{n}") for n in range(400)] + [(3 * n + 2, n % 50, 2, f"own{(n + 1) % 50}" if n % 2 else None, "old") for n in range(400)]
    want = walked(stored, incoming)
    assert run(spark, stored, incoming, rounds=3, few=0) == want


def test_all_or_nothing(spark):
    stored = spark.createDataFrame([(1, 1, "a", "s")], STORED)
    bad = spark.createDataFrame([(1, 1, 1, "a", "x"), (2, 9, None, None, "y")], INCOMING)
    with pytest.raises(upserts.RolledBack):
        upserts.bulk_upsert(stored, bad, Scratch(spark, "t"), require_existing=True, atomic=True)
    assert upserts.bulk_upsert(stored, bad, Scratch(spark, "t"), atomic=True)[1].count() == 2
    assert upserts.bulk_upsert(stored, bad.limit(0), Scratch(spark, "t"))[0].count() == 0


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def test_two_writers_lose_nothing(spark, tmp_path):
    first, second = (VersionedStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    first.commit({"t": table(spark, 1)})
    asked = []

    def slow(tables):
        if not asked:
            second.update(lambda t: {"t": t["t"].unionByName(table(spark, 2))})  # commits while the first is at work
        asked.append(1)
        return {"t": tables["t"].unionByName(table(spark, 3))}

    assert first.update(slow) == 3 and len(asked) == 2
    assert rows(first.read("t")) == [(1,), (2,), (3,)] and rows(second.read("t", 1)) == [(1,)] and rows(second.read("t", 2)) == [(1,), (2,)]
    with pytest.raises(StaleWrite):
        first.commit({"t": table(spark, 9)}, base=1)
    assert first.versions() == [1, 2, 3]


def test_crashed_commits_are_invisible_and_tables_commit_together(spark, tmp_path):
    held = VersionedStore(spark, f"file://{tmp_path}/s")
    assert held.latest() == 0 and held.tables() == {}
    held.commit({"a": table(spark, 1), "b": table(spark, 2)})
    table(spark, 7).write.parquet(f"file://{tmp_path}/s/data/crashed/a")
    with pytest.raises(ZeroDivisionError):
        held.update(lambda t: {"a": table(spark, 1 // 0)})
    assert held.latest() == 1 and rows(held.read("a")) == [(1,)]
    held.commit({"a": table(spark, 5)})
    assert rows(held.read("b")) == [(2,)] and rows(held.read("a", 1)) == [(1,)]  # b stays where it was
    assert held.vacuum(keep=1) == 1 and rows(held.read("a")) == [(5,)] and rows(held.read("b")) == [(2,)]
    with pytest.raises(KeyError):
        held.read("c")


def test_replacing_everything_owns_identities_anew(spark):
    leads = spark.createDataFrame([(3, 0, "k"), (1, 4, "k"), (2, -1, None)], "id long, revision long, identity string")
    made = store.replaced(leads)
    assert rows(made["leads"]) == [(1, 4, "k"), (2, 1, None), (3, 1, "k")]
    assert rows(made["identities"]) == [("k", 1)] and rows(made["conflicts"]) == [("k", 1, 3)]


def test_small_tables_pass_no_driver(spark):
    """Every round joined by broadcasts, whose rows go through the driver: what it took in grew with the rounds and tables."""
    a, b = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "y")], STORED), spark.createDataFrame([(1, 1, None, "b", "p"), (2, 3, None, "c", "q")], INCOMING)
    scratch = Scratch(spark, "t")
    leads = a.select("id", "revision", "identity", a["id"].alias("seq"))
    found = upserts._decided(b, leads, scratch, False)
    frames = found, upserts._after(leads, found), upserts.written_leads(a, b, leads, ["value"]), upserts.bulk_upsert(a, b, scratch)[1]
    assert not any("Broadcast" in f._jdf.queryExecution().executedPlan().toString() for f in frames)
