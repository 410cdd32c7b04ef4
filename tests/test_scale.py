"""Parts of the core that must work at any size: components, places in an order, choices in order, promotion, chains, bundles."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark import AccumulatorParam
from pyspark.sql import functions as F

from tamis.functions import metrics
from tamis.operators import audit, linkage, order, units
from tamis.operators.components import components
from tamis.operators.storage import stored
from tamis.sources import bundle, documents
from tamis.streaming import audit as appended


class Most(AccumulatorParam):
    def zero(self, value):
        return [0]

    def addInPlace(self, a, b):
        return max(a, b)


def joined(edges):
    """Union-find in plain Python."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    for n, m in ((30, 10), (60, 50), (200, 260)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        got = components(spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")).collect()
        assert {x["node"]: x["root"] for x in got} == joined(edges) and len(got) == len(joined(edges))
    named = linkage.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "z")], "left_id string, right_id string"), spark.createDataFrame([("a",), ("b",), ("c",), ("q",), ("z",)], "id string"))
    assert {tuple(x) for x in named.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("q", "q"), ("z", "z")}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["random", "sorted"])
def test_components_of_long_paths_settle(spark, how):
    n, sizes = 10_000, []
    id_ = (lambda x: F.xxhash64(x)) if how == "random" else (lambda x: x)
    edges = spark.range(n - 1).select(id_(F.col("id")).alias("a"), id_(F.col("id") + 1).alias("b"))

    def counted(df):
        out = stored(df)
        sizes.append(out.count() if df.columns == ["a", "to"] else 0)
        return out

    got = components(edges, keep=counted)
    least = spark.range(n).select(F.min(id_(F.col("id")))).first()[0]
    assert got.agg(F.min("root"), F.max("root"), F.count("*")).first()[:] == (least, least, n)
    rounds = [x for x in sizes if x]
    # each round leaves half of the nodes at most
    assert rounds[0] == n and all(2 * y <= x for x, y in zip(rounds, rounds[1:], strict=False)) and len(rounds) <= 14


def test_components_of_a_hub(spark):
    edges = spark.range(1, 20_000).select(F.lit(70_000).alias("a"), F.col("id").alias("b"))
    assert components(edges).agg(F.max("root"), F.count("*")).first()[:] == (1, 20_000)


def test_places_and_their_faults(spark):
    r = random.Random(2)
    rows = [(r.choice("xyz"), f"{r.random():.12f}") for _ in range(2000)]
    got = order.numbered(spark.createDataFrame(rows, "g string, v string").repartition(6), "g", "v").collect()
    for g in "xyz":
        assert [x["v"] for x in sorted((x for x in got if x["g"] == g), key=lambda x: x["place"])] == sorted(v for k, v in rows if k == g)
        assert {x["place"] for x in got if x["g"] == g} == set(range(1, sum(k == g for k, _ in rows) + 1))
    picks = [(r.choice("xyz"), k) for k in r.sample(range(1, 50_000), 3000)]
    of = {g: sorted(k for h, k in picks if h == g) for g in "xyz"}
    table = spark.createDataFrame(picks, "kind string, pick_order int")
    assert order.kth(table, {"x": 1, "y": 500, "z": 10_000, "q": 1}, width=100) == {"x": of["x"][0], "y": of["y"][499]}
    assert {(x["kind"], x["pick_order"]): x["place"] for x in order.ranks(table, width=100).collect()} == {(g, k): i for g in "xyz" for i, k in enumerate(of[g], 1)}
    values = [f"{k:05d}" for k in range(500)]
    for k in (7, 123, 499):
        values[k] = values[k - 1]
    values[250], values[300] = "00001", "99999"
    want = {k: "repeat" if v == p else "inversion" for k, (p, v) in enumerate(zip(values, values[1:], strict=False), 1) if v <= p}
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found = order.order_violations(spark.createDataFrame(list(enumerate(values)), "at long, by string"), "at", "by").collect()
        assert {x["at"]: x["fault"] for x in found} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_places_of_repeated_units_are_definite(spark):
    rows = [(f"U{k // 5:03d}", "ONE", f"B{k * 7 % 13:02d}", False) for k in range(600)]
    want = {(x[0], x[2]): k for k, x in enumerate(sorted(rows), 1)}
    for seed, parts in ((0, 1), (1, 5), (2, 9)):
        frame = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "unit_id string, unit_type string, block string, withdrawn boolean").repartition(parts)
        assert {(x["unit_id"], x["block"]): x["place"] for x in units.available_units(frame).collect()} == want


def plain_assignment(who, stock):
    left, out = sorted(u for u in stock if not u[3]), {}
    for k, (i, _, _, prefs) in enumerate(sorted((w for w in who if w[1] == "SELECTED"), key=lambda w: (w[2], w[0])), 1):
        pick = next(((u, r) for r, p in enumerate(prefs or [], 1) for u in left if u[1] == p), (left[0], 0) if left else (None, 0))
        if pick[0]:
            left.remove(pick[0])
        out[i] = (pick[0] and pick[0][0], pick[1], k)
    return out


@pytest.mark.parametrize(("n", "stated", "block"), [(120, 4, 40), (120, 0, 50), (200, 2, 1000)])
def test_assignment_in_rounds_and_blocks(spark, n, stated, block):
    r = random.Random(n + stated)
    kinds = ["ONE", "TWO", "THREE", "FOUR", "FIVE"]
    stock = [(f"U{i:04d}", r.choice(kinds), "B", r.random() < 0.1) for i in range(n * 3 // 4)]
    who = [(f"A{i}", "SELECTED" if r.random() < 0.9 else "WAITLISTED", hashlib.sha256(str((n, i)).encode()).hexdigest(), r.sample([*kinds, "SIX"], r.randrange(stated, 6)) if r.random() < 0.97 else None) for i in range(n)]
    got = units.assign(
        spark.createDataFrame([w[:3] for w in who], "application_id string, outcome string, ticket_hex string"),
        spark.createDataFrame([(w[0], w[3]) for w in who], "application_id string, preferences array<string>"),
        spark.createDataFrame(stock, "unit_id string, unit_type string, block string, withdrawn boolean"), "D", block).collect()
    assert {x["application_id"]: (x["unit_id"], x["preference_rank"], x["pick_order"]) for x in got} == plain_assignment(who, stock)


def test_assignment_has_no_group_of_all_winners(spark):
    """Where everybody finds a stated type, ten million winners need counts and joins only; nothing groups a draw."""
    won = spark.range(10_000_000).select(F.col("id").cast("string").alias("application_id"), F.lit("SELECTED").alias("outcome"), F.sha2(F.col("id").cast("string"), 256).alias("ticket_hex"))
    plan = units.pick_order(won, "D")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
    sure = order.ranks(won.select(F.when(F.col("application_id").endswith("7"), "ONE").otherwise("TWO").alias("kind"), F.crc32(F.col("ticket_hex").cast("binary")).alias("pick_order")))
    plan = sure._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and "SinglePartition" not in plan


def plain_promotion(ranking, selections, gone, holders, declined):
    ticket = {x[0]: x for x in selections}
    holders, skip = set(holders), set(declined) | set(gone)
    out = []
    for v in sorted((ticket[g] for g in set(gone) if g in ticket), key=lambda x: (x[1], x[0])):
        holders.discard(v[0])
        waiting = sorted((rank, who) for pool, who, rank in ranking if pool == v[2])
        k = next((k for k, (_, who) in enumerate(waiting) if who not in holders and who not in skip), None)
        if k is None:
            out.append((v[0], None, v[2], 0))
            continue
        who = waiting[k][1]
        out.append((v[0], who, v[2], 1 + sum(w not in holders for _, w in waiting[:k])))
        holders.add(who)
        skip.add(who)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_promotion_over_several_pools(spark, seed):
    r = random.Random(seed)
    pools = ["P", "Q", "R", "S"][: r.randrange(2, 5)]
    ids = [f"A{i}" for i in range(60)]
    ranking = [(p, x, k) for p in pools for k, x in enumerate(r.sample(ids, r.randrange(20, 60)), 1)]
    selections = [(x, hashlib.sha256(str((seed, x)).encode()).hexdigest(), r.choice([*pools, "T"])) for x in ids]
    holders = r.sample(ids, 30)
    gone, declined = r.sample(holders, 15) + r.sample(ids, 2), r.sample(ids, 6)
    one = lambda x: spark.createDataFrame([(i,) for i in x], "application_id string")
    got = units.promote(spark.createDataFrame(ranking, "pool string, application_id string, rank int"), spark.createDataFrame(selections, "application_id string, ticket_hex string, pool_code string"), one(gone), one(holders), one(declined))
    assert [tuple(x)[:4] for x in got.collect()] == plain_promotion(ranking, selections, gone, holders, declined)


def test_pairs_are_made_in_their_first_shared_key(spark):
    r = random.Random(3)
    rows = [(f"r{i:03d}", r.sample([f"k{k}" for k in range(25)], r.randrange(4))) for i in range(150)] + [(f"big{i:03d}", ["k0", "huge"]) for i in range(30)]
    keys = spark.createDataFrame(rows, "application_id string, keys array<string>")
    most = 29
    size = {k: sum(k in x for _, x in rows) for _, some in rows for k in some}
    want = {(a, b): frozenset(x) & frozenset(y) for a, x in rows for b, y in rows if a < b and any(size[k] <= most for k in set(x) & set(y))}
    got = linkage.block_pairs(keys, most, keys.select("application_id", F.size("keys").alias("n")))
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    found = got.collect()
    of = dict(rows)
    assert {(x["left_id"], x["right_id"]): frozenset(x["shared_keys"]) for x in found} == want and len(found) == len(want)
    assert all((x["l_n"], x["r_n"]) == (len(of[x["left_id"]]), len(of[x["right_id"]])) for x in found)


def test_side_by_side_jaro_equals_one_by_one():
    r = random.Random(4)
    left, right = [], []
    for _ in range(3000):
        x = "".join(r.choice("ABCDE É") for _ in range(r.randrange(r.choice([1, 5, 20, 65]))))
        y = x if r.random() < 0.1 else "".join(r.choice("ABCDE É") for _ in range(r.randrange(r.choice([1, 5, 20, 65])))) if r.random() < 0.5 else "".join(c for c in x if r.random() < 0.85)
        left.append(x)
        right.append(y)
    assert metrics.jaro_winklers(left, right).tolist() == [metrics.jaro_winkler(a, b) for a, b in zip(left, right, strict=True)]


def test_long_and_missing_names(spark):
    rows = [("A" * 70, "A" * 69 + "B"), (None, ""), ("x", None), ("MARTHA", "MARHTA"), ("MARTHA", "MARHTA")]
    got = spark.createDataFrame(rows, "a string, b string").select(metrics.jaro_winkler_udf("a", "b").alias("s")).collect()
    assert [x["s"] for x in got] == [metrics.jaro_winkler(a or "", b or "") for a, b in rows]


def test_stream_of_audit_events_goes_on_after_a_restart(spark, tmp_path):
    import datetime as dt

    rows = [(f"log{k % 3}" if k % 7 else None, f"E{k:03d}", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=k), "a", "r", "act", "T", str(k), None if k % 5 == 0 else f"p={k}") for k in range(60)]
    schema = "scheme_code string, event_id string, occurred_at timestamp, actor string, actor_role string, action string, entity_type string, entity_id string, payload string"
    at = str(tmp_path)
    for part in (rows[:20], rows[20:21], rows[21:]):  # each call starts a new query from the same checkpoint
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{at}/in")
        got = appended.append_to(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/chain", f"{at}/checkpoint")
    logs = {}
    for x in rows:
        logs.setdefault(x[0] or "-", []).append(x)
    numbered = [(k, *x[1:], i) for k, some in logs.items() for i, x in enumerate(some, 1)]
    want = audit.link(spark.createDataFrame(numbered, schema + ", sequence long")).select(F.col("scheme_code").alias("log"), "sequence", "event_id", "previous_hash", "hash")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def longest_fold(spark, monkeypatch):
    """The most events that one task links from now on."""
    longest = spark.sparkContext.accumulator([0], Most())
    fold = audit._folded

    def counted(batches, *how):
        seen = 0
        for batch in fold(batches, *how):
            seen += batch.num_rows
            yield batch
        longest.add([seen])

    monkeypatch.setattr(audit, "_folded", counted)
    return longest


def test_long_logs_are_linked_in_bounded_blocks(spark, monkeypatch):
    rows = [(log, k, f"{log}-{k}", f"p={k}") for log, n in (("a", 3), ("b", 900), (None, 250), ("c", 1), ("d", 400)) for k in range(1, n + 1)]
    frame = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "scheme_code string, sequence long, event_id string, payload string").repartition(6)
    frame = frame.withColumns({c: F.lit(None).cast("string") for c in ("actor", "actor_role", "action", "entity_type", "entity_id")} | {"occurred_at": F.lit("2026-01-01 00:00:00").cast("timestamp")})
    want, previous, log = set(), "", ""
    for name, k, i, payload in rows:
        previous = "0" * 64 if name != log else previous
        log, digest = name, hashlib.sha256(f"{previous}|event/1|{k}|2026-01-01T00:00:00Z||||||{payload}".encode()).hexdigest()
        want.add((name, k, i, previous, digest))
        previous = digest
    longest = longest_fold(spark, monkeypatch)
    got = audit.link(frame, block=100)
    assert {tuple(x) for x in got.select("scheme_code", "sequence", "event_id", "previous_hash", "hash").collect()} == want and got.count() == len(want)
    assert 0 < longest.value[0] <= 700
    assert audit.link(frame.limit(0)).count() == 0


def test_stream_links_a_long_log_in_bounded_blocks(spark, tmp_path, monkeypatch):
    import datetime as dt

    monkeypatch.setattr(audit, "BLOCK", 100)
    longest = longest_fold(spark, monkeypatch)
    rows = [("x" if k % 10 else "y", f"E{k:04d}", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=k // 3), f"a\0b{k}") for k in range(1500)]
    schema, at = "scheme_code string, event_id string, occurred_at timestamp, payload string", str(tmp_path)
    none = {c: F.lit(None).cast("string") for c in ("actor", "actor_role", "action", "entity_type", "entity_id")}
    for part in (rows[:900], rows[900:]):
        spark.createDataFrame(random.Random(1).sample(part, len(part)), schema).withColumns(none).repartition(3).write.mode("append").parquet(f"{at}/in")
        full = spark.read.parquet(f"{at}/in").schema
        got = appended.append_to(spark.readStream.schema(full).parquet(f"{at}/in"), f"{at}/chain", f"{at}/checkpoint")
    want = set()
    for log in "xy":
        previous = "0" * 64
        for k, (_, i, when, payload) in enumerate([x for x in rows if x[0] == log], 1):
            digest = hashlib.sha256(f"{previous}|event/1|{k}|{when:%Y-%m-%dT%H:%M:%SZ}||||||{payload}".encode()).hexdigest()
            want.add((log, k, i, previous, digest))
            previous = digest
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert 0 < longest.value[0] <= 700


def test_ordered_digests(spark):
    rows = [(f"A{k:04d}", f"line {k} é") for k in range(3000)]
    frame = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "application_id string, line string").repartition(7)
    text = "".join(f"{x}\n" for x in ["head", "two", *[v for _, v in rows]])
    got = documents.ordered_digest(["head", "two"], frame).first()
    assert tuple(got) == (hashlib.sha256(text.encode()).hexdigest(), 3002, len(text.encode()))
    assert documents.digest_of(["only"], frame.limit(0)) == hashlib.sha256(b"only\n").hexdigest()


@pytest.mark.parametrize("size", [1, 3, 10, 1 << 20])
def test_bundles_read_alike_in_any_ranges(spark, tmp_path, size):
    texts = {"a.txt": b"one\ntwo\n\nlast without end", "b.txt": b"", "c.txt": b"\n\n", "d.txt": "é\r\nx=1|2\n".encode()}
    for name, body in texts.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "e.txt").mkdir()
    for k, body in enumerate((b"part one\n", b"", b"part ", b"two\n")):
        if k != 2:  # parts hold whole lines
            (tmp_path / "e.txt" / f"part-{k:06d}").write_bytes(body if k != 3 else b"part two\n")
    texts["e.txt"] = b"part one\npart two\n"
    spark.dataSource.register(bundle.BundleSource)
    lines = spark.read.format("bundle").option("splitBytes", str(size)).load(str(tmp_path))
    got = {}
    for x in sorted(lines.collect(), key=lambda x: (x["file"], x["at"])):
        got[x["file"]] = got.get(x["file"], b"") + bytes(x["line"]) + (b"\n" if x["ended"] else b"")
    assert got == {k: v for k, v in texts.items() if v}
    assert {x["file"]: (x["bytes"], x["hash"]) for x in bundle.digests(lines).collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in texts.items() if v}


def test_published_bundles_show_forged_and_missing_files(spark, tmp_path):
    rows = spark.range(2000).select(F.format_string("A%05d", "id").alias("application_id"), F.concat(F.lit("e="), F.col("id").cast("string")).alias("line"))
    at = f"file://{tmp_path}/b"
    bundle.publish(at, ["schemeCode=S"], {"roll.txt": (["roll/1"], rows), "rules.txt": (["version=1", "x=2"], None)})
    text = "roll/1\n" + "".join(f"e={k}\n" for k in range(2000))
    found = {x["file"]: x for x in bundle.compared(bundle.read(spark, at)).collect()}
    assert found["roll.txt"]["hash"] == hashlib.sha256(text.encode()).hexdigest() and all(x["matches"] for x in found.values()) and len(found) == 2
    bundle.write(at, "roll.txt", ["roll/1"], rows.where("id <> 77") if "id" in rows.columns else rows.where("application_id <> 'A00077'"))
    (tmp_path / "b" / "extra.txt").write_text("x\n")
    found = {x["file"]: x["matches"] for x in bundle.compared(bundle.read(spark, at)).collect()}
    assert found == {"roll.txt": False, "rules.txt": True, "extra.txt": False}




def test_changes_of_two_writers_are_not_lost(spark, tmp_path):
    from tamis.operators.lifecycle import Conflict
    from tamis.operators.snapshots import Snapshots

    one, two = (Snapshots(spark, f"file://{tmp_path}/t", "id") for _ in range(2))
    assert one.version() == -1
    one.create(spark.range(6).selectExpr("cast(id as string) as id", "'OPEN' as status", "0 as n"))
    with pytest.raises(Conflict):
        two.create(spark.range(1).selectExpr("cast(id as string) as id", "'OPEN' as status", "0 as n"))
    tried = []

    def claim(state):
        """Takes whatever is open; before it commits for the first time, another writer takes two rows and adds one."""
        if not tried:
            two.change(lambda s: s.where("id < '2'").withColumn("status", F.lit("SECOND")).unionByName(spark.createDataFrame([("9", "OPEN", 5)], "id string, status string, n int")))
        tried.append(1)
        return state.where("status = 'OPEN'").withColumns({"status": F.lit("FIRST"), "n": F.col("n") + 1})

    assert one.change(claim) == 2 and len(tried) == 2
    assert sorted(map(tuple, one.read().collect())) == [("0", "SECOND", 0), ("1", "SECOND", 0), *[(str(k), "FIRST", 1) for k in range(2, 6)], ("9", "FIRST", 6)]
    assert {x["id"]: x["_changed"] for x in one.read(changed=True).collect()} == {"0": 1, "1": 1, "2": 2, "3": 2, "4": 2, "5": 2, "9": 2}
    tried.clear()
    with pytest.raises(Conflict):
        one.change(lambda s: (two.change(lambda t: t.limit(1).withColumn("n", F.col("n") + 1)), s)[1], tries=1)
    two.change(lambda s: s.where("id = '9'").withColumn("_gone", F.lit(True)))
    assert one.read().count() == 6 and one.read(1).count() == 7 and one.read(0).where("status = 'OPEN'").count() == 6


def test_many_changes_write_a_base(spark, tmp_path, monkeypatch):
    from tamis.operators import snapshots

    monkeypatch.setattr(snapshots, "MOST_CHANGES", 2)
    table = snapshots.Snapshots(spark, f"file://{tmp_path}/t", "id")
    table.create(spark.createDataFrame([("a", 0), ("b", 0)], "id string, n int"))
    for k in range(4):
        table.change(lambda s, k=k: s.where(F.col("id") == "ab"[k % 2]).withColumn("n", F.col("n") + 10))
    assert sorted(map(tuple, table.read(changed=True).collect())) == [("a", 20, 3), ("b", 20, 4)] and len(table.manifest().changes) == 1
    assert sorted(map(tuple, table.read(2).collect())) == [("a", 10), ("b", 10)]
