"""Ordered walks without a SQL twin, against plain Python on small random fixtures."""

import random

from pyspark.sql import functions as F

from tracewright.operators import correlate, sessions


def purchases(rows, window):
    out, open_, ambiguous = [], {}, {}
    for ctx, ms, ident, is_request, request, outcome in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        alive = [q for q in open_.get(ctx, []) if ms - q[0] <= window]
        flag = ambiguous.get(ctx, False) and bool(alive)
        if is_request:
            open_[ctx], ambiguous[ctx] = [*alive, (ms, ident, request)], flag or bool(alive)
            continue
        found = [q for q in alive if q[2] == request] if request is not None else alive if len(alive) == 1 and not flag else []
        hit = found[0] if len(found) == 1 and outcome != "unknown" else None
        open_[ctx], ambiguous[ctx] = [q for q in alive if q is not hit], flag
        out.append((ctx, ident, hit[1] if hit else None, outcome if hit else "unmatched"))
    return sorted(out, key=str)


def test_match_purchases(spark):
    rng, t, rows = random.Random(3), 0, []
    for i in range(600):
        t += rng.randrange(6)
        rows.append((f"c{i % 4}", t, i, rng.random() < 0.5, rng.choice([None, None, "a", "b"]), rng.choice(["success", "failure", "unknown"])))
    df = spark.createDataFrame(rows, "ctx string, ms bigint, id bigint, is_request boolean, request string, outcome string")
    want = purchases(rows, 10)
    for target in (10**6, 30):
        got = correlate.match_purchases(df, ["ctx"], "ms", "id", F.col("is_request"), ~F.col("is_request"), F.col("request"), F.col("outcome"), 10, target)
        assert sorted([(r.ctx, r.ident, r.request_ident, r.status) for r in got.collect()], key=str) == want


def leaves(rows, recent):
    out, state = [], {}
    for src, pos, env, join, leave, addr, endpoint in sorted(rows, key=lambda r: (r[0], r[1])):
        cur, older = state.get(src, (None, []))
        if cur and cur[0] != env:
            cur = None
        if join:
            older = ([cur] + older)[:recent] if cur else older
            cur = (env, pos, f"{addr}:1")
        elif leave:
            able = [s for s in [cur, *older] if s and s[0] == env]
            same = [s for s in able if endpoint and s[2] == endpoint]
            hit = same[0] if len(same) == 1 else able[0] if not same and len(able) == 1 else None
            out.append((src, pos, hit[1] if hit else None))
            if hit:
                cur, older = (None, older) if hit is cur else (cur, [s for s in older if s is not hit])
        state[src] = (cur, older)
    return sorted(out)


def test_attribute_leaves(spark):
    rng, rows = random.Random(5), []
    for i in range(500):
        kind = rng.random()
        rows.append((f"s{i % 3}", i, f"e{i // 60 % 2}", kind < 0.3, 0.3 <= kind < 0.6, f"h{rng.randrange(3)}", rng.choice([None, "h0:1", "h1:1", "h9:1"])))
    df = spark.createDataFrame(rows, "src string, pos bigint, environment_key string, is_join boolean, is_leave boolean, address string, endpoint string")
    got = sessions.attribute_leaves(df.withColumn("port", F.lit("1")), ["src"], "pos")
    assert sorted(tuple(r) for r in got.collect()) == leaves(rows, 8)


def test_user_activity(spark):
    rng, rows = random.Random(9), []
    for i in range(200):
        name = "handle: Pilot7 " if rng.random() < 0.05 else ""
        rows.append((f"e{i % 2}", i, f"{name}accountId: acc{rng.randrange(60)}x ref acc{rng.randrange(60)}x"))
    want, known = [], {"e0": set(), "e1": set()}
    for env, pos, text in rows:
        ident = text.split("accountId: ")[1].split()[0]
        named = "pilot7" in text.lower()
        if named:
            known[env].add(ident)
        if named or any(k in text for k in known[env]):
            known[env].add(ident)
            want.append((env, pos))
    df = spark.createDataFrame(rows, "environment_key string, pos bigint, text string")
    got = sessions.user_activity(df, "pilot7")
    assert sorted((r.environment_key, r.pos) for r in got.collect()) == sorted(want)
    assert 0 < len(want) < len(rows)


def test_user_activity_finds_ids_inside_longer_tokens_and_seeds(spark):
    rows = [
        ("e", 1, "userId: ab pilot7"), ("e", 2, "userId: xabx"), ("e", 3, "see [xabx] userId: q.9"), ("e", 4, "userId: zz"),
        ("e", 5, "q.9"), ("e", 6, None), ("f", 1, "ab"), ("f", 2, "the seed one"), ("e", 0, "userId: ab"), ("f", 3, ""),
    ]
    df = spark.createDataFrame(rows, "environment_key string, pos bigint, text string")
    got = {(r.environment_key, r.pos) for r in sessions.user_activity(df, "pilot7").collect()}
    assert got == {("e", 1), ("e", 2), ("e", 3), ("e", 5)}
    got = {(r.environment_key, r.pos) for r in sessions.user_activity(df, "pilot7", ["seed one", "ab"]).collect()}
    assert got == {("e", 0), ("e", 1), ("e", 2), ("e", 3), ("e", 5), ("f", 1), ("f", 2)}
    assert sessions.user_activity(df.limit(0), "pilot7").count() == 0


def closed(rows, recent):
    """Sessions as (source, start, end, stale reason, actions)."""
    ends = {p: s for _, p, s in leaves(rows, recent) if s is not None}
    out, state = [], {}
    for src, pos, env, join, leave, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        cur = state.get(src)
        if cur and cur["env"] != env:
            cur.update(end=pos, why="environment_changed")
            cur = None
        if join:
            if cur:
                cur.update(end=pos - 1, why="superseded_by_join")
            cur = {"src": src, "start": pos, "env": env, "end": None, "why": None, "n": 0}
            out.append(cur)
        elif leave and pos in ends:
            hit = next(s for s in out if s["src"] == src and s["start"] == ends[pos])
            hit.update(end=pos, why=None, n=hit["n"] + 1)
            cur = None if hit is cur else cur
        elif not leave and cur:
            cur["n"] += 1
        state[src] = cur
    return sorted((s["src"], s["start"], s["end"], s["why"], s["n"]) for s in out)


def test_closed_sessions(spark):
    rng, rows = random.Random(8), []
    for i in range(500):
        kind = rng.random()
        rows.append((f"s{i % 3}", i, f"e{i // 45 % 2}", kind < 0.2, 0.2 <= kind < 0.4, f"h{rng.randrange(4)}", rng.choice([None, "h0:1", "h1:1", "h9:1"])))
    # positions rise over all sources, so that each is the key of one row
    df = spark.createDataFrame(rows, "src string, pos bigint, environment_key string, is_join boolean, is_leave boolean, address string, endpoint string")
    df = df.withColumns({"port": F.lit("1"), "ms": F.col("pos") * 10, "is_action": F.lit(True)})
    for target in (10**6, 40):
        got = sessions.closed_sessions(df, ["src"], "pos", "ms", target_rows=target)
        assert sorted((r.src, r.start_pos, r.end_pos, r.stale_reason, r.action_count) for r in got.collect()) == closed(rows, 8)


def test_related_events_of_a_value_that_all_share(spark):
    rows = [("e", v, i, i // 3) for i in range(300) for v in ("all", f"v{i % 40}")] + [("f", "all", 900, 900)]
    corr = spark.createDataFrame(rows, "environment_key string, value string, event_id bigint, ms bigint")
    targets = spark.createDataFrame([("e", 299), ("e", 5), ("e", 1000)], "environment_key string, event_id bigint")
    events = spark.createDataFrame([("e", 298, 99), ("e", 1000, 400), ("e", 7, 500), ("f", 900, 900)], "environment_key string, event_id bigint, ms bigint")
    given = spark.createDataFrame([(5, 7), (5, 900), (1000, 298), (1000, 1000), (1000, 298), (1000, 12345)], "event_id bigint, contributor_id bigint")

    def order(target, ids):
        return sorted((i for i in ids if i != target), key=lambda i: (-(i // 3), i))[:4]

    plain = correlate.related_events(corr, targets, 4).collect()
    found = {t: [r.event_id for r in sorted(plain, key=lambda r: r["rank"]) if r.target_id == t] for t in (299, 5, 1000)}
    assert found == {299: order(299, range(300)), 5: order(5, range(300)), 1000: []}
    more = correlate.related_events(corr, targets, 4, given, events).collect()
    found = {t: [r.event_id for r in sorted(more, key=lambda r: r["rank"]) if r.target_id == t] for t in (299, 5, 1000)}
    assert found == {299: order(299, range(300)), 5: [7, *order(5, range(300))[:3]], 1000: [298]}


def test_related_events_deal_their_rows_by_number(spark, monkeypatch):
    """Tasks get a bounded number of rows, and many wanted values give the same relations as few that are broadcast."""
    rows = [("env", v, i, i % 50) for i in range(400) for v in ("all", f"u{i % 9}")] + [("env", "u1", 1, 1), ("env", None, 3, 3)]
    corr = spark.createDataFrame(rows, "environment_key string, value string, event_id long, ms long")
    targets = spark.createDataFrame([("env", i) for i in range(0, 400, 7)], "environment_key string, event_id long")
    events = corr.select("environment_key", "event_id", "ms").distinct()
    given = spark.createDataFrame([(7, 6), (7, 6), (14, 999)], "event_id long, contributor_id long")
    by_target: dict[int, set] = {i: set() for i in range(0, 400, 7)}
    for t in by_target:
        shared = {v for _, v, i, _ in rows if i == t and v is not None}
        by_target[t] |= {(-ms, i) for _, v, i, ms in rows if v in shared and i != t} | ({(-6, 6)} if t == 7 else set())
    want = {(t, i, n + 1) for t, hits in by_target.items() for n, (_, i) in enumerate(sorted(hits)[:5])}
    for few in (correlate.FEW_VALUES, 0):
        monkeypatch.setattr(correlate, "FEW_VALUES", few)
        out = correlate.related_events(corr, targets, 5, given, events, task_rows=20)
        assert out.rdd.getNumPartitions() >= 2 * 58 * 6 // 20
        assert {(r.target_id, r.event_id, r.rank) for r in out.collect()} == want
        assert out.count() == len(want)
