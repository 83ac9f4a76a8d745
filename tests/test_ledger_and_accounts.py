"""Quota, accounts, ledger and intake against brute force replays."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bomweave.operators import accounts, ledger, quota
from bomweave.plans.intake import proof_intake
from bomweave.sources import events as event_source
from bomweave.sources import ledger as ledger_files

START = dt.datetime(2024, 1, 1)
ATTEMPT = "attempt_id bigint, user_id bigint, tier string, created_at timestamp"
EVENT = ("event_id string, event_type string, user_id bigint, customer_id string, attempt_count bigint, "
         "received_at timestamp, token_hash string")


def replay(rows, days, limit):
    accepted, out = {}, {}
    for attempt, user, tier, at in sorted(rows, key=lambda r: (r[3], r[0])):
        recent = [t for t in accepted.setdefault(user, []) if t > at - dt.timedelta(days=days)]
        ok = tier != "free" or len(recent) < limit
        if ok:
            accepted[user].append(at)
        out[attempt] = ok
    return out


def made_attempts(seed, users=4, rows=400, hours=24 * 25, mixed=True):
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        user = 0 if rnd.random() < 0.4 else rnd.randrange(users)
        tier = "pro" if mixed and user == 1 and rnd.random() < 0.3 or user == 2 else "free"
        out.append((i, user, tier, START + dt.timedelta(hours=rnd.randrange(hours))))
    return out


@pytest.mark.parametrize("seed,days,limit", [(1, 3, 3), (2, 7, 4), (3, 30, 10)])
def test_quota_replay(spark, seed, days, limit):
    rows = made_attempts(seed)
    got = {r["attempt_id"]: r["accepted"] for r in quota.admit(spark.createDataFrame(rows, ATTEMPT), days, limit).collect()}
    assert got == replay(rows, days, limit)


def test_quota_replay_of_odd_rows(spark):
    """Missing tiers and users, repeated ids, and a lone early time."""
    rows = [(i % 40, None if i % 7 == 0 else i % 3, None if i % 2 else "free", at) for i, _, _, at in made_attempts(4, rows=150)]
    rows += [(500, 1, None, dt.datetime(1970, 1, 2)), (501, 1, "free", None), (502, 1, "pro", None)]
    accepted, want = {}, []
    for attempt, user, tier, at in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        mine = accepted.setdefault(user, [])
        ok = tier == "pro" or sum(t > at - dt.timedelta(days=3) for t in mine) < 4
        if ok:
            mine.append(at)
        want.append((attempt, user, at, ok))
    want += [(501, 1, None, False), (502, 1, None, True)]
    got = quota.admit(spark.createDataFrame(rows, ATTEMPT), 3, 4)
    assert got.columns == ["attempt_id", "user_id", "tier", "created_at", "accepted"]
    rows_ = [(r["attempt_id"], r["user_id"], r["created_at"], r["accepted"]) for r in got.collect()]
    assert sorted(rows_, key=repr) == sorted(want, key=repr)


def test_ten_accepted_eleventh_refused(spark):
    rows = [(i, 1, "free", START + dt.timedelta(hours=i)) for i in range(11)] + [
        (11, 1, "free", START + dt.timedelta(days=30)), (12, 1, "free", START + dt.timedelta(days=30, minutes=1))]
    got = {r["attempt_id"]: r["accepted"] for r in quota.admit(spark.createDataFrame(rows, ATTEMPT)).collect()}
    assert [got[i] for i in range(13)] == [True] * 10 + [False, True, False]


def test_rolling_usage(spark):
    rows = made_attempts(5)
    for days in (1, 7):
        got = {(r["user_id"], r["created_at"]): r["recent"] for r in quota.rolling_usage(spark.createDataFrame(rows, ATTEMPT), days).collect()}
        for (user, at), n in got.items():
            assert n == sum(1 for r in rows if r[1] == user and at - dt.timedelta(days=days) < r[3] <= at)
        assert len(got) == len({(r[1], r[3]) for r in rows})


def fold(rows):
    """Event by event over a dict of accounts."""
    table, outcomes = {}, {}
    for e in sorted(rows, key=lambda r: (r[5], r[0])):
        event, kind, user, customer, attempts, _, token = e
        if kind == accounts.CHECKOUT and user is not None:
            row = table.setdefault(user, {"hash": None, "tier": "pro", "cust": None})
            row.update(tier="pro", cust=customer)
        elif kind == accounts.CANCELLED or (kind == accounts.PAYMENT_FAILED and attempts >= 3):
            if customer:
                for u in [u for u, r in table.items() if r["cust"] == customer]:
                    del table[u]
        elif kind == accounts.KEY_GENERATE:
            row = table.get(user)
            if row and row["hash"]:
                outcomes[event] = "conflict"
            else:
                table.setdefault(user, {"hash": None, "tier": "free", "cust": None})["hash"] = token
                outcomes[event] = "issued"
        elif kind == accounts.KEY_ROTATE:
            table.setdefault(user, {"hash": None, "tier": "free", "cust": None})["hash"] = token
            outcomes[event] = "rotated"
    return table, outcomes


def made_events(seed, rows=500):
    rnd = random.Random(seed)
    kinds = [accounts.CHECKOUT, accounts.CANCELLED, accounts.PAYMENT_FAILED, accounts.KEY_GENERATE, accounts.KEY_ROTATE,
             "customer.subscription.updated"]
    out = []
    for i in range(rows):
        user = 0 if rnd.random() < 0.35 else rnd.randrange(12)
        kind = rnd.choice(kinds)
        who = None if kind == accounts.CHECKOUT and rnd.random() < 0.1 else user
        # two customers per user, and one that several users share
        customer = rnd.choice([f"c{user}", f"c{user}x", "shared" if user < 4 else f"c{user}", ""] if kind != accounts.CHECKOUT
                              else [f"c{user}", f"c{user}x", "shared" if user < 4 else f"c{user}"])
        out.append((f"e{i:04d}", kind, who, customer, rnd.randrange(6), START + dt.timedelta(hours=rnd.randrange(24 * 6)), f"h{i}"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_account_fold(spark, seed):
    rows = made_events(seed)
    want, outcomes = fold(rows)
    rnd = random.Random(seed)
    again = [r[:5] + (r[5] + dt.timedelta(minutes=rnd.randrange(1, 600)),) + r[6:] for r in rnd.sample(rows, 100)]
    delivered = rows + again
    rnd.shuffle(delivered)
    table = accounts.intake(spark.createDataFrame(delivered, EVENT))
    assert table.count() == len(rows)
    got = {r["user_id"]: {"hash": r["token_hash"], "tier": r["subscription_tier"], "cust": r["stripe_customer_id"]}
           for r in accounts.account_state(table).collect()}
    assert got == want
    assert {r["event_id"]: r["outcome"] for r in accounts.key_outcomes(table).collect()} == outcomes


def test_key_reveal_rotate_and_tier_kept(spark):
    def event(i, kind, token=None, customer=None):
        return (f"e{i}", kind, 1, customer, None, START + dt.timedelta(minutes=i), token)

    rows = [event(0, accounts.CHECKOUT, customer="c"), event(1, accounts.KEY_GENERATE, "a"), event(2, accounts.KEY_GENERATE, "b"),
            event(3, accounts.KEY_ROTATE, "c")]
    table = spark.createDataFrame(rows, EVENT)
    assert [r["outcome"] for r in accounts.key_outcomes(table).orderBy("event_id").collect()] == ["issued", "conflict", "rotated"]
    assert [tuple(r) for r in accounts.account_state(table).collect()] == [(1, "c", "pro", "c")]


def test_merge_keeps_other_columns(spark):
    current = spark.createDataFrame([(1, "h", "pro", "c", 2), (2, "g", "free", None, None)],
                                    "user_id bigint, token_hash string, subscription_tier string, stripe_customer_id string, scans_this_month int")
    changes = spark.createDataFrame([(1, "n"), (3, "m")], "user_id bigint, token_hash string")
    got = {r["user_id"]: tuple(r)[1:] for r in accounts.merge_accounts(current, changes).collect()}
    assert got == {1: ("n", "pro", "c", 2), 2: ("g", "free", None, None), 3: ("m", "free", None, 0)}


def test_webhook_payloads(spark):
    bodies = [
        '{"id":"evt_1","type":"checkout.session.completed","created":1704067200,"data":{"object":{"customer":"cus_1","metadata":{"user_id":"u1"}}}}',
        '{"id":"evt_2","type":"invoice.payment_failed","created":1704067201,"data":{"object":{"customer":{"id":"cus_1","name":"n"},"attempt_count":3}}}',
        "broken", '{"id":"evt_3","type":"' + "x" * 70_000 + '"}']
    rows = event_source.parsed_events(spark.createDataFrame([(b,) for b in bodies], "value string")).orderBy("event_id").collect()
    assert [(r["event_id"], r["user_id"], r["customer_id"], r["attempt_count"]) for r in rows] == [
        ("evt_1", "u1", "cus_1", None), ("evt_2", None, "cus_1", 3), ("evt_3", None, None, None)]
    state = accounts.account_state(event_source.parsed_events(spark.createDataFrame([(b,) for b in bodies[:1]], "value string"))).collect()
    assert [r["subscription_tier"] for r in state] == ["pro"]


KEYS = "user_id bigint, token_hash string, subscription_tier string, stripe_customer_id string, scans_this_month int"
PROJECTS = "id string, name string, repository_url string, created_at timestamp"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_intake_and_ledger(spark, tmp_path):
    keys = spark.createDataFrame([(1, sha("k1"), None, None, None), (2, sha("k2"), "pro", None, 0)], KEYS)
    body = '{"projectName":"%s","commitSha":"%s","scannedFiles":1,"dependencies":[{"name":"openai","version":"1","ecosystem":"Python (pip)","riskLevel":"High","description":"d"}],"finOps":[],"complianceStatus":"Passed"}'
    uploads = [(i, "k1", body % (f"proj{i % 3}", f"s{i}"), START + dt.timedelta(hours=i)) for i in range(12)]
    uploads += [(100, "k2", body % ("proj0", ""), START), (101, "bad", body % ("x", "y"), START), (102, "", body % ("x", "y"), START)]
    known = spark.createDataFrame([(sha("proj0"), "proj0", None, START)], PROJECTS)
    earlier = spark.createDataFrame([(-1, 1, START - dt.timedelta(days=2)), (-2, 1, START - dt.timedelta(days=31))],
                                    "upload_id bigint, user_id bigint, created_at timestamp")
    done = proof_intake(spark.createDataFrame(uploads, "upload_id bigint, api_key string, body string, created_at timestamp"), keys, known, earlier)
    drills = done.drills.collect()
    assert sorted(r["commit_sha"] for r in drills) == sorted(["local-dev-uncommitted"] + [f"s{i}" for i in range(9)])
    assert sorted(r["upload_id"] for r in done.refused.collect()) == [9, 10, 11]
    for r in drills:
        assert r["crypto_hash"] == sha(r["commit_sha"] + r["ai_bom_json"])
        assert "- **openai** (v1): d (Risk: High)" in r["annex_iv_markdown"]
        assert "**Current Automated Posture:** Passed" in r["annex_iv_markdown"]
    assert sorted(r["name"] for r in done.projects.collect()) == ["proj0", "proj1", "proj2"]

    target = str(tmp_path / "drills")
    ledger_files.append_drills(done.drills, target)
    stored = ledger_files.read_drills(spark, target)
    assert stored.count() == 10 and ledger.verified(stored).filter("hash_ok").count() == 10
    history = ledger.history(stored, done.projects)
    assert history.filter("user_id = '2'").count() == 1
    assert [r["commit_sha"] for r in ledger.latest(stored, done.projects, "1", 2, since=START).collect()] == ["s8", "s7"]
    recent = quota.usage_as_of(stored, START + dt.timedelta(hours=12))
    assert {r["user_id"]: r["recent"] for r in recent.collect()} == {"1": 9, "2": 1}
    for frame in (recent, ledger.latest(stored, done.projects, since=START)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(created_date" in plan
    mine = stored.filter("user_id = '1'").select("crypto_hash").first()["crypto_hash"]
    ask = spark.createDataFrame([(mine, "2")], "crypto_hash string, user_id string")
    assert ledger.proofs(ask, stored).count() == 0 and ledger.proofs(ask, stored, per_tenant=False).count() == 1


def test_checkout_outcomes(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (1, "z")], "user_id bigint, session_id string")
    sessions = spark.createDataFrame([("a", 1, "complete", "c1"), ("b", 1, "open", "c1")],
                                     "session_id string, session_user_id bigint, status string, customer_id string")
    verified = accounts.verify_checkouts(requests, sessions)
    assert {(r["user_id"], r["session_id"]): r["outcome"] for r in verified.collect()} == {
        (1, "a"): "pro", (2, "a"): "forbidden", (1, "b"): "free", (1, "z"): "unavailable"}
    assert [tuple(r) for r in accounts.checkout_changes(verified).collect()] == [(1, "c1", "pro")]
