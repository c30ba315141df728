"""Requests for one site in one batch, applied in order: against a plain loop over a dictionary."""

import json
import random

from lotweave.plans import schemas

GOOD = {"vin": "//a/text()", "goal": "Buy"}


def plain(existing, asked):
    """(outcomes, table without stamps of time) by a loop over the requests in order."""
    state, out = dict(existing), []
    for no, op, site, text in sorted(asked):
        config = json.loads(text) if text.startswith("{") and text.endswith("}") else None
        ok = config is not None and "vin" in config and "goal" in config
        if op == "create" and site in state:
            out.append((no, site, "conflict"))
        elif op == "update" and site not in state:
            out.append((no, site, "missing"))
        elif not ok:
            out.append((no, site, "invalid"))
        elif op == "create":
            meta = config.get("_metadata", {}) | {"site_id": site, "created_by": "me", "version": "1.0.0"}
            state[site] = config | {"_metadata": meta}
            out.append((no, site, "created"))
        else:
            before = state[site].get("_metadata", {})
            meta = config.get("_metadata", before) | {"site_id": site, "updated_by": "me", "version": before.get("version", "1.0.0")}
            state[site] = config | {"_metadata": meta}
            out.append((no, site, "updated"))
    return sorted(out), state


def bare(config):
    config = json.loads(config)
    return {k: ({x: y for x, y in v.items() if not x.endswith("_at")} if k == "_metadata" else v) for k, v in config.items()}


def test_batches_against_a_plain_loop(spark):
    rng = random.Random(8)
    for seed in range(3):
        existing = {f"s{i}": GOOD | {"n": "//n"} | ({"_metadata": {"version": "2.0", "old": 1}} if i % 2 else {}) for i in range(4)}
        asked = []
        for no in range(60):
            config = dict(rng.choice([GOOD, GOOD, GOOD, {"vin": "x"}, {"price": ".p"}]), price=f".p{no}")
            if rng.random() < 0.3:
                config["_metadata"] = {"note": no, "version": "9"}
            text = json.dumps(config) if rng.random() < 0.95 else "{broken"
            asked.append((no, rng.choice(["create", "update"]), f"s{rng.randrange(9)}", text))
        old = spark.createDataFrame([(k, json.dumps(v)) for k, v in existing.items()], "site_id string, config string")
        new = spark.createDataFrame(asked, "request_no long, op string, site_id string, config string")
        want, state = plain(existing, asked)
        got = sorted((r["request_no"], r["site_id"], r["status"]) for r in schemas.schema_outcomes(old, new.repartition(5)).collect())
        assert got == want and len(got) == 60
        table = {r["site_id"]: bare(r["config"]) for r in schemas.applied_schemas(old, new, "me").collect()}
        assert table == {k: v for k, v in state.items()}, seed


def test_repeated_creations_give_one_row_each(spark):
    asked = spark.createDataFrame([("a", json.dumps(GOOD)), ("a", '{"price": ".p"}'), ("a", json.dumps(GOOD | {"x": ".y"})), ("b", '{"price": ".p"}')], "site_id string, config string")
    none = asked.limit(0)
    got = schemas.create_schemas(none, asked).collect()
    assert sorted((r["site_id"], r["status"]) for r in got) == [("a", "conflict"), ("a", "conflict"), ("a", "created"), ("b", "invalid")] or sorted(
        (r["site_id"], r["status"]) for r in got
    ) == [("a", "conflict"), ("a", "created"), ("a", "invalid"), ("b", "invalid")]
    assert sum(r["config"] is not None for r in got) == 1 and len(got) == 4
    told = {r["status"]: r["error"] for r in got}
    assert told["created"] is None and told["conflict"] == "Schema already exists: a" and told["invalid"].startswith("Invalid schema: Missing required field: vin")


def test_errors_of_each_request(spark):
    old = spark.createDataFrame([("s", json.dumps(GOOD))], "site_id string, config string")
    asked = spark.createDataFrame([(1, "update", "t", json.dumps(GOOD)), (2, "update", "s", "[]"), (3, "create", "s", json.dumps(GOOD))], "request_no long, op string, site_id string, config string")
    got = {r["request_no"]: (r["status"], r["error"]) for r in schemas.schema_outcomes(old, asked).collect()}
    assert got == {1: ("missing", "Schema not found: t"), 2: ("invalid", "Invalid schema: unreadable"), 3: ("conflict", "Schema already exists: s")}
