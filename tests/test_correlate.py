import random

from helpers import values

from emberline.operators import correlate

CANDIDATE = "type STRING, ref STRING, date STRING, title STRING, url STRING"
ITEM = "category STRING, type STRING, id LONG, sha STRING, url STRING, title STRING, date STRING, confidence STRING"


def test_match_rules(table):
    terms = table([("bug/pool", "t7", "test_id", 4), ("bug/pool", "pool", "slug", 3), ("bug/pool", "database", "error", 2),
                   ("bug/pool", "exhausted", "error", 2), ("bug/pool", "worker", "error", 2)],
                  "category STRING, token STRING, kind STRING, weight INT")
    seen = table([("bug/pool", "2026-02-10T00:00:00Z")], "category STRING, first_started_at STRING")
    found = table([("commit", r, f"2026-02-{d}T00:00:00Z", t, "u") for r, d, t in (
        ("1", "11", "Fix T7"), ("2", "09", "Fix T7"), ("3", "11", "Database only"), ("4", "11", "database worker cleanup"),
        ("5", "10", "Grow pool"), ("6", "11", "worker exhausted"))], CANDIDATE)
    got = correlate.match(terms, seen, found)
    assert values(got, "ref", "confidence", "weak_hits", "weight") == [
        ("1", "match", 0, 5), ("4", "possible", 2, 2), ("5", "match", 0, 3), ("6", "possible", 2, 2)]
    requests = correlate.match(terms, seen, found.replace("commit", "pr", "type"))
    assert ("2",) in values(requests, "ref")
    assert values(correlate.fix_items(requests).where("title = 'Grow pool'"), "id", "sha") == [(5, None)]


def test_weak_matches_equal_brute_force(table):
    rng = random.Random(5)
    vocabulary = [f"word{chr(97 + i)}" for i in range(8)]
    cats = {f"bug/c{i}": rng.sample(vocabulary, rng.randint(1, 4)) for i in range(25)}
    titles = {str(i): rng.sample(vocabulary, rng.randint(1, 5)) for i in range(40)}
    terms = table([(c, w, "error", 2) for c, ws in cats.items() for w in ws], "category STRING, token STRING, kind STRING, weight INT")
    seen = table([(c, "") for c in cats], "category STRING, first_started_at STRING")
    found = table([("commit", i, "2026-02-11T00:00:00Z", " ".join(ws), "u") for i, ws in titles.items()], CANDIDATE)
    expected = sorted((c, i, len(set(cw) & set(tw))) for c, cw in cats.items() for i, tw in titles.items() if len(set(cw) & set(tw)) >= 2)
    assert values(correlate.match(terms, seen, found), "category", "ref", "weak_hits") == expected


def test_orders(table):
    items = table([("c", "pr", 1, None, "u", "t", "2026-02-18T10:00:00Z", "possible"), ("c", "pr", 2, None, "u", "t", "", "match"),
                   ("c", "commit", None, "aaa", "u", "t", "2026-02-18T09:00:00Z", "match"),
                   ("c", "pr", 3, None, "u", "t", "2026-02-18T12:00:00Z", "match"),
                   ("c", "commit", None, "bbb", "u", "t", "2026-02-19", "possible")], ITEM)
    ranked = [r.ref for r in correlate.sorted_items(items).orderBy("position").collect()]
    assert ranked == ["3", "aaa", "2", "bbb", "1"]
    detail = [r.ref for r in correlate.detail_order(items).orderBy("position").collect()]
    assert detail == ["aaa", "3", "2", "bbb", "1"]


def test_file_kinds(table):
    paths = table([("a/b.test.ts",), ("tests/x.py",), ("src/core.ts",), (".github/workflows/ci.yaml",), ("Dockerfile",), ("src/contest.py",)], "p STRING")
    assert [r[0] for r in paths.select(correlate.file_kind(paths.p)).collect()] == ["test", "test", "production", "ci", "ci", "production"]


def test_search_terms(table):
    cats = table([("test-flake/poolWait-timeout", "error in red Bolt after 12s")], "category STRING, example_error STRING")
    ids = table([("test-flake/poolWait-timeout", "T1")], "category STRING, test_id STRING")
    got = dict((t, k) for t, k in values(correlate.search_terms(cats, ids), "token", "kind"))
    assert got == {"t1": "test_id", "poolwait-timeout": "slug", "poolwait": "component", "timeout": "component", "bolt": "error"}
