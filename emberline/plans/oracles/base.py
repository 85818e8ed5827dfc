"""DuckDB building blocks for the oracles, written apart from the Spark side.

`compose` prefixes a statement with the common table expressions it mentions.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["runs"] = """
SELECT o_orderkey AS run_id, 'https://ci.example.com/runs/' || o_orderkey AS run_url,
  CASE o_orderkey % 3 WHEN 0 THEN 'ci.yaml' WHEN 1 THEN 'e2e.yaml' ELSE 'nightly.yml' END AS workflow,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'main' WHEN '2' THEN 'release'
    WHEN '3' THEN 'gh-readonly-queue/main/pr-' || o_orderkey
    WHEN '4' THEN 'gh-readonly-queue/develop/pr-' || o_orderkey ELSE 'develop' END AS branch,
  CASE WHEN left(o_orderpriority, 1) IN ('3', '4') THEN 'merge_group'
    WHEN o_orderkey % 2 = 0 THEN 'push' ELSE 'pull_request' END AS event,
  md5(CAST(o_custkey AS VARCHAR)) AS commit_sha, o_orderdate AS created_ts,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, 1 + o_orderkey % 2 AS run_attempt,
  CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'P' THEN 'cancelled' ELSE 'success' END AS conclusion,
  CASE WHEN o_orderkey % 11 = 0 THEN 'pending' WHEN o_orderkey % 13 = 0 THEN 'error' ELSE 'done' END AS status
FROM orders"""

CTES["bad_runs"] = "SELECT * FROM runs WHERE conclusion <> 'success'"

CTES["jobs"] = """
SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS job_seq,
  CAST('0x' || left(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' ||
    CAST(l_quantity AS INT) || '|' || CAST(round(l_extendedprice * 100) AS BIGINT) || '|' ||
    strftime(l_shipdate, '%Y%m%d')), 15) AS BIGINT) AS job_id,
  'job-' || l_linenumber AS job_name,
  CASE l_returnflag WHEN 'R' THEN 'failure' WHEN 'A' THEN 'cancelled' ELSE 'success' END AS conclusion,
  l_shipdate AS completed_ts,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'failure' ELSE 'success' END AS build,
  CASE WHEN l_returnflag = 'R' THEN 'failure' WHEN l_returnflag = 'A' AND l_suppkey % 4 = 0 THEN 'failure'
    WHEN l_returnflag = 'A' THEN 'cancelled' ELSE 'success' END AS test,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'build'
    WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_suppkey % 4 = 0) THEN 'test' ELSE '' END AS failure_step,
  l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber % 6 AS framework, CAST(l_quantity AS INT) AS qty
FROM lineitem"""

CTES["bad_jobs"] = "SELECT * FROM jobs WHERE conclusion <> 'success'"

CTES["parts"] = """
SELECT p_partkey AS partkey, p_name, p_type, p_brand, lower(replace(p_brand, '#', '-')) AS brand_slug FROM part"""

CTES["fact"] = """
SELECT r.run_id, r.run_url, r.branch, r.event, r.commit_sha, j.job_name AS failed_job_name,
  j.conclusion AS job_conclusion, r.created_at AS run_started_at,
  strftime(j.completed_ts, '%Y-%m-%dT%H:%M:%SZ') AS job_completed_at, r.run_attempt, j.failure_step,
  j.job_seq, j.job_id
FROM bad_runs r JOIN bad_jobs j ON r.run_id = j.run_id"""

CTES["classified"] = """
SELECT r.run_id, r.run_url, r.branch, r.event, r.commit_sha, r.created_at AS run_started_at, r.created_ts,
  r.run_attempt, r.status, j.job_seq, j.job_id, j.job_name, j.conclusion AS job_conclusion, j.failure_step AS step,
  CASE p_type WHEN 'STANDARD' THEN 'test-flake/' WHEN 'ECONOMY' THEN 'infra-flake/' WHEN 'PROMO' THEN 'bug/'
    WHEN 'SMALL' THEN 'build-error/' WHEN 'MEDIUM' THEN 'test-flake/systemic-' ELSE 'misc/' END || brand_slug ||
    CASE WHEN suppkey % 2 = 0 THEN '/T' || (suppkey % 10) ELSE '' END AS category,
  CASE WHEN suppkey % 17 = 0 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN ''
    WHEN (p_type IN ('PROMO', 'SMALL')) <> (suppkey % 13 = 0 AND p_brand LIKE 'Brand#2%') THEN 'no'
    ELSE 'yes' END AS is_flake,
  CASE suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'T' || (suppkey % 10)
    ELSE 'T' || (suppkey % 10) || ', T' || (j.partkey % 7) END AS test_id,
  CASE WHEN suppkey % 5 = 0 THEN '' ELSE 'error in ' || p_name || ' after ' || qty || 's' END AS error_message,
  CASE WHEN suppkey % 7 = 0 THEN '' ELSE 'Job ' || job_name || ' failed on ' || p_name END AS summary,
  row_number() OVER (ORDER BY r.created_ts DESC, r.run_id, j.job_seq, j.job_id) AS pos
FROM bad_jobs j JOIN parts p ON j.partkey = p.partkey JOIN bad_runs r ON r.run_id = j.run_id"""

CTES["done"] = "SELECT * FROM classified WHERE status = 'done'"

CTES["valid"] = """
SELECT * EXCLUDE (category), category AS full_category,
  CASE WHEN len(string_split(category, '/')) >= 3
    THEN array_to_string(string_split(category, '/')[:-2], '/') ELSE category END AS category,
  CASE WHEN len(string_split(category, '/')) >= 3 THEN string_split(category, '/')[-1] ELSE '' END AS subcategory
FROM done WHERE regexp_matches(category, '^(test-flake|infra-flake|bug|build-error)/')"""

CTES["cats"] = """
SELECT category, CAST(count(DISTINCT run_id) AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS jobs,
  CASE WHEN min(is_flake) = 'yes' AND max(is_flake) = 'yes' THEN 'yes'
    WHEN min(is_flake) = 'no' AND max(is_flake) = 'no' THEN 'no' ELSE 'mixed' END AS flake,
  coalesce(arg_min(error_message, pos) FILTER (error_message <> ''), '') AS example_error,
  coalesce(arg_min(summary, pos) FILTER (summary <> ''), '') AS example_summary,
  max(run_started_at) AS last_started_at, min(run_started_at) AS first_started_at, min(pos) AS first_pos
FROM valid GROUP BY category"""

CTES["cat_tests"] = """
SELECT DISTINCT category, trim(t) AS test_id FROM (SELECT category, unnest(string_split(test_id, ',')) AS t FROM valid)
WHERE trim(t) <> ''"""

CTES["verdicts"] = """
SELECT run_id, CAST(count(*) AS BIGINT) AS jobs,
  CASE WHEN count(*) FILTER (is_flake = 'no') > 0 THEN 'real'
    WHEN count(*) FILTER (is_flake = 'yes') > 0 THEN 'flake' ELSE 'unclear' END AS verdict
FROM done GROUP BY run_id"""

CTES["totals"] = """
SELECT CAST(count(*) AS BIGINT) AS total_runs, CAST(count(*) FILTER (verdict = 'flake') AS BIGINT) AS flake_runs,
  CAST(count(*) FILTER (verdict = 'real') AS BIGINT) AS real_failure_runs,
  CAST(count(*) FILTER (verdict = 'unclear') AS BIGINT) AS unclear_runs, CAST(sum(jobs) AS BIGINT) AS total_jobs
FROM verdicts"""

CTES["log"] = r"""
SELECT run_id, job_id, CAST(n AS BIGINT) AS line_no, strftime(completed_ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' ||
  CASE n WHEN 1 THEN 'Run ' || job_name WHEN 2 THEN 'Testing part ' || p_name
   WHEN 3 THEN CASE framework
     WHEN 0 THEN chr(27) || '[31m[FAIL]' || chr(27) || '[0m Parts [It] updates the part [' || (10000 + j.partkey % 97) || ', sanity, slow]'
     WHEN 1 THEN '--- FAIL: TestPart' || (j.partkey % 89) || ' (0.53s)'
     WHEN 2 THEN 'FAILED tests/test_part.py::TestPart::test_case_' || (j.partkey % 83) || ' - AssertionError'
     WHEN 3 THEN 'Tests run: 1, Failures: 1 <<< FAILURE! PartServiceTest#testCase' || (j.partkey % 79)
     WHEN 4 THEN 'FAIL src/part/case' || (j.partkey % 97) || '.test.ts > PartModule > rejects case'
     ELSE 'Collecting the results of upstream jobs' END
   ELSE CASE WHEN framework = 5 AND suppkey % 3 = 0 THEN 'Result: an upstream job did not pass'
     WHEN p_type = 'STANDARD' THEN 'context deadline exceeded after 30s'
     WHEN p_type = 'ECONOMY' THEN 'dial tcp 10.0.0.7:5432: connection refused'
     WHEN p_type = 'PROMO' THEN 'panic: runtime error: nil pointer dereference'
     WHEN p_type = 'SMALL' THEN 'src/part.go:42: undefined: NewPartClient'
     WHEN p_type = 'MEDIUM' THEN 'timed out waiting for device /dev/part after 60s'
     ELSE 'fatal: out of memory (killed)' END END AS text
FROM bad_jobs j JOIN parts p ON j.partkey = p.partkey, range(1, 5) AS g(n)"""

# What the log of a job is known to say, straight from the columns it was made of.
CTES["sig"] = """
SELECT j.run_id, j.job_id, framework < 5 AS ran_test, p_type = 'SMALL' AND NOT silent AS build,
  p_type IN ('STANDARD', 'MEDIUM') AND NOT silent AS timeout,
  CASE p_type WHEN 'STANDARD' THEN 'context deadline exceeded after 30s'
    WHEN 'ECONOMY' THEN 'dial tcp 10.0.0.7:5432: connection refused'
    WHEN 'PROMO' THEN 'panic: runtime error: nil pointer dereference'
    WHEN 'SMALL' THEN 'src/part.go:42: undefined: NewPartClient'
    WHEN 'MEDIUM' THEN 'timed out waiting for device /dev/part after 60s'
    ELSE 'fatal: out of memory (killed)' END AS error_message,
  CASE p_type WHEN 'STANDARD' THEN 'context deadline exceeded after #s'
    WHEN 'ECONOMY' THEN 'dial tcp #.#.#.#:#: connection refused'
    WHEN 'PROMO' THEN 'panic: runtime error: nil pointer dereference'
    WHEN 'SMALL' THEN 'src/part.go:#: undefined: NewPartClient'
    WHEN 'MEDIUM' THEN 'timed out waiting for device /dev/part after #s'
    ELSE 'fatal: out of memory (killed)' END AS signature,
  CASE p_type WHEN 'STANDARD' THEN 'context-deadline-exceeded-after-s' WHEN 'ECONOMY' THEN 'dial-tcp-connection-refused'
    WHEN 'PROMO' THEN 'panic-runtime-error-nil-pointer-dereference'
    WHEN 'SMALL' THEN 'src-part-go-undefined-newpartclient' WHEN 'MEDIUM' THEN 'timed-out-waiting-for-device-dev-part-after-s'
    ELSE 'fatal-out-of-memory-killed' END AS slug,
  CASE framework WHEN 0 THEN CAST(10000 + j.partkey % 97 AS VARCHAR) WHEN 1 THEN 'TestPart' || (j.partkey % 89)
    WHEN 2 THEN 'tests/test_part.py::TestPart::test_case_' || (j.partkey % 83)
    WHEN 3 THEN 'PartServiceTest#testCase' || (j.partkey % 79) WHEN 4 THEN 'PartModule > rejects case' ELSE '' END AS test_id,
  CASE framework WHEN 2 THEN 'tests/test_part.py' WHEN 4 THEN 'src/part/case' || (j.partkey % 97) || '.test.ts' ELSE '' END AS test_file
FROM (SELECT *, framework = 5 AND suppkey % 3 = 0 AS silent FROM bad_jobs) j JOIN parts p ON j.partkey = p.partkey
WHERE NOT silent"""

def _marker(key: str) -> str:
    return f"""CASE framework WHEN 0 THEN chr(27) || '[31m[FAIL]' || chr(27) || '[0m Parts [It] updates the part [' || (10000 + {key} % 97) || ', sanity, slow]'
      WHEN 1 THEN '--- FAIL: TestPart' || ({key} % 89) || ' (0.53s)'
      WHEN 2 THEN 'FAILED tests/test_part.py::TestPart::test_case_' || ({key} % 83) || ' - AssertionError'
      WHEN 3 THEN 'Tests run: 1, Failures: 1 <<< FAILURE! PartServiceTest#testCase' || ({key} % 79)
      WHEN 4 THEN 'FAIL src/part/case' || ({key} % 97) || '.test.ts > PartModule > rejects case ' || ({key} % 97)
      ELSE 'Collecting the results of upstream jobs' END"""


def _test(key: str) -> str:
    return f"""CASE framework WHEN 0 THEN CAST(10000 + {key} % 97 AS VARCHAR) WHEN 1 THEN 'TestPart' || ({key} % 89)
      WHEN 2 THEN 'tests/test_part.py::TestPart::test_case_' || ({key} % 83) WHEN 3 THEN 'PartServiceTest#testCase' || ({key} % 79)
      WHEN 4 THEN 'PartModule > rejects case ' || ({key} % 97) ELSE '' END"""


CTES["long_log"] = f"""
SELECT run_id, job_id, CAST(n AS BIGINT) AS line_no, 52 + j.partkey % 13 AS n_lines,
  strftime(completed_ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || CASE WHEN n = 1 THEN 'Run ' || job_name WHEN n = 2 THEN 'Testing part ' || p_name
    WHEN n = 8 OR (n = 40 AND j.partkey % 2 = 0) THEN {_marker('j.partkey')} WHEN n = 13 THEN {_marker('suppkey')}
    WHEN n = 20 AND suppkey % 4 = 0 THEN 'node-' || (suppkey % 25) || ': heartbeat lost'
    WHEN n = 52 + j.partkey % 13 THEN CASE WHEN framework = 5 AND suppkey % 3 = 0 THEN 'Result: an upstream job did not pass'
      WHEN p_type = 'STANDARD' THEN 'context deadline exceeded after 30s' WHEN p_type = 'ECONOMY' THEN 'dial tcp 10.0.0.7:5432: connection refused'
      WHEN p_type = 'PROMO' THEN 'panic: runtime error: nil pointer dereference' WHEN p_type = 'SMALL' THEN 'src/part.go:42: undefined: NewPartClient'
      WHEN p_type = 'MEDIUM' THEN 'timed out waiting for device /dev/part after 60s' ELSE 'fatal: out of memory (killed)' END
    ELSE 'step ' || n || ' ok' END AS text
FROM bad_jobs j JOIN parts p ON j.partkey = p.partkey, range(1, 65) AS g(n) WHERE n <= 52 + j.partkey % 13"""

# What a long log says, from the columns it was made of: its first test, all tests, error and root cause.
CTES["long_sig"] = f"""
SELECT *, CASE WHEN first_test = second_test THEN first_test ELSE first_test || ', ' || second_test END AS failed_test,
  coalesce(root_cause, CASE p_type WHEN 'STANDARD' THEN 'context-deadline-exceeded-after-s' WHEN 'ECONOMY' THEN 'dial-tcp-connection-refused'
    WHEN 'PROMO' THEN 'panic-runtime-error-nil-pointer-dereference' WHEN 'SMALL' THEN 'src-part-go-undefined-newpartclient'
    WHEN 'MEDIUM' THEN 'timed-out-waiting-for-device-dev-part-after-s' END) AS slug
FROM (SELECT j.run_id, j.job_id, j.framework, j.partkey, j.suppkey, p_type, framework < 5 AS ran_test, p_type = 'SMALL' AND NOT silent AS build,
  p_type IN ('STANDARD', 'MEDIUM') AND NOT silent AS timeout, {_test('j.partkey')} AS first_test, {_test('suppkey')} AS second_test,
  CASE WHEN suppkey % 4 = 0 THEN 'lost-node-' || (suppkey % 25) WHEN p_type NOT IN ('STANDARD', 'ECONOMY', 'PROMO', 'SMALL', 'MEDIUM')
    THEN 'out-of-memory' END AS root_cause,
  CASE WHEN suppkey % 4 = 0 THEN 'node-' || (suppkey % 25) || ': heartbeat lost' WHEN p_type = 'STANDARD' THEN 'context deadline exceeded after 30s'
    WHEN p_type = 'ECONOMY' THEN 'dial tcp 10.0.0.7:5432: connection refused' WHEN p_type = 'PROMO' THEN 'panic: runtime error: nil pointer dereference'
    WHEN p_type = 'SMALL' THEN 'src/part.go:42: undefined: NewPartClient' WHEN p_type = 'MEDIUM' THEN 'timed out waiting for device /dev/part after 60s'
    ELSE 'fatal: out of memory (killed)' END AS error_message,
  CASE framework WHEN 2 THEN ['tests/test_part.py'] WHEN 4 THEN ['src/part/case' || (j.partkey % 97) || '.test.ts', 'src/part/case' || (suppkey % 97) || '.test.ts']
    ELSE [] END AS test_files
  FROM (SELECT *, framework = 5 AND suppkey % 3 = 0 AS silent FROM bad_jobs) j JOIN parts p ON j.partkey = p.partkey
  WHERE NOT silent OR suppkey % 4 = 0)"""

CTES["commits"] = r"""
SELECT md5('c' || p.partkey) AS sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS author_date,
  CASE p.partkey % 4 WHEN 0 THEN 'Fix flaky test T' || (p.partkey % 10) WHEN 1 THEN 'Increase timeout for ' || brand_slug
    WHEN 2 THEN 'Retry ' || p_name || ' setup' ELSE 'Update docs for ' || p_name END AS subject
FROM parts p JOIN orders o ON o.o_orderkey = p.partkey WHERE o_orderdate >= TIMESTAMP '2001-05-03'"""

CTES["commit_files"] = """
SELECT DISTINCT md5(CAST(o_custkey AS VARCHAR)) AS sha, f AS filename FROM (
  SELECT o_custkey, 'src/part/case' || (o_custkey % 97) || '.test.ts' AS f FROM orders
  UNION ALL SELECT o_custkey, 'tests/test_part.py' FROM orders WHERE o_custkey % 5 = 0)"""

CTES["prs"] = """
SELECT s_suppkey AS number, strftime(DATE '2001-01-01' + CAST(s_suppkey AS INT), '%Y-%m-%dT00:00:00Z') AS created,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Deflake T' || (s_suppkey % 10)
    ELSE 'Investigate brand-' || (s_suppkey % 25) || ' failures' END AS title,
  'https://git.example.com/example/shop/pull/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 9 <> 0"""

# Search terms by definition: best kind per (category, token).
CTES["terms"] = """
SELECT category, token, arg_max(kind, (weight, kind)) AS kind, CAST(max(weight) AS INT) AS weight FROM (
  SELECT category, lower(test_id) AS token, 'test_id' AS kind, 4 AS weight FROM cat_tests
  UNION ALL SELECT category, lower(split_part(category, '/', 2)), 'slug', 3 FROM cats
  UNION ALL SELECT category, w, 'component', 3 FROM
    (SELECT category, unnest(string_split(split_part(category, '/', 2), '-')) AS w FROM cats)
    WHERE regexp_full_match(w, '[a-z]{4,}') AND w NOT IN ('systemic')
  UNION ALL SELECT category, w, 'error', 2 FROM
    (SELECT category, unnest(string_split(example_error, ' ')) AS w FROM cats)
    WHERE regexp_full_match(w, '[a-z]{4,}') AND w NOT IN ('error', 'after')
) GROUP BY category, token"""

# Every category against every candidate: the definition, without candidate selection.
_MATCH = """
SELECT category, ref, date, title, CASE WHEN strong IS NOT NULL THEN 'match' ELSE 'possible' END AS confidence,
  weak_hits, CAST(coalesce(strong, weak) + CASE WHEN action THEN 1 ELSE 0 END AS BIGINT) AS weight
FROM (
  SELECT t.category, c.ref, c.date, c.title, max(weight) FILTER (kind IN ('test_id', 'slug')) AS strong,
    max(weight) FILTER (kind IN ('component', 'error')) AS weak, CAST(count(*) FILTER (kind IN ('component', 'error')) AS BIGINT) AS weak_hits,
    any_value(len(list_intersect(c.ws, ['fix','flake','flaky','deflake','retry','timeout'])) > 0) AS action
  FROM terms t JOIN cats k ON t.category = k.category
  JOIN (SELECT {ref} AS ref, {date} AS date, {title} AS title,
          list_concat(string_split(lower({title}), ' '), string_split(replace(lower({title}), '-', ' '), ' ')) AS ws FROM {source}) c
    ON list_contains(c.ws, t.token) {when}
  GROUP BY t.category, c.ref, c.date, c.title)
WHERE strong IS NOT NULL OR weak_hits >= 2"""
CTES["commit_hits"] = _MATCH.format(ref="sha", date="author_date", title="subject", source="commits",
                                    when="AND c.date >= k.first_started_at")
CTES["pr_hits"] = _MATCH.format(ref="CAST(number AS VARCHAR)", date="created", title="title", source="prs", when="")

CTES["items"] = """
SELECT category, 'commit' AS type, CAST(NULL AS BIGINT) AS id, ref AS sha,
  'https://git.example.com/example/shop/commit/' || ref AS url, title, date, confidence FROM commit_hits
UNION ALL SELECT category, 'pr', CAST(ref AS BIGINT), NULL, 'https://git.example.com/example/shop/pull/' || ref,
  title, date, confidence FROM pr_hits"""

CTES["phase_events"] = """
SELECT user_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 'classify' ELSE 'recheck' END AS phase, event_id,
  event_type AS tool, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS turns,
  CAST(round(value * 1000) AS BIGINT) AS duration_ms, event_type = 'error' AND value > 50 AS is_error FROM events"""

CTES["phases"] = """
SELECT run_id, phase, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  bool_or(is_error) AS is_error, CAST(count(*) AS BIGINT) AS calls FROM phase_events GROUP BY run_id, phase"""

CTES["agents"] = """
SELECT CAST(count(*) AS BIGINT) AS agents, CAST(count(*) FILTER (failed) AS BIGINT) AS errors
FROM (SELECT run_id, bool_or(is_error) AS failed FROM phases GROUP BY run_id)"""

CTES["phase_metrics"] = """
SELECT phase || '.turns' AS metric, turns AS v FROM phases
UNION ALL SELECT phase || '.duration_ms', duration_ms FROM phases"""

CTES["metric_dists"] = """
SELECT m AS metric, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max,
  coalesce(CAST((CAST(sum(v) AS BIGINT) * 20 + count(v)) // (2 * count(v)) AS DOUBLE) / 10, 0.0) AS avg,
  coalesce(median(v), 0.0) AS median
FROM (VALUES ('classify.turns'), ('classify.duration_ms'), ('recheck.turns'), ('recheck.duration_ms')) t(m)
LEFT JOIN (SELECT * FROM phase_metrics WHERE v <> 0) p ON p.metric = t.m GROUP BY m"""

CTES["updates"] = """
SELECT run_id, job_seq, job_id, CASE conclusion WHEN 'failure' THEN 'done' WHEN 'cancelled' THEN 'classified'
  ELSE 'error' END AS status FROM jobs"""

CTES["latest"] = """
SELECT run_id, CASE max(CASE status WHEN 'error' THEN 1 WHEN 'classified' THEN 2 ELSE 3 END)
  WHEN 1 THEN 'error' WHEN 2 THEN 'classified' ELSE 'done' END AS status, CAST(count(*) AS BIGINT) AS updates
FROM updates GROUP BY run_id"""

CTES["stamps"] = """
SELECT run_id, created_ts, CASE run_id % 5 WHEN 0 THEN created_at
  WHEN 1 THEN strftime(created_ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' WHEN 2 THEN strftime(created_ts, '%Y-%m-%d')
  WHEN 3 THEN '' ELSE 'not-a-date' END AS stamp FROM runs"""


def compose(sql: str, recursive: str = "") -> str:
    """Prefix `sql` with the expressions it names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql + recursive)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in order]
    if recursive:
        parts.append(recursive)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} " + ",\n".join(parts) + "\n" + sql.strip() if parts else sql.strip()
