"""Oracles of log signals, verdicts and convergence.

Where possible the expected answer comes from the columns the log text was made of, not
from reading the text again with the same patterns.
"""

from emberline.plans.oracles.base import _MATCH, CTES, compose

_HISTORY = """
SELECT branch, job_name, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (p) AS BIGINT) AS passed_runs,
  CAST(count(*) FILTER (f) AS BIGINT) AS failed_runs, count(*) FILTER (p) = 0 AND count(*) >= 2 AS never_passes
FROM (SELECT r.branch, j.job_name, r.run_id, bool_or(j.conclusion = 'success') AS p, bool_or(j.conclusion <> 'success') AS f
  FROM (SELECT run_id, branch, row_number() OVER (PARTITION BY branch ORDER BY created_ts DESC, run_id) AS rn FROM runs) r
  JOIN jobs j ON j.run_id = r.run_id WHERE rn <= {n} GROUP BY ALL) GROUP BY branch, job_name"""

_SAME = """
SELECT commit_sha, job_name, CAST(count(*) FILTER (j.conclusion <> 'success') AS BIGINT) AS failed,
  CAST(count(*) FILTER (j.conclusion = 'success') AS BIGINT) AS passed,
  bool_or(j.conclusion <> 'success') AND bool_or(j.conclusion = 'success') AS intermittent
FROM jobs j JOIN runs r ON r.run_id = j.run_id GROUP BY commit_sha, job_name"""

_SYSTEMIC = """
SELECT run_id, run_jobs, signature_jobs, signature FROM (
  SELECT j.run_id, CAST(sum(count(*)) OVER (PARTITION BY j.run_id) AS BIGINT) AS run_jobs,
    CAST(count(*) AS BIGINT) AS signature_jobs, s.signature
  FROM bad_jobs j JOIN bad_runs r ON r.run_id = j.run_id
  LEFT JOIN sig s ON s.run_id = j.run_id AND s.job_id = j.job_id GROUP BY j.run_id, s.signature)
WHERE signature IS NOT NULL AND run_jobs >= 2 AND signature_jobs >= 0.9 * run_jobs"""

_TOUCHED = """
SELECT s.run_id, s.job_id, r.commit_sha AS sha, s.test_file AS filename FROM sig s JOIN runs r ON r.run_id = s.run_id
WHERE (r.commit_sha, s.test_file) IN (SELECT sha, filename FROM commit_files)"""

_CLASSIFY = f"""
SELECT run_id, job_id, job_name, reason,
  CASE reason WHEN 'cascade-cancel' THEN 'infra-flake/cascade-cancel' WHEN 'build-error' THEN 'build-error/' || slug
    WHEN 'never-ran' THEN 'infra-flake/' || coalesce(slug, 'unknown-failure')
    WHEN 'systemic' THEN 'test-flake/systemic-' || slug
    WHEN 'regression' THEN 'bug/' || slug || CASE WHEN test_id <> '' THEN '/' || test_id ELSE '' END
    ELSE 'test-flake/' || slug || CASE WHEN test_id <> '' THEN '/' || test_id ELSE '' END END AS category,
  CASE WHEN reason IN ('build-error', 'regression') THEN 'no' WHEN reason = 'unknown' THEN 'unclear' ELSE 'yes' END AS is_flake,
  coalesce(test_id, '') AS test_id, coalesce(error_message, '') AS error_message
FROM (
  SELECT j.run_id, j.job_id, j.job_name, s.slug, s.test_id, s.error_message,
    CASE WHEN j.conclusion = 'cancelled' AND j.failure_step = '' AND j.run_id IN (SELECT run_id FROM jobs WHERE conclusion = 'failure')
      THEN 'cascade-cancel'
    WHEN s.build THEN 'build-error' WHEN NOT coalesce(s.ran_test, false) THEN 'never-ran'
    WHEN (j.run_id, s.signature) IN (SELECT run_id, signature FROM ({_SYSTEMIC})) THEN 'systemic'
    WHEN (r.commit_sha, j.job_name) IN (SELECT commit_sha, job_name FROM ({_SAME}) WHERE intermittent) THEN 'passes-elsewhere'
    WHEN (r.branch, j.job_name) IN (SELECT branch, job_name FROM ({_HISTORY.format(n=20)}) WHERE never_passes)
      OR (j.run_id, j.job_id) IN (SELECT run_id, job_id FROM ({_TOUCHED})) THEN 'regression'
    WHEN s.timeout THEN 'timing' ELSE 'unknown' END AS reason
  FROM bad_jobs j JOIN bad_runs r ON r.run_id = j.run_id
  LEFT JOIN sig s ON s.run_id = j.run_id AND s.job_id = j.job_id
  WHERE s.job_id IS NOT NULL OR j.conclusion = 'cancelled')"""

# Rules that fire on the marker lines and on the last line, by framework and by part type.
_RULE_HITS = """
SELECT run_id, job_id, CAST(line_no AS BIGINT) AS line_no, r.rule_id, r.framework, r.kind, r.priority, r.slug FROM (
  SELECT run_id, job_id, unnest(CASE WHEN partkey % 2 = 0 THEN [8, 13, 40] ELSE [8, 13] END) AS line_no,
    CASE framework WHEN 0 THEN ['ginkgo-test-1', 'ginkgo-case-1'] WHEN 1 THEN ['go-test-1'] WHEN 2 THEN ['pytest-test-1']
      WHEN 3 THEN ['junit-test-1', 'junit-test-2'] WHEN 4 THEN ['jest-test-1'] ELSE [] END AS ids FROM bad_jobs
  UNION ALL SELECT run_id, job_id, 20, ['node-' || (suppkey % 25)] FROM bad_jobs WHERE suppkey % 4 = 0
  UNION ALL SELECT run_id, job_id, 52 + j.partkey % 13, CASE p_type WHEN 'STANDARD' THEN ['any-timeout-3'] WHEN 'ECONOMY' THEN ['any-network-1']
      WHEN 'PROMO' THEN ['go-crash-1', 'any-crash-1'] WHEN 'SMALL' THEN ['any-build-2'] WHEN 'MEDIUM' THEN ['any-timeout-2']
      ELSE ['any-resource-2', 'any-resource-3'] END
    FROM bad_jobs j JOIN parts p ON p.partkey = j.partkey WHERE NOT (framework = 5 AND suppkey % 3 = 0)) h
JOIN (SELECT id AS rule_id, split_part(id, '-', 1) AS framework, split_part(id, '-', 2) AS kind,
    CASE split_part(id, '-', 2) WHEN 'test' THEN 3 WHEN 'case' THEN 4 ELSE 1 END AS priority,
    CASE id WHEN 'any-resource-3' THEN 'out-of-memory' END AS slug
    FROM (SELECT unnest(['ginkgo-test-1', 'ginkgo-case-1', 'go-test-1', 'pytest-test-1', 'junit-test-1', 'junit-test-2', 'jest-test-1',
      'any-timeout-3', 'any-network-1', 'go-crash-1', 'any-crash-1', 'any-build-2', 'any-timeout-2', 'any-resource-2', 'any-resource-3']) AS id)
  UNION ALL SELECT 'node-' || n_nationkey, 'site', 'node', 1, 'lost-node-' || n_nationkey FROM nation) r
  ON list_contains(h.ids, r.rule_id)"""

_LONG_TOUCHED = """SELECT s.run_id, s.job_id FROM (SELECT run_id, job_id, unnest(test_files) AS f FROM long_sig) s
  JOIN runs r ON r.run_id = s.run_id WHERE (r.commit_sha, s.f) IN (SELECT sha, filename FROM commit_files)"""

_LONG_SYSTEMIC = _SYSTEMIC.replace("LEFT JOIN sig s", "LEFT JOIN (SELECT *, regexp_replace(error_message, '[0-9]+', '#', 'g') AS signature FROM long_sig) s")

_CLASSIFY_ALL = f"""
SELECT run_id, job_id, job_name, reason,
  CASE reason WHEN 'cascade-cancel' THEN 'infra-flake/cascade-cancel' WHEN 'build-error' THEN 'build-error/' || slug
    WHEN 'never-ran' THEN 'infra-flake/' || coalesce(slug, 'unknown-failure') WHEN 'systemic' THEN 'test-flake/systemic-' || slug
    ELSE CASE reason WHEN 'regression' THEN 'bug/' ELSE 'test-flake/' END || slug || CASE WHEN first_test <> '' THEN '/' || first_test ELSE '' END END AS category,
  CASE WHEN reason IN ('build-error', 'regression') THEN 'no' WHEN reason = 'unknown' THEN 'unclear' ELSE 'yes' END AS is_flake,
  coalesce(first_test, '') AS test_id, coalesce(failed_test, '') AS failed_test, coalesce(error_message, '') AS error_message
FROM (
  SELECT j.run_id, j.job_id, j.job_name, s.slug, s.first_test, s.failed_test, s.error_message,
    CASE WHEN j.conclusion = 'cancelled' AND j.failure_step = '' AND j.run_id IN (SELECT run_id FROM jobs WHERE conclusion = 'failure') THEN 'cascade-cancel'
    WHEN s.build THEN 'build-error' WHEN NOT coalesce(s.ran_test, false) THEN 'never-ran'
    WHEN (j.run_id, regexp_replace(s.error_message, '[0-9]+', '#', 'g')) IN (SELECT run_id, signature FROM ({_LONG_SYSTEMIC})) THEN 'systemic'
    WHEN (r.commit_sha, j.job_name) IN (SELECT commit_sha, job_name FROM ({_SAME}) WHERE intermittent) THEN 'passes-elsewhere'
    WHEN (r.branch, j.job_name) IN (SELECT branch, job_name FROM ({_HISTORY.format(n=20)}) WHERE never_passes)
      OR (j.run_id, j.job_id) IN ({_LONG_TOUCHED}) THEN 'regression'
    WHEN s.timeout THEN 'timing' ELSE 'unknown' END AS reason
  FROM bad_jobs j JOIN bad_runs r ON r.run_id = j.run_id LEFT JOIN long_sig s ON s.run_id = j.run_id AND s.job_id = j.job_id
  WHERE s.job_id IS NOT NULL OR j.conclusion = 'cancelled')"""

# Hits of the long logs, and hunks where the gap to the hit before is more than two frames.
_HUNKS = """
SELECT run_id, job_id, CAST(hunk_no AS BIGINT) AS hunk_no, CAST(greatest(1, min(line_no) - 5) AS BIGINT) AS first_line,
  CAST(least(max(n_lines), max(line_no) + 5) AS BIGINT) AS last_line
FROM (SELECT *, sum(CASE WHEN line_no - before <= 11 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, job_id ORDER BY line_no) AS hunk_no
  FROM (SELECT *, lag(line_no) OVER (PARTITION BY run_id, job_id ORDER BY line_no) AS before FROM long_log
    WHERE regexp_matches(text, '--- FAIL:|FAILED|heartbeat lost|timed out|panic:')))
GROUP BY run_id, job_id, hunk_no"""

# Words of a message, then every pair of distinct word sets.
_WORDS = """list_sort(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({text}), '[0-9]+', '#', 'g'),
  '[^a-z0-9#]+', ' ', 'g'), ' '), lambda w: w <> '')))"""

_PAIR = """len(list_intersect(a.ws, b.ws)) * 100 >= {percent} * len(list_distinct(list_concat(a.ws, b.ws)))"""

_CLUSTERS = f"""
errs AS (SELECT category AS name, runs, {_WORDS.format(text='example_error')} AS ws FROM cats),
links AS (SELECT a.name AS x, b.name AS y FROM errs a JOIN errs b ON a.name <> b.name AND len(a.ws) > 0 AND len(b.ws) > 0
          AND {_PAIR.format(percent=80)}),
reach(x, y) AS (SELECT name, name FROM errs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
grouped AS (SELECT e.name, e.runs, min(r.y) AS cluster FROM errs e JOIN reach r ON r.x = e.name GROUP BY e.name, e.runs)"""

# From the logs to renamed rows: names, their errors, clusters of similar errors and the winner of each.
_RENAMED = f"""
judged AS ({_CLASSIFY}),
rows_ AS (SELECT c.*, array_to_string(string_split(c.category, '/')[:2], '/') AS name, r.created_ts, r.created_at AS run_started_at,
    c.job_name || CASE WHEN c.test_id <> '' THEN ' in ' || c.test_id ELSE '' END || ': ' || c.reason AS summary,
    row_number() OVER (ORDER BY r.created_ts DESC, c.run_id, j.job_seq, j.job_id) AS pos
  FROM judged c JOIN bad_runs r ON r.run_id = c.run_id JOIN bad_jobs j ON j.run_id = c.run_id AND j.job_id = c.job_id),
errs AS (SELECT name, count(DISTINCT run_id) AS runs,
    {_WORDS.format(text="coalesce(arg_min(error_message, pos) FILTER (error_message <> ''), '')")} AS ws FROM rows_ GROUP BY name),
links AS (SELECT a.name AS x, b.name AS y FROM errs a JOIN errs b ON a.name <> b.name AND len(a.ws) > 0 AND len(b.ws) > 0
          AND {_PAIR.format(percent=80)}),
reach(x, y) AS (SELECT name, name FROM errs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
grouped AS (SELECT e.name, e.runs, min(r.y) AS cluster FROM errs e JOIN reach r ON r.x = e.name GROUP BY e.name, e.runs),
won AS (SELECT name, first_value(name) OVER (PARTITION BY cluster ORDER BY runs DESC, name) AS winner FROM grouped),
final AS (SELECT r.* EXCLUDE (category), w.winner || substr(r.category, length(r.name) + 1) AS category, w.winner
  FROM rows_ r JOIN won w ON w.name = r.name)"""

# The same from the long logs, with every failed test, and the commits that speak of the logs.
_RENAMED_ALL = _RENAMED.replace(_CLASSIFY, _CLASSIFY_ALL)
_OWN_TERMS = CTES["terms"].replace("FROM cat_tests", "FROM log_tests").replace("FROM cats", "FROM log_cats")
_FIX_REPORT = f"""{_RENAMED_ALL},
log_cats AS (SELECT winner AS category, count(DISTINCT run_id) AS runs, count(*) AS jobs, min(run_started_at) AS first_started_at,
  coalesce(arg_min(error_message, pos) FILTER (error_message <> ''), '') AS example_error FROM final GROUP BY winner),
log_tests AS (SELECT DISTINCT winner AS category, trim(t) AS test_id FROM (SELECT winner, unnest(string_split(failed_test, ',')) AS t FROM final) WHERE trim(t) <> ''),
log_terms AS ({_OWN_TERMS}),
log_commits AS (SELECT md5('g' || p.partkey) AS sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS author_date,
  CASE p.partkey % 5 WHEN 0 THEN 'Stabilize TestPart' || (p.partkey % 89) WHEN 1 THEN 'Retry when connection refused on dial'
    WHEN 2 THEN 'Allow for context deadline exceeded' WHEN 3 THEN 'Fix lost-node-' || (p.partkey % 25) ELSE 'Update the docs' END AS subject
  FROM parts p JOIN orders o ON o.o_orderkey = p.partkey),
log_fixes AS ({_MATCH.format(ref="sha", date="author_date", title="subject", source="log_commits",
                             when="AND c.date >= k.first_started_at").replace("FROM terms t JOIN cats k", "FROM log_terms t JOIN log_cats k")})"""

ORACLES = {
    "log_fix_report": compose("""SELECT c.category, runs, jobs, CASE WHEN f.ref IS NOT NULL THEN 'commit' END AS type, f.ref AS sha, f.date, f.title, f.confidence
        FROM log_cats c LEFT JOIN log_fixes f ON f.category = c.category""", _FIX_REPORT),
    "renamed_categories": compose("""SELECT run_id, job_id, category, is_flake, test_id AS failed_test, summary, 'done' AS status FROM final""",
                                  _RENAMED),
    "pipeline_report": compose("""SELECT winner AS category,
        CASE WHEN count(*) = count(*) FILTER (is_flake = 'yes') THEN 'yes' WHEN count(*) = count(*) FILTER (is_flake = 'no') THEN 'no'
          ELSE 'mixed' END AS flake,
        CAST(count(DISTINCT run_id) AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS jobs,
        coalesce(arg_min(error_message, pos) FILTER (error_message <> ''), '') AS example_error,
        coalesce(arg_min(summary, pos) FILTER (summary <> ''), '') AS example_summary,
        min(run_started_at) AS first_started_at, max(run_started_at) AS last_started_at,
        CAST(count(DISTINCT category) FILTER (category <> winner) AS BIGINT) AS n_subcategories FROM final GROUP BY winner""", _RENAMED),
    "rule_hits": compose(_RULE_HITS),
    "rule_categories": compose("""SELECT run_id, job_id, CASE WHEN build THEN 'build-error/' || slug WHEN NOT ran_test THEN 'infra-flake/' || slug
        ELSE 'test-flake/' || slug || CASE WHEN first_test <> '' THEN '/' || first_test ELSE '' END END AS category, failed_test, error_message FROM long_sig"""),
    "failing_test_lists": compose("""SELECT run_id, job_id, first_test AS test_id, failed_test,
        CAST(CASE WHEN first_test = second_test THEN 1 ELSE 2 END AS BIGINT) AS n_tests FROM long_sig WHERE first_test <> ''"""),
    "classify_all_tests": compose(_CLASSIFY_ALL),
    "context_hunks": compose(_HUNKS),
    "log_lines": compose("SELECT run_id, job_id, line_no, text FROM log"),
    "log_line_counts": compose("SELECT run_id, job_id, CAST(count(*) AS BIGINT) AS lines FROM log GROUP BY run_id, job_id"),
    "failure_markers": compose("""SELECT run_id, job_id, line_no, framework, kind FROM (
        SELECT j.run_id, j.job_id, CAST(3 AS BIGINT) AS line_no, unnest(CASE framework WHEN 0 THEN ['ginkgo', 'ginkgo']
            WHEN 1 THEN ['go'] WHEN 2 THEN ['pytest'] WHEN 3 THEN ['junit'] WHEN 4 THEN ['jest'] ELSE [] END) AS framework,
          unnest(CASE framework WHEN 0 THEN ['test', 'case'] WHEN 5 THEN [] ELSE ['test'] END) AS kind FROM bad_jobs j
        UNION ALL
        SELECT j.run_id, j.job_id, 4, unnest(CASE p_type WHEN 'PROMO' THEN ['go', 'any'] ELSE ['any'] END),
          unnest(CASE p_type WHEN 'PROMO' THEN ['crash', 'crash'] WHEN 'STANDARD' THEN ['timeout'] WHEN 'MEDIUM' THEN ['timeout']
            WHEN 'ECONOMY' THEN ['network'] WHEN 'SMALL' THEN ['build'] ELSE ['resource'] END)
        FROM bad_jobs j JOIN parts p ON p.partkey = j.partkey WHERE NOT (framework = 5 AND suppkey % 3 = 0))"""),
    "normalize_errors": compose("""SELECT run_id, job_id, line_no, trim(replace(replace(text[22:],
        chr(27) || '[31m', ''), chr(27) || '[0m', '')) AS error_text FROM log"""),
    "extract_test_ids": compose("SELECT run_id, job_id, test_id, test_file FROM sig WHERE test_id <> ''"),
    "grep_context": compose("""SELECT l.run_id, l.job_id, l.line_no, bool_or(h.line_no = l.line_no) AS is_hit, l.text
        FROM log l JOIN (SELECT run_id, job_id, line_no FROM log WHERE contains(text, '--- FAIL:') OR contains(text, 'timed out')) h
          ON h.run_id = l.run_id AND h.job_id = l.job_id AND abs(h.line_no - l.line_no) <= 5 GROUP BY ALL"""),
    "drop_aggregation_jobs": compose("""SELECT run_id, job_id, conclusion FROM bad_jobs
        WHERE conclusion = 'cancelled' OR NOT (framework = 5 AND suppkey % 3 = 0)"""),
    "compose_category": compose("""SELECT run_id, job_id, CASE WHEN build THEN 'build-error/' || slug
        WHEN NOT ran_test THEN 'infra-flake/' || slug ELSE 'test-flake/' || slug ||
        CASE WHEN test_id <> '' THEN '/' || test_id ELSE '' END END AS category FROM sig"""),
    "intermittent_same_commit": compose(_SAME),
    "branch_history": compose(_HISTORY.format(n=20)),
    "branch_history_short": compose(_HISTORY.format(n=2)),
    "cascade_cancel": compose("""SELECT run_id, job_id, job_name FROM jobs WHERE conclusion = 'cancelled' AND failure_step = ''
        AND run_id IN (SELECT run_id FROM jobs WHERE conclusion = 'failure')"""),
    "commit_touches_test": compose(_TOUCHED),
    "systemic_failures": compose(_SYSTEMIC),
    "classify_failures": compose(_CLASSIFY),
    "similar_errors": compose(f"""SELECT array_to_string(a.ws, ' ') AS a, array_to_string(b.ws, ' ') AS b,
        CAST(len(list_intersect(a.ws, b.ws)) AS BIGINT) AS shared,
        CAST(len(list_distinct(list_concat(a.ws, b.ws))) AS BIGINT) AS total
        FROM (SELECT DISTINCT {_WORDS.format(text='error_message')} AS ws FROM classified WHERE error_message <> '') a
        JOIN (SELECT DISTINCT {_WORDS.format(text='error_message')} AS ws FROM classified WHERE error_message <> '') b
        ON array_to_string(a.ws, ' ') < array_to_string(b.ws, ' ') AND {_PAIR.format(percent=70)}"""),
    "converge_categories": compose("""SELECT name, runs, cluster, CAST(count(*) OVER (PARTITION BY cluster) AS BIGINT) AS members,
        first_value(name) OVER (PARTITION BY cluster ORDER BY runs DESC, name) AS winner FROM grouped""", _CLUSTERS),
}
