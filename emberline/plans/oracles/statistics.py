"""Oracles of execution statistics and report outputs."""

from emberline.plans.oracles.base import compose

_DIST = "{{'min': {m}.min, 'max': {m}.max, 'avg': {m}.avg, 'median': {m}.median}}"

# The categories in report order with their counts.
_COUNTED = """
SELECT row_number() OVER (ORDER BY runs DESC, first_pos) AS number, c.category, coalesce(d.description, '') AS description,
  flake, runs, jobs, example_error, example_summary, last_started_at, CAST(coalesce(n_t, 0) AS BIGINT) AS n_test_ids,
  CAST(coalesce(n_s, 0) AS BIGINT) AS n_subcategories, CAST(coalesce(n_f, 0) AS BIGINT) AS n_fixes,
  CAST(coalesce(n_m, 0) AS BIGINT) AS n_matches
FROM cats c
LEFT JOIN (SELECT category, count(*) AS n_t FROM cat_tests GROUP BY category) t ON t.category = c.category
LEFT JOIN (SELECT category, count(DISTINCT subcategory) AS n_s FROM valid WHERE subcategory <> '' GROUP BY category) s ON s.category = c.category
LEFT JOIN (SELECT category, count(*) AS n_f, count(*) FILTER (confidence = 'match') AS n_m FROM items GROUP BY category) f ON f.category = c.category
LEFT JOIN (SELECT array_to_string(string_split(category, '/')[:2], '/') AS category, arg_min(summary, pos) AS description
  FROM valid_full GROUP BY 1) d ON d.category = c.category"""
_FULL = "valid_full AS (SELECT * REPLACE (full_category AS category) FROM valid)"
_AFFECTED = """(SELECT category, CAST(run_id AS VARCHAR) AS run_id, run_url, branch, left(run_started_at, 10) AS date, run_started_at,
  CAST(count(*) AS BIGINT) AS jobs_failed FROM valid GROUP BY ALL)"""
_SUBS = "(SELECT DISTINCT category, subcategory FROM valid WHERE subcategory <> '')"

_AGO = "date_diff('day', CAST(left(last_started_at, 10) AS DATE), DATE '2001-08-01')"
_LINE = """'  - ' || left(date, 10) || ' [' || CASE type WHEN 'pr' THEN '#' || id ELSE left(sha, 7) END || '](' || url || ') ' || title"""


def _row(section, block, number, item, rank, key, line, source):
    return (f"SELECT {section} AS section, CAST({block} AS INT) AS block, CAST({number} AS BIGINT) AS number, {item} AS item, "
            f"CAST({rank} AS BIGINT) AS rank, {key} AS key, {line} AS line FROM {source}")


_B = "CASE WHEN flake = 'yes' THEN 0 ELSE 1 END"
_TABLE = ("chr(10) || '| No. | Root cause | Subcategories | Runs | Jobs | Last seen | Fixes | Possible fixes |' || chr(10) || "
          "'|---|---|---|---|---|---|---|---|'")
_AGE, _REF = "-epoch(CAST(date AS TIMESTAMPTZ))", "CASE type WHEN 'commit' THEN '0' || sha ELSE '1' || lpad(CAST(id AS VARCHAR), 20, '0') END"


def _of(rows):
    return f"(SELECT n.number, n.flake, i.* FROM nested n JOIN {rows} i ON i.category = n.category)"


def _fix(item, condition):
    return _row(4, _B, "number", item, _AGE, _REF, _LINE, f"{_of('items')} WHERE {condition}")


_MD = " UNION ALL ".join([
    _row(0, 0, 0, 0, 0, "''", """'# Why CI runs failed' || chr(10) || chr(10) || 'As of 2001-08-01. Failed runs: ' || total_runs || '; flaky ' ||
      flake_runs || ', lasting ' || real_failure_runs || ', undecided ' || unclear_runs || '.'""", "totals"),
    _row("DISTINCT CASE WHEN flake = 'yes' THEN 1 ELSE 2 END", 0, 0, 0, 0, "''",
         f"chr(10) || CASE WHEN flake = 'yes' THEN '### Flaky causes' ELSE '### Lasting causes' END || chr(10) || {_TABLE}", "nested"),
    _row("CASE WHEN flake = 'yes' THEN 1 ELSE 2 END", 1, "number", 0, 0, "''",
         f"""'| ' || number || ' | `' || category || '` | ' || n_subcategories || ' | ' || runs || ' | ' || jobs || ' | ' ||
         CASE WHEN {_AGO} = 0 THEN 'today' WHEN {_AGO} = 1 THEN '1 day ago' ELSE {_AGO} || ' days ago' END || ' | ' ||
         n_matches || ' | ' || (n_fixes - n_matches) || ' |'""", "nested"),
    _row(3, 0, 0, 0, 0, "''", """chr(10) || 'Failed jobs: ' || total_jobs || ' in ' || total_runs || ' runs.' || chr(10) ||
      chr(10) || '## Causes one by one' || chr(10)""", "totals"),
    _row(4, _B, "number", 0, 0, "''", """'### ' || number || '. `' || category || '`' || chr(10) ||
      CASE WHEN description <> '' THEN chr(10) || description || chr(10) ELSE '' END || chr(10) ||
      '- runs: ' || runs || chr(10) || '- jobs: ' || jobs""", "nested"),
    _row(4, _B, "number", 1, 0, "test_id", "'  - test: ' || test_id", _of("cat_tests")),
    _row(4, _B, "number", 2, 0, "subcategory", "'  - subcategory: ' || subcategory", _of(_SUBS)),
    _row(4, _B, "number", 3, 0, "''", "'- fixes:'", "nested WHERE n_matches > 0"),
    _fix(4, "confidence = 'match' AND type = 'commit'"), _fix(5, "confidence = 'match' AND type = 'pr'"),
    _row(4, _B, "number", 6, 0, "''", "'- possible fixes:'", "nested WHERE n_fixes > n_matches"),
    _fix(7, "confidence <> 'match'"),
    _row(4, _B, "number", 8, 0, "''", """
      CASE WHEN example_error <> '' THEN '- error: `' || example_error || '`' || chr(10) ELSE '' END ||
      CASE WHEN example_summary <> '' THEN '- summary: ' || example_summary || chr(10) ELSE '' END || chr(10) ||
      '| Run | Branch | Day | Failed jobs |' || chr(10) || '|---|---|---|---|'""", "nested"),
    _row(4, _B, "number", 9, "-epoch(CAST(run_started_at AS TIMESTAMPTZ))", "run_id", """'| [' || run_id || '](' || run_url || ') | ' ||
      CASE WHEN length(branch) > 40 THEN left(branch, 37) || '...' ELSE branch END || ' | ' || date || ' | ' || jobs_failed || ' |'""",
         _of(_AFFECTED)),
    _row(4, _B, "number", 10, 0, "''", "''", "nested"),
    _row(5, 0, 0, 0, 0, "''", """'## Runs without a verdict' || chr(10) || chr(10) || '| Run | Status |' || chr(10) || '|---|---|'""",
         "(SELECT 1 WHERE EXISTS (SELECT 1 FROM bad_runs WHERE status <> 'done'))"),
    _row(5, 1, "CASE status WHEN 'pending' THEN 0 ELSE 1 END", 0, 0, "CAST(run_id AS VARCHAR)",
         "'| [' || run_id || '](' || run_url || ') | ' || status || ' |'", "bad_runs WHERE status <> 'done'"),
])
_NEST = f"{_FULL},\nnested AS ({_COUNTED})"


def _record(part, number, key, fields, source):
    return f"SELECT {part} AS part, CAST({number} AS BIGINT) AS number, {key} AS key, CAST(to_json({{{fields}}}) AS VARCHAR) AS record FROM {source}"


_JSON = " UNION ALL ".join([
    _record(0, 0, "''", """'metadata': {'generated_by': 'emberline'}, 'date': '2001-08-01', 'total_runs': total_runs, 'flake_runs': flake_runs,
      'real_failure_runs': real_failure_runs, 'unclear_runs': unclear_runs, 'total_jobs': total_jobs""", "totals"),
    _record(1, "number", "category", """'name': category, 'description': description, 'is_flake': flake, 'runs': runs, 'jobs': jobs,
      'n_test_ids': n_test_ids, 'n_subcategories': n_subcategories, 'n_fixes': n_fixes, 'example_error': example_error,
      'example_summary': example_summary""", "nested"),
    _record(2, "number", "test_id", "'name': category, 'test_id': test_id", _of("cat_tests")),
    _record(3, "number", "subcategory", "'name': category, 'subcategory': subcategory", _of(_SUBS)),
    _record(4, "number", "run_id", """'name': category, 'run_id': run_id, 'run_url': run_url, 'branch': branch, 'date': date,
      'run_started_at': run_started_at, 'jobs_failed': jobs_failed""", _of(_AFFECTED)),
    _record(5, "number", "type || '-' || coalesce(sha, CAST(id AS VARCHAR))", """'name': category, 'type': type, 'id': id, 'sha': sha, 'url': url,
      'title': title, 'date': date, 'confidence': confidence""", _of("items")),
    _record(6, "CASE status WHEN 'pending' THEN 0 ELSE 1 END", "CAST(run_id AS VARCHAR)",
            "'run_id': CAST(run_id AS VARCHAR), 'status': status, 'run_url': run_url", "bad_runs WHERE status <> 'done'"),
])

ORACLES = {
    "phase_stats": compose("SELECT * FROM phases"),
    "phase_tool_counts": compose("""SELECT run_id, phase, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tool_calls
        FROM (SELECT run_id, phase, tool, count(*) AS n FROM phase_events GROUP BY ALL) GROUP BY run_id, phase"""),
    "tool_calls": compose("""SELECT tool, CAST(count(*) AS BIGINT) AS calls,
        row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS position FROM phase_events GROUP BY tool"""),
    "turn_distribution": compose("""SELECT metric, min(v) AS min, max(v) AS max,
        CAST((CAST(sum(v) AS BIGINT) * 20 + count(v)) // (2 * count(v)) AS DOUBLE) / 10 AS avg, median(v) AS median
        FROM phase_metrics WHERE metric LIKE '%.turns' GROUP BY metric"""),
    "classifier_summary": compose("SELECT * FROM metric_dists, agents"),
    "execution_stats": compose(f"""SELECT total_runs, flake_runs, CAST(to_json({{'model': 'none', 'engine_version': '1',
        'classifier_agents': {{'agents': agents, 'errors': errors,
          'classify_phase': {{'turns': {_DIST.format(m='ct')}, 'duration_ms': {_DIST.format(m='cd')}}},
          'recheck_phase': {{'turns': {_DIST.format(m='rt')}, 'duration_ms': {_DIST.format(m='rd')}}},
          'tool_calls': tools}}}}) AS VARCHAR) AS execution_stats
        FROM totals, agents, (SELECT map_from_entries(list((tool, n) ORDER BY n DESC, seen)) AS tools FROM
            (SELECT tool, CAST(count(*) AS BIGINT) AS n, min(event_id) AS seen FROM phase_events GROUP BY tool)),
          (SELECT * FROM metric_dists WHERE metric = 'classify.turns') ct, (SELECT * FROM metric_dists WHERE metric = 'classify.duration_ms') cd,
          (SELECT * FROM metric_dists WHERE metric = 'recheck.turns') rt, (SELECT * FROM metric_dists WHERE metric = 'recheck.duration_ms') rd"""),
    "quality_signals": compose("""SELECT agents, errors, CAST((errors * 2000 + agents) // (2 * agents) AS DOUBLE) / 10 AS error_rate,
        (SELECT CAST(count(*) AS BIGINT) FROM verdicts WHERE verdict = 'unclear') AS unclear_runs,
        (SELECT CAST(count(*) AS BIGINT) FROM bad_runs WHERE status <> 'done') AS unfinished_runs FROM agents"""),
    "quality_trend": compose("""SELECT period, runs, agents, unclear_runs, unfinished_runs, agent_error_rate, turns,
        round(unclear_runs - lag(unclear_runs) OVER (ORDER BY period), 1) AS unclear_runs_change, round(unfinished_runs - lag(unfinished_runs) OVER (ORDER BY period), 1) AS unfinished_runs_change, round(agent_error_rate - lag(agent_error_rate) OVER (ORDER BY period), 1) AS agent_error_rate_change, round(turns - lag(turns) OVER (ORDER BY period), 1) AS turns_change,
        CASE WHEN count(unclear_runs) OVER w = 0 THEN 0.0 ELSE CAST((CAST(sum(CAST(round(unclear_runs * 10) AS BIGINT)) OVER w AS BIGINT) * 20 + count(unclear_runs) OVER w * 10) // (2 * count(unclear_runs) OVER w * 10) AS DOUBLE) / 10 END AS unclear_runs_before, CASE WHEN count(unfinished_runs) OVER w = 0 THEN 0.0 ELSE CAST((CAST(sum(CAST(round(unfinished_runs * 10) AS BIGINT)) OVER w AS BIGINT) * 20 + count(unfinished_runs) OVER w * 10) // (2 * count(unfinished_runs) OVER w * 10) AS DOUBLE) / 10 END AS unfinished_runs_before, CASE WHEN count(agent_error_rate) OVER w = 0 THEN 0.0 ELSE CAST((CAST(sum(CAST(round(agent_error_rate * 10) AS BIGINT)) OVER w AS BIGINT) * 20 + count(agent_error_rate) OVER w * 10) // (2 * count(agent_error_rate) OVER w * 10) AS DOUBLE) / 10 END AS agent_error_rate_before, CASE WHEN count(turns) OVER w = 0 THEN 0.0 ELSE CAST((CAST(sum(CAST(round(turns * 10) AS BIGINT)) OVER w AS BIGINT) * 20 + count(turns) OVER w * 10) // (2 * count(turns) OVER w * 10) AS DOUBLE) / 10 END AS turns_before FROM (
          SELECT strftime(created_ts, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS runs, CAST(count(a.failed) AS BIGINT) AS agents,
            CAST(count(*) FILTER (verdict = 'unclear') AS BIGINT) AS unclear_runs,
            CAST(count(*) FILTER (status <> 'done') AS BIGINT) AS unfinished_runs,
            CASE WHEN count(a.failed) = 0 THEN 0.0 ELSE
              CAST((count(*) FILTER (a.failed) * 2000 + count(a.failed)) // (2 * count(a.failed)) AS DOUBLE) / 10 END AS agent_error_rate,
            CAST(coalesce(sum(a.turns), 0) AS BIGINT) AS turns
          FROM bad_runs r LEFT JOIN verdicts v ON v.run_id = r.run_id
          LEFT JOIN (SELECT run_id, bool_or(is_error) AS failed, sum(turns) AS turns FROM phases GROUP BY run_id) a ON a.run_id = r.run_id GROUP BY 1)
        WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""),
    "report_json": compose(_JSON, _NEST),
    "report_md_rows": compose(_MD, _NEST),
    "summary_text": compose("""SELECT total_runs || ' failed runs analyzed: ' || flake_runs || ' caused by flakes, ' || real_failure_runs ||
        ' by real failures' || CASE WHEN unclear_runs > 0 THEN ', ' || unclear_runs || ' unclear' ELSE '' END || '. Top root causes: ' ||
        (SELECT string_agg(category || ' (' || runs || ' runs)', ' and ' ORDER BY runs DESC, first_pos) FROM
          (SELECT * FROM cats ORDER BY runs DESC, first_pos LIMIT 2)) || '.' AS summary FROM totals"""),
    "empty_report": compose("""SELECT '2001-08-01' AS date, 'no-failures' AS status,
        'The selection holds no failed run.' AS message, CAST(count(*) AS BIGINT) AS total_runs,
        CAST(0 AS BIGINT) AS flake_runs, CAST(0 AS BIGINT) AS real_failure_runs, CAST(0 AS BIGINT) AS unclear_runs,
        CAST(0 AS BIGINT) AS total_jobs, CAST(0 AS BIGINT) AS categories, CAST(0 AS BIGINT) AS unfinished_runs
        FROM bad_runs WHERE created_ts >= TIMESTAMP '2031-01-01' HAVING count(*) = 0"""),
}

# Consecutive rises up to a period: its number minus that of the last period without a rise.
ORACLES["quality_rises"] = f"""SELECT period, signal, value, CAST(n - last_break AS BIGINT) AS rising_for, n - last_break >= 2 AS sustained FROM (
  SELECT *, max(CASE WHEN before IS NULL OR value <= before THEN n END) OVER (PARTITION BY signal ORDER BY period) AS last_break FROM (
    SELECT *, row_number() OVER (PARTITION BY signal ORDER BY period) AS n, lag(value) OVER (PARTITION BY signal ORDER BY period) AS before FROM (
      SELECT period, unnest(['unclear_runs', 'unfinished_runs', 'agent_error_rate', 'turns']) AS signal,
        unnest([CAST(unclear_runs AS DOUBLE), unfinished_runs, agent_error_rate, turns]) AS value FROM ({ORACLES["quality_trend"]}))))"""

_PHASE_TOTALS = """SELECT CASE event_id % 4 WHEN 0 THEN 'classify' WHEN 1 THEN 'recheck' WHEN 2 THEN 'correlate' ELSE 'summarize' END AS phase,
  count(*) AS records, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  CAST(sum(duration_ms // 2) AS BIGINT) AS duration_api_ms, count(*) FILTER (is_error) AS errors,
  CAST(sum(7) FILTER (tool = 'view') AS BIGINT) AS cache, CAST(sum(turns * 100) AS BIGINT) AS input, CAST(sum(event_id % 50) AS BIGINT) AS output
  FROM phase_events GROUP BY 1"""
_TOTALS_JSON = """(SELECT '{"records":' || records || ',"turns":' || turns || ',"duration_ms":' || duration_ms || ',"duration_api_ms":' || duration_api_ms ||
  ',"errors":' || errors || ',"usage":{' || CASE WHEN cache IS NULL THEN '' ELSE '"cache_tokens":' || cache || ',' END || '"input_tokens":' || input ||
  ',"output_tokens":' || output || '}}' FROM (%s) WHERE phase = '%s')"""
ORACLES["phase_usage"] = compose(f"""SELECT phase, records, turns, duration_ms, duration_api_ms, errors, CASE WHEN cache IS NULL THEN '' ELSE
  'cache_tokens=' || cache || ',' END || 'input_tokens=' || input || ',output_tokens=' || output AS usage FROM ({_PHASE_TOTALS})""")
ORACLES["execution_stats_phases"] = compose(f"""SELECT agents, {_TOTALS_JSON % (_PHASE_TOTALS, 'correlate')} AS correlator_agent,
  {_TOTALS_JSON % (_PHASE_TOTALS, 'summarize')} AS summarizer_agent FROM agents""")

ORACLES["empty_report_forms"] = compose("""SELECT form, CAST(line_no AS INT) AS line_no, line FROM (VALUES
  ('text', 1, 'The selection holds no failed run.'), ('markdown', 1, '# CI failure report'), ('markdown', 2, ''), ('markdown', 3, 'Date: 2001-08-01'),
  ('markdown', 4, ''), ('markdown', 5, 'The selection holds no failed run.'), ('markdown', 6, ''), ('markdown', 7, '- repository: `example/shop`'),
  ('markdown', 8, '- branch: `main,develop`'), ('markdown', 9, '- workflow: `*`'), ('markdown', 10, '- lookback_days: `90`'),
  ('json', 1, '{"date":"2001-08-01","status":"no-failures","message":"The selection holds no failed run.","filters":{"repository":"example/shop","branch":"main,develop","workflow":"*","lookback_days":"90"},"total_runs":0,"flake_runs":0,"real_failure_runs":0,"unclear_runs":0,"total_jobs":0,"categories":[],"unfinished_runs":[]}')
  ) t(form, line_no, line) WHERE NOT EXISTS (SELECT 1 FROM bad_runs WHERE created_ts >= TIMESTAMP '2031-01-01')""")
