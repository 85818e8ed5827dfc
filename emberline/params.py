"""The defaults and limits the engine is defined by."""

# Statuses, conclusions and prefixes the inputs use.
FAILED_CONCLUSIONS = ("failure", "cancelled")
VALID_PREFIXES = ("test-flake/", "infra-flake/", "bug/", "build-error/")
QUEUE_PREFIX = "gh-readonly-queue"

# Column order of the failed-job interchange file.
FAILED_JOB_COLUMNS = (
    "run_id", "run_url", "branch", "event", "commit_sha", "failed_job_name",
    "job_conclusion", "run_started_at", "job_completed_at", "run_attempt", "failure_step",
)

RUN_CAP = 200            # newest runs kept per status, workflow and branch
BRANCH_HISTORY = 20      # newest runs of a branch that count as its history
SYSTEMIC_SHARE = 0.9     # share of a run's jobs that makes one signature systemic
SYSTEMIC_MIN_JOBS = 2
CLUSTER_JACCARD = 0.8    # word-set similarity that makes two errors one root cause
GREP_CONTEXT = 5         # lines kept around a hit

# Parameters of the registered queries.
REFERENCE_DATE = "2001-08-01"
LOOKBACK_DAYS = 90
BRANCHES = ["main", "develop"]
WORKFLOWS = ["ci.yaml", "e2e.yaml"]
SKIP_JOBS = ["job-7"]
RUN_IDS = [0, 1, 2, 3, 7, 11, 13, 22, 1000, 4999, 12001, 99999999]
REPOSITORY = "example/shop"
GIT_BASE = "https://git.example.com"

# Jobs of one run that one block of a run document holds; a longer run has several blocks in job order.
BLOCK_JOBS = 10000
