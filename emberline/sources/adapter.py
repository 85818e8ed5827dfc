"""CI-shaped tables derived from the star-schema test tables (see FIXTURES.md).

Only projections and joins. `conclusions` arguments are translated to the raw code
column so that the predicate reaches the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_CODES = {"failure": "F", "cancelled": "P", "success": "O"}
JOB_CODES = {"failure": "R", "cancelled": "A", "success": "N"}
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _decode(code: Column, names: dict[str, str]) -> Column:
    failure, cancelled = names["failure"], names["cancelled"]
    return (F.when(code == failure, "failure").when(code == cancelled, "cancelled")
            .otherwise("success"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def runs(spark: SparkSession, sf: str, conclusions=None) -> DataFrame:
    orders = table(spark, sf, "orders")
    if conclusions:
        orders = orders.where(F.col("o_orderstatus").isin([RUN_CODES[c] for c in conclusions]))
    key = F.col("o_orderkey")
    text_key = key.cast("string")
    return orders.select(
        key.alias("run_id"),
        F.concat(F.lit("https://ci.example.com/runs/"), text_key).alias("run_url"),
        F.when(key % 3 == 0, "ci.yaml").when(key % 3 == 1, "e2e.yaml")
         .otherwise("nightly.yml").alias("workflow"),
        F.expr("""CASE substr(o_orderpriority, 1, 1)
                    WHEN '1' THEN 'main' WHEN '2' THEN 'release'
                    WHEN '3' THEN concat('gh-readonly-queue/main/pr-', o_orderkey)
                    WHEN '4' THEN concat('gh-readonly-queue/develop/pr-', o_orderkey)
                    ELSE 'develop' END""").alias("branch"),
        F.expr("""CASE WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'merge_group'
                       WHEN o_orderkey % 2 = 0 THEN 'push' ELSE 'pull_request' END""").alias("event"),
        F.md5(F.col("o_custkey").cast("string")).alias("commit_sha"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (1 + key % 2).alias("run_attempt"),
        _decode(F.col("o_orderstatus"), RUN_CODES).alias("conclusion"),
        F.when(key % 11 == 0, "pending").when(key % 13 == 0, "error")
         .otherwise("done").alias("status"),
    )


def _job_id() -> Column:
    """Identity of a job inside its run: 60 bits of a digest over the natural key."""
    natural = F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        F.date_format("l_shipdate", "yyyyMMdd"))
    return F.conv(F.substring(F.md5(natural), 1, 15), 16, 10).cast("bigint")


def jobs(spark: SparkSession, sf: str, conclusions=None) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    if conclusions:
        lines = lines.where(F.col("l_returnflag").isin([JOB_CODES[c] for c in conclusions]))
    build = F.expr("CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'failure' ELSE 'success' END")
    test = F.expr("""CASE WHEN l_returnflag = 'R' THEN 'failure'
                          WHEN l_returnflag = 'A' AND l_suppkey % 4 = 0 THEN 'failure'
                          WHEN l_returnflag = 'A' THEN 'cancelled' ELSE 'success' END""")

    def step(name: str, conclusion: Column, number: int) -> Column:
        return F.struct(F.lit(name).alias("name"), conclusion.alias("conclusion"),
                        F.lit(number).alias("number"))

    return lines.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("bigint").alias("job_seq"),
        _job_id().alias("job_id"),
        F.concat(F.lit("job-"), F.col("l_linenumber").cast("string")).alias("job_name"),
        _decode(F.col("l_returnflag"), JOB_CODES).alias("conclusion"),
        F.col("l_shipdate").cast("timestamp").alias("completed_at"),
        F.array(step("checkout", F.lit("success"), 1), step("build", build, 2),
                step("test", test, 3)).alias("steps"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        (F.col("l_linenumber") % 6).alias("framework"),
        F.col("l_quantity").cast("int").alias("qty"),
    )


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("partkey"), "p_name", "p_type", "p_brand",
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand_slug"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table: one row per failed job of a failed run, with its classification.

    Jobs meet parts first and runs last, so the result leaves the join partitioned by
    `run_id` and the (category, run) roll-up needs no further exchange. Nested steps and long
    texts do not travel through the joins.
    """
    failed = ("failure", "cancelled")
    odd = F.col("suppkey") % 2 == 0
    real = F.col("p_type").isin("PROMO", "SMALL") != (
        (F.col("suppkey") % 13 == 0) & F.col("p_brand").startswith("Brand#2"))
    test = F.concat(F.lit("T"), (F.col("suppkey") % 10).cast("string"))
    second = F.concat(F.lit("T"), (F.col("partkey") % 7).cast("string"))
    prefix = F.expr("""CASE p_type WHEN 'STANDARD' THEN 'test-flake/' WHEN 'ECONOMY' THEN 'infra-flake/'
        WHEN 'PROMO' THEN 'bug/' WHEN 'SMALL' THEN 'build-error/'
        WHEN 'MEDIUM' THEN 'test-flake/systemic-' ELSE 'misc/' END""")
    failed_step = F.try_element_at(F.filter("steps", lambda s: s["conclusion"] == "failure"), F.lit(1))["name"]
    rows = jobs(spark, sf, failed).withColumn("failed_step", failed_step).drop("steps")
    detail = rows.join(parts(spark, sf), "partkey").select(
        "run_id", "job_seq", "job_id", "job_name", F.col("conclusion").alias("job_conclusion"), "failed_step",
        F.concat(prefix, F.col("brand_slug"),
                 F.when(odd, F.concat(F.lit("/"), test)).otherwise("")).alias("category"),
        F.when((F.col("suppkey") % 17 == 0) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "")
         .when(real, "no").otherwise("yes").alias("is_flake"),
        F.when(F.col("suppkey") % 3 == 0, "").when(F.col("suppkey") % 3 == 1, test)
         .otherwise(F.concat(test, F.lit(", "), second)).alias("test_id"),
        "suppkey", "p_name", "qty",
    )
    error_message = F.when(F.col("suppkey") % 5 == 0, "").otherwise(
        F.concat(F.lit("error in "), "p_name", F.lit(" after "), F.col("qty").cast("string"), F.lit("s")))
    summary = F.when(F.col("suppkey") % 7 == 0, "").otherwise(
        F.concat(F.lit("Job "), "job_name", F.lit(" failed on "), "p_name"))
    run_side = runs(spark, sf, failed).select(
        "run_id", "run_url", "branch", "event", "commit_sha", "created_at",
        iso(F.col("created_at")).alias("run_started_at"), "run_attempt", "status")
    return detail.join(run_side, "run_id").select(
        "run_id", "job_seq", "job_id", "job_name", "job_conclusion", F.coalesce("failed_step", F.lit("")).alias("failed_step"),
        "category", "is_flake", "test_id", error_message.alias("error_message"), summary.alias("summary"),
        *[c for c in run_side.columns if c != "run_id"], position().alias("pos"))


def position() -> Column:
    """Document order of a fact row: newest run first, then run id, then job order."""
    return F.struct((-F.unix_timestamp("created_at")).alias("age"), F.col("run_id").alias("run"),
                    F.col("job_seq").alias("seq"), F.col("job_id").alias("job"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Four narrow lines per failed or cancelled job, each with an ISO time prefix."""
    marker = F.expr(r"""CASE framework
        WHEN 0 THEN concat('\u001b[31m[FAIL]\u001b[0m Parts [It] updates the part [', 10000 + partkey % 97, ', sanity, slow]')
        WHEN 1 THEN concat('--- FAIL: TestPart', partkey % 89, ' (0.53s)')
        WHEN 2 THEN concat('FAILED tests/test_part.py::TestPart::test_case_', partkey % 83, ' - AssertionError')
        WHEN 3 THEN concat('Tests run: 1, Failures: 1 <<< FAILURE! PartServiceTest#testCase', partkey % 79)
        WHEN 4 THEN concat('FAIL src/part/case', partkey % 97, '.test.ts > PartModule > rejects case')
        ELSE 'Collecting the results of upstream jobs' END""")
    error = F.expr("""CASE WHEN framework = 5 AND suppkey % 3 = 0 THEN 'Result: an upstream job did not pass'
        WHEN p_type = 'STANDARD' THEN 'context deadline exceeded after 30s'
        WHEN p_type = 'ECONOMY' THEN 'dial tcp 10.0.0.7:5432: connection refused'
        WHEN p_type = 'PROMO' THEN 'panic: runtime error: nil pointer dereference'
        WHEN p_type = 'SMALL' THEN 'src/part.go:42: undefined: NewPartClient'
        WHEN p_type = 'MEDIUM' THEN 'timed out waiting for device /dev/part after 60s'
        ELSE 'fatal: out of memory (killed)' END""")
    stamp = iso(F.col("completed_at"))

    def line(number: int, text: Column) -> Column:
        return F.struct(F.lit(number).cast("bigint").alias("line_no"),
                        F.concat(stamp, F.lit(" "), text).alias("text"))

    texts = F.array(
        line(1, F.concat(F.lit("Run "), "job_name")),
        line(2, F.concat(F.lit("Testing part "), "p_name")),
        line(3, marker), line(4, error))
    return (jobs(spark, sf, ("failure", "cancelled"))
            .join(parts(spark, sf).select("partkey", "p_name", "p_type"), "partkey")
            .select("run_id", "job_id", F.inline(texts)))


def long_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of 52 to 64 lines per failed or cancelled job: two failed tests near each other, the first of them once
    more for even parts, a lost node for every fourth supplier, and the error in the last line."""
    def marker(no: str) -> Column:
        return F.expr(rf"""CASE framework
            WHEN 0 THEN concat('\u001b[31m[FAIL]\u001b[0m Parts [It] updates the part [', 10000 + {no} % 97, ', sanity, slow]')
            WHEN 1 THEN concat('--- FAIL: TestPart', {no} % 89, ' (0.53s)')
            WHEN 2 THEN concat('FAILED tests/test_part.py::TestPart::test_case_', {no} % 83, ' - AssertionError')
            WHEN 3 THEN concat('Tests run: 1, Failures: 1 <<< FAILURE! PartServiceTest#testCase', {no} % 79)
            WHEN 4 THEN concat('FAIL src/part/case', {no} % 97, '.test.ts > PartModule > rejects case ', {no} % 97)
            ELSE 'Collecting the results of upstream jobs' END""")

    error = F.expr("""CASE WHEN framework = 5 AND suppkey % 3 = 0 THEN 'Result: an upstream job did not pass'
        WHEN p_type = 'STANDARD' THEN 'context deadline exceeded after 30s'
        WHEN p_type = 'ECONOMY' THEN 'dial tcp 10.0.0.7:5432: connection refused'
        WHEN p_type = 'PROMO' THEN 'panic: runtime error: nil pointer dereference'
        WHEN p_type = 'SMALL' THEN 'src/part.go:42: undefined: NewPartClient'
        WHEN p_type = 'MEDIUM' THEN 'timed out waiting for device /dev/part after 60s'
        ELSE 'fatal: out of memory (killed)' END""")
    line, last = F.col("line_no"), F.col("n_lines")
    text = (F.when(line == 1, F.concat(F.lit("Run "), "job_name")).when(line == 2, F.concat(F.lit("Testing part "), "p_name"))
            .when((line == 8) | ((line == 40) & (F.col("partkey") % 2 == 0)), marker("partkey")).when(line == 13, marker("suppkey"))
            .when((line == 20) & (F.col("suppkey") % 4 == 0), F.concat(
                F.lit("node-"), (F.col("suppkey") % 25).cast("string"), F.lit(": heartbeat lost")))
            .when(line == last, error).otherwise(F.concat(F.lit("step "), line.cast("string"), F.lit(" ok"))))
    return (jobs(spark, sf, ("failure", "cancelled"))
            .join(parts(spark, sf).select("partkey", "p_name", "p_type"), "partkey")
            .withColumn("n_lines", 52 + F.col("partkey") % 13)
            .withColumn("stamp", F.concat(iso(F.col("completed_at")), F.lit(" ")))  # once a job, not once a line
            .withColumn("line_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_lines")))
            # through a generator: searches of the text do not each contain the expression that makes it
            .select("run_id", "job_id", "line_no", F.explode(F.array(F.concat("stamp", text))).alias("text")))


def user_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that a user of the test tables adds: one for each node, and a name for what the kernel killed."""
    key = F.col("n_nationkey").cast("string")
    nodes = table(spark, sf, "nation").select(
        F.concat(F.lit("node-"), key).alias("rule_id"), F.lit("site").alias("framework"), F.lit("node").alias("kind"),
        F.concat(F.lit("node-"), key, F.lit(":")).alias("anchor"),
        F.when(F.col("n_nationkey") % 2 == 1, "node-[0-9]+: heartbeat").alias("pattern"), F.lit(1).alias("priority"),
        F.concat(F.lit("lost-node-"), key).alias("slug"))
    killed = table(spark, sf, "region").where("r_regionkey = 0").selectExpr(
        "'any-resource-3' AS rule_id", "'any' AS framework", "'resource' AS kind", "'killed' AS anchor",
        "CAST(NULL AS STRING) AS pattern", "1 AS priority", "'out-of-memory' AS slug")
    return nodes.unionByName(killed)


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commit messages have a body; only the subject line is searched."""
    subject = F.expr("""CASE partkey % 4
        WHEN 0 THEN concat('Fix flaky test T', partkey % 10)
        WHEN 1 THEN concat('Increase timeout for ', brand_slug)
        WHEN 2 THEN concat('Retry ', p_name, ' setup')
        ELSE concat('Update docs for ', p_name) END""")
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("partkey"), "o_orderdate")
    return parts(spark, sf).join(dates, "partkey").select(
        F.md5(F.concat(F.lit("c"), F.col("partkey").cast("string"))).alias("sha"),
        iso(F.col("o_orderdate").cast("timestamp")).alias("author_date"),
        F.concat(subject, F.lit("\n\nReviewed by the team")).alias("message"))


def log_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commits that speak of what the logs say: a test, an error, a lost node, or nothing of it."""
    subject = F.expr("""CASE partkey % 5
        WHEN 0 THEN concat('Stabilize TestPart', partkey % 89)
        WHEN 1 THEN 'Retry when connection refused on dial'
        WHEN 2 THEN 'Allow for context deadline exceeded'
        WHEN 3 THEN concat('Fix lost-node-', partkey % 25)
        ELSE 'Update the docs' END""")
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("partkey"), "o_orderdate")
    return parts(spark, sf).join(dates, "partkey").select(
        F.md5(F.concat(F.lit("g"), F.col("partkey").cast("string"))).alias("sha"),
        iso(F.col("o_orderdate").cast("timestamp")).alias("author_date"), subject.alias("message"))


def commit_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files changed by the commit that triggered a run (one row per commit and file)."""
    keys = table(spark, sf, "orders").select("o_custkey").distinct()
    names = F.expr("""CASE WHEN o_custkey % 5 = 0
        THEN array(concat('src/part/case', o_custkey % 97, '.test.ts'), 'tests/test_part.py')
        ELSE array(concat('src/part/case', o_custkey % 97, '.test.ts')) END""")
    return keys.select(F.md5(F.col("o_custkey").cast("string")).alias("sha"),
                       F.explode(names).alias("filename"))


def candidate_files(spark: SparkSession, sf: str) -> DataFrame:
    """One changed file per candidate commit."""
    name = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('src/part/case', p_partkey % 97, '.test.ts')
        WHEN 1 THEN 'src/part/core.ts' ELSE '.github/workflows/ci.yaml' END""")
    return table(spark, sf, "part").select(
        F.md5(F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("sha"),
        name.alias("filename"))


def pull_requests(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr("""CASE WHEN s_suppkey % 2 = 0 THEN concat('Deflake T', s_suppkey % 10)
        ELSE concat('Investigate brand-', s_suppkey % 25, ' failures') END""")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("number"),
        F.expr("date_format(date_add(DATE'2001-01-01', cast(s_suppkey as int)), \"yyyy-MM-dd'T'00:00:00'Z'\")")
         .alias("created"),
        title.alias("title"),
        F.concat(F.lit("https://git.example.com/example/shop/pull/"),
                 F.col("s_suppkey").cast("string")).alias("url"),
        F.when(F.col("s_suppkey") % 9 == 0, "closed").otherwise("open").alias("state"))


def phase_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event-grain execution records of the analysis: one tool call each."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_id") % 2 == 0, "classify").otherwise("recheck").alias("phase"),
        F.col("event_id"),
        F.col("event_type").alias("tool"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("bigint") % 10).alias("turns"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        ((F.col("event_type") == "error") & (F.col("value") > 50)).alias("is_error"))


# --- the same tables as files ------------------------------------------------------

def _spoilt(record: Column, key: Column, broken: Column, keyless: Column) -> Column:
    """JSON text of a record: cut in half where `broken` holds, without its key where `keyless` does."""
    text = F.to_json(record)
    return (F.when(broken, F.substring(text, F.lit(1), (F.length(text) / 2).cast("int")))
            .when(keyless, F.replace(text, F.concat(F.lit('"'), key, F.lit('":')), F.lit('"other":'))).otherwise(text)).alias("value")


def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """Runs as JSON lines, some of them broken."""
    rows = runs(spark, sf, ("failure", "cancelled")).drop("status")
    no = F.col("run_id")
    return rows.select(_spoilt(F.struct(*rows.columns), F.lit("run_id"), no % 17 == 0, no % 19 == 0))


def job_records(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with nested steps as JSON lines, some of them broken or with text for a number."""
    rows = jobs(spark, sf).select("run_id", "job_seq", "job_id", "job_name", "conclusion", "completed_at", "steps")
    no = F.col("job_id")
    record = _spoilt(F.struct(*rows.columns), F.lit("job_id"), no % 17 == 0, no % 19 == 0)
    text = F.replace(record, F.lit('"number":1'), F.lit('"number":"first"'))
    return rows.select(F.when((no % 17 != 0) & (no % 23 == 0), text).otherwise(record).alias("value"))


def commit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tab-separated commits: quotes, back-slashes and tabs in subjects, lines without a date or with a wrong one."""
    rows = parts(spark, sf).select("partkey", F.md5(F.concat(F.lit("c"), F.col("partkey").cast("string"))).alias("sha")).join(
        commits(spark, sf), "sha")
    key, subject = F.col("partkey"), F.split("message", "\n")[0]
    subject = (F.when(key % 5 == 0, F.concat(F.lit('"'), subject)).when(key % 5 == 1, F.concat(subject, F.lit("\\")))
               .when(key % 5 == 2, F.concat(subject, F.lit("\twith a tab"))).otherwise(subject))
    return rows.select(F.when(key % 11 == 0, F.concat_ws("\t", "sha", subject))
                       .when(key % 13 == 0, F.concat_ws("\t", "sha", F.lit("yesterday"), subject))
                       .otherwise(F.concat_ws("\t", "sha", "author_date", subject)).alias("value"))


def pull_request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tab-separated open pull requests; some titles begin with a quote, some lines lack the `#` or the address."""
    rows = pull_requests(spark, sf).where("state = 'open'")
    key = F.col("number")
    title = F.when(key % 4 == 0, F.concat(F.lit('"'), "title", F.lit(" only"))).when(key % 4 == 1, F.concat("title", F.lit("\tand \\"))).otherwise(F.col("title"))
    number = F.concat(F.when(key % 10 == 7, "").otherwise("#"), key.cast("string"))
    return rows.select(F.concat_ws("\t", number, "created", title, F.when(key % 10 != 3, F.col("url"))).alias("value"))


def phase_records(spark: SparkSession, sf: str) -> DataFrame:
    """Execution records of all four phases with nested tool calls and usage, as JSON lines."""
    no, turns = F.col("event_id"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint") % 10
    spent = F.round(F.col("value") * 1000).cast("bigint")
    usage = F.map_concat(
        F.create_map(F.lit("input_tokens"), (turns * 100).cast("string"), F.lit("service"), F.lit("standard"),
                     F.lit("output_tokens"), (no % 50).cast("string")),
        F.when(F.col("event_type") == "view", F.create_map(F.lit("cache_tokens"), F.lit("7"))).otherwise(
            F.create_map().cast("map<string,string>")))
    phase = F.element_at(F.array(*map(F.lit, ("classify", "recheck", "correlate", "summarize"))), (no % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.to_json(F.struct(
        F.col("user_id").cast("string").alias("run_id"), phase.alias("phase"), turns.alias("turns"), spent.alias("duration_ms"),
        F.expr("cast(round(value * 1000) as bigint) div 2").alias("duration_api_ms"), ((F.col("event_type") == "error") & (F.col("value") > 50)).alias("is_error"),
        F.create_map(F.col("event_type"), F.lit(1)).alias("tool_calls"), usage.alias("usage"))).alias("value"))
