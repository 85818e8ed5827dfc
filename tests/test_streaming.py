from helpers import values

from emberline.streaming import status_table


def block(run_id, status):
    return f"<!-- BEGIN RUN {run_id} -->\n- **status**: {status}\n\n#### job: `a`\n<!-- END RUN {run_id} -->\n"


def test_status_table_follows_documents_and_never_goes_back(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    (tmp_path / "in").mkdir()

    def drop(name, text):
        (tmp_path / "in" / name).write_text(text)
        query = status_table.start(status_table.document_stream(spark, source), target, state)
        query.awaitTermination(120)
        return dict(values(status_table.read(spark, target), "run_id", "status"))

    assert drop("1.md", block(1, "pending") + block(2, "pending")) == {"1": "pending", "2": "pending"}
    assert drop("2.md", block(1, "done") + block(2, "error")) == {"1": "done", "2": "error"}
    assert drop("3.md", block(1, "classified") + block(2, "pending") + block(3, "pending")) == {"1": "done", "2": "error", "3": "pending"}
