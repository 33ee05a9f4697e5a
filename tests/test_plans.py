"""Plans of queries whose work must not grow with their form, and SQL that states the rule of its query."""

import duckdb

from scriptorium.functions import redaction
from scriptorium.plans import corpus, style, text_rules

SF = "/root/testdata/sf0.001"


def test_rules_run_once_a_text(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    plan = text_rules.p8_redaction_counts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.maxPlanStringLength")
    assert plan.count("Terrace") == 2  # replaced and counted


def test_redaction_and_its_sql_agree_on_numbers_in_a_row_and_on_white_space(spark):
    texts = ["555-123-4567 555-123-4568", "555-123-4567x1 555-123-4568_(555) 123-4569", "\x01\x03 5\x01\x03a 555-123-4567a", "token=word-\x0b", "api_key: jo.e@x.co", "( 123 Baker Street", "password: hunter22\xa0x"]
    rows = list(enumerate(texts))
    got = sorted((r.i, r.redacted) for r in redaction.redact(spark.createDataFrame(rows, "i long, text string")).collect())
    con = duckdb.connect()
    con.sql("create table given (i bigint, text varchar)")
    con.executemany("insert into given values (?, ?)", rows)
    assert got == con.sql(f"WITH {text_rules.redacted_sql('given', 'i')} SELECT i, t FROM {text_rules.LAST} ORDER BY i").fetchall()
    assert got[0][1] == "[REDACTED] [REDACTED]"


def test_long_work_on_documents_is_dealt_over_all_tasks(spark):
    for query in (text_rules.p6_redaction, text_rules.p8_redaction_counts, corpus.k9_report_totals, style.t3_distinctive):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, query.__name__


def test_texts_are_cut_once(spark):
    """What t14 and t15 return is made from written counts: their plans cut no text."""
    for query in (style.t14_delta, style.t15_self_distance):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "split(" not in plan
