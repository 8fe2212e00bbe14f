"""Sources and sinks: given tables are written as files of the domain and read again, or taken for uploads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import tables, workflow
from ..sources import fixtures, readers, sinks
from ..sources.fixtures import sql_and
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, md5(text) AS text_md5 FROM documents")
def jsonl_documents(spark, sf_dir):
    """SRC5, SNK11: documents as JSON lines and back, whatever line ends stand inside their texts."""
    path = _folder(spark, "jsonl")
    sinks.json_lines(fixtures.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
    found = readers.json_lines(spark, path, "doc_id long, source string, text string")
    return found.select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("SELECT p_partkey, p_name || ' \"' || p_brand || '\", ' || chr(10) || 'é' AS note, p_retailprice AS price FROM part")
def csv_sheets(spark, sf_dir):
    """SRC6, SRC7, SNK10: a sheet with quotes, commas and line breaks in its cells, and back."""
    path, part = _folder(spark, "csv"), fixtures.table(spark, sf_dir, "part")
    note = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", \né'))
    sinks.csv(part.select("p_partkey", note.alias("note"), F.col("p_retailprice").alias("price")), path)
    return readers.csv_table(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "note", F.col("price").cast(part.schema["p_retailprice"].dataType).alias("price"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN true ELSE false END AS valid FROM conversations")
def chat_examples(spark, sf_dir):
    """PRJ6, JSN5, JSN6: training examples as chats, some with a target without the key, some with one that is no JSON."""
    turns = fixtures.table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 3
    target = F.when(kind == 0, parsing.target_json(F.col("role"), F.lit(0.5))).when(kind == 1, '{"other": 1}').otherwise("no JSON")
    path = _folder(spark, "chats")
    rows = turns.select("conv_id", "turn", F.lit("You answer.").alias("system"), "text", target.alias("target"))
    chats = rows.withColumn("messages", sinks.chat("system", "text", "target"))
    sinks.json_lines(chats.select("conv_id", "turn", "messages"), path)
    found = readers.json_lines(spark, path, "conv_id long, turn long, messages array<struct<role:string,content:string>>")
    return sinks.valid_chat(found, "value").select("conv_id", "turn", "valid")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL ELSE NULL END AS value, CASE WHEN event_id % 4 = 2 THEN event_type || ';x' END AS listed,
  CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_type = 'view' THEN 'INCLUDE' WHEN event_type = 'click' THEN 'EXCLUDE' ELSE 'MAYBE' END ELSE 'MAYBE' END AS decision FROM events""")
def parsed_answers(spark, sf_dir):
    """JSN3, JSN4: replies with a value, a blank one, a list with blanks, and a decision in any case or none that is known."""
    k, said = F.col("event_id") % 4, F.when(F.col("event_type") == "view", "include").when(F.col("event_type") == "click", "Exclude ").otherwise("perhaps")
    reply = (
        F.when(k == 0, F.concat(F.lit('{"value": " '), "event_type", F.lit('"}'))).when(k == 1, F.lit('{"value": " "}'))
        .when(k == 2, F.concat(F.lit('```json\n{"values": ["'), "event_type", F.lit('", " ", "x "]}\n```'))).otherwise(F.concat(F.lit('{"decision": "'), said, F.lit('"}')))
    )
    found = fixtures.table(spark, sf_dir, "events").withColumn("o", parsing.json_object(reply))
    listed = F.array_join(parsing.list_answer(F.col("o")), ";")
    return found.select("event_id", parsing.scalar_answer(F.col("o")).alias("value"), listed.alias("listed"), parsing.screening_decision(F.col("o")).alias("decision"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.5::DOUBLE ELSE c_acctbal END AS grams, c_name AS name, NULL::VARCHAR AS batch_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def mended_rows(spark, sf_dir):
    """SNK7, SNK13, SNK15, SNK18: a subset of records whose missing numbers are filled, NUL characters dropped and a column added."""
    rows = fixtures.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).cast("double").alias("grams"), F.concat(F.lit("\x00"), "c_name").alias("name"))
    ids = fixtures.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    kept = sinks.subset({"customer": rows}, ids, "c_custkey")["customer"]
    return sinks.migrate(sinks.without_nul(sinks.fill_null(kept, "grams", F.lit(1.5))), {"batch_id": "string"})


UPLOADED = """u AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey // 2 AS VARCHAR) END AS raw_id,
  CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS abstract, p_brand AS author,
  CASE p_partkey % 3 WHEN 0 THEN 'include on title' WHEN 1 THEN 'EXCLUDE ' || p_type || ' / ' || p_brand ELSE 'unsure' END AS said FROM part),
k AS (SELECT *, CASE WHEN raw_id IS NULL THEN CAST(('0x' || substr(sha256('row-' || row), 1, 8)) AS BIGINT) ELSE CAST(raw_id AS BIGINT) END AS record_id FROM u WHERE title IS NOT NULL OR abstract IS NOT NULL)"""


@query("WITH " + UPLOADED + """ SELECT record_id, coalesce(title, '') AS title, md5('# ' || coalesce(title, '') || chr(10) || chr(10) || '**Authors:** ' || author || '  ' || chr(10) || CASE WHEN abstract IS NULL THEN '' ELSE '## Abstract' || chr(10) || chr(10) || abstract || chr(10) END) AS md5,
  record_id || '_' || coalesce(replace(title, ' ', '_'), CAST(record_id AS VARCHAR)) || '.md' AS file_name,
  CASE WHEN said LIKE 'include%' THEN '{"decision":"INCLUDE","tag":""}' WHEN said LIKE 'EXCLUDE%' THEN '{"decision":"EXCLUDE","tag":"' || trim(regexp_replace(lower(said[9:]), '[^a-z0-9]+', '_', 'g'), '_') || '","tag_label":"' || said[9:] || '"}'
    ELSE '{"decision":"MAYBE","tag":"","raw":"unsure"}' END AS value_json FROM k QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY row DESC) = 1""")
def uploaded_screening(spark, sf_dir):
    """GTQ7, SRC8, STR24, STR28: an export of references with ids that repeat or are missing, as records and decisions."""
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, "include on title").when(k % 3 == 1, F.concat(F.lit("EXCLUDE "), "p_type", F.lit(" / "), "p_brand")).otherwise("unsure")
    part = fixtures.table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.when(k % 4 != 0, F.expr("CAST(p_partkey div 2 AS string)")).alias("U1"), F.when(k % 5 != 0, F.col("p_name")).alias("T1"), F.when(k % 10 != 0, F.col("p_type")).alias("Ab"), F.col("p_brand").alias("Author"), said.alias("TA_Decision"),
    )
    return readers.screening_upload(part).select("record_id", "title", F.md5("md_text").alias("md5"), "file_name", "value_json")


@query(sql_and("tasks iterations", """t AS (SELECT kind, CASE WHEN status = 'done' AND priority = 1 THEN 'failed' ELSE status END AS status, claimed_at AS finished_at FROM tasks), m AS (SELECT max(finished_at) AS as_of FROM t), i AS (SELECT max(created_at) AS last FROM iterations),
e AS (SELECT count(*) AS n_runs, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM t, m WHERE kind = 'kind0' AND status IN ('done', 'failed') AND finished_at > as_of - INTERVAL 24 HOURS),
c AS (SELECT count(*) AS n_candidates, count(*) FILTER (WHERE accepted) AS n_accepted FROM iterations, i, m WHERE created_at + (as_of - last) > as_of - INTERVAL 24 HOURS)
SELECT *, coalesce(n_failed / nullif(n_runs, 0)::DOUBLE, 0) AS failure_rate, coalesce(n_accepted / nullif(n_candidates, 0)::DOUBLE, 0) AS accept_rate FROM e, c"""))
def optimizer_health(spark, sf_dir):
    """AGG9, FLT6: failures and acceptances of the last 24 hours; candidates' times are moved to those of the tasks."""
    failed = (F.col("status") == "done") & (F.col("priority") == 1)
    tasks = fixtures.tasks(spark, sf_dir).select("kind", F.when(failed, "failed").otherwise(F.col("status")).alias("status"), F.col("claimed_at").alias("finished_at"))
    iterations = fixtures.iterations(spark, sf_dir)
    last = tasks.agg(F.max("finished_at").alias("as_of")).join(iterations.agg(F.max("created_at").alias("last")))  # one row
    shift = F.col("created_at") + (F.col("as_of") - F.col("last"))
    moved = iterations.join(F.broadcast(last)).withColumn("created_at", shift).select("created_at", "accepted", "as_of")
    return workflow.optimizer_health(tasks.join(F.broadcast(last.select("as_of"))), moved, F.col("as_of"), kind="kind0")
