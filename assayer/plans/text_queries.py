"""Text, parsing, scoring and reference-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, names, parsing, text
from ..operators import ground_truth, metrics, passages, scoring, summaries
from ..sources import fixtures, sinks
from ..sources.fixtures import sql, sql_and
from .registry import query


@query("SELECT page_id, CAST(length(CASE WHEN regexp_matches(html, '(?i)<body[^>]*>') THEN regexp_replace(html, '(?is)^.*?<body[^>]*>', '') ELSE html END) AS INTEGER) AS n FROM pages")
def boilerplate_strip(spark, sf_dir):
    """STR19."""
    return fixtures.table(spark, sf_dir, "pages").select("page_id", F.length(text.stripped_boilerplate(F.col("html"))).alias("n"))


#: Stretches of eight words of documents and passages, whole passages that have fewer.
QUOTED = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM b),
quoted AS (SELECT doc_id, item_id FROM ds JOIN bs USING (s) UNION
  SELECT doc_id, item_id FROM d JOIN (SELECT item_id, w FROM b WHERE len(w) BETWEEN 1 AND 7) p ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(p.w, ' ') || ' '))
"""


@query(QUOTED + "SELECT doc_id, item_id FROM quoted")
def excerpt_containment(spark, sf_dir):
    """Quotations of benchmark passages: eight words in a row from anywhere in a passage, or all of a shorter one."""
    return passages.leaked(fixtures.table(spark, sf_dir, "documents"), fixtures.table(spark, sf_dir, "benchmark"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def lookup_keys(spark, sf_dir):
    """STR8."""
    part = fixtures.table(spark, sf_dir, "part")
    return part.select("p_partkey", text.lookup_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("key"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugs(spark, sf_dir):
    """STR23."""
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("SELECT p_partkey, p_name || ';' || p_brand AS listed FROM part")
def value_alternatives(spark, sf_dir):
    """STR6."""
    part = fixtures.table(spark, sf_dir, "part")
    return part.select("p_partkey", F.array_join(text.alternatives(F.concat("p_name", F.lit(" | "), "p_brand", F.lit("|"))), ";").alias("listed"))


@query("""SELECT event_id, CASE WHEN k > 1 THEN least(1.0::DOUBLE, k / 100.0::DOUBLE) ELSE k::DOUBLE END AS confidence FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def confidences(spark, sf_dir):
    """JSN2."""
    return fixtures.table(spark, sf_dir, "events").select("event_id", parsing.confidence(F.get_json_object("props", "$.k")).alias("confidence"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2""")
def response_objects(spark, sf_dir):
    """JSN1: fenced, with prose around, and broken."""
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure. "), "props", F.lit(" That is all."))).otherwise(F.concat(F.lit("{broken "), "props"))
    found = fixtures.table(spark, sf_dir, "events").withColumn("object", parsing.json_object(raw))
    return found.select("event_id", F.try_variant_get("object", "$.k", "string").alias("k"))


@query(sql("runs", """SELECT run_id, CASE WHEN predicted IS NULL THEN 'abstain_miss' WHEN k % 5 = 0 OR predicted = truth OR k % 5 = 2 THEN 'hit' ELSE 'wrong' END AS outcome,
  CASE WHEN predicted IS NULL THEN 0.0::DOUBLE WHEN k % 5 = 0 OR (predicted = truth AND k % 5 <> 2) THEN 1.0::DOUBLE WHEN k % 5 = 2 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN predicted IS NULL THEN 0.5::DOUBLE WHEN k % 5 = 0 OR (predicted = truth AND k % 5 <> 2) THEN 1.0::DOUBLE WHEN k % 5 = 2 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS honesty_score FROM runs"""))
def alternative_scores(spark, sf_dir):
    """SCR1: any of several true values, in other letters and punctuation, counts in full; one that is nearly the same counts 0.9."""
    k = F.col("k") % 5
    truth = F.when(k == 0, F.concat(F.lit("other | "), "predicted", F.lit("| more"))).when(k == 2, "an international research collaboration").otherwise(F.col("truth"))
    said = F.when(F.col("predicted").isNull(), None).when(k == 0, F.concat(F.lit(" "), F.upper("predicted"), F.lit("."))).when(k == 2, "an internationl research collaboratio").otherwise(F.col("predicted"))
    runs = fixtures.runs(spark, sf_dir).select("run_id", truth.alias("truth"), said.alias("predicted"))
    runs = runs.withColumn("truth", F.coalesce("truth", F.lit("x")))
    return scoring.single(runs).select("run_id", "result.outcome", "result.score", "result.honesty_score")


@query(sql("runs", """SELECT run_id, CASE WHEN truth = 'c0' THEN CASE WHEN predicted IS NULL THEN 'correct_abstain' ELSE 'hallucination' END
  WHEN predicted IS NULL THEN 'abstain_miss' WHEN predicted = truth THEN 'hit' ELSE 'wrong' END AS outcome,
  CASE WHEN truth = 'c0' THEN CASE WHEN predicted IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN predicted = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM runs"""))
def single_scores(spark, sf_dir):
    """SCR1, SCR4: with truth c0 taken as missing."""
    runs = fixtures.runs(spark, sf_dir).select("run_id", "predicted", F.when(F.col("truth") != "c0", F.col("truth")).alias("truth"))
    return scoring.single(runs).select("run_id", "result.outcome", "result.score")


@query(
    sql_and(
        "list_pairs",
        """l AS (SELECT record_id, list_transform(truth, lambda x: lower(x)) AS t, list_transform(predicted, lambda x: lower(x)) AS p FROM list_pairs),
m AS (SELECT record_id, len(t) AS nt, len(p) AS np, CAST(list_sum(list_transform(list_distinct(p), lambda v: least(len(list_filter(p, lambda x: x = v)), len(list_filter(t, lambda x: x = v))))) AS INTEGER) AS tp FROM l)
SELECT record_id, tp, 2.0::DOUBLE * tp / (nt + np) AS score FROM m""",
    )
)
def list_scores(spark, sf_dir):
    """SCR2, SCR3, ARR1, ARR2: closed vocabulary, so matching is by equality."""
    return scoring.lists(fixtures.list_pairs(spark, sf_dir), "sub_sector", False).select("record_id", "tp", "result.score")


@query()
def list_scores_fuzzy(spark, sf_dir):
    """SCR2 with STR14's similarity."""
    return scoring.lists(fixtures.list_pairs(spark, sf_dir), "author_affiliation", True).select("record_id", "tp", "result.*", "missing", "extra")


#: Author lists of customers: two true names; the predicted ones agree by initials, have a lone initial, other letters, or are missing.
AUTHORS = """a AS (SELECT c_custkey, c_custkey % 5 AS k, CAST(c_acctbal < 0 AS BOOLEAN) AS cited FROM customer)"""


def _author_lists(spark, sf_dir):
    k, id_ = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    truth = F.array(F.concat(F.lit("Ünal"), id_, F.lit(", Robert Edward")), F.concat(F.lit("Okoro"), id_, F.lit(", Ada")))
    one = F.when(k == 0, F.concat(F.lit("UNAL"), id_, F.lit(", R. E."))).when(k == 1, F.concat(F.lit("Robert Edward Ünal"), id_)).when(k == 2, F.concat(F.lit("Ünal"), id_, F.lit(", R.")))
    two = F.when(k == 3, F.concat(F.lit("Okoro"), id_, F.lit(", Ada"))).when(k < 3, F.concat(F.lit("okoro"), id_, F.lit(",  ada")))
    predicted = F.filter(F.array(one, two), lambda x: x.isNotNull())
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", k.alias("k"), truth.alias("truth"), predicted.alias("predicted"), (F.col("c_acctbal") >= 0).alias("excerpt_verified"))


#: Found of the two names: with k 0 the accent keeps look-up keys apart, with 2 the lone initial.
AUTHOR_SCORES = "s AS (SELECT c_custkey, k, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS tp, CASE k WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 END AS np, cited FROM a)"


@query(f"""WITH {AUTHORS}, {AUTHOR_SCORES} SELECT c_custkey, CAST(tp AS INTEGER) AS tp, 2.0::DOUBLE * tp / (np + 2) AS score, CASE WHEN np = 0 THEN 'abstain_miss' WHEN tp = 2 THEN 'hit' WHEN tp = np THEN 'abstain_miss' ELSE 'wrong' END AS outcome FROM s""")
def author_list_scores(spark, sf_dir):
    """SCR2 for authors: folded equality, then author equality, in order."""
    return scoring.lists(_author_lists(spark, sf_dir), "authors", False).select("c_custkey", "tp", "result.score", "result.outcome")


@query(f"""WITH {AUTHORS}, {AUTHOR_SCORES}, h AS (SELECT c_custkey, k, CASE k WHEN 1 THEN 1.0::DOUBLE WHEN 4 THEN 0.5::DOUBLE
  ELSE 2 * (tp::DOUBLE / np) * ((tp + 0.5::DOUBLE * (2 - tp)) / 2) / ((tp::DOUBLE / np) + ((tp + 0.5::DOUBLE * (2 - tp)) / 2)) END AS honesty, cited, np FROM s)
SELECT c_custkey, CASE WHEN cited AND np > 0 THEN honesty * 0.5::DOUBLE ELSE honesty END AS honesty_score FROM h""")
def field_scores(spark, sf_dir):
    """SCR3, SCR4: dispatch by kind; an excerpt that isn't in the source halves the honesty of an answer."""
    return scoring.field_scores(_author_lists(spark, sf_dir), "authors", "list_categorical").select("c_custkey", "result.honesty_score")


@query(f"""WITH {AUTHORS}, {AUTHOR_SCORES}, t AS (SELECT count(*) AS n, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(2 - tp)::BIGINT AS fn FROM s)
SELECT n, tp, fp, fn, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM t""")
def author_gate(spark, sf_dir):
    """MET6 for authors."""
    return metrics.list_metrics(_author_lists(spark, sf_dir), [], None, "authors").select("n", "tp", "fp", "fn", "precision", "recall")


@query(sql("runs", """SELECT run_id, CASE WHEN k % 10 = 0 THEN 0.5::DOUBLE WHEN (k % 2 = 0) = is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN k % 10 = 0 THEN 'maybe_vs_' || CASE WHEN is_correct THEN 'include' ELSE 'exclude' END
    WHEN (k % 2 = 0) = is_correct THEN CASE WHEN NOT is_correct AND k % 3 <> 1 THEN 'correct_wrong_tag' ELSE 'correct' END
    ELSE CASE WHEN k % 2 = 0 THEN 'wrong_include_vs_exclude' ELSE 'wrong_exclude_vs_include' END END AS outcome FROM runs"""))
def screening_scores(spark, sf_dir):
    """SCR5: with a tag that is part of the true one, another one, and none."""
    d = F.when(F.col("k") % 10 == 0, "MAYBE").when(F.col("k") % 2 == 0, "INCLUDE").otherwise("EXCLUDE")
    truth = F.when(F.col("is_correct"), "include").otherwise("exclude")
    tag = F.when(F.col("k") % 3 == 1, " Design ").when(F.col("k") % 3 == 2, "population").otherwise("")
    runs = fixtures.runs(spark, sf_dir)
    return runs.select("run_id", scoring.screening(d, tag, truth, F.lit("wrong design")).alias("s")).select("run_id", "s.*")


@query()
def excerpt_verification(spark, sf_dir):
    """STR17: benchmark passages against all documents that share three words in a row with them, exact and near."""
    pairs = passages.excerpt_pairs(fixtures.table(spark, sf_dir, "documents"), fixtures.table(spark, sf_dir, "benchmark"))
    return scoring.verify_excerpts(pairs, "excerpt", "source").select("doc_id", "item_id", "verified")


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Korea, Rep.' WHEN 1 THEN 'Korea, Rep.' WHEN 2 THEN 'Egypt, Arab Rep.' WHEN 3 THEN 'Korea, Dem. People''s Rep.' WHEN 4 THEN 'Micronesia, Fed. Sts.' WHEN 5 THEN 'Congo' WHEN 6 THEN 'usa' ELSE c_name END AS country FROM customer""")
def countries(spark, sf_dir):
    """STR9: aliases, names in other letters, the head of a name with a comma, a head that two names share, and an alias of a country that isn't in the taxonomy."""
    known = ["Korea, Rep.", "Egypt, Arab Rep.", "Korea, Dem. People's Rep.", "Micronesia, Fed. Sts.", "Congo, Rep.", "Congo, Dem. Rep."]
    said = F.element_at(F.array(*[F.lit(x) for x in ("South  Korea", "KOREA, REP", "egypt", "DPRK", "Micronesia", "Congo", "usa", "")]), (F.col("c_custkey") % 8 + 1).cast("int"))
    said = F.when(said == "", F.col("c_name")).otherwise(said)
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", names.country(said, known).alias("country"))


@query("SELECT c_custkey, c_name AS a, c_custkey % 2 = 0 AS same FROM customer")
def author_equality(spark, sf_dir):
    """STR11, STR12: initials that agree, and a lone initial that doesn't."""
    given = F.when(F.col("c_custkey") % 2 == 0, "Robert Edward").otherwise("Robert")
    short = F.when(F.col("c_custkey") % 2 == 0, "R. E.").otherwise("R.")
    a, b = F.concat("c_name", F.lit(", "), given), F.concat("c_name", F.lit(", "), short)
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"), names.authors_equal(a, b).alias("same"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'not reported' WHEN c_custkey % 3 = 1 THEN 'World Health Organization' ELSE c_name END AS value FROM customer")
def institutions(spark, sf_dir):
    """STR10, STR13."""
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, "Not specified (see text)").when(k == 1, F.when(F.col("c_custkey") % 2 == 0, "who").otherwise(" WHO ")).otherwise(F.col("c_name"))
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", F.when(text.is_missing(raw), text.MISSING).otherwise(names.institution(raw)).alias("value"))


@query("SELECT event_id, event_id % 7 + 10 AS id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, CAST(('0x' || substr(sha256('x' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) AS id FROM events WHERE event_id % 2 = 1")
def stable_ids(spark, sf_dir):
    """STR24."""
    even = F.col("event_id") % 2 == 0
    raw = F.when(even & (F.col("event_id") % 4 == 0), (F.col("event_id") % 7 + 10).cast("string")).when(even, F.concat((F.col("event_id") % 7 + 10).cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    return fixtures.table(spark, sf_dir, "events").select("event_id", text.stable_id(raw).alias("id"))


@query()
def mismatch_classes(spark, sf_dir):
    """MET20, STR16: similarity runs once on each distinct wrong pair."""
    wrong = fixtures.list_pairs(spark, sf_dir).select(F.array_join("truth", " ").alias("truth"), F.array_join("predicted", " ").alias("predicted"))
    pairs = wrong.groupBy("truth", "predicted").agg(F.count("*").alias("n")).withColumn("kind", fuzzy.mismatch("truth", "predicted"))
    return pairs.groupBy("kind").agg(F.sum("n").alias("n"))


@query("""SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) <= 410""")
def rare_values(spark, sf_dir):
    """AGG20."""
    return summaries.frequencies(fixtures.table(spark, sf_dir, "part"), "p_type", 410)


@query("""WITH k AS (SELECT *, p_partkey % 6 AS k FROM part),
i AS (SELECT p_partkey, k, p_name AS v FROM k WHERE k NOT IN (0, 2) UNION ALL SELECT p_partkey, k, upper(p_name) FROM k WHERE k = 1 UNION ALL SELECT p_partkey, k, 'José ' || p_name FROM k WHERE k = 2 UNION ALL SELECT p_partkey, k, p_brand FROM k WHERE k > 2)
SELECT 'empty' AS issue, count(*) AS n FROM k WHERE k = 0 UNION ALL SELECT 'encoding_noise', count(*) FROM i WHERE k = 2 UNION ALL SELECT 'duplicate_entry', count(*) FROM k WHERE k = 1 UNION ALL SELECT 'name_order', count(*) FROM i WHERE contains(v, ' ')
UNION ALL SELECT 'not_in_taxonomy', count(*) FROM i WHERE lower(v) NOT IN (SELECT p_name FROM part) UNION ALL SELECT 'rare_category', count(*) FROM (SELECT v FROM i GROUP BY v HAVING count(*) <= 2) HAVING count(*) > 0""")
def truth_audit(spark, sf_dir):
    """GTQ1, STR26, AGG21: records without values, with a copy in other letters, with accents, and with values outside the taxonomy."""
    part, k = fixtures.table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    values = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("p_name", F.upper("p_name"))).when(k == 2, F.array(F.concat(F.lit("José "), "p_name"))).otherwise(F.array("p_name", "p_brand"))
    truth = part.select(F.col("p_partkey").alias("record_id"), values.alias("values"))
    return ground_truth.audit(truth, part.select(F.col("p_name").alias("value")).distinct()).groupBy("issue").agg(F.count("*").alias("n"))


@query()
def truth_proposals(spark, sf_dir):
    """GTQ2, JON16, STR15: nations against region names and two longer forms."""
    values = fixtures.table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    allowed = fixtures.table(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
    return ground_truth.propose(values.unionByName(allowed), allowed)


@query("""SELECT s_name AS value, s_name AS proposed, NULL::DOUBLE AS score, 'valid' AS action FROM supplier UNION ALL SELECT ' SUPPLIER' || substr(s_name, 9), ' SUPPLIER' || substr(s_name, 9), NULL, 'valid' FROM supplier
UNION ALL SELECT 'Suplier#' || substr(s_name, 10), s_name, 200 * 17 / 35.0::DOUBLE, 'remap' FROM supplier UNION ALL SELECT s_name || ' Limited', s_name, 200 * 18 / 44.0::DOUBLE, 'review' FROM supplier
UNION ALL SELECT s_name || '|none', s_name, NULL, 'manual_pick' FROM supplier""")
def nearest_allowed(spark, sf_dir):
    """GTQ2, JON16, STR15: each allowed name as it is, in other letters, with a letter less, with a word more, and beside another."""
    names = fixtures.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.expr("substring(s_name, 10)").alias("number"))
    forms = F.array("s_name", F.concat(F.lit(" SUPPLIER#"), "number"), F.concat(F.lit("Suplier#"), "number"), F.concat("s_name", F.lit(" Limited")), F.concat("s_name", F.lit("|none")))
    return ground_truth.propose(names.select(F.explode(forms).alias("value")), names.select(F.col("s_name").alias("value"), F.col("s_suppkey").alias("rank")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'accept' WHEN 2 THEN 'edit' ELSE 'edit' END AS kind, CASE p_partkey % 4 WHEN 2 THEN p_brand WHEN 3 THEN p_name END AS value FROM part")
def review_decisions(spark, sf_dir):
    """GTQ3."""
    k = F.col("p_partkey") % 4
    cell = F.when(k == 0, " Keep").when(k == 1, "ACCEPT ").when(k == 2, F.concat(F.lit("Edit:  "), "p_brand")).otherwise(F.col("p_name"))
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", ground_truth.decision(cell).alias("d")).select("p_partkey", "d.*")


@query("""WITH r AS (SELECT p_partkey // 3 AS record_id, p_brand AS t FROM part WHERE p_partkey % 5 <> 0), g AS (SELECT record_id, list_sort(list(DISTINCT t)) AS targets FROM r GROUP BY 1),
t AS (SELECT p_partkey AS record_id, p_brand AS old FROM part WHERE p_partkey % 2 = 0)
SELECT record_id, old, CASE WHEN len(targets) = 1 THEN targets[1] END AS new, CASE WHEN len(targets) > 1 THEN 'conflict' WHEN old IS NULL THEN 'no_truth' WHEN old = targets[1] THEN 'unchanged' ELSE 'change' END AS status FROM g LEFT JOIN t USING (record_id)""")
def categorical_plan(spark, sf_dir):
    """GTQ4."""
    part = fixtures.table(spark, sf_dir, "part")
    decision = F.when(F.col("p_partkey") % 5 == 0, "keep").otherwise("accept")
    reviews = part.select(F.expr("p_partkey div 3").alias("record_id"), F.col("p_brand").alias("suggestion"), decision.alias("curator_decision"))
    truth = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("value"))
    return ground_truth.plan_single(reviews, truth)


@query("""WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two, p_partkey % 4 AS k FROM part)
SELECT p_partkey AS record_id, one || ';' || two AS old, CASE k WHEN 0 THEN two || ';zebra' WHEN 1 THEN one || ';other' WHEN 2 THEN one || ';' || two || ';other' END AS new,
  CASE k WHEN 0 THEN 'remove: ' || one || ';add: zebra' WHEN 1 THEN 'replace: ' || two || ' -> other' WHEN 2 THEN 'add: other' END AS ops FROM w WHERE k < 3""")
def list_plan(spark, sf_dir):
    """GTQ5: several reviews of a record, one after the other; values that are there in other letters aren't added, those that aren't there can't be removed."""
    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.split("p_name", " ").alias("values"), (F.col("p_partkey") % 4).alias("k"))
    one, two = F.col("values")[0], F.col("values")[1]
    step = lambda n, k, issue, value, said: F.struct(F.lit(n).alias("ordinal"), F.array(*map(F.lit, k)).alias("of"), F.lit(issue).alias("issue_type"), value.alias("value"), F.lit(said).alias("curator_decision"))
    steps = F.array(
        step(1, [0], "recall_miss", one, "Accept"), step(2, [0], "models_agree_gt_lacks", F.lit(" zebra"), "accept"), step(3, [0, 1, 3], "models_agree_gt_lacks", F.upper(two), "accept"),
        step(4, [1], "recall_miss", F.concat(F.lit(" "), F.upper(two)), "edit: other"), step(5, [2], "recall_miss", F.lit("absent"), "edit: other"), step(6, [2, 3], "recall_miss", F.lit("absent"), "accept"),
        step(7, [0, 1, 2, 3], "recall_miss", two, "keep"),
    )
    reviews = part.withColumn("r", F.explode(steps)).where(F.array_contains("r.of", F.col("k"))).select("record_id", "r.ordinal", "r.issue_type", "r.value", "r.curator_decision")
    plan = ground_truth.plan_lists(reviews, part)
    return plan.select("record_id", *[F.array_join(c, ";").alias(c) for c in ("old", "new", "ops")])


@query("""WITH t AS (SELECT p_partkey AS record_id, p_brand AS value FROM part), c AS (SELECT record_id, value AS old, 'new' AS new FROM t WHERE record_id % 3 = 0), j AS (SELECT p_partkey * 10 AS run_id, p_partkey AS record_id FROM part)
SELECT 'truth' AS part, record_id, CASE WHEN record_id % 3 = 0 THEN 'new' ELSE value END AS value FROM t UNION ALL SELECT 'log', record_id, old || ' -> ' || new FROM c UNION ALL SELECT 'judgment', record_id, CAST(run_id AS VARCHAR) FROM j WHERE record_id % 3 <> 0""")
def applied_changes(spark, sf_dir):
    """GTQ6, SNK8: changes applied to the truth, the log of them, and judgments of changed records taken back."""
    part = fixtures.table(spark, sf_dir, "part")
    truth = part.select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("value"))
    changes = truth.where("record_id % 3 = 0").select("record_id", F.col("value").alias("old"), F.lit("new").alias("new"))
    new, log = ground_truth.apply_changes(truth, changes, F.lit("2024-01-01"))
    judgments = part.select((F.col("p_partkey") * 10).alias("run_id"), F.col("p_partkey").alias("record_id"))
    left = sinks.delete_matching(judgments, changes, ["record_id"])
    row = lambda name, rows, value: rows.select(F.lit(name).alias("part"), "record_id", value.cast("string").alias("value"))
    logged = row("log", log, F.concat("old_value", F.lit(" -> "), "new_value"))
    return row("truth", new, F.col("value")).unionByName(logged).unionByName(row("judgment", left, F.col("run_id")))


@query(sql_and("runs ground_truth", """raw AS (SELECT run_id, record_id, 'c' || CAST(record_id % 15 AS VARCHAR) AS value, k, CASE WHEN k % 11 <> 0 THEN latency_ms END AS lp,
  record_id IN (SELECT record_id FROM ground_truth WHERE field_name = 'f0' AND record_id % 3 = 0) AS leak FROM runs),
marked AS (SELECT *, coalesce(k < 30, true) AS unsure, coalesce(lp < 100, true) AS unlikely FROM raw),
first AS (SELECT record_id, value, min(run_id) AS run_id FROM marked WHERE NOT leak AND NOT unsure AND NOT unlikely GROUP BY ALL),
kept AS (SELECT record_id, run_id AS kept_id FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY run_id) AS n FROM first) WHERE n <= 40)
SELECT run_id, CASE WHEN leak THEN 'gt_leak' WHEN run_id > kept_id THEN 'dup' WHEN unsure THEN 'low_confidence' WHEN unlikely THEN 'low_logprob' WHEN run_id = kept_id THEN 'kept' ELSE 'over_cap' END AS reason
FROM marked LEFT JOIN kept USING (record_id)"""))
def training_rows(spark, sf_dir):
    """GTQ8, JON18: what keeps each teacher label out of the training set: a truth anywhere, a copy, confidence, logprob, a full value."""
    value = F.concat(F.lit("c"), (F.col("record_id") % 15).cast("string"))
    rows = fixtures.runs(spark, sf_dir).select(F.col("run_id").alias("ordinal"), "record_id", value.alias("value"), (F.col("k") / 100).alias("confidence"), F.when(F.col("k") % 11 != 0, F.col("latency_ms") / 1000).alias("logprob"))
    truth = fixtures.ground_truth(spark, sf_dir).where("field_name = 'f0' AND record_id % 3 = 0")
    return ground_truth.training_rows(rows, truth, 0.3, 0.1, 40).select(F.col("ordinal").alias("run_id"), "reason")


@query(QUOTED + """, x AS (SELECT d.doc_id, d.n_chars, d.doc_id IN (SELECT doc_id FROM quoted) AS leak, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN leak THEN 'leak' WHEN n_chars < 200 THEN 'short' WHEN quality = 0 THEN 'quality' ELSE 'kept' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def training_filter(spark, sf_dir):
    """Drop counts of documents by the first reason that holds, as GTQ8 has for rows: a quoted passage, length, quality."""
    docs = fixtures.table(spark, sf_dir, "documents")
    leaks = passages.leaked(docs, fixtures.table(spark, sf_dir, "benchmark")).select("doc_id").distinct().withColumn("leak", F.lit(True))
    rows = docs.select("doc_id", "n_chars").join(leaks, "doc_id", "left").join(fixtures.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ground_truth.first_failing(rows, [("leak", F.col("leak")), ("short", F.col("n_chars") < 200), ("quality", F.col("quality") == 0)])


@query("SELECT l.quality, d.doc_id FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) l JOIN documents d USING (doc_id) WHERE r <= 20")
def capped_labels(spark, sf_dir):
    """WIN12, WIN13: at most 20 of a label, which is the feature."""
    rows = fixtures.table(spark, sf_dir, "documents").select("doc_id").join(fixtures.table(spark, sf_dir, "labels"), "doc_id")
    return ground_truth.capped(rows, "quality", [F.col("doc_id")], 20).select("quality", "doc_id")


@query()
def normalised_texts(spark, sf_dir):
    """STR1-STR5: of whole documents."""
    docs = fixtures.table(spark, sf_dir, "documents")
    folds = docs.select("doc_id", text.both_folds("text").alias("f"))
    return folds.select("doc_id", F.md5(text.category_fold(F.col("f.normed"))).alias("folded"), F.md5("f.shown").alias("display"))
