"""The registered queries: every operator over the driver's tables, and the SQL that says the same.

Responses over `part` are made from its key by integer arithmetic, twelve kinds of them; the SQL derives the expected
results from the kind, not by parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.backends import answered, replay
from tagmill.functions import text as fn
from tagmill.identity import KEYS, with_keys
from tagmill.operators import dedup, failures, labels, merge, report, throttle
from tagmill.operators.parse import parse

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
NEXT = dict(zip(CATEGORIES, CATEGORIES[1:] + CATEGORIES[:1], strict=True))
THRESHOLD = 60
PROMPT = "Text: {text} ({context}) {{json}}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts with c (category), o (the next one), k, conf, b."""
    part = dedup.keep_first(_table(spark, sf_dir, "part"), "p_name", "p_brand", order="p_partkey")
    nxt = F.create_map(*(F.lit(x) for pair in NEXT.items() for x in pair))
    return part.select(*KEYS, F.col("p_partkey").alias("k"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("c"), nxt[F.col("p_type")].alias("o"), (F.col("p_partkey") * 37 % 101).alias("conf"), (F.col("p_partkey") % 12).alias("b"))


def _response():
    label = lambda name, conf: F.concat(F.lit('{"name": "'), name, F.lit('", "confidence": '), conf.cast("string"), F.lit("}"))
    some = lambda *xs: F.concat(F.lit('{"labels": ['), F.concat_ws(", ", *xs), F.lit("]}"))
    c, o, conf, b, unknown = F.col("c"), F.col("o"), F.col("conf"), F.col("b"), F.lit("UNKNOWN")
    return (
        F.when(b == 1, some(label(c, conf), label(o, F.lit(96))))
        .when(b == 2, some(label(c, conf), label(c, conf)))
        .when(b == 3, some(label(F.substring(c, F.lit(1), F.length(c) - 1), conf)))
        .when(b == 4, some(label(unknown, conf)))
        .when(b == 5, some(label(unknown, F.lit(99)), label(c, F.lit(99))))
        .when(b == 6, F.lit('{"labels": []}'))
        .when(b == 7, F.lit('{"error": "timeout"}'))
        .when(b == 8, F.concat(F.lit("["), label(c, conf), F.lit("]")))
        .when(b == 9, some(label(c, F.lit('"95.7"'))))
        .when(b == 10, some(label(F.concat(F.lit("  "), c, F.lit(" ")), conf)))
        .when(b == 11, F.lit("123"))
        .otherwise(some(label(c, conf)))
    )


def _parsed(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir)
    recorded = items.select(*KEYS, _response().alias("raw_response"))
    return parse(replay(recorded)(items), CATEGORIES, THRESHOLD)


def _validated(spark, sf_dir) -> DataFrame:
    return labels.post_validate(_parsed(spark, sf_dir), CATEGORIES)


_PARSED = """
WITH items AS (
  SELECT p_partkey AS k, p_name AS key_text, p_brand AS key_context, p_type AS c,
    CASE p_type WHEN 'ECONOMY' THEN 'LARGE' WHEN 'LARGE' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'PROMO' WHEN 'PROMO' THEN 'SMALL' WHEN 'SMALL' THEN 'STANDARD' ELSE 'ECONOMY' END AS o,
    p_partkey * 37 % 101 AS conf, p_partkey % 12 AS b
  FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1
), parsed AS (
  SELECT *,
    CASE b WHEN 1 THEN CASE WHEN conf >= 96 THEN c || '|' || o WHEN conf >= 60 THEN o || '|' || c ELSE o END
      WHEN 4 THEN 'unmatched_UNKNOWN' WHEN 5 THEN 'unmatched_UNKNOWN|' || c WHEN 6 THEN 'unclassified' WHEN 7 THEN 'api_error' WHEN 11 THEN 'parse_error' ELSE c END AS label,
    CAST(CASE b WHEN 1 THEN greatest(conf, 96) WHEN 5 THEN 99 WHEN 6 THEN 0 WHEN 7 THEN 0 WHEN 9 THEN 95 WHEN 11 THEN 0 ELSE conf END AS INTEGER) AS confidence,
    CASE WHEN b IN (6, 7, 11) THEN 'yes' WHEN b IN (1, 5, 9) THEN 'no' WHEN conf >= 60 THEN 'no' ELSE 'yes' END AS is_low_confidence,
    CASE b WHEN 3 THEN 'fuzzy_corrected: ' || substr(c, 1, length(c) - 1) || ' → ' || c WHEN 4 THEN 'unmatched: unmatched_UNKNOWN' WHEN 5 THEN 'unmatched: unmatched_UNKNOWN'
      WHEN 6 THEN 'no_labels' WHEN 7 THEN 'api_error: timeout' WHEN 11 THEN 'unexpected_type: int' ELSE 'ok' END AS parse_status
  FROM items
), validated AS (
  SELECT k, key_text, key_context, c, o, b, confidence, label AS before,
    CASE b WHEN 4 THEN 'unclassified' WHEN 5 THEN c ELSE label END AS label,
    CASE b WHEN 4 THEN 'yes' ELSE is_low_confidence END AS is_low_confidence,
    parse_status || CASE b WHEN 4 THEN '; post_validate all_invalid: unmatched_UNKNOWN' WHEN 5 THEN '; post_validate removed: unmatched_UNKNOWN' ELSE '' END AS parse_status
  FROM parsed
), named AS (SELECT k, unnest(string_split(label, '|')) AS label FROM validated WHERE b NOT IN (4, 6, 7, 11))
"""


def parse_responses(spark, sf_dir):
    return _parsed(spark, sf_dir).select("k", "label", "confidence", "is_low_confidence", "parse_status")


def post_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("k", "label", "confidence", "is_low_confidence", "parse_status")


def post_validate_audit(spark, sf_dir):
    return labels.audit(_validated(spark, sf_dir)).select("key_text", "key_context", "raw_label", "invalid_names")


def failure_flags(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("k", failures.is_failed("label").alias("failed"), failures.category("label", "confidence_detail").alias("category"), failures.failure_type("label").alias("failure_type"))


def confidence_detail(spark, sf_dir):
    return _parsed(spark, sf_dir).select("k", "confidence_detail")


def json_repair(spark, sf_dir):
    """Responses damaged in five ways, whole again."""
    items = _items(spark, sf_dir)
    good = F.concat(F.lit('{"labels": [{"name": "'), F.col("c"), F.lit('", "confidence": '), F.col("conf").cast("string"), F.lit("}]}"))
    d = F.col("k") % 5
    raw = (
        F.when(d == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(d == 1, F.concat(F.lit("Here it is: "), good, F.lit(" as asked.")))
        .when(d == 2, F.replace(good, F.lit("}]}"), F.lit("},]}")))
        .when(d == 3, F.replace(good, F.lit('"'), F.lit("'")))
        .otherwise(F.replace(good, F.lit("]}"), F.lit("")))
    )
    made = parse(replay(items.select(*KEYS, raw.alias("raw_response")))(items), CATEGORIES, THRESHOLD)
    return made.select("k", "label", "confidence", "is_low_confidence", "parse_status")


def failure_ranks(spark, sf_dir):
    """The breakdown as a report lists it: the most frequent type first, ties by name."""
    return failures.ranked(failures.breakdown(_parsed(spark, sf_dir)))


def label_ranks(spark, sf_dir):
    """The labels as a report lists them."""
    return report.label_distribution(_validated(spark, sf_dir), CATEGORIES).select("label", "n", F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("place"))


def retry_streaks(spark, sf_dir):
    """Streaks carried over from two rounds to the third, and who has had enough tries."""
    a = _attempts(spark, sf_dir)
    carried = failures.next_streaks(failures.streaks(a.filter("round <= 2")).filter("streak > 0"), a.filter("round = 3"))
    last = failures.with_streak(a.filter("round = 3"), carried)
    return last.select("k", "streak", (failures.is_failed("label") & failures.exhausted()).alias("exhausted"))


def retry_file(spark, sf_dir):
    """What a retry writes back: successes, then failures, each in the order of the input."""
    good, bad = merge.split(_attempts(spark, sf_dir).filter("round = 1").withColumn("ord", F.col("k")))
    rows = merge.written_order(good, bad)
    return rows.select("k", "label", F.col("ord._part").alias("part"), F.col("ord.ord").alias("place"))


def failure_breakdown(spark, sf_dir):
    return failures.breakdown(_parsed(spark, sf_dir))


def report_summary(spark, sf_dir):
    return report.totals(_validated(spark, sf_dir), CATEGORIES)


def report_confidence_hist(spark, sf_dir):
    return report.confidence_histogram(_validated(spark, sf_dir))


def report_multilabel(spark, sf_dir):
    return report.names_per_item(_validated(spark, sf_dir), CATEGORIES)


def report_labels(spark, sf_dir):
    return report.label_distribution(_validated(spark, sf_dir), CATEGORIES).select("label", "n", "pct")


def report_low_conf(spark, sf_dir):
    return report.low_confidence(_validated(spark, sf_dir)).select("key_text", "key_context", "label", "confidence", "parse_status")


def dedup_first(spark, sf_dir):
    return dedup.keep_first(_table(spark, sf_dir, "documents"), "text", "source", order="doc_id").select("doc_id", "source", "n_chars")


def dedup_summary(spark, sf_dir):
    return dedup.summary(_table(spark, sf_dir, "documents"), "text")


def head_n(spark, sf_dir):
    unique = dedup.keep_first(_table(spark, sf_dir, "documents"), "text", order="doc_id")
    return dedup.sample(unique, first=25, order="doc_id").select("doc_id", "source")


def random_n(spark, sf_dir):
    unique = dedup.keep_first(_table(spark, sf_dir, "documents"), "text", order="doc_id")
    return dedup.sample(unique, random=50, seed=7).select("doc_id", "source")


def _variant():
    k, c = F.col("k") % 4, F.col("c")
    return F.when(k == 0, c).when(k == 1, F.concat(F.lit("  "), c, F.lit("\t"))).when(k == 2, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(F.lit("UNKNOWN"))


def validate_fuzzy(spark, sf_dir):
    named = _items(spark, sf_dir).select("k", "c", _variant().alias("name"))
    return labels.validate_name(named, "name", CATEGORIES).select("k", "name", "validated", "exact")


def extract_valid(spark, sf_dir):
    made = _items(spark, sf_dir).select("k", F.concat(F.col("c"), F.lit("| "), F.col("o"), F.lit(" ||UNKNOWN|"), F.col("c")).alias("label"))
    valid = labels.valid_names(F.col("label"), CATEGORIES)
    return made.select("k", F.array_join(valid, "|").alias("valid"), F.size(valid).cast("long").alias("n_valid"))


def _documents(spark, sf_dir) -> DataFrame:
    return dedup.keep_first(_table(spark, sf_dir, "documents"), "text", "source", order="doc_id").select(*KEYS, "doc_id")


def _known(spark, sf_dir) -> DataFrame:
    """Results of the documents of good quality; the last of an item counts."""
    from tagmill.sources.ledger import latest

    docs = with_keys(_table(spark, sf_dir, "documents"), "text", "source")
    found = docs.join(_table(spark, sf_dir, "labels"), "doc_id").filter("quality = 1")
    return latest(found.select(*KEYS, F.lit("old").alias("label"), F.col("doc_id").alias("seq")))


def resume_hits(spark, sf_dir):
    return merge.resume_hits(_documents(spark, sf_dir), _known(spark, sf_dir)).select(F.col("seq").alias("doc_id"), "label")


def resume_todo(spark, sf_dir):
    return merge.resume_todo(_documents(spark, sf_dir), _known(spark, sf_dir)).select("doc_id")


def append_merge(spark, sf_dir):
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    results = _documents(spark, sf_dir).join(toxic, "doc_id", "left_semi").select(*KEYS, F.lit("new").alias("label"), F.col("doc_id").alias("seq"))
    return merge.with_history(results, _known(spark, sf_dir)).select(F.col("seq").alias("doc_id"), "label")


_KNOWN = """
WITH docs AS (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS i FROM documents),
known AS (
  SELECT d.text, d.source, max(d.doc_id) AS doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 GROUP BY d.text, d.source
)
"""


def _compared(spark, sf_dir) -> DataFrame:
    k, c, o = F.col("k") % 4, F.col("c"), F.col("o")
    old = F.when(k == 0, c).when(k == 1, F.concat(c, F.lit("|"), o)).when(k == 2, F.lit("")).otherwise(o)
    return merge.compare(_validated(spark, sf_dir), _items(spark, sf_dir).select(*KEYS, old.alias("label")))


def compare_labels(spark, sf_dir):
    return _compared(spark, sf_dir).select("k", "compare_old_label", "label", "compare_is_match")


def compare_diff(spark, sf_dir):
    return _compared(spark, sf_dir).filter("compare_is_match = 'no'").select("key_text", "key_context", "compare_old_label", "label", "confidence", "parse_status")


def compare_summary(spark, sf_dir):
    return merge.compare_summary(_compared(spark, sf_dir))


_COMPARED = (
    _PARSED
    + """, compared AS (
  SELECT *, CASE k % 4 WHEN 0 THEN c WHEN 1 THEN c || '|' || o WHEN 2 THEN '' ELSE o END AS old FROM validated
), judged AS (
  SELECT *, CASE WHEN old = label OR (old <> '' AND list_sort(list_distinct(string_split(old, '|'))) = list_sort(list_distinct(string_split(label, '|')))) THEN 'yes' ELSE 'no' END AS same FROM compared
)
"""
)


def _attempts(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir).select(*KEYS, "k", "c", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("round"))
    m = (F.col("k") * 7 + F.col("round") * 5 + F.floor(F.col("k") / 6)) % 6
    label = F.when(m == 0, F.col("c")).when(m <= 2, "unclassified").when(m == 3, "api_error").when(m == 4, "parse_error").otherwise("unmatched_X")
    return items.select(*KEYS, "k", "round", label.alias("label"), F.lit("{}").alias("confidence_detail"))


_ATTEMPTS = """
WITH items AS (SELECT p_partkey AS k, p_type AS c FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1),
attempt AS (
  SELECT k, r AS round, CASE (k * 7 + r * 5 + k // 6) % 6 WHEN 0 THEN c WHEN 1 THEN 'unclassified' WHEN 2 THEN 'unclassified' WHEN 3 THEN 'api_error' WHEN 4 THEN 'parse_error' ELSE 'unmatched_X' END AS label
  FROM items, (VALUES (1), (2), (3)) v(r)
), kind AS (
  SELECT *, label IN ('unclassified', 'api_error', 'parse_error', 'unmatched_X') AS failed, label IN ('unclassified', 'parse_error', 'unmatched_X') AS semantic,
    CASE WHEN label = 'unmatched_X' THEN 'unmatched' ELSE label END AS failure_type FROM attempt
), streak AS (
  SELECT k, count(*) FILTER (semantic AND round > coalesce(last, 0)) AS streak
  FROM (SELECT *, max(CASE WHEN NOT semantic THEN round END) OVER (PARTITION BY k) AS last FROM kind) GROUP BY k
)
"""


def semantic_streak(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    return failures.streaks(a).join(a.filter("round = 1").select(*KEYS, "k"), KEYS).select("k", "streak")


def retry_eligible(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    last = a.filter("round = 3").filter(failures.is_failed("label"))
    return failures.eligible(last, failures.streaks(a)).select("k", "label")


def retry_merge(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    good, bad = merge.split(a.filter("round = 1"))
    # every third item isn't tried in the second round
    outcome = a.filter("round = 2 AND k % 3 <> 0").join(bad.select(*KEYS), KEYS, "left_semi")
    good, bad = merge.retry_merge(good, bad, outcome)
    return good.withColumn("state", F.lit("success")).unionByName(bad.withColumn("state", F.lit("failure"))).select("k", "round", "label", "state")


def convergence(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    return failures.convergence(failures.breakdown(a.filter("round = 1")), failures.breakdown(a.filter("round = 3")))


def _answers(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return answered(
        _items(spark, sf_dir),
        _response(),
        prompt_tokens=k % 400 + 100,
        completion_tokens=k % 50,
        total_tokens=k % 400 + 100 + k % 50,
        n_retries=F.when(k % 7 == 0, k % 5).otherwise(0),
        n_429=F.when(k % 7 == 0, k % 2).otherwise(0),
        n_timeouts=F.when(k % 11 == 0, 1).otherwise(0),
        n_other_errors=F.when(k % 13 == 0, 2).otherwise(0),
        counted_retries=F.when(k % 7 == 0, k % 5).otherwise(0),
        backoff_seconds=F.when(k % 7 == 0, (k % 5) * 0.5).otherwise(0.0),
    )


def run_stats(spark, sf_dir):
    return report.run_stats(_answers(spark, sf_dir))


def max_retries_item(spark, sf_dir):
    return report.most_retried(_answers(spark, sf_dir))


def sliding_window_audit(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 100)
    return throttle.sliding_window(events, "ts", 86400, tokens="tokens", by=["user_id"]).select("event_id", "n_window", "tokens_window")


def sliding_window_all(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 100)
    return throttle.sliding_window(events, "ts", 3600, tokens="tokens").select("event_id", "n_window", "tokens_window")


def cycle_usage(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "reserved").otherwise("failed")
    return throttle.cycle_usage(_table(spark, sf_dir, "events").withColumn("status", status), "ts", "status", 21600)


def admission_schedule(spark, sf_dir):
    capacity = throttle.window_capacity(5, 3000, 850)
    return _table(spark, sf_dir, "events").select("event_id", throttle.admission(F.col("event_id"), capacity, 1.5).alias("admitted_at"))


def prompt_render(spark, sf_dir):
    made = _table(spark, sf_dir, "documents").select("doc_id", fn.prompt(PROMPT, F.col("text"), F.col("source")).alias("prompt"))
    return made.select("doc_id", F.length("prompt").cast("long").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("hash"), fn.prompt_hash(F.col("prompt")).alias("short_hash"))


def identity_keys(spark, sf_dir):
    keyed = with_keys(_table(spark, sf_dir, "conversations"), "text", "role")
    return keyed.select("conv_id", "turn", "key_context", F.md5(F.col("key_text").cast("binary")).alias("text_hash"))


_QUERIES = (
    dedup_first, dedup_summary, head_n, random_n, identity_keys, prompt_render, parse_responses, validate_fuzzy, extract_valid, post_validate,
    post_validate_audit, failure_flags, failure_breakdown, report_summary, report_confidence_hist, report_multilabel, report_labels, report_low_conf,
    resume_hits, resume_todo, append_merge, compare_labels, compare_diff, compare_summary, semantic_streak, retry_eligible, retry_merge, convergence,
    run_stats, max_retries_item, sliding_window_audit, cycle_usage, admission_schedule, sliding_window_all, confidence_detail, json_repair, failure_ranks, label_ranks, retry_streaks, retry_file,
)
QUERIES = {f.__name__: f for f in _QUERIES}

ORACLES = {
    "dedup_first": "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, ''), coalesce(source, '') ORDER BY doc_id) = 1",
    "dedup_summary": "SELECT count(*) AS n_rows, count(DISTINCT coalesce(text, '')) AS n_unique, count(*) - count(DISTINCT coalesce(text, '')) AS n_duplicates FROM documents",
    "head_n": "SELECT doc_id, source FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1) ORDER BY doc_id LIMIT 25",
    "identity_keys": "SELECT conv_id, turn, coalesce(role, '') AS key_context, md5(coalesce(text, '')) AS text_hash FROM conversations",
    "prompt_render": "SELECT doc_id, length(p) AS n_chars, md5(p) AS hash, substr(md5(p), 1, 8) AS short_hash FROM (SELECT doc_id, 'Text: ' || text || ' (' || source || ') {json}' AS p FROM documents)",
    "parse_responses": _PARSED + "SELECT k, label, confidence, is_low_confidence, parse_status FROM parsed",
    "validate_fuzzy": _PARSED + """SELECT k, CASE k % 4 WHEN 0 THEN c WHEN 1 THEN '  ' || c || chr(9) WHEN 2 THEN substr(c, 1, length(c) - 1) ELSE 'UNKNOWN' END AS name,
      CASE WHEN k % 4 = 3 THEN 'UNKNOWN' ELSE c END AS validated, k % 4 < 2 AS exact FROM items""",
    "extract_valid": _PARSED + "SELECT k, c || '|' || o AS valid, CAST(2 AS BIGINT) AS n_valid FROM items",
    "post_validate": _PARSED + "SELECT k, label, confidence, is_low_confidence, parse_status FROM validated",
    "post_validate_audit": _PARSED + "SELECT key_text, key_context, before AS raw_label, 'unmatched_UNKNOWN' AS invalid_names FROM validated WHERE b IN (4, 5)",
    "failure_flags": _PARSED + """SELECT k, b IN (4, 5, 6, 7, 11) AS failed, CASE WHEN b = 7 THEN 'transient' ELSE 'semantic' END AS category,
      CASE b WHEN 4 THEN 'unmatched' WHEN 5 THEN 'unmatched' WHEN 6 THEN 'unclassified' WHEN 7 THEN 'api_error' WHEN 11 THEN 'parse_error' ELSE 'other' END AS failure_type FROM parsed""",
    "failure_breakdown": _PARSED + """SELECT CASE b WHEN 6 THEN 'unclassified' WHEN 7 THEN 'api_error' WHEN 11 THEN 'parse_error' ELSE 'unmatched' END AS failure_type, count(*) AS n
      FROM parsed WHERE b IN (4, 5, 6, 7, 11) GROUP BY 1""",
    "report_summary": _PARSED + """SELECT count(*) AS total, count(*) FILTER (b NOT IN (4, 6, 7, 11)) AS success, count(*) FILTER (b IN (4, 6, 7, 11)) AS failed, count(*) FILTER (is_low_confidence = 'yes') AS low_conf,
      count(*) FILTER (b = 3) AS fuzzy_corrected, count(*) FILTER (b IN (4, 5)) AS post_validated FROM validated""",
    "report_confidence_hist": _PARSED + """SELECT r.name AS range, count(v.k) AS n, round(100.0 * count(v.k) / (SELECT count(*) FROM validated), 1)::DOUBLE AS pct
      FROM (VALUES ('>=95', 95, 1000), ('90-94', 90, 94), ('80-89', 80, 89), ('50-79', 50, 79), ('<50', -1000, 49)) r(name, lo, hi) LEFT JOIN validated v ON v.confidence BETWEEN r.lo AND r.hi GROUP BY r.name""",
    "report_multilabel": _PARSED + """SELECT CAST(CASE WHEN b IN (4, 6, 7, 11) THEN 0 ELSE len(string_split(label, '|')) END AS INTEGER) AS n_labels, count(*) AS n,
      round(100.0 * count(*) / (SELECT count(*) FROM validated), 1)::DOUBLE AS pct FROM validated GROUP BY 1""",
    "report_labels": _PARSED + "SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM validated), 1)::DOUBLE AS pct FROM named GROUP BY label",
    "report_low_conf": _PARSED + "SELECT key_text, key_context, label, confidence, parse_status FROM validated WHERE is_low_confidence = 'yes'",
    "resume_hits": _KNOWN + "SELECT doc_id, 'old' AS label FROM known",
    "resume_todo": _KNOWN + "SELECT d.doc_id FROM docs d LEFT JOIN known k ON k.text = d.text AND k.source = d.source WHERE d.i = 1 AND k.doc_id IS NULL",
    "append_merge": _KNOWN + """, new AS (SELECT text, source, doc_id FROM docs WHERE i = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
      SELECT doc_id, 'new' AS label FROM new UNION ALL SELECT k.doc_id, 'old' FROM known k LEFT JOIN new n ON n.text = k.text AND n.source = k.source WHERE n.doc_id IS NULL""",
    "compare_labels": _COMPARED + "SELECT k, old AS compare_old_label, label, same AS compare_is_match FROM judged",
    "compare_diff": _COMPARED + "SELECT key_text, key_context, old AS compare_old_label, label, confidence, parse_status FROM judged WHERE same = 'no'",
    "compare_summary": _COMPARED + """SELECT count(*) AS total, count(*) FILTER (same = 'yes') AS matched, count(*) FILTER (same = 'no') AS differ,
      round(100.0 * count(*) FILTER (same = 'yes') / count(*), 1)::DOUBLE AS match_pct FROM judged""",
    "semantic_streak": _ATTEMPTS + "SELECT k, streak FROM streak",
    "retry_eligible": _ATTEMPTS + "SELECT kind.k, label FROM kind JOIN streak USING (k) WHERE round = 3 AND failed AND NOT (semantic AND streak >= 2)",
    "retry_merge": _ATTEMPTS + """, r1 AS (SELECT * FROM kind WHERE round = 1), r2 AS (SELECT kind.* FROM kind JOIN r1 USING (k) WHERE kind.round = 2 AND r1.failed AND k % 3 <> 0),
      last AS (SELECT r1.k, coalesce(r2.round, r1.round) AS round, coalesce(r2.label, r1.label) AS label, coalesce(r2.failed, r1.failed) AS failed FROM r1 LEFT JOIN r2 USING (k))
      SELECT k, round, label, CASE WHEN failed THEN 'failure' ELSE 'success' END AS state FROM last""",
    "convergence": _ATTEMPTS + """, n AS (SELECT failure_type, count(*) FILTER (round = 1) AS n_before, count(*) FILTER (round = 3) AS n_after FROM kind WHERE failed GROUP BY failure_type)
      SELECT * FROM n WHERE n_before <> n_after""",
    "run_stats": _PARSED + """SELECT CAST(sum(k % 400 + 100) AS BIGINT) AS prompt_tokens, CAST(sum(k % 50) AS BIGINT) AS completion_tokens, CAST(sum(k % 400 + 100 + k % 50) AS BIGINT) AS total_tokens,
      CAST(sum(CASE WHEN k % 7 = 0 THEN k % 5 ELSE 0 END) AS BIGINT) AS total_retries, CAST(sum(CASE WHEN k % 7 = 0 THEN k % 2 ELSE 0 END) AS BIGINT) AS total_429s,
      CAST(sum(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_timeouts, CAST(sum(CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS total_other_errors,
      round(CAST(sum(CASE WHEN k % 7 = 0 THEN (k % 5) * 0.5 ELSE 0 END) AS DOUBLE), 2) AS total_backoff_seconds FROM items""",
    "max_retries_item": _PARSED + """SELECT CASE WHEN n > 0 THEN key_text ELSE '' END AS max_retries_item, CAST(n AS BIGINT) AS max_retries_count
      FROM (SELECT key_text, k, CASE WHEN k % 7 = 0 THEN k % 5 ELSE 0 END AS n FROM items) ORDER BY n DESC, k LIMIT 1""",
    "sliding_window_audit": """SELECT event_id, count(*) OVER w AS n_window, CAST(sum(event_id % 100) OVER w AS BIGINT) AS tokens_window FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
    "sliding_window_all": """SELECT event_id, count(*) OVER w AS n_window, CAST(sum(event_id % 100) OVER w AS BIGINT) AS tokens_window FROM events
      WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""",
    "confidence_detail": _PARSED + """, one AS (SELECT *, '{"name": "' || c || '", "confidence": ' || conf || ', "reason": "", "exact_match": true, "original_name": null}' AS e FROM items)
      SELECT k, CASE b WHEN 1 THEN '[' || CASE WHEN conf >= 96 THEN e || ', ' ELSE '' END || '{"name": "' || o || '", "confidence": 96, "reason": "", "exact_match": true, "original_name": null}' || CASE WHEN conf < 96 THEN ', ' || e ELSE '' END || ']'
        WHEN 2 THEN '[' || e || ', ' || e || ']'
        WHEN 3 THEN '[{"name": "' || c || '", "confidence": ' || conf || ', "reason": "", "exact_match": false, "original_name": "' || substr(c, 1, length(c) - 1) || '"}]'
        WHEN 4 THEN '[{"name": "UNKNOWN", "confidence": ' || conf || ', "reason": "", "exact_match": false, "original_name": "UNKNOWN"}]'
        WHEN 5 THEN '[{"name": "UNKNOWN", "confidence": 99, "reason": "", "exact_match": false, "original_name": "UNKNOWN"}, {"name": "' || c || '", "confidence": 99, "reason": "", "exact_match": true, "original_name": null}]'
        WHEN 6 THEN '{"labels":[]}' WHEN 7 THEN '{"error":"timeout"}' WHEN 9 THEN '[{"name": "' || c || '", "confidence": 95, "reason": "", "exact_match": true, "original_name": null}]' WHEN 11 THEN '123' ELSE '[' || e || ']' END AS confidence_detail FROM one""",
    "json_repair": _PARSED + "SELECT k, c AS label, CAST(conf AS INTEGER) AS confidence, CASE WHEN conf >= 60 THEN 'no' ELSE 'yes' END AS is_low_confidence, 'ok' AS parse_status FROM items",
    "failure_ranks": _PARSED + """SELECT failure_type, n, row_number() OVER (ORDER BY n DESC, failure_type) AS place FROM (SELECT CASE b WHEN 6 THEN 'unclassified' WHEN 7 THEN 'api_error' WHEN 11 THEN 'parse_error' ELSE 'unmatched' END AS failure_type, count(*) AS n
      FROM parsed WHERE b IN (4, 5, 6, 7, 11) GROUP BY 1)""",
    "label_ranks": _PARSED + "SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM named GROUP BY label",
    "retry_streaks": _ATTEMPTS + """SELECT kind.k, streak, failed AND semantic AND streak >= 2 AS exhausted FROM kind JOIN streak USING (k) WHERE round = 3""",
    "retry_file": _ATTEMPTS + "SELECT k, label, CASE WHEN failed THEN 1 ELSE 0 END AS part, k AS place FROM kind WHERE round = 1",
    "cycle_usage": """SELECT cycle, count(*) FILTER (event_type = 'purchase') AS n_success, count(*) FILTER (event_type = 'view') AS n_reserved, count(*) FILTER (event_type IN ('purchase', 'view')) AS n_counted
      FROM (SELECT event_type, 1 + (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 21600000000 AS cycle FROM events) GROUP BY cycle""",
    "admission_schedule": "SELECT event_id, CAST((event_id // 3) * 1.5 AS DOUBLE) AS admitted_at FROM events",
}
