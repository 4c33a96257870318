"""Utterances: routes, mentions, slots, context, sessions, annotated examples, intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultsift.functions import dialogue as say
from faultsift.operators import aggregates, conversations, joins
from faultsift.plans.intents import tag_intents, train_intents

from . import fixtures as fx
from .registry import query


def _turns(spark, folder):
    return fx.table(spark, folder, "conversations")


@query("keyword_route", """
SELECT conv_id, turn, CASE
  WHEN contains(lower(text), 'menu') OR contains(lower(text), 'back') OR contains(lower(text), 'options')
    THEN 'menu'
  WHEN contains(lower(text), 'hello') OR contains(lower(text), 'hi') THEN 'greeting'
  WHEN contains(lower(text), 'json') OR contains(lower(text), 'download') OR contains(lower(text), 'fetch')
    THEN 'fetch'
  ELSE 'help' END AS route FROM conversations""")
def _(spark, folder):
    return _turns(spark, folder).select(
        "conv_id", "turn", say.keyword_route(F.col("text")).alias("route"))


@query("extract_owner_mention", r"""
SELECT conv_id, turn, nullif(regexp_extract(text, '(?i)(?:owner|for)\s+(\w+)', 1), '') AS owner,
       NOT contains(lower(text), 'without') AS with_report FROM conversations""")
def _(spark, folder):
    return _turns(spark, folder).select(
        "conv_id", "turn", say.owner_mention(F.col("text")).alias("owner"),
        say.wants_report(F.col("text")).alias("with_report"))


@query("slot_carry_forward", f"""WITH {fx.TURN_SQL}
SELECT conv_id, turn, coalesce(last_value(platform IGNORE NULLS) OVER (PARTITION BY conv_id
       ORDER BY turn ROWS UNBOUNDED PRECEDING), 'Windows') AS platform_slot FROM turns""")
def slot_query(spark, folder):
    return conversations.carry_slot(
        fx.user_turns(spark, folder), "conv_id", "turn", "platform", "platform_slot", "Windows"
    ).select("conv_id", "turn", "platform_slot")


@query("history_window", """
SELECT conv_id, turn, list_aggregate(list(text) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 'string_agg', ' | ') AS context
FROM conversations""")
def history_query(spark, folder):
    return conversations.history(_turns(spark, folder), "conv_id", "turn", "text").select(
        "conv_id", "turn", F.array_join("history", " | ").alias("context"))


@query("conversation_sessions", """
WITH steps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM steps)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n_events
FROM numbered GROUP BY user_id, s""")
def sessions_query(spark, folder):
    return conversations.sessions(fx.table(spark, folder, "events"), "user_id", "ts").withColumn(
        "n_events", F.col("n_events").cast("bigint"))


RULES = [("click", "open_link"), ("error", "analyze_failure"), ("signup", "greet")]


@query("intent_action_lookup", """
SELECT event_id, event_type AS intent, CASE event_type WHEN 'click' THEN 'open_link'
       WHEN 'error' THEN 'analyze_failure' WHEN 'signup' THEN 'greet' ELSE 'how_to_use' END AS action
FROM events""")
def _(spark, folder):
    rules = spark.createDataFrame(RULES, "intent STRING, action STRING")
    intents = fx.table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("intent"))
    return joins.lookup_action(intents, rules, "how_to_use")


def _examples(spark, folder):
    """Parts as annotated examples; some annotations contain brackets."""
    name = F.when(F.col("p_partkey") % 19 == 0, F.concat(F.lit("a[b "), "p_name")).when(
        F.col("p_partkey") % 23 == 0, F.concat("p_name", F.lit(" (x)"))).otherwise(F.col("p_name"))
    example = F.concat(
        F.lit("get data for ["), name, F.lit("](product) of ["), "p_brand", F.lit("]("),
        F.lower("p_type"), F.lit(")"))
    return fx.table(spark, folder, "part").select(
        "p_partkey", F.col("p_type").alias("intent"), example.alias("example"))


EXAMPLE_SQL = r"""
examples AS (SELECT p_partkey, p_type AS intent, 'get data for [' ||
   CASE WHEN p_partkey % 19 = 0 THEN 'a[b ' || p_name WHEN p_partkey % 23 = 0 THEN p_name || ' (x)'
        ELSE p_name END || '](product) of [' || p_brand || '](' || lower(p_type) || ')' AS example FROM part),
entities AS (SELECT p_partkey, intent,
  unnest(regexp_extract_all(example, '\[(.*?)\]\((.*?)\)', 1)) AS entity_text,
  unnest(regexp_extract_all(example, '\[(.*?)\]\((.*?)\)', 2)) AS entity_type FROM examples)
"""


@query("parse_annotations",
       f"WITH {EXAMPLE_SQL} SELECT p_partkey, entity_text, entity_type FROM entities")
def _(spark, folder):
    found = F.explode(say.annotations(F.col("example")))
    return _examples(spark, folder).select("p_partkey", found.alias("e")).select("p_partkey", "e.*")


@query("annotation_audit", f"""WITH {EXAMPLE_SQL}
SELECT intent, count(entity_text) AS annotations, count(DISTINCT entity_type) AS entity_types,
       count(*) FILTER (WHERE regexp_matches(entity_text, '[\\[\\]]')) AS nested_brackets,
       count(*) FILTER (WHERE regexp_matches(entity_text, '[()]')) AS nested_parentheses
FROM entities GROUP BY intent""")
def _(spark, folder):
    examples = _examples(spark, folder).withColumn("entities", say.annotations(F.col("example")))
    return aggregates.annotation_audit(examples)


@query("triage_prompt", """
SELECT d.doc_id, chr(10) || 'Test ID: ' || d.doc_id || chr(10) || 'Test Title: ' || lang || chr(10)
  || 'Description: ' || coalesce(CAST(quality AS VARCHAR), 'Unknown') || chr(10) || 'Error: ' || source
  || chr(10) || chr(10) || 'Logs:' || chr(10) || text || chr(10) || chr(10)
  || 'Analyze the test failure above and provide:' || chr(10) || '1. Likely cause of the failure:' || chr(10)
  || '2. Confidence level (0-100):' || chr(10) || '3. Suggested actions to fix:' || chr(10)
  || '4. Similar previous cases:' || chr(10) AS prompt
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, folder):
    docs = fx.table(spark, folder, "documents").join(
        fx.table(spark, folder, "labels"), "doc_id", "left")
    prompt = say.triage_prompt(F.col("doc_id"), F.col("lang"), F.col("quality"), F.col("source"),
                               F.split("text", "\n"))
    return docs.select("doc_id", prompt.alias("prompt"))


REPLY = ["1. Likely cause of the failure: ", " \n2. Confidence level (0-100): about ",
         "%\n3. Suggested actions to fix: ", "\n4. Similar previous cases: none"]


def _replies(spark, folder):
    """Benchmark texts as replies; every third one has no numbered fields."""
    reply = F.concat(F.lit(REPLY[0]), F.substring("text", 1, 40), F.lit(REPLY[1]),
                     F.col("item_id").cast("string"), F.lit(REPLY[2]),
                     F.substring(F.col("text"), F.lit(41), F.length("text")), F.lit(REPLY[3]))
    return fx.table(spark, folder, "benchmark").select(
        "item_id", F.when(F.col("item_id") % 3 == 2, F.col("text")).otherwise(reply).alias("reply"))


@query("parse_triage_reply", rf"""
WITH cut AS (SELECT item_id, item_id % 3 = 2 AS plain,
  regexp_extract(substr(text, 1, 40), '(?s)^(.*?)(?:2\.|$)', 1) AS cause,
  regexp_extract(substr(text, 41), '(?s)^(.*?)(?:4\.|$)', 1) AS suggestion FROM benchmark)
SELECT item_id, CASE WHEN plain THEN 'Unknown' ELSE trim(cause, ' ' || chr(10)) END AS cause,
       CASE WHEN plain THEN 0 ELSE item_id END AS confidence,
       CASE WHEN plain THEN 'No suggestion available'
            ELSE trim(suggestion, ' ' || chr(10)) END AS suggestion,
       CAST(0 AS INTEGER) AS n_cases FROM cut""")
def _(spark, folder):
    parsed = say.parse_triage_reply(F.col("reply"))
    return _replies(spark, folder).select("item_id", parsed.alias("p")).select(
        "item_id", "p.cause", "p.confidence", "p.suggestion",
        F.size("p.similar_cases").alias("n_cases"))


@query("intent_tagging")
def intent_query(spark, folder):
    turns = _turns(spark, folder).withColumn("intent", F.col("role"))
    return tag_intents(train_intents(turns), turns).select(
        "conv_id", "turn", "intent", "predicted_intent")
