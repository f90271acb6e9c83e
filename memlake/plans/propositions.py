"""The registered query of `memlake.operators.propositions`, beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import propositions
from memlake.sources import views

from .queries import E, query, quoted
from .upkeep import derived, sql_view

_N = "(session * 7 + ordinal * 3)"
#: Payloads of an extractor over the turns, with a fault of each kind here and there, alike in Spark and in SQL.
PAYLOAD = {
    "payload": "concat('{\"candidate_id\":', CASE WHEN %(n)s %% 61 = 0 THEN '\" \"' ELSE concat('\"c', CAST(%(n)s AS STRING), '\"') END, ',\"project_id\":', CASE WHEN %(n)s %% 5 = 0 THEN 'null' WHEN %(n)s %% 67 = 0 THEN '7' ELSE '\"p_en\"' END, ',\"claim_type\":\"fact\",\"subject\":', CASE WHEN %(n)s %% 71 = 0 THEN '\"\"' ELSE '\"s\"' END,"
    " ',\"source_role\":\"', CASE WHEN %(n)s %% 9 = 0 THEN 'unknown' WHEN %(n)s %% 73 = 0 THEN 'owner' WHEN %(n)s %% 4 > 0 THEN 'User' ELSE role END, '\",\"commitment\":\"', CASE %(n)s %% 10 WHEN 0 THEN 'question' WHEN 1 THEN 'observed' WHEN 2 THEN 'EXPLICIT' WHEN 3 THEN 'sure' ELSE 'committed' END,"
    " '\",\"evidence_refs\":', CASE %(n)s %% 29 WHEN 0 THEN '[]' WHEN 1 THEN '[\"a\",\"a \"]' WHEN 2 THEN '\"a\"' WHEN 3 THEN '[1]' WHEN 4 THEN 'null' ELSE '[\"ev_1\",\"ev_2\"]' END, ',\"confidence_components\":', CASE %(n)s %% 31 WHEN 0 THEN '{}' WHEN 1 THEN '{\"x\":2}' WHEN 2 THEN '{\"x\":true}' WHEN 3 THEN '{\"x\":\"1\"}' WHEN 4 THEN '{\"x\":1,\"y\":0}' ELSE '{\"x\":0.5}' END,"
    " CASE WHEN %(n)s %% 79 = 0 THEN '' ELSE ',\"schema_version\":\"ig01-a-proposition-v1\"' END,"
    " CASE %(n)s %% 23 WHEN 0 THEN ',\"value\":\"maybe so\"' WHEN 1 THEN ',\"value\":\"should we go\"' WHEN 2 THEN ',\"value\":{\"a\":{\"b\":{\"c\":1}}}' WHEN 3 THEN ',\"value\":{\"a\":{\"b\":{\"c\":{\"d\":1}}}}' WHEN 4 THEN ',\"value\":{\"a\":[{\" Prompt \":1}]}' WHEN 5 THEN concat(',\"value\":\"the ', chr(92), '\"prompt', chr(92), '\": here\"') WHEN 6 THEN ',\"odd\":1' WHEN 7 THEN ',\"value\":[[[[]]]]' WHEN 8 THEN ',\"value\":\"a quote of it\"' ELSE ',\"value\":\"use it\"' END,"
    " CASE %(n)s %% 19 WHEN 0 THEN ',\"temporal_scope\":{\"start\":\"2024-01-02T00:00:00Z\",\"end\":\"2024-01-01T00:00:00Z\"}' WHEN 1 THEN ',\"temporal_scope\":{\"start\":\"2024-01-01T00:00:00+00:00\",\"end\":\"2024-01-02T00:00:00Z\"}' WHEN 2 THEN ',\"temporal_scope\":[1]' WHEN 3 THEN ',\"correction_clues\":{\"explicit\":1}' WHEN 4 THEN ',\"correction_clues\":{\"explicit\":true,\"reason\":\"r\"}' WHEN 5 THEN ',\"target_clues\":{\"named_id\":\" \"}' WHEN 6 THEN ',\"target_clues\":{\"other\":\"x\"}' WHEN 7 THEN ',\"temporal_scope\":{\"start\":5}' ELSE '' END,"
    " CASE WHEN %(n)s %% 83 = 0 THEN '' ELSE '}' END)" % {"n": _N},
    "flag": f"CASE {_N} % 37 WHEN 0 THEN 'question' WHEN 1 THEN 'hypothetical' WHEN 2 THEN 'quoted' ELSE '' END",
}
_KEYS = "[" + ", ".join(map(quoted, propositions.REQUIRED + propositions.OPTIONAL)) + "]"
_STR = lambda f: f"(coalesce(json_type(j, '$.{f}'), '') = 'VARCHAR' AND NOT regexp_matches(json_extract_string(j, '$.{f}'), '^\\s*$'))"
_NONE = lambda f: f"coalesce(json_type(j, '$.{f}'), 'NULL') = 'NULL'"
_LOW = lambda f: f"lower(trim(json_extract_string(j, '$.{f}')))"
_LIST = lambda v: "(" + ", ".join(map(quoted, v)) + ")"
_OBJECT = lambda f, keys: f"({_NONE(f)} OR (json_type(j, '$.{f}') = 'OBJECT' AND len(list_filter(json_keys(j, '$.{f}'), lambda k: k NOT IN {_LIST(keys)})) = 0))"
_SAFE = " AND ".join(
    f"NOT regexp_matches(coalesce(CAST(json_extract(j, '$.{f}') AS VARCHAR), ''), '(?i)\"\\s*(?:{'|'.join(propositions.RESERVED)})\\s*\":') AND NOT regexp_matches(regexp_replace(regexp_replace(coalesce(CAST(json_extract(j, '$.{f}') AS VARCHAR), ''), '\"(?:[^\"\\\\]|\\\\.)*\"', 's', 'g'), '\\{{\\}}|\\[\\]', 's', 'g'), '^[^\\[\\]{{}}]*[\\[{{][^\\[\\]{{}}]*[\\[{{][^\\[\\]{{}}]*[\\[{{][^\\[\\]{{}}]*[\\[{{]')"
    for f in ("value", "temporal_scope", "correction_clues", "target_clues")
)
_VALID = f"""json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: NOT list_contains({_KEYS}, k))) = 0 AND {' AND '.join(f"json_exists(j, '$.{f}')" for f in propositions.REQUIRED)} AND {' AND '.join(map(_STR, ('candidate_id', 'claim_type', 'source_role', 'commitment', 'schema_version')))}
 AND {' AND '.join(f'({_NONE(f)} OR {_STR(f)})' for f in ('project_id', 'subject', 'predicate'))} AND {_LOW('source_role')} IN {_LIST(propositions.ROLES)} AND {_LOW('commitment')} IN {_LIST(propositions.COMMITMENTS)} AND trim(json_extract_string(j, '$.schema_version')) = '{propositions.VERSION}'
 AND json_type(j, '$.evidence_refs') = 'ARRAY' AND json_array_length(j, '$.evidence_refs') > 0 AND len(list_filter(json_extract(j, '$.evidence_refs[*]'), lambda r: json_type(r) <> 'VARCHAR' OR trim(json_extract_string(r, '$')) = '')) = 0
 AND len(list_distinct(list_transform(json_extract(j, '$.evidence_refs[*]'), lambda r: trim(json_extract_string(r, '$'))))) = json_array_length(j, '$.evidence_refs')
 AND json_type(j, '$.confidence_components') = 'OBJECT' AND len(json_keys(j, '$.confidence_components')) > 0 AND len(list_filter(json_extract(j, '$.confidence_components.*'), lambda x: json_type(x) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR TRY_CAST(json_extract_string(x, '$') AS DOUBLE) NOT BETWEEN 0 AND 1)) = 0
 AND {_OBJECT('temporal_scope', propositions.TEMPORAL)} AND coalesce(json_type(j, '$.temporal_scope.start'), 'VARCHAR') = 'VARCHAR' AND coalesce(json_type(j, '$.temporal_scope.end'), 'VARCHAR') = 'VARCHAR' AND coalesce(TRY_CAST(json_extract_string(j, '$.temporal_scope.start') AS TIMESTAMPTZ) <= TRY_CAST(json_extract_string(j, '$.temporal_scope.end') AS TIMESTAMPTZ), true)
 AND {_OBJECT('correction_clues', ('explicit', *propositions.CORRECTION))} AND coalesce(json_type(j, '$.correction_clues.explicit'), 'BOOLEAN') = 'BOOLEAN' AND {_OBJECT('target_clues', propositions.TARGET)} AND (NOT json_exists(j, '$.target_clues.named_id') OR {_STR('target_clues.named_id')}) AND {_SAFE}"""
_COMMITS = "commitment IN ('committed', 'explicit', 'implicit')"


@query(f"""{E}, {sql_view('given', PAYLOAD, 'evidence')}, parsed AS (SELECT session * 1000 + ordinal AS id, flag, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) ELSE CAST('null' AS JSON) END AS j FROM given),
 read AS (SELECT id, flag, coalesce({_VALID}, false) AS ok, {_LOW('commitment')} AS commitment, {_LOW('source_role')} AS role, coalesce(json_extract_string(j, '$.value'), '') AS said, json_type(j, '$.project_id') = 'VARCHAR' AS placed FROM parsed),
 coded AS (SELECT id, CASE WHEN NOT ok THEN 'INVALID_PROPOSITION' WHEN role IN ('assistant', 'tool', 'system') AND {_COMMITS} THEN 'NON_USER_COMMITMENT' WHEN role = 'unknown' AND {_COMMITS} THEN 'UNKNOWN_SOURCE_ROLE' WHEN commitment IN ('question', 'hypothetical') THEN 'NON_COMMITMENT'
  WHEN {_COMMITS} AND flag = 'question' THEN 'QUESTION_COMMITMENT' WHEN {_COMMITS} AND flag = 'hypothetical' THEN 'HYPOTHETICAL_COMMITMENT' WHEN {_COMMITS} AND flag = 'quoted' THEN 'QUOTED_COMMITMENT'
  WHEN {_COMMITS} AND regexp_matches(said, '(?i)\\?|\\b(should we|could we|shall we|what if)\\b') THEN 'QUESTION_COMMITMENT' WHEN {_COMMITS} AND regexp_matches(said, '(?i)\\b(maybe|perhaps|might|could|consider)\\b') THEN 'HYPOTHETICAL_COMMITMENT' WHEN {_COMMITS} AND regexp_matches(said, '(?i)\\b(quoted|quote)\\b') THEN 'QUOTED_COMMITMENT'
  WHEN NOT placed THEN 'SCOPE_UNRESOLVED' WHEN role = 'user' AND {_COMMITS} THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS code FROM read)
SELECT id, code IN ('NON_COMMITMENT', 'SCOPE_UNRESOLVED', 'VALIDATED', 'REVIEW_REQUIRED') AS valid, code = 'VALIDATED' AS canonical, code <> 'VALIDATED' AS review, code FROM coded""")
def propositions_judged(spark, sf_dir):
    given = derived(views.evidence(spark, sf_dir), PAYLOAD)
    return propositions.judged(given.select((F.col("session") * 1000 + F.col("ordinal")).alias("id"), "payload", F.array("flag").alias("flags")))
