import json

from memlake.operators import propositions

GOOD = {"candidate_id": "c", "project_id": "p", "claim_type": "fact", "source_role": "user", "commitment": "committed", "evidence_refs": ["e"], "confidence_components": {"x": 0.5}, "schema_version": propositions.VERSION, "value": "use redis"}


def test_codes(spark):
    cases = [
        (GOOD, "VALIDATED"), ({**GOOD, "project_id": None}, "SCOPE_UNRESOLVED"), ({**GOOD, "source_role": "assistant"}, "NON_USER_COMMITMENT"), ({**GOOD, "commitment": "observed"}, "REVIEW_REQUIRED"), ({**GOOD, "value": "Kullansak mı"}, "QUESTION_COMMITMENT"),
        ({k: v for k, v in GOOD.items() if k != "project_id"}, "INVALID_PROPOSITION"), ({**GOOD, "extra": 1}, "INVALID_PROPOSITION"), ({**GOOD, "evidence_refs": []}, "INVALID_PROPOSITION"), ({**GOOD, "confidence_components": {"x": 1.5}}, "INVALID_PROPOSITION"),
        ({**GOOD, "value": {"a": {"b": {"c": 1}}}}, "VALIDATED"), ({**GOOD, "value": {"a": {"b": {"c": {}}}}}, "VALIDATED"), ({**GOOD, "value": {"a": {"b": {"c": [1]}}}}, "INVALID_PROPOSITION"), ({**GOOD, "value": {"a": {" Token ": 1}}}, "INVALID_PROPOSITION"),
        ({**GOOD, "value": 'said "token": x'}, "VALIDATED"), ({**GOOD, "value": '"quoted words"'}, "QUOTED_COMMITMENT"), ({**GOOD, "value": 3.5}, "VALIDATED"), ([1], "INVALID_PROPOSITION"), (None, "INVALID_PROPOSITION"),
        ({**GOOD, "temporal_scope": {"start": "2024-01-01T00:00:00", "end": "2024-01-02T00:00:00"}}, "INVALID_PROPOSITION"), ({**GOOD, "temporal_scope": None}, "VALIDATED"), ({**GOOD, "correction_clues": {"reason": ""}}, "INVALID_PROPOSITION"), ({**GOOD, "target_clues": {"claim_key": None}}, "INVALID_PROPOSITION"),
    ]
    rows = [(i, json.dumps(p, ensure_ascii=False), []) for i, (p, _) in enumerate(cases)] + [(100, "{broken", []), (101, None, None), (102, json.dumps(GOOD), ["hypothetical"])]
    got = {r["id"]: r["code"] for r in propositions.judged(spark.createDataFrame(rows, "id long, payload string, flags array<string>")).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: code for i, (_, code) in enumerate(cases)}
    assert (got[100], got[101], got[102]) == ("INVALID_PROPOSITION", "INVALID_PROPOSITION", "HYPOTHETICAL_COMMITMENT")
