"""Fixed schemas of the relations; nothing is inferred from data."""

from __future__ import annotations

TURNS = (
    "case_id string, turn_id string, revision int, occurred_at timestamp, question_text string, prior_turns_summary string, decision string, "
    "reason_codes array<string>, answer_markdown string, evidence_fragment_ids array<string>, snapshot_id string, handoff_status string, "
    "recommended_line string, service_need string, stage_timings struct<understand_ms: int, retrieve_ms: int, draft_ms: int, verify_ms: int>, "
    "error_category string, model_version string, retrieval_config_version string"
)
FEEDBACK = (
    "feedback_id string, case_id string, turn_id string, occurred_at timestamp, helpful boolean, specialist_rating string, "
    "information_quality_rating string, specialist_ref string, integration_mode string, solved boolean, comment_text string"
)
COMPLETIONS = (
    "case_id string, completed_at timestamp, completion_reason string, resolution_status string, handoff_status string, integration_mode string, "
    "specialist_ref string, stage_code string, moderation_warning_count int, turn_count int"
)
FRAGMENTS = (
    "fragment_id string, document_version_id string, snapshot_id string, page_start int, page_end int, section string, kind string, "
    "heading_path array<string>, search_text string, text string, "
    "source_anchor struct<page: int, bbox: array<double>, section: string, text_excerpt: string, text_hash: string>, "
    "actor_roles array<string>, process string, provider string, document_status string, error_codes array<string>, review_status string, text_hash string"
)
SNAPSHOTS = "snapshot_id string, corpus string, document_version_ids array<string>, manifest_hash string, created_at timestamp, review_status string"
CARDS = (
    "card_id string, version string, snapshot_id string, title string, applicability struct<roles: array<string>, process: array<string>, "
    "provider: array<string>, document_status: array<string>, required_conditions: array<string>>, required_slots array<string>, allowed_action string, "
    "forbidden_generalization string, handoff_condition string, risk_level string, source_fragment_ids array<string>, source_quotes array<string>, "
    "source_anchors array<string>, review_status string"
)
GOLD = "label_source string, snapshot_id string, queries array<struct<query_id: string, document: string, query: string, expected_fragment_ids: array<string>, exact_codes: array<string>, subsets: array<string>>>"
MANIFEST = "file string, title string, corpus string, declared_version string, declared_date string"
EVENT_LOG = "event_id long, case_id string, turn_id string, revision int, type string, occurred_at timestamp, payload_json string"
OUTBOX = "id long, message_type string, payload_json string, created_at timestamp, delivered_at timestamp, attempt_count int, last_error string"
CLAIMS = "claim_id string, text string, fragment_ids array<string>, evidence_quote string, evidence_reference string, applies_if array<string>, requires_human_check boolean"
PAGES = (
    "page_number int, text string, text_blocks array<struct<text: string, bbox: array<double>>>, "
    "tables array<struct<headers: array<string>, rows: array<array<string>>, bbox: array<double>, warnings: array<string>>>, "
    "quality_flags array<string>, warnings array<string>"
)
