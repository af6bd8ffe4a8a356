"""Explicit table schemas; nothing is inferred."""

from __future__ import annotations

FILED_COLUMNS = (
    "ttb_id", "serial_number", "beverage_type", "source_of_product", "application_type",
    "brand_name", "fanciful_name", "class_type_designation", "applicant_name_address",
    "mailing_address", "plant_registry_no", "alcohol_content", "net_contents",
    "grape_varietal", "country_of_origin", "wine_appellation", "wine_vintage",
    "formula_id", "phone", "email", "application_date", "submitted_at",
)
DESIGN_COLUMNS = ("scenario", "expected_verdict", "violation_kind")
GOLD_COLUMNS = (
    "gt_brand_name", "gt_class_type_designation", "gt_alcohol_content",
    "gt_net_contents", "gt_applicant_name_address", "gt_government_warning",
)
CORPUS_COLUMNS = FILED_COLUMNS + DESIGN_COLUMNS + GOLD_COLUMNS + ("images",)
CORPUS_CSV = ", ".join(f"{name} string" for name in CORPUS_COLUMNS)

SUBMISSIONS = (
    "id bigint, "
    + ", ".join(f"{c} string" for c in FILED_COLUMNS if c not in ("application_date", "submitted_at"))
    + ", status string, engine_verdict string, disposition string, application_date date, "
    "submitted_at timestamp, decided_at timestamp, specialist_id string, decision_notes string, "
    "correction_due_at timestamp, processing_ms int, created_at timestamp, updated_at timestamp"
)
LABEL_IMAGES = (
    "id bigint, submission_id bigint, image_role string, position int, filename string, "
    "mime_type string, width_px int, height_px int, label_width_in double, label_height_in double, "
    "file_size_bytes bigint, enhanced_path string, binarized_path string, preprocess_log string, "
    "preprocess_ms int, preprocessed_at timestamp, created_at timestamp"
)
AUDIT_EVENTS = (
    "id bigint, submission_id bigint, event_type string, actor string, from_status string, "
    "to_status string, note string, occurred_at timestamp"
)
OCR_RESULTS = (
    "id bigint, label_image_id bigint, submission_id bigint, engine_name string, "
    "engine_version string, extracted_text string, confidence double, "
    "word_boxes array<struct<text:string,box:array<double>,conf:double>>, latency_ms int, "
    "ran_on_cpu boolean, image_variant string, status string, error_text string, "
    "created_at timestamp"
)
LLM_RESULTS = (
    "id bigint, submission_id bigint, label_image_id bigint, task string, model_name string, "
    "model_id string, model_full_id string, provider string, is_benchmark_only boolean, "
    "prompt_tokens int, completion_tokens int, total_tokens int, latency_ms int, "
    "requested_at timestamp, responded_at timestamp, result_text string, status string, "
    "created_at timestamp"
)
FIELD_COMPARISONS = (
    "id bigint, submission_id bigint, field_key string, application_value string, "
    "extracted_value string, source_ocr_result_id bigint, source_llm_result_id bigint, "
    "match_status string, similarity double, created_at timestamp"
)
CHECKLIST_ITEMS = (
    "id bigint, submission_id bigint, check_key string, label string, cfr_citation string, "
    "check_type string, verdict string, detail string, field_comparison_id bigint, "
    "created_at timestamp"
)
REVIEW_PROGRESS = (
    "submission_id bigint, ticked_check_keys string, decisions string, draft_notes string, "
    "updated_at timestamp"
)
PRICES = (
    "model_id string, input_price_per_1k decimal(12,8), output_price_per_1k decimal(12,8), "
    "source string, as_of string"
)
MANIFEST = (
    "array<struct<role:string,position:int,filename:string,mime_type:string,"
    "width_px:int,height_px:int,file_size_bytes:bigint>>"
)
EXTRACTED_KEYS = (
    "brand_name", "class_type_designation", "alcohol_content", "net_contents",
    "applicant_name_address", "country_of_origin", "government_warning",
)
