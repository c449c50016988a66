"""Closed label sets and the table contracts."""
from __future__ import annotations

# ---- Fixed values: closed label sets, in natural order --------------------------------------------------------------
TIERS = ["minor", "medium", "significant", "major"]
ABSTRACT_CLASSES = ["no_change", "minor", "major"]
DIFF_TYPES = ["claim_disappeared", "claim_added", "numerical_shift", "hedging_added", "hedging_removed", "claim_reversed",
              "outcome_switch"]
CITES = ["superseded", "current", "flagged_as_previous", "indirect", "not_relying", "unclear"]
STRENGTH_ORDER = ["superseded", "indirect", "flagged_as_previous", "unclear", "current", "not_relying"]
ROLES = ["model_input", "reported_as_fact", "background", "unknown"]
NOTIFY_CLASSES = ["superseded", "indirect"]
VALUE_USES = ["uses_old_value", "uses_current_value", "mentions_both", "unchanged_value", "cannot_tell"]
REVIEW_STATUSES = ["pending", "approved", "rejected", "not_required"]
ROOT_CAUSES = [
    "definition_change",
    "analysis_removed",
    "reporting_choice",
    "model_respecified",
    "outcome_redefinition",
    "method_change",
    "generality_reversed",
    "data_revision",
    "wording_only",
]
UNTRACED_ROOT_CAUSES = ["wording_only", "reporting_choice"]
# -------------------------------------------------------------------------------------------------------------------

DIFF_SCHEMA = (
    "diff_type string, preprint_text string, published_text string, change_description string, root_cause string, "
    "materiality double, rationale string, severity_tier string, "
    "evidence array<struct<doc_id:string,section:string,quote:string>>, label_problems array<string>")
