"""Fixed values.

Everything in this module is a value that must be equal to the one used by the
system whose results we reproduce: the triage command names, the text-contract
version, the supported event actions and taxonomies, the shipped label catalog
with its thresholds, and the keyword table of the development scorer. They are
stated plainly and in their natural order; nothing else lives here.
"""

from __future__ import annotations

# --- fixed values: text contract -------------------------------------------

#: Version of the text contract that our own bundles carry; the loader takes the expected one as a parameter.
TEXT_CONTRACT_VERSION = "text-v3"

# Triage bot command names (43), alphabetical.
TRIAGE_COMMANDS = (
    "approve",
    "area",
    "assign",
    "cc",
    "cherrypick",
    "close",
    "help",
    "hold",
    "hold-cancel",
    "joke",
    "kind",
    "label",
    "lgtm",
    "meow",
    "milestone",
    "ok-to-test",
    "override",
    "pony",
    "priority",
    "reopen",
    "release-note",
    "release-note-action-required",
    "release-note-none",
    "remove-area",
    "remove-cherrypick",
    "remove-kind",
    "remove-label",
    "remove-milestone",
    "remove-needs-rebase",
    "remove-priority",
    "remove-sig",
    "retest",
    "retest-required",
    "shrug",
    "sig",
    "skip",
    "test",
    "this-is-fine",
    "triage",
    "unassign",
    "uncc",
    "unhold",
    "woof",
)

# --- fixed values: events and catalog rules --------------------------------

SUPPORTED_ACTIONS = ("opened", "edited", "reopened")
SUPPORTED_TAXONOMIES = ("kind", "sig", "area")
DATASET_TAXONOMY_PREFIXES = ("area/", "kind/", "sig/")
SPLIT_NAMES = ("train", "validation", "lockbox")
SPLIT_METHOD = "grouped_creation_time_chronological_strict"
DEFAULT_REPOSITORY = "kubernetes/kubernetes"
SAMPLE_ID_PREFIX = "github_issue_"
URL_PLACEHOLDER = "<URL>"
ISSUE_REF_PLACEHOLDER = "<ISSUE_REF>"
MIN_MAX_LENGTH = 8
HEAD_FRACTION = 0.7
PAD_MULTIPLE = 8
NON_PRODUCTION_SUFFIX = " (non-production)"
KEYWORD_MATCH_SCORE = 0.9
KEYWORD_MISS_SCORE = 0.1
DRY_RUN_SCORE_DIGITS = 4

# --- fixed values: shipped model bundle ------------------------------------

MODEL_VERSION = "1.0.0"
MODEL_BACKEND = "transformer"
MODEL_MAX_LENGTH = 512

# Label catalog in model output order: (label, taxonomy, threshold).
# Thresholds are the float32 images stored with the model.
LABEL_CATALOG = (
    ("area/apiserver", "area", 0.7000000476837158),
    ("area/conformance", "area", 0.7000000476837158),
    ("area/kubectl", "area", 0.7000000476837158),
    ("area/kubelet", "area", 0.7000000476837158),
    ("area/test", "area", 0.7000000476837158),
    ("area/test-infra", "area", 0.7000000476837158),
    ("area/usability", "area", 0.7000000476837158),
    ("kind/bug", "kind", 0.7250000834465027),
    ("kind/cleanup", "kind", 0.7250000834465027),
    ("kind/documentation", "kind", 0.7250000834465027),
    ("kind/failing-test", "kind", 0.7250000834465027),
    ("kind/feature", "kind", 0.7250000834465027),
    ("kind/flake", "kind", 0.7250000834465027),
    ("sig/api-machinery", "sig", 0.3750000298023224),
    ("sig/apps", "sig", 0.3750000298023224),
    ("sig/architecture", "sig", 0.3750000298023224),
    ("sig/auth", "sig", 0.3750000298023224),
    ("sig/autoscaling", "sig", 0.3750000298023224),
    ("sig/cli", "sig", 0.3750000298023224),
    ("sig/cloud-provider", "sig", 0.3750000298023224),
    ("sig/cluster-lifecycle", "sig", 0.3750000298023224),
    ("sig/instrumentation", "sig", 0.3750000298023224),
    ("sig/network", "sig", 0.3750000298023224),
    ("sig/node", "sig", 0.3750000298023224),
    ("sig/release", "sig", 0.3750000298023224),
    ("sig/scalability", "sig", 0.3750000298023224),
    ("sig/scheduling", "sig", 0.3750000298023224),
    ("sig/storage", "sig", 0.3750000298023224),
    ("sig/testing", "sig", 0.3750000298023224),
    ("sig/windows", "sig", 0.3750000298023224),
)

# Development (keyword) scorer: label -> substrings of the lower-cased text.
DEVELOPMENT_KEYWORDS = (
    ("kind/bug", ("bug",)),
    ("kind/feature", ("feature",)),
    ("kind/cleanup", ("cleanup",)),
    ("sig/auth", ("auth", "security")),
    ("sig/cli", ("cli", "kubectl")),
    ("sig/scheduling", ("scheduling", "scheduler")),
    ("sig/node", ("node", "kubelet")),
    ("sig/api-machinery", ("api", "apiserver")),
    ("area/kubectl", ("kubectl",)),
    ("area/provider", ("provider", "cloud")),
    ("area/security", ("security", "cert")),
)
