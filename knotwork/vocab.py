"""The closed vocabularies of the graph, declared once."""

from __future__ import annotations

# The vocabularies of the format, in this module throughout. First note fields and the edge types that they give.
VALUE_AXIS = {"realizes": "REALIZES", "based_on": "BASED_ON", "depends_on": "DEPENDS_ON", "addresses": "ADDRESSES", "satisfies": "SATISFIES", "has_need": "HAS_NEED"}
SEMANTIC = {"serves": "SERVES", "delivered_by": "DELIVERS", "mentions": "MENTIONS", **VALUE_AXIS}
SINGLE_FIELDS = ("reports_to", "owns_node", "serves")
LIST_FIELDS = ("manages", "collaborates_with", "delivered_by", "mentions", "involves", *VALUE_AXIS)
#: Types that carry reachability from goals; mentions do not.
REACHING = ("OWNS", "SERVES", "DELIVERS", "involves", *VALUE_AXIS.values())
#: The field of a note that holds an edge of a type, and whether it holds one value or many.
WRITE_BACK = {"OWNS": ("owns_node", True), "SERVES": ("serves", True), "DELIVERS": ("delivered_by", False), "MENTIONS": ("mentions", False), "involves": ("involves", False), **{t: (f, False) for f, t in VALUE_AXIS.items()}}
VALUE_NEXUSES = ("product", "customer", "growth", "market", "system")
REQUIRED = ("nexus", "node_id", "node_type", "kind", "owner", "confidence", "sources", "updated", "ttl_days", "ripeness")
NODE_TYPES = (
    "spine", "operating-model", "gates", "bootstrap", "step-overview", "sprint-phase", "person", "system-component",
    "objective", "key-result", "epic", "task", "episode", "risk", "decision", "component-ref",
    "product", "service", "interface", "platform", "feature", "value-proposition", "need", "segment", "initiative", "entity", "concept",
)
KINDS = ("normative", "empirical")
#: Stems of notes that list others: they may lack sources.
INDEX_STEMS = ("_index", "_registry")
SYSTEM_NEXUS = "system"
RIPENESS = ("fresh", "ripening", "wilting")
ASPECT_KINDS = ("commitment", "state", "opinion")
VALUE_TYPES = ("date", "number", "text")
RISK_AXES = ("understanding_gap", "expectation_divergence", "schedule_slip", "requirements_change")

#: Prefixes of ids that tell the kind of a node.
EPISODE, GOAL, TASK, OBJECTIVE, TEAM = "pulse-", "kr-", "task-", "obj-", "team-"
CONTENT_OVERVIEW = "step-overview"
GATE_FROM, REVIEW_FROM = 0.6, 0.5
