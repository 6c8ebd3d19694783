"""Fixed vocabularies of the graph model and literal-map lookups over them.

Every table here has a few dozen entries at most, so lookups are literal map
expressions inside the projection: no join, no broadcast, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: node types, and the subtypes each one admits (null always valid) ---
SUBTYPES: dict[str, list[str]] = {
    "Character": ["Person", "Deity", "Creature", "Construct"],
    "Place": ["Region", "City", "Realm", "Building", "Landmark"],
    "Organization": [
        "Faction", "Clan", "Sect", "Guild", "Kingdom", "Empire", "Army", "Cult", "Church", "Corporation", "School",
    ],
    "Item": ["Weapon", "Consumable", "Resource", "Treasure", "Relic", "Artifact"],
    "Ability": ["Spell", "Technique", "Skill", "Aspect", "Talent", "Passive", "Active"],
    "Concept": ["System", "PowerSystem", "Language", "Species", "Rank", "Currency", "Law", "Phenomenon"],
    "Event": ["Battle", "Tournament", "Disaster", "Ritual", "Ceremony"],
    "Title": ["Honorary", "Political", "Religious", "Combat"],
}
NODE_TYPES = list(SUBTYPES)

# --- fixed values: relation names by tier, and the label shown for each ---
TIER_RELATIONS: dict[int, list[str]] = {
    1: [
        "AffiliatedWith", "LocatedIn", "MemberOf", "LeaderOf", "HasAbility", "OwnsItem", "HasTitle",
        "ParticipatedIn", "RelatedTo",
    ],
    2: [
        "Ally", "Enemy", "Rival", "Mentor", "Student", "Family", "Parent", "Child", "Sibling", "Spouse",
        "Romantic", "Betrayed", "Serves", "Killed", "Protects", "Fears", "Respects",
    ],
    3: ["SAME_AS", "ALIAS", "SECRET_IDENTITY", "REINCARNATION", "TRANSMIGRATED_INTO"],
}
RELATION_TIER = {name: tier for tier, names in TIER_RELATIONS.items() for name in names}
DISPLAY_LABELS = {
    "AffiliatedWith": "affiliated with", "LocatedIn": "in", "MemberOf": "member of", "LeaderOf": "leads",
    "HasAbility": "has ability", "OwnsItem": "owns", "HasTitle": "holds", "ParticipatedIn": "took part in",
    "Ally": "ally of", "Enemy": "enemy of", "Rival": "rival of", "Mentor": "mentor of", "Student": "student of",
    "Family": "family of", "Parent": "parent of", "Child": "child of", "Sibling": "sibling of",
    "Spouse": "spouse of", "Romantic": "romantic with", "Betrayed": "betrayed", "Serves": "serves",
    "Killed": "killed", "Protects": "protects", "Fears": "fears", "Respects": "respects",
    "SAME_AS": "same as", "ALIAS": "alias", "SECRET_IDENTITY": "secret identity",
    "REINCARNATION": "reincarnation of", "TRANSMIGRATED_INTO": "transmigrated into",
}
METHODS = ["gliner", "rule", "llm"]

# --- fixed values: tagger label -> node type ---
LABEL_TYPES = {
    "Character": "Character", "person": "Character",
    "Place": "Place", "location": "Place",
    "Organization": "Organization", "faction": "Organization",
    "Item": "Item", "Ability": "Ability",
    "Concept": "Concept", "power system": "Concept", "phenomenon": "Concept", "language": "Concept",
    "Event": "Event", "Title": "Title",
}

# --- fixed values: name handling ---
OUTER_PUNCTUATION = "\"'“”‘’()[]{}.,;:!?—-"
GENERIC_NAME_TOKENS = [
    "the", "a", "an", "lord", "lady", "ser", "sir", "king", "queen", "house", "guild", "city", "man", "woman",
]

# --- fixed values: tier 1 rule table (source type, target type) -> relation, and leadership cues ---
TYPE_PAIR_RELATION = {
    ("Character", "Organization"): "MemberOf",
    ("Character", "Place"): "LocatedIn",
    ("Character", "Ability"): "HasAbility",
    ("Character", "Item"): "OwnsItem",
    ("Character", "Title"): "HasTitle",
    ("Character", "Event"): "ParticipatedIn",
    ("Organization", "Place"): "LocatedIn",
    ("Organization", "Organization"): "AffiliatedWith",
    ("Place", "Event"): "ParticipatedIn",
}
LEADER_CUES = [
    "leader", "led", "leads", "head", "ruler", "ruled", "rules", "reigned", "commander", "commands", "chief",
    "regent", "throne", "king", "queen", "lord",
]

# --- fixed values: tier 2 phrase -> relation, symmetric relations, type rules ---
RELATION_PHRASES = {
    "ally of": "Ally", "allied with": "Ally", "friend of": "Ally", "enemy of": "Enemy", "rival of": "Rival",
    "mentor of": "Mentor", "teacher of": "Mentor", "trained": "Mentor", "raised": "Mentor",
    "student of": "Student", "apprentice of": "Student",
    "parent of": "Parent", "father of": "Parent", "mother of": "Parent",
    "child of": "Child", "son of": "Child", "daughter of": "Child",
    "sibling of": "Sibling", "brother of": "Sibling", "sister of": "Sibling",
    "uncle of": "Family", "aunt of": "Family", "relative of": "Family",
    "spouse of": "Spouse", "married to": "Spouse", "in love with": "Romantic", "lover of": "Romantic",
    "betrayed": "Betrayed", "serves": "Serves", "works for": "Serves", "serves under": "Serves",
    "killed": "Killed", "protects": "Protects", "fears": "Fears", "respects": "Respects",
}
SYMMETRIC_SOCIAL = ["Ally", "Enemy", "Rival", "Sibling", "Spouse", "Family", "Romantic"]
PERSON_ONLY = ["Parent", "Child", "Sibling", "Spouse", "Romantic", "Family", "Mentor", "Student"]
AGENT_TYPES = ["Character", "Organization"]
INVERSE_RELATIONS = {"Child": "Parent", "Student": "Mentor"}

# --- fixed values: tier 3 ---
SYMMETRIC_IDENTITY = ["SAME_AS"]
SINGLE_ANCHOR_IDENTITY = ["TRANSMIGRATED_INTO", "REINCARNATION"]
MIN_CITATION_CHARS = 8

# --- fixed values: self-reference surfaces of coreference merging ---
SELF_REFERENCE = ["I", "me", "my", "mine", "myself", "you", "your", "yours", "yourself"]


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """``mapping[key]`` as an expression, null when the key is absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def relation_tier(relation: Column) -> Column:
    return lookup(RELATION_TIER, relation)


def relation_label(relation: Column) -> Column:
    """Display label, blank for relations that are not worth a label."""
    return F.coalesce(lookup(DISPLAY_LABELS, relation), F.lit(""))


def relation_step_label(relation: Column) -> Column:
    """Label of one hop in a path or connection list; never blank."""
    return F.coalesce(lookup(DISPLAY_LABELS, relation), F.lit("linked"))


def relations_table(spark: SparkSession) -> DataFrame:
    """The relation vocabulary as a dimension table (31 rows)."""
    rows = [(r, t, DISPLAY_LABELS.get(r, ""), r in SYMMETRIC_SOCIAL + SYMMETRIC_IDENTITY) for r, t in RELATION_TIER.items()]
    return spark.createDataFrame(rows, "relation string, tier int, label string, symmetric boolean")
