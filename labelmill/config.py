"""Configuration: label specs, rule lexicons, bands, and the agronomy presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

Lexicon = dict[str, tuple[str, ...]]


@dataclass(frozen=True)
class LabelSpec:
    """Label fields of a corpus: one domain flag, routing flags, two
    multi-label sets and two single-class fields."""

    domain: str
    flags: tuple[str, ...]
    crops: tuple[str, ...]
    topics: tuple[str, ...]
    intents: tuple[str, ...]
    urgencies: tuple[str, ...]
    difficulties: tuple[str, ...] = ("simple", "medium", "hard")
    source_types: tuple[str, ...] = ("synthetic",)
    exclusive_crops: tuple[str, ...] = ("both", "unknown")

    @property
    def binary(self) -> tuple[str, ...]:
        return (self.domain, *self.flags)

    @property
    def sets(self) -> dict[str, tuple[str, ...]]:
        return {"crops": self.crops, "topics": self.topics}

    @property
    def classes(self) -> dict[str, tuple[str, ...]]:
        return {"intent": self.intents, "urgency": self.urgencies}

    def with_flags(self, *flags: str) -> "LabelSpec":
        return replace(self, flags=tuple(flags))


@dataclass(frozen=True)
class RuleConfig:
    """Keyword lexicons of the rule classifier; dict order is priority order."""

    spec: LabelSpec
    flag_keywords: Lexicon
    topic_keywords: Lexicon
    crop_keywords: Lexicon
    intent_keywords: Lexicon
    urgent_keywords: tuple[str, ...]
    soon_keywords: tuple[str, ...]
    negative_hints: tuple[str, ...] = ()
    crop_both: str = "both"
    crop_unknown: str = "unknown"
    default_topic: str = "general_agronomy"
    other_intent: str = "other"
    question_intent: str = "question"
    question_mark: str = "?"
    urgency_levels: tuple[str, str, str] = ("low", "medium", "high")

    def domain_keywords(self) -> tuple[str, ...]:
        lexicons = (self.crop_keywords, self.topic_keywords, self.flag_keywords)
        words = [w for lexicon in lexicons for ws in lexicon.values() for w in ws]
        return tuple(dict.fromkeys(words))


@dataclass(frozen=True)
class Band:
    """Accepted range of one corpus statistic; ``None`` leaves a side open.
    ``low_label``/``high_label`` name the finding on each side."""

    check: str
    lo: float | None = None
    hi: float | None = None
    low_label: str = "low"
    high_label: str = "high"


@dataclass(frozen=True)
class Thresholds:
    """Decision thresholds of the token model."""

    binary: dict[str, float] = field(default_factory=dict)
    sets: dict[str, float] = field(default_factory=dict)
    default: float = 0.5

    def of(self, field_name: str) -> float:
        return self.binary.get(field_name, self.sets.get(field_name, self.default))


# ---------------------------------------------------------------------------
# Fixed values of the agronomy preset.  They have to be exactly these words,
# spaces and numbers, because predictions and gates are compared on them.
# ---------------------------------------------------------------------------

FLAGS_4 = ("needs_rag", "needs_web_search", "needs_weather_data", "needs_farm_data")
FLAGS_5 = (*FLAGS_4, "needs_epa_label")

AGRONOMY_SPEC = LabelSpec(
    domain="is_ag_related",
    flags=FLAGS_4,
    crops=("corn", "soybean", "both", "unknown"),
    topics=(
        "weather", "disease", "pest", "weed", "nutrient", "soil", "management",
        "market_economics", "equipment", "ag_technology", "policy_regulation",
        "general_agronomy",
    ),
    intents=(
        "question", "diagnosis", "recommendation", "planning", "monitoring",
        "information_lookup", "comparison", "other",
    ),
    urgencies=("low", "medium", "high"),
)
AGRONOMY_SPEC_5 = AGRONOMY_SPEC.with_flags(*FLAGS_5)

AGRONOMY_EVAL = RuleConfig(
    spec=AGRONOMY_SPEC,
    flag_keywords={
        "needs_web_search": (
            "today", "right now", "current", "latest", "cash bid", "cash bids",
            "basis", "futures", "price", "prices", "regulation", "cutoff",
            "deadline", "dicamba", "news", "outbreak",
        ),
        "needs_weather_data": (
            "rain", "storm", "temperature", "temperatures", "forecast", "humidity",
            "wind", "frost", "heat", "drought", "spray window", "spray today",
            "tomorrow", "field to dry", "dry spell", "weather",
        ),
        "needs_rag": (
            "disease", "fungus", "fungal", "blight", "rot", "yellow", "deficiency",
            "armyworm", "aphid", "waterhemp", "marestail", "foxtail",
            "lambsquarters", "weed", "pest", "soil crusting", "side-dress",
            "sidedress", "what should i do", "next move",
        ),
        "needs_farm_data": (
            "field", "farm", "quarter", "north 80", "west farm", "soil test",
            "planting date", "growth stage", "hybrid", "variety", "yield history",
            "home quarter", "river bottom", "sandy hill", "black dirt",
        ),
    },
    topic_keywords={
        "weather": ("rain", "forecast", "wind", "humidity", "temperature", "frost", "heat", "drought", "weather"),
        "disease": ("disease", "blight", "fungus", "rot", "mold", "lesion"),
        "pest": ("pest", "armyworm", "aphid", "beetle", "worm", "insect"),
        "weed": ("weed", "waterhemp", "foxtail", "marestail", "lambsquarters", "palmer"),
        "nutrient": ("nitrogen", "phosphorus", "potassium", "sulfur", "nutrient", "deficiency", "yellow"),
        "soil": ("soil", "infiltration", "compaction", "crusting", "ph", "cec"),
        "management": ("spray", "planting", "harvest", "side-dress", "sidedress", "manage", "rotation"),
        "market_economics": ("cash bid", "cash bids", "price", "basis", "futures", "market", "elevator"),
        "equipment": ("planter", "monitor", "row unit", "closing wheel", "combine", "toolbar"),
        "ag_technology": ("sensor", "telematics", "prescription", "monitor", "drone", "data sync", "app"),
        "policy_regulation": ("regulation", "cutoff", "label", "compliance", "deadline", "dicamba"),
        "general_agronomy": ("agronomy", "crop", "field"),
    },
    crop_keywords={
        "corn": ("corn", "maize"),
        "soybean": ("soybean", "soybeans", "bean", "beans"),
    },
    intent_keywords={
        "diagnosis": ("what is", "what does that point to", "diagnose", "suspect", "why is"),
        "recommendation": ("what should i do", "do i need to", "next move", "can i still", "fix"),
        "planning": ("should i", "tomorrow", "before next season", "timing", "window"),
        "monitoring": ("watch", "track", "monitor", "scout", "doing"),
        "information_lookup": ("current", "today", "right now", "lookup", "what is the current"),
        "comparison": ("compare", "versus", "vs", "better"),
        "question": ("what", "why", "how"),
    },
    urgent_keywords=("now", "today", "tomorrow", "urgent", "right now"),
    soon_keywords=("soon", "next", "this week"),
)

# Words the live router knows beyond the evaluation lexicon.
ROUTER_EXTRA_FLAGS: Lexicon = {
    "needs_weather_data": ("plant this week", "this week", "should i plant", "plant?"),
    "needs_rag": ("spray", "plant", "planting"),
    "needs_farm_data": ("should i spray", "sidedress"),
}
ROUTER_EXTRA_TOPICS: Lexicon = {
    "weather": ("tomorrow",),
    "nutrient": ("sidedress", "side-dress"),
    "management": ("plant",),
}
ROUTER_EXTRA_INTENTS: Lexicon = {
    "planning": ("this week",),
    "information_lookup": ("price of",),
}
ROUTER_NEGATIVE_HINTS = (
    "movie", "restaurant", "song", "flight", "hotel", "traffic", "game",
    "weather in paris",
)

ROUTER_THRESHOLDS = Thresholds(
    binary={
        "is_ag_related": 0.5,
        "needs_rag": 0.52,
        "needs_web_search": 0.5,
        "needs_weather_data": 0.5,
        "needs_farm_data": 0.5,
    },
    sets={"crops": 0.45, "topics": 0.42},
)

# Phrases that make a text "vague", and the shorter list of the older audit.
VAGUE_PHRASES = (
    "looks bad", "looks rough", "not right", "acting up", "field looks", "weird",
    "off", "something wrong", "now what", "what is this", "too wet yet",
    "spray today", "beans yellow", "crop looks", "help",
)
VAGUE_PHRASES_AUDIT = (
    "looks bad", "not right", "acting up", "field looks", "weird", "off",
    "something wrong", "help", "now what", "what is this",
)

# Flag combinations (in FLAGS_5 order) with their minimum row counts.
EDGE_COMBOS = (
    ("weather_only", (False, False, True, False, False), 20),
    ("web_only", (False, True, False, False, False), 20),
    ("farm_only", (False, False, False, True, False), 20),
    ("epa_only", (False, False, False, False, True), 0),
    ("rag_plus_weather", (True, False, True, False, False), 20),
    ("rag_plus_farm", (True, False, False, True, False), 20),
    ("web_plus_weather", (False, True, True, False, False), 20),
    ("rag_plus_epa", (True, False, False, False, True), 0),
)
AUDIT_COMBO_SPARSE = 12
AUDIT_COMBOS = tuple(
    (name, flags[:4], AUDIT_COMBO_SPARSE) for name, flags, _ in EDGE_COMBOS if not flags[4]
)

GATE_BANDS = (
    Band("non_domain_ratio", 0.25, 0.35),
    Band("lead_flag_ratio", 0.30, 0.70),
    Band("short_ratio", 0.08),
    Band("vague_ratio", 0.04),
    Band("multi_topic_ratio", 0.20),
    Band("hard_rows", 100),
)
REPORT_BANDS = (
    Band("non_domain_ratio", 0.25, 0.35),
    Band("short_ratio", 0.08),
    Band("vague_ratio", 0.04),
    Band("multi_topic_ratio", 0.20),
)
AUDIT_BANDS = (
    Band("non_domain_ratio", 0.25, 0.35, "weak", "diluting"),
    Band("lead_flag_ratio", 0.25, 0.60, "underused", "overrepresented"),
    Band("short_ratio", 0.08, None, "underrepresented"),
    Band("vague_ratio", 0.08, None, "underrepresented"),
    Band("multi_topic_ratio", 0.18, None, "underrepresented"),
)
AUDIT_TOPIC_SHARE = (0.08, 0.22)
LOW_TOPIC_FLOOR = 20
LOW_TOPIC_SHARE = 0.04
SHORT_WORDS = 5
EXPECTED_SPLITS = (("train", 2400), ("val", 400), ("test", 400))
FLAG_MODULES = {
    "needs_rag": "rag",
    "needs_web_search": "web_search",
    "needs_weather_data": "weather_api",
    "needs_farm_data": "farm_data",
}
# ---------------------------------------------------------------------------


def extend(base: Lexicon, extra: Lexicon) -> Lexicon:
    """Lexicon with extra words appended per label, label order unchanged."""
    return {label: (*words, *extra.get(label, ())) for label, words in base.items()}


AGRONOMY = replace(
    AGRONOMY_EVAL,
    flag_keywords=extend(AGRONOMY_EVAL.flag_keywords, ROUTER_EXTRA_FLAGS),
    topic_keywords=extend(AGRONOMY_EVAL.topic_keywords, ROUTER_EXTRA_TOPICS),
    intent_keywords=extend(AGRONOMY_EVAL.intent_keywords, ROUTER_EXTRA_INTENTS),
    negative_hints=ROUTER_NEGATIVE_HINTS,
)
