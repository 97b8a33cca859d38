"""The control plane's output for one question: term groups, concepts and lists that the data plane matches against papers."""

from __future__ import annotations

from dataclasses import dataclass, field

from quillscreen.functions.text import py_domain_text, unique

#: Spellings that a group gains when one of the cues occurs in its name or terms.
OXYGEN = ("OER", "oxygen evolution reaction", "oxygen evolution", "water oxidation")
INTERPHASE = ("SEI", "solid electrolyte interphase", "solid-electrolyte interphase", "solid electrolyte interface", "solid-electrolyte interface")
LITHIUM = ("lithium-ion battery", "lithium ion battery", "li-ion battery", "li ion battery", "lithium battery", "lithium metal", "lithium-metal", "graphite anode", "silicon anode")
SPIN = (
    "spin state", "spin-state", "spin transition", "spin-state transition", "low-spin", "low spin", "high-spin", "high spin", "electronic spin state", "spin density",
    "spin polarization", "spin modulation", "spin-selective", "electronic structure", "orbital occupancy", "eg occupancy", "e g occupancy", "metal-oxygen covalency",
    "metal oxygen covalency", "co 3d-o 2p covalency", "co 3d o 2p covalency", "3d-o 2p covalency", "3d o 2p covalency", "covalency",
)
CATALYST = (
    "transition metal oxide", "oxide catalyst", "electrocatalyst", "catalyst", "oxyhydroxide", "perovskite", "cobalt oxide", "NiOOH", "CoOOH", "LaCoO3", "LaCoO 3", "MnOOH",
    "cobaltite", "single-atom catalyst", "single atom catalyst",
)
CUES = (
    (("sei", "solid electrolyte interphase"), INTERPHASE),
    (("lithium", "li-ion"), LITHIUM),
    (("spin", "electronic", "covalency", "orbital"), SPIN),
    (("catalyst", "oxide", "material", "transition metal"), CATALYST),
)
#: Context of a lithium question, and what lies beside it.
TARGET_CONTEXT = ("lithium-ion battery", "lithium ion battery", "li-ion battery", "li ion battery", "lithium battery", "lithium", "lithium metal", "lithium-metal", "lithium metal battery", "lithium metal anode", "graphite anode", "silicon anode")
BESIDE_CONTEXT = (
    "beyond lithium-ion", "beyond lithium ion", "aqueous zinc-ion", "aqueous zinc ion", "azib", "azibs", "zinc-ion battery", "zinc ion battery", "zinc-based battery",
    "zinc based battery", "zinc battery", "zn-ion battery", "zn based battery", "zn-based battery", "zn battery", "sodium-ion battery", "sodium ion battery", "sodium battery",
    "na-ion battery", "potassium-ion battery", "potassium ion battery", "potassium battery", "k-ion battery", "magnesium-ion battery", "magnesium ion battery", "magnesium battery",
    "mg-ion battery",
)
#: Names of other chemistries, element symbols, and elements that count as concepts.
DRIFT = (
    "sodium", "potassium", "zinc", "zn", "azib", "azibs", "magnesium", "beyond lithium-ion", "beyond lithium ion", "aqueous zinc-ion", "aqueous zinc ion", "sodium-ion battery",
    "sodium ion battery", "potassium-ion battery", "potassium ion battery", "zinc-ion battery", "zinc ion battery", "zinc-based battery", "zinc based battery", "zinc battery",
    "magnesium-ion battery", "magnesium ion battery", "magnesium battery", "na-ion battery", "k-ion battery", "zn-ion battery", "zn-based battery", "zn based battery", "zn battery",
    "mg-ion battery", "mg battery", "sodium battery", "potassium battery",
)
SYMBOLS = ("zn", "na", "k", "mg")
ELEMENTS = ("sodium", "potassium", "zinc", "magnesium", "azib", "azibs")


@dataclass(frozen=True)
class Group:
    """Any of ``terms`` satisfies the group."""

    name: str
    terms: tuple[str, ...]
    required: bool = True

    def expanded(self) -> tuple[str, ...]:
        """The terms with the spellings that their cues add: 12 own terms at most, 36 with the additions."""
        own = unique(list(self.terms), 12)
        cue = py_domain_text(" ".join([self.name, *own]))
        if any(c in cue for c in ("oer", "oxygen evolution", "water oxidation")):
            return tuple(unique([*own, *OXYGEN], 36))
        if "context" in self.name.lower() and any(c in cue for c in ("lithium", "li-ion", "li ion")):
            return LITHIUM
        return tuple(unique([*own, *(t for cues, extra in CUES if any(c in cue for c in cues) for t in extra)], 36))


@dataclass(frozen=True)
class Contract:
    """What a question requires, welcomes and rules out."""

    question: str
    domain: str = "general_science"
    groups: tuple[Group, ...] = ()
    must_include: tuple[str, ...] = ()
    must_exclude: tuple[str, ...] = ()
    required_concepts: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    aspects: tuple[str, ...] = ()
    must_terms: tuple[str, ...] = ()
    core_terms: tuple[str, ...] = ()
    optional_terms: tuple[str, ...] = ()
    must_term_groups: tuple[tuple[str, ...], ...] = ()
    seed_titles: tuple[str, ...] = ()
    question_id: str = "q1"
    weights: dict[str, float] = field(default_factory=dict)

    def required_groups(self) -> list[tuple[str, tuple[str, ...]]]:
        own = [g for g in self.groups if g.required and g.terms and g.name not in ("must_concepts", "optional_high_confidence")]
        planned = [Group(f"query_plan_group_{i}", terms) for i, terms in enumerate(self.must_term_groups, 1) if terms]
        return [(g.name, g.expanded()) for g in [*own, *planned]]

    def optional_groups(self) -> list[tuple[str, tuple[str, ...]]]:
        return [(g.name, g.expanded()) for g in self.groups if not g.required and g.terms and g.name != "negative_context_group"]

    def terms_of(self, name: str) -> list[str]:
        return unique([t for g in self.groups if g.name == name for t in g.terms], 24)

    def wants_lithium(self) -> bool:
        return any(c in py_domain_text(" ".join(g.terms)) for g in self.groups if g.required for c in ("lithium", "li-ion"))
