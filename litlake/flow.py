"""Which stages of a survey run and how, and the settings that filters and thresholds are made from."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from .operators.filters import ArticleFilter
from .operators.summaries import percent_to_threshold

#: The stages in the order in which they run, those that work on records alone, and other names of stages.
STAGES = ("discovery", "enrichment", "classification", "stats", "visualization", "pdf_download", "reference_analysis", "agent_input", "paper_agents", "domain_synthesis", "final_report")
CORE = ("discovery", "enrichment", "classification", "stats", "visualization", "reference_analysis")
ALIASES = {
    "discovery": ("download", "metadata", "metadata_pipeline", "discover"), "enrichment": ("enrich",), "classification": ("classify",), "visualization": ("visualize",), "reference_analysis": ("references",),
    "pdf_download": ("pdf", "pdfs", "download_pdfs"), "paper_agents": ("agents", "paper_reader_agent"), "domain_synthesis": ("domain_synthesizer_agent", "domain_agents"), "final_report": ("report",),
}


def stage_name(text: str, allowed: Iterable[str] = STAGES) -> str:
    """A stage by its name or an alias, hyphens as underscores; others are an error."""
    plain = text.strip().replace("-", "_")
    found = next((stage for stage, names in ALIASES.items() if plain in names), plain)
    if found not in set(allowed):
        raise ValueError(f"unsupported stage: {text}")
    return found


@dataclass(frozen=True)
class Plan:
    """Stages that are switched off, and modes of stages; what isn't said is on and "default"."""

    off: frozenset[str] = frozenset()
    modes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, disabled: Sequence[str] = (), modes: Sequence[str] = (), allowed: Iterable[str] = STAGES) -> Plan:
        """From names and "stage=mode" pairs, as a command line or a request gives them."""
        chosen = {}
        for pair in modes:
            stage, sign, mode = pair.partition("=")
            if not sign or not mode.strip():
                raise ValueError(f"not stage=mode: {pair}")
            chosen[stage_name(stage, allowed)] = mode.strip()
        return cls(frozenset(stage_name(s, allowed) for s in disabled), chosen)

    def runs(self, stage: str, default: bool = True) -> bool:
        """A stage with a mode is on unless it is switched off."""
        return stage not in self.off and (default or stage in self.modes)

    def mode(self, stage: str, default: str = "default") -> str:
        return self.modes.get(stage, default)

    def rows(self) -> list[tuple[str, bool, str]]:
        """(stage, runs, mode) of every stage that something is said about, by name."""
        return [(s, self.runs(s), self.mode(s)) for s in sorted({*self.off, *self.modes})]


def article_filter(keywords: str = "", article_types: str = "", authors: str = "", institutions: str = "", min_citations: int | None = None, year: int | None = None, from_year: int | None = None, to_year: int | None = None) -> ArticleFilter:
    """From lists as a command line gives them, separated by commas."""
    split = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    return ArticleFilter(split(keywords), split(article_types), min_citations, year, from_year, to_year, split(authors), split(institutions))


def reference_limits(percent: float | None = None, most: int | None = None) -> tuple[float, int | None]:
    """(threshold, most records); a number of records has to be positive."""
    if most is not None and most < 1:
        raise ValueError("at least one record")
    return percent_to_threshold(percent), most
