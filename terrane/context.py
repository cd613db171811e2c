"""What one conversation gets from the documents: active and parked areas, and numbered passages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .operators.resolve import RULES


@dataclass(frozen=True)
class Context:
    """active and parked: id, label, authority, score, reasons; passages: n, doc, section, text, domain_id, via."""

    active: list[dict] = field(default_factory=list)
    parked: list[dict] = field(default_factory=list)
    passages: list[dict] = field(default_factory=list)

    @property
    def ask_areas(self) -> list[dict]:
        return [a for a in self.active if a["authority"] == "ask"]

    def without(self, area: str) -> Context:
        """The context after the user refuses an area; the other passages keep their numbers."""
        return replace(self, active=[a for a in self.active if a["id"] != area], passages=[p for p in self.passages if p["domain_id"] != area])

    def to_dict(self) -> dict:
        return {
            "active_domains": [{"id": a["id"], "label": a["label"], "authority": a["authority"], "score": round(a["score"], 3), "why": a["reasons"]} for a in self.active],
            "parked_domains": [{"id": a["id"], "label": a["label"]} for a in self.parked],
            "passages": [{"n": p["n"], "doc": p["doc"], "section": p["section"], "domain": p["domain_id"], "via": p["via"], "text": p["text"]} for p in self.passages],
        }

    def rules(self) -> str:
        lines = [f"- {a['label']}: {RULES.get(a['authority'], RULES['project'])}" for a in self.active]
        return "\n".join(lines + [f"- {a['label']}: {RULES['parked']}" for a in self.parked])

    def render(self) -> str:
        """Markdown for a model or a reader."""
        if not (self.active or self.passages):
            return "No area of the documents seems relevant here; answer from general knowledge.\n"
        parts = ["# Context from the documents"]
        if self.active:
            parts.append("## Relevant areas\n" + "\n".join(f"- **{a['label']}** [{a['authority']}]: {'; '.join(a['reasons']) or 'related content'}" for a in self.active))
        if self.rules():
            parts.append("## How to treat them\n" + self.rules())
        if self.passages:
            parts.append("## Passages\n" + "\n\n".join(f"[{p['n']}] {source_name(p)}{'' if p['via'] == 'question' else ' (found by its area, not by the wording)'}\n{p['text']}" for p in self.passages))
        parts.append("Cite passages as [n]; pass over those that turn out not to matter. Name any area above that could matter but went unused.")
        return "\n\n".join(parts) + "\n"


def source_name(passage: dict) -> str:
    return passage["doc"] + (f" > {passage['section']}" if passage["section"] else "")
