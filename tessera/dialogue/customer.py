"""The simulated customer: what a session's customer wants (the intent card), says first, and answers."""

from __future__ import annotations

import json
import random
import re
from dataclasses import asdict, dataclass, field

from ..functions.constraints import BUDGET, KINDS, ROOTS
from ..functions.lexicons import ATTRIBUTES

# Fields whose text names materials and colors, and the words that it is searched for.
FIELDS = ["title", "features", "details", "description", "categories", "store"]
MATERIAL = re.compile(r"\b(cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric)\b", re.I)
COLOR = re.compile(r"\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange)\b", re.I)
LIMIT = 180


def flat(value: object, sign: str = " ") -> list[str]:
    """The texts of a field: ``key value`` of a map, items of a list, a text itself; nothing of null."""
    if isinstance(value, dict):
        return [f"{k}{sign}{v}" for k, v in value.items()]
    return [str(v) for v in value] if isinstance(value, list) else [] if value is None else [str(value)]


def _stated(value: object) -> list[str]:
    empty = (None, "", [])
    if isinstance(value, dict):
        return flat({k: v for k, v in value.items() if v not in empty}, ": ")
    return flat([v for v in value if v not in empty[:2]]) if isinstance(value, list) else [] if value in empty[:2] else [str(value)]


def searchable(product: dict) -> str:
    return " ".join(t for f in FIELDS for t in flat(product.get(f))).strip()


def tidy(text: str, limit: int = LIMIT) -> str:
    return re.sub(r"\s+", " ", text).strip(" -;,.\t\n")[:limit].rstrip()


def coarse_category(path: list[str]) -> str:
    parts = [p for v in path for p in map(str.strip, str(v).split(",")) if p and p.lower() not in ROOTS]
    return " ".join(parts[-2:]) if parts else "clothing item"


def kind(text: str) -> str:
    low = text.lower()
    if re.search(BUDGET, low):
        return "budget"
    return next((k for k, words in KINDS if any(w in low for w in words.split())), "feature")


def sourced_card(product: dict, limit: int = LIMIT) -> dict:
    """What a customer for ``product`` wants, each wish with the field that it comes from."""
    wishes = [(t, f) for f in ("features", "details") for t in _stated(product.get(f))]
    text = searchable(product)
    for place, name, pattern, form in ((0, "material", MATERIAL, "{}"), (1, "color", COLOR, "color: {}")):
        if m := pattern.search(text):
            origin = next((f for f in FIELDS if pattern.search(" ".join(flat(product.get(f))))), "unknown")
            wishes.insert(place, (form.format(m[1].lower()), f"{name}_regex:{origin}"))
    if product.get("price") not in (None, ""):
        wishes.append((f"budget around ${product['price']}", "price"))
    title = tidy(str(product.get("title") or "product"), limit)
    first: dict[str, str] = {}
    for text, source in wishes:
        if (short := tidy(text, limit)) and short not in first:
            first[short] = source
    chosen = [{"value": v, "source": s} for v, s in first.items()][:4] or [{"value": title, "source": "title_fallback"}]
    return {"target_category": title, "hard_constraints": chosen[:2], "soft_preferences": chosen[2:] or chosen[:1]}


def intent_card(product: dict, limit: int = LIMIT) -> dict:
    card = sourced_card(product, limit)
    return card | {k: [w["value"] for w in card[k]] for k in ("hard_constraints", "soft_preferences")}


def behavior(sample_id: str, scenario: str, card: dict) -> dict:
    """How the customer acts; the turn of an override is drawn from the sample's own seed."""
    out: dict = {"scenario_type": scenario}
    if scenario == "intent_override":
        new = card["hard_constraints"][0] if card["hard_constraints"] else "Please prioritize the target requirements."
        old = card["soft_preferences"][-1] if card["soft_preferences"] else "I prefer a different style."
        turn = random.Random(f"{sample_id}\0{scenario}").choice([3, 4])
        out["override"] = {"turn": turn, "old_value": old, "new_value": new, "message": f"Actually, ignore my earlier preference. What I need is: {new}."}
    return out


def hidden(sample: dict, product: dict) -> tuple[dict, dict]:
    """(intent card, behavior) of a sample: its own, or made from its target."""
    if "intent_card" in sample and "behavior" in sample:
        return sample["intent_card"], sample["behavior"]
    card = intent_card(product)
    return card, behavior(str(sample.get("sample_id", "")), str(sample["scenario_type"]), card)


@dataclass
class Customer:
    scenario: str
    category: str
    hard: list
    soft: list
    change: dict = field(default_factory=dict)
    told: list = field(default_factory=list)
    declined: bool = False
    changed: bool = False

    @classmethod
    def of(cls, sample: dict, product: dict) -> Customer:
        card, acts = hidden(sample, product)
        wishes = [[str(v) for v in card.get(k, [])] for k in ("hard_constraints", "soft_preferences")]
        scenario = str(sample["scenario_type"])
        return cls(scenario, coarse_category(product.get("categories") or []), *wishes, acts.get("override") or {}, changed=scenario != "intent_override")

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Customer:
        return cls(**json.loads(text))

    def begin(self) -> str:
        if self.scenario == "buying" and self.hard:
            self.told.append(self.hard[0])
            return f"I'm looking for {self.category}. A key requirement is: {self.hard[0]}."
        if self.scenario == "intent_override":
            return f"I'm looking for {self.category}. {self.change['old_value']}"
        return f"I'm looking for {self.category}, but I'm still exploring."

    def oracle(self) -> str:
        """Everything the customer wants, at once."""
        return " ".join([self.category, *self.hard, *self.soft])

    def answer(self, turn: int, asked: object) -> str:
        """What is said after turn ``turn``, in which ``asked`` was the question's attribute."""
        if not self.changed and turn + 1 == int(self.change.get("turn", 3)):
            self.changed = True
            if new := str(self.change.get("new_value", "")):
                self.told.append(new)
            return str(self.change.get("message", "Actually, please ignore my earlier preference."))
        if not isinstance(asked, str) or not asked:
            return "Those options are not quite right yet. Ask me about one specific attribute."
        if self.scenario == "boundary" and not self.declined:
            self.declined = True
            return f"I don't have a preference for {asked}; please use your judgment."
        about = asked if asked in ATTRIBUTES else "other"
        open_ = [w for w in (*self.hard, *self.soft) if w not in self.told and (about == "other" or kind(w) == about)][:2]
        if not open_:
            return f"I don't have an additional preference for {about}."
        self.told += open_
        return "For that, what matters is: " + "; ".join(open_) + "."
