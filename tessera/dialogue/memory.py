"""What a session remembers between turns, and the fixed question order. A memory is JSON in tables."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from ..functions.constraints import QUESTION_ORDER
from ..functions.lexicons import plain
from .grammar import parse
from .state import State, apply, terms, structured_query

# The language that changes a request, drops all of it, declines, rejects, and ends the first request.
CHANGES = re.compile(r"\b(?:actually|instead|ignore\s+(?:my\s+)?earlier|changed?\s+my\s+mind|what\s+i\s+need)\b", re.I)
DROPS_ALL = re.compile(r"\b(?:ignore\s+(?:my\s+)?earlier\s+preference|forget\s+(?:my\s+)?earlier|changed?\s+my\s+mind)\b", re.I)
DECLINES = re.compile(r"\b(?:no|don['’]?t\s+have|without)\b.{0,30}\bpreference\b", re.I)
REJECTS = re.compile(r"\b(?:not quite right|ask me about)\b", re.I)
DETAILS = re.compile(r"\bA key requirement is:\s*|,\s*but\b|\.\s+", re.I)
SHOPPING = re.compile(r"\b(?:looking for|shopping for|need|want)\b", re.I)
# Nouns of product categories, and the words that mention an attribute.
NOUNS = re.compile(
    r"\b(shoes?|boots?|sneakers?|sandals?|slippers?|dress(?:es)?|shirts?|tops?|tees?|pants?|jeans?|shorts?|skirts?|jackets?|coats?|sweaters?|hoodies?"
    r"|socks?|underwear|bras?|swimwear|jewelry|earrings?|necklaces?|bracelets?|rings?|watches?|bags?|hats?)\b", re.I
)
MENTIONED = {
    "material": r"\b(cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric|linen|denim)\b",
    "color": r"\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange|beige)\b",
    "size": r"\b(size|sizing|width|wide|narrow|small|medium|large|xl|xxl)\b",
    "style": r"\b(style|fit|fitted|loose|sleeve|neck|casual|formal|vintage)\b",
    "brand": r"\b(brand|made by|manufacturer)\b",
    "budget": r"(?:\$\s*\d|\b(?:budget|under|below|less than|up to)\s+\$?\d)",
    "use_case": r"\b(hiking|running|walking|gym|winter|summer|outdoor|work|wedding|travel|sports?)\b",
}
# The questions.
QUESTIONS = {
    "category": "What type of product are you looking for?", "material": "Do you have a preferred material?",
    "feature": "Which product feature matters most to you?", "color": "Do you have a color preference?",
    "style": "What style or fit would you prefer?", "size": "Do you have a size or width requirement?",
    "use_case": "What occasion or use case is this for?", "budget": "What budget range should I use?",
    "brand": "Do you have a preferred brand?", "other": "Is there one other must-have requirement I should prioritize?",
}
NO_QUESTION = "Here are the best matches based on your current preferences."
BROAD = "I found a broad set of possible matches. "
LAST_TURN = 10


def first_request(message: str) -> str:
    """The product asked for, without the details that follow it."""
    return DETAILS.split(message, 1)[0].strip()


def mentioned(text: str) -> list[str]:
    return [a for a, p in MENTIONED.items() if re.search(p, text, re.I)]


@dataclass
class Memory:
    """One session. ``dry``: turns since a message last changed the constraints; ``override``: the last message changed
    the request."""

    profile: dict = field(default_factory=dict)
    base_request: str = ""
    messages: list = field(default_factory=list)
    state: State = field(default_factory=State)
    last_asked: str | None = None
    dry: int = 0
    other_used: bool = False
    override: bool = False

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str | None) -> Memory:
        d = json.loads(text) if text else {}
        return cls(**{**d, "state": State.from_dict(d.get("state", {}))})

    def hear(self, message: str, turn: int) -> None:
        """Take a customer's message in."""
        known = self.state.constraints()
        if turn == 1 or not self.base_request:
            self.base_request = first_request(message)
        before, said = self.state, list(self.messages)
        everything = turn > 1 and bool(DROPS_ALL.search(message))
        if everything:
            self.state = State(category=before.category, turn=before.turn)
            self.last_asked, self.dry, self.other_used = None, 0, False
        self.state = apply(self.state, parse(message, self.state, turn))
        self.override = turn > 1 and bool(CHANGES.search(message))
        if DECLINES.search(message) or REJECTS.search(message):  # nothing to search for
            if self.last_asked and self.last_asked not in self.state.no_preference:
                self.state.no_preference.append(self.last_asked)
            self.dry += 1
            return
        if self.override:
            self._changed(message, before, said, everything)
        else:
            self.messages.append(message)
        self.dry = 0 if turn == 1 or self.state.constraints() != known else self.dry + 1

    def _changed(self, message: str, before: State, said: list[str], everything: bool) -> None:
        old, new = ({w.lower() for w in NOUNS.findall(t)} for t in (self.base_request, message))
        if old and new and not old & new:
            self.base_request = first_request(message)
            self.messages = [message]
        else:
            still = _kept_details(before, self.state) if everything else []
            kept = [m for m in said if m != self.base_request and any(_names(m, v) for v in still)]
            both = [self.base_request, *kept, message]
            self.messages = list(dict.fromkeys(both)) if everything else both
        self.state.asked_attributes.clear()
        self.state.no_preference.clear()
        self.last_asked, self.other_used = None, False

    def context(self) -> str:
        return " ".join(self.messages).strip()

    def legacy_query(self) -> str:
        """What the baseline searches for: what was said, or else the constraints."""
        return self.context() or structured_query(self.state, False)

    def ask(self, turn: int, broad: bool = False) -> tuple[str, str | None]:
        """(message, attribute) of the next question by the fixed order; remembers it."""
        closed = {*self.state.asked_attributes, *self.state.no_preference, *(a for a in mentioned(" ".join(self.messages)) if a != "feature")}
        return self.asks(next((a for a in QUESTION_ORDER if a not in closed), None) if turn < LAST_TURN else None, broad, False)

    def asks(self, attribute: str | None, broad: bool = False, other: bool = True) -> tuple[str, str | None]:
        """Ask about ``attribute``; ``other``: a question about anything else counts as used."""
        self.last_asked = attribute
        if attribute is None:
            return NO_QUESTION, None
        if attribute not in self.state.asked_attributes:
            self.state.asked_attributes.append(attribute)
        self.other_used = self.other_used or (other and attribute == "other")
        return (BROAD if broad else "") + QUESTIONS[attribute], attribute

    def request(self, message: str) -> dict:
        """The columns of a search request."""
        s = self.state
        average = self.profile.get("average_prior_rating")
        return {
            "current_message": message, "raw_context": self.context(), "base_request": self.base_request, "structured_query": structured_query(s),
            "category": s.category, "hard": terms(s.hard_constraints), "soft": terms(s.soft_preferences), "excluded": terms(s.excluded),
            "override": self.override, "tags": [str(t) for t in self.profile.get("preference_tags", [])], "average_prior_rating": None if average is None else float(average),
            "blocked": [*s.asked_attributes, *s.no_preference], "dry": self.dry, "other_used": self.other_used,
            "evidence": bool(s.category or SHOPPING.search(self.base_request)), "legacy_query": self.legacy_query(),
        }


def _group(s: State, name: str) -> list[str]:
    return [str(v) for g in (s.hard_constraints, s.soft_preferences) if name in g for v in (g[name] if isinstance(g[name], list) else [g[name]])]


def _kept_details(before: State, now: State) -> list[str]:
    """After a request that drops all: of fields with a value named before and now, the older values stay as soft ones.
    Returns the values that confirm them."""
    confirmed: list[str] = []
    for name in sorted({*now.hard_constraints, *now.soft_preferences} - {"price_min", "price_max"}):
        new, old = _group(now, name), _group(before, name)
        if {plain(v) for v in new} & {plain(v) for v in old}:
            confirmed += new
            if extra := [v for v in old if v not in new]:
                kept = now.soft_preferences.setdefault(name, [])
                kept += [v for v in extra if v not in kept]
    return list(dict.fromkeys(confirmed))


def _names(message: str, value: str) -> bool:
    words = plain(value)
    return bool(words) and bool(re.search(rf"(?<![a-z0-9]){re.escape(words)}(?![a-z0-9])", plain(message)))
