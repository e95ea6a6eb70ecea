"""State patches, message grammar, session memory, simulated customers: plain Python."""

import pytest

from tessera.dialogue import customer as C
from tessera.dialogue.grammar import mentions, parse
from tessera.dialogue.memory import NO_QUESTION, Memory, first_request, mentioned
from tessera.dialogue.state import Op, Patch, State, apply, structured_query, terms
from tessera.functions.lexicons import canonical


def after(message, turn=2, **state):
    before = State.from_dict(state)
    return apply(before, parse(message, before, turn)).to_dict(False)


def ops(message, turn=2, **state):
    return [(o.op, o.field, o.value, o.strength) for o in parse(message, State.from_dict(state), turn).operations]


@pytest.mark.parametrize(
    "message, state, want",
    [
        ("Some sneakers for men, please", {}, {"category": "sneakers", "hard_constraints": {"audience": ["men"]}}),
        ("Navy blue would be nice", {}, {"soft_preferences": {"color": ["navy"]}}),
        ("It must be wool", {"soft_preferences": {"material": ["wool"]}}, {"hard_constraints": {"material": ["wool"]}}),
        ("Anything but green", {"soft_preferences": {"color": ["green", "red"]}}, {"soft_preferences": {"color": ["red"]}, "excluded": {"color": ["green"]}}),
        ("Green is fine now", {"excluded": {"color": ["green"]}}, {}),
        ("Red instead of pink", {"soft_preferences": {"color": ["pink"]}}, {"soft_preferences": {"color": ["red"]}}),
        ("I no longer want denim", {"soft_preferences": {"material": ["denim", "silk"]}}, {"soft_preferences": {"material": ["silk"]}}),
        ("between $20 and 35.50", {}, {"hard_constraints": {"price_min": 20, "price_max": 35.5}}),
        ("now at least 80", {"hard_constraints": {"price_max": 50}}, {"hard_constraints": {"price_min": 80}}),
        ("raise my budget to 90", {"hard_constraints": {"price_max": 50}}, {"hard_constraints": {"price_max": 90}}),
        ("the budget is flexible", {"hard_constraints": {"price_max": 50, "price_min": 5}}, {"no_preference": ["budget"]}),
        ("I don't care about the color", {"soft_preferences": {"color": ["red"]}}, {"no_preference": ["color"]}),
        ("Boots, actually", {"category": "sandals", "soft_preferences": {"color": ["red"]}}, {"category": "boots"}),
        ("size 9 wide in a classic style", {}, {"hard_constraints": {"size": ["9 WIDE"]}, "soft_preferences": {"style": ["classic"]}}),
        ("make that Acme & Co", {"soft_preferences": {"brand": ["other"]}}, {"soft_preferences": {"brand": ["acme & co"]}}),
        ("I'd prefer acme sneakers", {}, {"category": "sneakers", "soft_preferences": {"brand": ["acme"]}}),
        ("warm, for work", {}, {"soft_preferences": {"feature": ["warm"], "use_case": ["work"]}}),
        ("work work work", {}, {}),
        ("running shoes", {}, {"category": "running_shoes"}),
        ("Let's start over", {"category": "boots", "excluded": {"color": ["red"]}, "asked_attributes": ["color"]}, {}),
        ("", {"category": "boots"}, {"category": "boots"}),
        ("faux-leather", {}, {"soft_preferences": {"material": ["faux_leather"]}}),
    ],
)
def test_messages(message, state, want):
    assert after(message, **state) == {"schema_version": "0.1.0", "turn": 2, **want}


def test_operations_and_evidence():
    assert ops("no leather, no leather") == [("exclude", "material", "leather", None)]
    assert ops("now for women", hard_constraints={"audience": ["men"]}) == [("replace", "audience", "women", "hard")]
    assert [(m.alias, m.value) for m in mentions("winter boots and boot", "category")] == [("winter boots", "winter_boots"), ("boot", "boots")]
    patch = parse("under $40", State(), 3)
    assert Patch.from_dict(patch.to_dict()) == patch and patch.operations[0].evidence == "under $40"


def test_what_states_and_operations_refuse():
    for bad in (lambda: Op("exclude", "category", "x"), lambda: Op("add", "shape", "x"), lambda: Op("set", "color"), lambda: Op("set", "color", "x", "firm"), lambda: Op("set", "color", "x", confidence=2),
                lambda: Patch((), 0), lambda: State.from_dict({"hard_constraints": {"shape": ["x"]}}), lambda: State.from_dict({"excluded": {"price_max": [3]}}), lambda: State.from_dict({"no_preference": ["price"]}),
                lambda: apply(State(), Patch((Op("add", "price_max", 3),), 1)), lambda: canonical("price_max", True), lambda: canonical("price_min", -1), lambda: canonical("shape", "x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        parse(None, State(), 1)
    before = State.from_dict({"soft_preferences": {"color": ["grey", "Gray"]}})
    assert before.soft_preferences == {"color": ["gray"]}
    gone = apply(before, Patch((Op("clear", "color"),), 1))
    assert not gone.soft_preferences and before.soft_preferences and terms({"b": 1, "a": ["x"]}) == [{"field": "a", "values": ["x"]}, {"field": "b", "values": ["1"]}]
    assert structured_query(State(category="winter_boots", soft_preferences={"color": ["red"]}, excluded={"color": ["pink"]})) == "winter boots red"


def test_memory():
    m = Memory()
    m.hear("I'm looking for boots, but something light.", 1)
    assert m.base_request == "I'm looking for boots" == first_request("I'm looking for boots. A key requirement is: wool") and m.dry == 0
    assert m.ask(1) == ("Do you have a preferred material?", "material") and m.ask(1, True)[0].startswith("I found a broad set")
    m.hear("I don't have a preference for that", 2)
    assert m.dry == 1 and m.last_asked in m.state.no_preference and len(m.messages) == 1
    m.hear("wool, and water-resistant", 3)
    assert m.dry == 0 and m.state.soft_preferences == {"material": ["wool"], "feature": ["water_resistant"]}
    m.hear("Actually, ignore my earlier preference. What I need is wool.", 4)
    assert m.override and m.state.category == "boots" and m.state.hard_constraints == {"material": ["wool"]}
    assert m.messages == ["I'm looking for boots", "wool, and water-resistant", "Actually, ignore my earlier preference. What I need is wool."]
    m.hear("Actually, sandals instead", 5)
    assert m.messages == ["Actually, sandals instead"] and m.base_request == "Actually, sandals instead"
    assert m.ask(10) == (NO_QUESTION, None) and Memory.loads(m.dumps()) == m
    assert mentioned("a red one under $5, size M") == ["color", "size", "budget"]


PRODUCT = {"title": "Trail boot", "features": ["Grey wool lining", ""], "details": {"Color": "Gray", "Weight": ""}, "price": 80.5, "categories": ["Clothing, Shoes & Jewelry", "Women, Boots"]}


def test_customer():
    assert C.sourced_card(PRODUCT)["hard_constraints"] == [{"value": "wool", "source": "material_regex:features"}, {"value": "color: grey", "source": "color_regex:features"}]
    assert C.intent_card({})["hard_constraints"] == ["product"] == C.intent_card({})["soft_preferences"] and C.sourced_card({})["hard_constraints"][0]["source"] == "title_fallback"
    assert C.coarse_category(PRODUCT["categories"]) == "Women Boots" and C.coarse_category([]) == "clothing item"
    buyer = C.Customer.of({"sample_id": "a", "scenario_type": "buying"}, PRODUCT)
    assert buyer.begin() == "I'm looking for Women Boots. A key requirement is: wool."
    assert buyer.answer(1, "color") == "For that, what matters is: color: grey; Color: Gray." and buyer.answer(2, "color") == "I don't have an additional preference for color."
    assert buyer.answer(3, None).startswith("Those options") and C.Customer.loads(buyer.dumps()) == buyer and buyer.answer(4, "shape") == "For that, what matters is: Grey wool lining."
    shy = C.Customer.of({"sample_id": "a", "scenario_type": "boundary"}, PRODUCT)
    assert shy.begin().endswith("still exploring.") and shy.answer(1, "size").startswith("I don't have a preference for size") and "additional" in shy.answer(2, "size")
    turns = {C.behavior(f"s{i}", "intent_override", C.intent_card(PRODUCT))["override"]["turn"] for i in range(20)}
    fickle = C.Customer.of({"sample_id": "s", "scenario_type": "intent_override"}, PRODUCT)
    turn = fickle.change["turn"]
    assert turns == {3, 4} and not fickle.changed and fickle.answer(turn - 1, "color") == "Actually, ignore my earlier preference. What I need is: wool." and fickle.changed
