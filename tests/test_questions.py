"""What the parser takes from a sentence."""

import pytest

from skeinframe.plans.questions import parse

NATIONS = ["Scotland", "Ireland", "Northern Ireland", "Wales"]


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("How many inhabited lake islands are there in Northern Ireland?", {"intent": "count", "nation": "Northern Ireland", "type": "lake", "inhabited": True}),
        ("Give me 3 largest sea islands in Ireland", {"intent": "superlative", "sort": "area", "limit": 3, "nation": "Ireland", "type": "sea"}),
        ("total population of Wales", {"intent": "total", "measure": "population", "nation": "Wales"}),
        ("Mull vs Iona", {"intent": "compare", "names": ("mull", "iona")}),
        ("uninhabited islands over 2.5 km2 within 30 km of Oban", {"intent": "search", "inhabited": False, "min_area": 2.5, "near": (56.4, -5.5, 30.0)}),
        ("islands with puffins", {"intent": "search", "tokens": ("puffins",)}),
        ("count islands by type", {"intent": "count", "group_by": "type"}),
    ],
)
def test_parse(sentence, want):
    q = parse(sentence, NATIONS, {"Oban": (56.4, -5.5)})
    got = {k: getattr(q.facets, k) if k in ("nation", "type", "inhabited", "min_area", "near") else getattr(q, k) for k in want}
    assert got == want
