import pytest

from postlane.functions.query_syntax import field_boosts, minimum_should_match


@pytest.mark.parametrize(
    ("spec", "wanted"),
    [("50%", 5), ("150%", 10), ("-50%", 5), ("3", 3), ("-3", 7), ("15", 10), ("5<70%", 7), ("15<70%", 10), ("3<50% 5<30%", 3), ("2<2 5<3 7<40%", 4), ("2 < 2 5 < 3", 3), (None, 1), (4, 4), ("-12", 0)],
)
def test_minimum_should_match(spec, wanted):
    assert minimum_should_match(10, spec) == wanted


@pytest.mark.parametrize("spec", ["five%", "five", "5<", "", "3<x", "4<5 6"])
def test_unreadable_specs_are_errors(spec):
    with pytest.raises(ValueError):
        minimum_should_match(10, spec)


def test_field_boosts():
    assert field_boosts(["title^2", "body"]) == {"title": 2.0, "body": None}
    assert field_boosts("body^0.5") == {"body": 0.5}
    assert field_boosts(None) == {}
