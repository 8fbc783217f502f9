import pytest

from rankloom.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train()


@pytest.mark.parametrize(
    "kind, form, text",
    [
        ("card", "4111.1111.1111.1111", "paid with {} today"),
        ("card", "4111  1111  1111  1111", "card {} was used"),
        ("ip", "192 . 168 . 1 . 20", "server {} is down"),
        ("ip", "192. 168. 1. 20", "host {} replied"),
    ],
)
def test_cards_and_addresses_in_other_forms(field, kind, form, text):
    at = text.index("{}")
    assert pii.find([text.format(form)], field) == [([], [(kind, at, at + len(form))])]


@pytest.mark.parametrize("text", ["paid with 4111.1111.1111.1112 today", "server 192 . 168 . 1 . 700 is down"])
def test_forms_that_do_not_hold(field, text):
    assert not {"ip", "card"} & {kind for kind, *_ in pii.find([text], field)[0][1]}
