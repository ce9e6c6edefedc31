import pytest
from hypothesis import given, settings, strategies as st

from lacquer.functions import policy as P
from lacquer.functions.names import candidates, canonical


def masks():
    return P.standard().masks


@pytest.mark.parametrize(
    ("mask", "value", "expected"),
    [
        (P.Mask.fixed("****"), "secret-token", "****"), (P.Mask.fixed("****"), "", ""),
        (P.Mask.preserve_edges(2, 2, "****", 4), "abcd", "****"), (P.Mask.preserve_edges(1, 1, "****", 2), "密钥值", "密****值"),
        (P.Mask.preserve_edges(1, 0, "****", 0), "密钥值", "密****"), (P.Mask.preserve_suffix(4, "****", 4), "1234567890", "****7890"),
        (P.Mask.preserve_suffix(4, "****", 4), "abcd", "****"), (P.Mask.preserve_suffix(0, "****", 0), "密钥值", "****"), (P.Mask.empty(), "x", ""),
    ],
)
def test_masks(mask, value, expected):
    assert mask.mask(value) == expected


def test_default_masks():
    assert [m.mask("abcdefgh") for m in masks()] == ["ab****gh", "*******h", "****", "<redacted>"]


@pytest.mark.parametrize("name", ["access_token", "access-token", "access.token", "access Token", " access[token] "])
def test_spellings_are_one_name(name):
    rules = P.rules_of({"access_token": P.HIGH})
    assert rules.level(name) == P.HIGH


def test_candidates():
    assert candidates("OPENAI_ACCESS_TOKEN") == ("openaiaccesstoken", "accesstoken", "token")
    assert candidates("HTTPServer2Token") == ("httpserver2token", "server2token", "token")
    assert candidates("_id") == ("id",)
    assert candidates("  _ ") == ()
    assert candidates("a_b", by_suffix=False) == ("ab",)


def test_exact_allowance_holds_for_its_own_name_only():
    rules = P.Rules((("accesstoken", P.HIGH),), allow_exact=("accesstoken",))
    assert rules.classify("access_token") == ("allowed", "accesstoken", "exact")
    assert rules.classify("OPENAI_ACCESS_TOKEN") == ("sensitive", "accesstoken", "token_suffix")
    assert rules.level("access_token") == 0
    assert rules.level("OPENAI_ACCESS_TOKEN") == P.HIGH


def test_strongest_floor_candidate_counts():
    policy = P.Policy(rules=P.Rules(allow_exact=("token",)), floor=P.rules_of({"token": P.SECRET, "access_token": P.MEDIUM}))
    assert policy.sensitivity_for("OPENAI_ACCESS_TOKEN") == P.SECRET
    assert policy.sensitivity_for("token") == P.SECRET


def test_unknown_fields_and_suffix_allowance():
    policy = P.Policy(rules=P.Rules(allow_suffix=("diagnostic",), unknown=P.SECRET), floor=None)
    assert policy.sensitivity_for("request_diagnostic") == 0
    assert policy.sensitivity_for("other_field") == P.SECRET
    matched = P.Policy(rules=P.Rules((("x", P.LOW),), unknown=P.SECRET), floor=None)
    assert matched.sensitivity_for("my_x") == P.LOW


def test_builder_is_transactional():
    base = P.standard()
    with pytest.raises(P.PolicyError):
        base.builder().fields(lambda r: r.high("ok").secret("  "))
    with pytest.raises(P.PolicyError):
        base.builder().mask(P.HIGH, P.Mask.fixed(""))
    with pytest.raises(P.PolicyError):
        base.builder().limits(max_output_bytes=1 << 40)
    policy = base.builder().fields(lambda r: r.low("a").raise_level(P.HIGH, "a").override_level(P.MEDIUM, "a").allow_suffix("b").include_preset("session")).build()
    assert policy.sensitivity_for("a") == P.MEDIUM
    assert base.sensitivity_for("a") == 0
    assert policy.rules.classify("my_b")[0] == "allowed"
    cleared = policy.builder().fields(lambda r: r.clear_allowed().remove("a")).disable_floor().build()
    assert cleared.sensitivity_for("a") == 0 and cleared.sensitivity_for("password") == 0


def test_contexts_only_raise():
    policy = P.standard().builder().context("query", lambda r: r.low("password").high("page")).build()
    assert policy.sensitivity_for("page") == 0
    assert policy.sensitivity_for("page", "query") == P.HIGH
    assert policy.sensitivity_for("password", "query") == P.SECRET


def test_json_round_trip_and_default():
    policy = P.strict().builder().context("body", lambda r: r.high("x")).mask(P.LOW, P.Mask.empty()).build()
    assert P.Policy.from_json(policy.to_json()) == policy
    before = P.replace_application_default(policy)
    assert P.application_default() is policy
    P.replace_application_default(before)


@given(st.text(alphabet="abcXYZ019", min_size=1, max_size=64), st.integers(0, 9), st.integers(0, 9), st.integers(0, 9))
def test_a_mask_never_shows_a_short_value(value, prefix, suffix, full):
    shown = P.Mask.preserve_edges(prefix, suffix, "****", full).mask(value)
    assert shown != value
    assert len(value) > max(full, prefix + suffix) or shown == "****"


@settings(max_examples=200)
@given(st.text(max_size=30))
def test_names_resolve_alike_each_time(name):
    policy = P.standard()
    assert policy.sensitivity_for(name) == policy.sensitivity_for(name)
    assert not candidates(name) or candidates(name)[0] == canonical(name) or "İ" in name or name.lower() != name


@given(st.integers(0, 4), st.integers(0, 4))
def test_a_floor_is_never_lowered(app, floor):
    rules = P.rules_of({"x": app}) if app else P.Rules()
    base = P.rules_of({"x": floor}) if floor else None
    assert P.Policy(rules=rules, floor=base).sensitivity_for("x") == max(app, floor)
