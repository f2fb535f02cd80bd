import json

import pytest

from tagmill.functions.text import repaired
from tagmill.operators.parse import parse

CATS = ["Computer Science", "Finance", "Marketing"]


def one(name="Finance", conf=97, **more):
    return {"name": name, "confidence": conf, **more}


def labels(*items):
    return json.dumps({"labels": list(items)})


# raw response -> label, confidence, low, status
CASES = {
    labels(one()): ("Finance", 97, "no", "ok"),
    labels(one(), one()): ("Finance", 97, "no", "ok"),
    labels(one(conf=50)): ("Finance", 50, "yes", "ok"),
    labels(one(conf=95), one("Marketing", 99)): ("Marketing|Finance", 99, "no", "ok"),
    labels(one(conf=96), one("Marketing", 96)): ("Finance|Marketing", 96, "no", "ok"),
    labels(one("Finanse", 96)): ("Finance", 96, "no", "fuzzy_corrected: Finanse → Finance"),
    labels(one("Zoology", 96)): ("unmatched_Zoology", 96, "no", "unmatched: unmatched_Zoology"),
    labels(one("Finanse", 96), one("Zoology", 97)): ("unmatched_Zoology|Finance", 97, "no", "fuzzy_corrected: Finanse → Finance; unmatched: unmatched_Zoology"),
    labels(one("Finanse", 10), one("Marketing", 97)): ("Marketing", 97, "no", "fuzzy_corrected: Finanse → Finance"),
    labels(one(" Finance\t", 96)): ("Finance", 96, "no", "ok"),
    labels(one("finance", 96)): ("Finance", 96, "no", "fuzzy_corrected: finance → Finance"),
    '{"labels": []}': ("unclassified", 0, "yes", "no_labels"),
    "[]": ("unclassified", 0, "yes", "no_labels"),
    "{}": ("unclassified", 0, "yes", "no_labels"),
    '{"labels": null}': ("unclassified", 0, "yes", "no_labels"),
    '{"labels": ""}': ("unclassified", 0, "yes", "no_labels"),
    '{"labels": 0}': ("unclassified", 0, "yes", "no_labels"),
    '{"labels": false}': ("unclassified", 0, "yes", "no_labels"),
    '{"error": "x"}': ("api_error", 0, "yes", "api_error: x"),
    '{"error": null}': ("api_error", 0, "yes", "api_error: None"),
    '{"error": "x", "labels": [{"name": "Finance", "confidence": 99}]}': ("Finance", 99, "no", "ok"),
    "123": ("parse_error", 0, "yes", "unexpected_type: int"),
    '"s"': ("parse_error", 0, "yes", "unexpected_type: str"),
    "null": ("parse_error", 0, "yes", "unexpected_type: NoneType"),
    "true": ("parse_error", 0, "yes", "unexpected_type: bool"),
    "1.5": ("parse_error", 0, "yes", "unexpected_type: float"),
    '{"labels": "abc"}': ("unclassified", 0, "yes", "no_valid_labels_after_validation"),
    '{"labels": {"name": "A"}}': ("unclassified", 0, "yes", "no_valid_labels_after_validation"),
    '{"labels": 5}': ("processing_error", 0, "yes", "exception: 'int' object is not iterable"),
    '{"labels": true}': ("processing_error", 0, "yes", "exception: 'bool' object is not iterable"),
    '[{"name": "Finance", "confidence": 96}]': ("Finance", 96, "no", "ok"),
    '[1, "x", {"name": "Finance", "confidence": 96}]': ("Finance", 96, "no", "ok"),
    labels(one(conf=95.9)): ("Finance", 95, "no", "ok"),
    labels(one(conf="95.9")): ("Finance", 95, "no", "ok"),
    labels(one(conf=" 95 ")): ("Finance", 95, "no", "ok"),
    labels(one(conf=-3.9)): ("Finance", -3, "yes", "ok"),
    labels({"name": "Finance"}): ("Finance", 0, "yes", "ok"),
    labels(one(conf=None)): ("Finance", 0, "yes", "ok"),
    labels(one(conf="95%")): ("Finance", 0, "yes", "ok"),
    labels(one(conf="95d")): ("Finance", 0, "yes", "ok"),
    labels(one(conf=[])): ("Finance", 0, "yes", "ok"),
    labels(one(conf="nan")): ("Finance", 0, "yes", "ok"),
    labels(one(conf=True)): ("Finance", 1, "yes", "ok"),
    labels(one(conf="inf")): ("processing_error", 0, "yes", "exception: cannot convert float infinity to integer"),
    labels(one(None, 96)): ("unmatched_None", 96, "no", "unmatched: unmatched_None"),
    labels({"confidence": 96}): ("unclassified", 0, "yes", "no_valid_labels_after_validation"),
    labels(one("  ", 96)): ("unclassified", 0, "yes", "no_valid_labels_after_validation"),
    "hopeless": ("parse_error", 0, "yes", "json_parse_failed"),
    "": ("parse_error", 0, "yes", "json_parse_failed"),
    '```json\n{"labels": [{"name": "Finance", "confidence": 96}]}\n```': ("Finance", 96, "no", "ok"),
    'Sure: {"labels": [{"name": "Finance", "confidence": 96,},]} there': ("Finance", 96, "no", "ok"),
    "{'labels': [{'name': 'Finance', 'confidence': 96}]}": ("Finance", 96, "no", "ok"),
    '{"labels": [{"name": "Finance", "confidence": 96}': ("Finance", 96, "no", "ok"),
    '{"labels": [{"name": "Finance", "confidence": 96, "reason": "it is': ("Finance", 96, "no", "ok"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, raw) for i, raw in enumerate(CASES)] + [(-1, None)]
    df = parse(spark.createDataFrame(rows, "i int, raw_response string"), CATS, 95)
    return {r["i"]: r for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=list(CASES))
def test_decision_table(parsed, i):
    r = parsed[i]
    assert (r["label"], r["confidence"], r["is_low_confidence"], r["parse_status"]) == list(CASES.values())[i]


def test_null_response(parsed):
    assert (parsed[-1]["label"], parsed[-1]["confidence_detail"]) == ("parse_error", "")


def test_detail_holds_all_labels_by_confidence(spark):
    raw = labels(one("Finanse", 50, reason="é"), one("Marketing", 97))
    r = parse(spark.createDataFrame([(raw,)], "raw_response string"), CATS, 95).first()
    assert json.loads(r["confidence_detail"]) == [
        {"name": "Marketing", "confidence": 97, "reason": "", "exact_match": True, "original_name": None},
        {"name": "Finance", "confidence": 50, "reason": "é", "exact_match": False, "original_name": "Finanse"},
    ]


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(labels(one()), "x", 7)], "raw_response string, _v string, pos int")
    r = parse(df, CATS, 95).first()
    assert (r["pos"], r["label"]) == (7, "Finance")


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": 1, }', {"a": 1}),
        ("[1, 2", [1, 2]),
        ('{"a": "x', {"a": "x"}),
        ('{"a": {"b": [1, {"c": "d', {"a": {"b": [1, {"c": "d"}]}}),
        ("{'a': 'it''s'}", None),
        ('{"a":', {"a": None}),
        ('{"a": True, "b": None}', {"a": True, "b": None}),
        ("text without any", None),
    ],
)
def test_repair(text, value):
    made = repaired(text)
    if value is not None:
        assert json.loads(made) == value
    else:
        assert made is None or json.loads(made) is not None
