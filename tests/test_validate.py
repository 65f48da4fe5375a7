import json

import pytest
from pyspark.sql import functions as F

from labelmill.config import AGRONOMY_SPEC_5
from labelmill.operators import corpus as C
from labelmill.operators import validate as V
from labelmill.sources import files

SPEC = AGRONOMY_SPEC_5


def row(number, text, **changes):
    labels = {"is_ag_related": True, "crops": ["corn"], "topics": ["soil"], **dict.fromkeys(SPEC.flags, False), "intent": "question", "urgency": "low"}
    meta = {"source_type": "synthetic", "difficulty": "simple", "notes": "n"}
    out = {"id": f"route_{number:06d}", "input": text, "labels": labels, "meta": meta}
    for key, value in changes.items():
        place = labels if key in labels else meta if key in meta else out
        place[key] = value
    return out


def flat(spark, splits):
    """Flat corpus frame from {split: rows}."""
    rows = [(split, pos, line, json.dumps(r)) for pos, (split, rs) in enumerate(splits.items()) for line, r in enumerate(rs, 1)]
    df = spark.createDataFrame(rows, "split string, split_pos int, line_no int, line string").repartition(3)
    parsed = df.select("split", "split_pos", "line_no", F.from_json("line", C.corpus_schema(SPEC)).alias("r"))
    return C.flatten(parsed.select("split", "split_pos", "line_no", "r.*"), SPEC)


OUTSIDE = dict(is_ag_related=False, crops=[], topics=[])
BROKEN = {
    "bad_id": row(0, "t01", id="route_12\n"), "blank_input": row(2, " \x85"), "repeated_crop": row(3, "t03", crops=["corn", "corn"]),
    "unknown_crop": row(4, "t04", crops=["rice"]), "repeated_topic": row(5, "t05", topics=["soil", "soil"]),
    "unknown_topic": row(6, "t06", topics=["soil", "moon"]), "unknown_intent": row(7, "t07", intent="x"),
    "unknown_urgency": row(8, "t08", urgency=None), "unknown_difficulty": row(9, "t09", difficulty="x"), "blank_notes": row(10, "t10", notes=" "),
    "domain_without_crop": row(11, "t11", crops=[]), "domain_without_topic": row(12, "t12", topics=[]),
    "outside_with_crop": row(13, "t13", **{**OUTSIDE, "crops": ["corn"]}), "outside_with_topic": row(14, "t14", **{**OUTSIDE, "topics": ["soil"]}),
    "both_not_alone": row(15, "t15", crops=["both", "corn"]), "unknown_not_alone": row(16, "t16", crops=["corn", "unknown"]),
    "outside_with_needs_rag": row(17, "t17", **{**OUTSIDE, "needs_rag": True}),
    "outside_with_needs_epa_label": row(18, "t18", **{**OUTSIDE, "needs_epa_label": True}),
}


def test_each_row_rule_fires_alone(spark):
    found = V.validate_corpus(flat(spark, {"train": list(BROKEN.values())}), SPEC)
    got = sorted((r.line_no, r.rule) for r in found.collect())
    assert got == [(i, name) for i, name in enumerate(BROKEN, 1)]


def test_valid_rows_pass_and_gate_is_silent(spark):
    good = flat(spark, {"train": [row(1, "a"), row(2, "b", **OUTSIDE)]})
    found = V.validate_corpus(good, SPEC)
    assert found.count() == 0
    V.raise_on_violation(found)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_uniqueness_over_splits_blames_later_rows(spark, hot_rows):
    df = flat(spark, {
        "train": [row(1, "Corn  looks BAD!"), row(2, "x")], "val": [row(1, "y"), row(3, "corn looks bad")],
        "test": [row(1, "z"), row(4, "corn, looks bad"), row(5, " "), row(6, "")],
    })
    rows = V.validate_corpus(df, SPEC, hot_rows=hot_rows).collect()
    got = sorted((r.rule, r.split, r.line_no, r.detail) for r in rows if r.rule.startswith("repeated"))
    assert got == [
        ("repeated_id", "test", 1, "0:1"), ("repeated_id", "val", 1, "0:1"),
        ("repeated_input", "test", 2, "0:1"), ("repeated_input", "val", 2, "0:1"),
        ("repeated_signature", "test", 2, "0:1"), ("repeated_signature", "val", 2, "0:1")]
    with pytest.raises(ValueError, match="blank_input=2, repeated_id=2"):
        V.raise_on_violation(V.validate_corpus(df, SPEC))


def test_positions_by_name_use_structs(spark):
    df = spark.createDataFrame([("b", "x", "k"), ("a", "y", "k"), ("c", "z", "")], "p string, q string, k string")
    got = V.repeated(df, {"dup": F.col("k")}, ["p", "q"], ["p"])
    assert [tuple(r) for r in got.collect()] == [("b", "dup", "a:y")]


STRING = {"type": "string"}
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "labels"],
    "properties": {
        "id": {"type": "string", "pattern": "^route_[0-9]{6}$"},
        "labels": {
            "type": "object", "additionalProperties": False, "required": ["flag", "crops"],
            "properties": {
                "flag": {"type": "boolean"},
                "crops": {"type": "array", "uniqueItems": True, "items": {"type": "string", "enum": ["corn", "soybean"]}},
                "note": {"type": "string", "minLength": 1},
            },
        },
    },
}
GOOD = '{"id":"route_000001","labels":{"flag":true,"crops":["corn"]}}'
LINES = {
    GOOD: [], '{"id":"route_000001","labels":{"flag":true,"crops":[]}}': [],
    "": ["blank_line"], "  ": ["blank_line"], "{bad": ["bad_json"], '{"id":"a","id":"b"}': ["repeated_key"], "[1]": ["not_an_object", "$: not object"],
    '{"id":5,"labels":{"flag":true,"crops":[]}}': ["$.id: not string"],
    '{"id":"route_000001\\n","labels":{"flag":true,"crops":[]}}': ["$.id: pattern"],
    '{"id":"route_000001"}': ["$: missing keys"],
    '{"id":"route_000001","labels":{"flag":true,"crops":[]},"z":1,"b":2}': ["$: extra keys"],
    '{"id":"route_000001","labels":[]}': ["$.labels: not object"],
    '{"id":"route_000001","labels":{"crops":[],"flag":"true"}}': ["$.labels.flag: not boolean"],
    '{"id":"route_000001","labels":{"crops":[],"flag":null}}': ["$.labels.flag: not boolean"],
    '{"id":"route_000001","labels":{"flag":false}}': ["$.labels: missing keys"],
    '{"id":"route_000001","labels":{"flag":false,"crops":"corn"}}': ["$.labels.crops: not array"],
    '{"id":"route_000001","labels":{"flag":false,"crops":["corn","corn"]}}': ["$.labels.crops: repeated items"],
    '{"id":"route_000001","labels":{"flag":false,"crops":["corn",5]}}': ["$.labels.crops[]: not string"],
    '{"id":"route_000001","labels":{"flag":false,"crops":["rice"]}}': ["$.labels.crops[]: not in enum"],
    '{"id":"route_000001","labels":{"flag":false,"crops":[],"note":""}}': ["$.labels.note: too short"],
}


def test_schema_rules_on_raw_lines(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "line_no int, value string").repartition(4)
    found = {}
    for r in V.validate_lines(df, SCHEMA, ["line_no"]).collect():
        found.setdefault(r.line_no, []).append(r.rule)
    for i, (line, want) in enumerate(LINES.items()):
        assert sorted(found.get(i, [])) == sorted(want), line


def test_extra_keys_are_listed(spark):
    df = spark.createDataFrame([(1, '{"id":"route_000001","labels":{"flag":true,"crops":[]},"z":1,"b":2}')], "line_no int, value string")
    assert [r.detail for r in V.validate_lines(df, SCHEMA, ["line_no"]).collect()] == ["b, z"]


def test_unsupported_types_raise_before_any_job(spark):
    with pytest.raises(ValueError, match="unsupported schema type 'number'"):
        V.schema_cells({"type": "object", "properties": {"n": {"type": "number"}}}, F.lit(None))
    with pytest.raises(ValueError, match=r"\$\[\]\[\]: unsupported schema type 'number'"):
        df = spark.range(1).select(F.parse_json(F.lit("[]")).alias("doc"))
        df.select(V.schema_cells({"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, F.col("doc")))


NESTED = {
    "type": "object", "required": ["rows"],
    "properties": {
        "rows": {
            "type": "array", "uniqueItems": True,
            "items": {"type": "object", "additionalProperties": False, "required": ["on"], "properties": {"on": {"type": "boolean"}, "odd 'name": {"type": "string", "enum": ["a"]},
                      "tags": {"type": "array", "uniqueItems": True, "items": {"type": "array", "items": {"type": "string", "minLength": 2}}}}},
        },
    },
}


def broken(value, schema, path="$", at="$"):
    """Rules and places of what breaks a schema, by walking the parsed value."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool}
    if not isinstance(value, kinds[schema["type"]]):
        yield f"{path}: not {schema['type']}", at
    elif schema["type"] == "object":
        if set(schema.get("required", [])) - set(value):
            yield f"{path}: missing keys", at
        if schema.get("additionalProperties") is False and set(value) - set(schema["properties"]):
            yield f"{path}: extra keys", at
        for name, child in schema["properties"].items():
            if name in value:
                yield from broken(value[name], child, f"{path}.{name}", f"{at}.{name}")
    elif schema["type"] == "array":
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            yield f"{path}: repeated items", at
        for i, item in enumerate(value):
            yield from broken(item, schema["items"], f"{path}[]", f"{at}[{i}]")
    elif schema["type"] == "string":
        if len(value) < schema.get("minLength", 0):
            yield f"{path}: too short", at
        if value not in schema.get("enum", [value]):
            yield f"{path}: not in enum", at


def test_items_of_any_depth_against_a_walk(spark):
    import random

    rng = random.Random(4)

    def tags():
        return rng.choice([[], [["ab", "c"]], [["ab"], ["ab"]], [["x"], "y", [1, None]], "none", None, [[]]])

    def item():
        made = {k: v for k, v in (("on", rng.choice([True, False, "true", None])), ("odd 'name", rng.choice(["a", "b", 1])), ("tags", tags()), ("more", 1)) if rng.random() < 0.7}
        return rng.choice([made, made, made, dict(reversed(made.items())), [made], 5])

    values = [{"rows": [item() for _ in range(rng.randrange(5))]} for _ in range(150)]
    values += [{"rows": [{"on": True, "tags": []}, {"tags": [], "on": True}]}, {"rows": {}}, {}, {"rows": None}]
    lines = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "line_no int, value string").repartition(3)
    got = {}
    for r in V.validate_lines(lines, NESTED, ["line_no"]).collect():
        place = r.detail.split(": ")[0] if "[]" in r.rule else r.rule.split(": ")[0]
        got.setdefault(r.line_no, []).append((r.rule, place))
    for i, value in enumerate(values):
        assert sorted(got.get(i, [])) == sorted(broken(value, NESTED)), value


def test_keys_and_types_from_the_spec_alone(spark):
    def line(**changes):
        out = row(1, "text")
        for key, value in changes.items():
            place = out["labels"] if key in out["labels"] or key == "needs_more" else out["meta"] if key in out["meta"] else out
            if value is ...:
                del place[key]
            else:
                place[key] = value
        return json.dumps(out)

    cases = {
        line(): [], line(needs_rag=...): ["$.labels: missing keys"], line(needs_more=True): ["$.labels: extra keys"], line(needs_rag="true"): ["$.labels.needs_rag: not boolean"],
        line(needs_rag=None): ["$.labels.needs_rag: not boolean"], line(crops=["corn", 5]): ["$.labels.crops[]: not string"], line(meta=...): ["$: missing keys"],
        line(notes=7): ["$.meta.notes: not string"], line(input=None): ["$.input: not string"], line(labels=[]): ["$.labels: not object"], line(other=1): ["$: extra keys"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "line_no int, value string")
    got = {}
    for r in V.validate_lines(df, V.spec_schema(SPEC), ["line_no"]).collect():
        got.setdefault(r.line_no, []).append(r.rule)
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_lines_are_split_not_lost(spark):
    lines = ['{"a": 1}', "{bad", "", " ", '{"a": 1, "a": 2}', "[1]", "null", '{"a": ']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    readable, rejected = V.split_lines(df)
    assert [r.n for r in readable.collect()] == [0]
    assert sorted((r.n, r.reason) for r in rejected.collect()) == [(1, "bad_json"), (4, "repeated_key"), (5, "not_an_object"), (6, "not_an_object"), (7, "bad_json")]


def test_numbered_lines_keep_line_numbers(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text(GOOD + "\n\n{bad\n", encoding="utf-8")
    lines = files.read_numbered_lines(spark, str(tmp_path / "train.jsonl"))
    found = V.validate_lines(lines, SCHEMA, ["file", "line_no"])
    assert sorted((r.file, r.line_no, r.rule) for r in found.collect()) == [("train.jsonl", 2, "blank_line"), ("train.jsonl", 3, "bad_json")]
    assert files.read_lines(spark, str(tmp_path / "train.jsonl")).count() == 3


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    for name, n in (("a", 900), ("b", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i} {'x' * (i % 13)}\n" for i in range(1, n + 1)), encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = files.read_numbered_lines(spark, str(tmp_path))
        assert lines.select("value").rdd.getNumPartitions() > 1
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 901 and all(r.value.split()[0] == f"{r.file[0]}{r.line_no}" for r in rows)
