import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lattica import types
from lattica.functions import geometry, labels, parse, scoring, text
from lattica.operators import rewards


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(values, kind="double"):
    return F.lit(None).cast(f"array<{kind}>") if values is None else F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def target_of(spark, label, box, positions, size=(100, 100)):
    return labels.build_target(F.lit(label), arr(box), arr(positions, "int"), F.lit(size[0]), F.lit(size[1]))


def test_captions(spark):
    cases = {"A-B/<person>,  says: 'Hi!'": "a b person says hi", "a\tb": "a\tb", "  x　 y ": "x y", "(1) #2; ~3": "1 2 3", "": "", " ".join("abcde" * 20): " ".join(("abcde" * 20)[:50])}
    for raw, want in cases.items():
        assert one(spark, text.normalize_caption(F.lit(raw))) == want
    assert one(spark, text.count_words(F.lit(" a b\t c "))) == 3
    assert one(spark, text.strip_image_token(F.lit("<image>\n<image> x <image>"))) == "x <image>"
    assert one(spark, text.strip_image_token(F.lit("a <image> <image>\nb"))) == "a  b"
    assert one(spark, text.comma_list(F.lit(" a, ,b,"))) == ["a", "b"] and one(spark, text.comma_list(F.lit(None).cast("string"))) == []
    assert one(spark, text.audit_prompt(F.lit("c"))).startswith("<image>\nNews text: c\nDetermine whether")


def test_labels_and_targets(spark):
    t = one(spark, target_of(spark, "face_swap&text_attribute", [10, 20, 60, 80], [4, 2, 2, 99, -1]))
    assert (t["verdict"], t["types"], t["image_bbox"], t["text_positions"]) == ("manipulated", ["face_swap", "text_attribute"], [100, 200, 600, 800], [2, 4])
    assert one(spark, labels.canonical_answer(target_of(spark, "orig", None, [3]))) == '{"verdict":"pristine","types":[],"image_bbox":null,"text_positions":[]}'
    assert one(spark, labels.normalize_bbox(arr([8, 4, 40, 28]), F.lit(64), F.lit(32))) == [125, 125, 625, 875]
    assert one(spark, labels.normalize_bbox(arr([0.0025, 0.0035, 2.0, -1.0]), F.lit(1), F.lit(1))) == [2, 4, 1000, 0]
    assert one(spark, labels.normalize_bbox(arr([]), F.lit(1), F.lit(1))) is None
    assert one(spark, labels.label_to_types(F.lit(" TA & fs&Face Swap"))) == ["face_swap", "text_attribute"]
    for bad in ("ORIG", "orig&fs", "fs&"):
        with pytest.raises(Exception, match="unknown manipulation label"):
            one(spark, labels.label_to_types(F.lit(bad)))
    with pytest.raises(Exception, match="box needs"):
        one(spark, labels.normalize_bbox(arr([1, 2, 3]), F.lit(10), F.lit(10)))
    names = {"orig": "normal", "fs": "face_swap", "fs&fa": "image_mixed", "ts&ta": "text_mixed", "fs&ta": "image_text_mixed"}
    for label, want in names.items():
        assert one(spark, labels.case_name(target_of(spark, label, [1, 1, 2, 2], [1]))) == want


def test_geometry(spark):
    vectors = [(None, None, 1.0), (None, [0, 0, 1, 1], 0.0), ([0, 0, 10, 10], [5, 5, 10, 10], 0.25), ([1, 1, 1, 1], [5, 5, 5, 5], 1.0), ([0, 0, 2, 2], [3, 3, 4, 4], 0.0)]
    for a, b, want in vectors:
        assert one(spark, geometry.bbox_iou(arr(a), arr(b))) == want
    assert one(spark, geometry.set_f1(arr([], "int"), arr([], "int"))) == 1.0
    assert one(spark, geometry.set_f1(arr([1, 1, 2], "int"), arr([2, 3], "int"))) == 0.5
    assert one(spark, geometry.clamp(F.lit(float("nan")))) == 0.0 and one(spark, geometry.clamp(F.lit(3))) == 1.0
    c = one(spark, geometry.token_counts(arr([0, 1, 9], "int"), arr([1, 2], "int"), F.lit(5)))
    assert tuple(c) == (1, 2, 1, 1)
    assert one(spark, scoring.candidate_score(F.lit(-1000.0), F.lit(-1000.0))) == 0.5


PARSES = [
    ('{"verdict":"fake","types":"fs, ta","image_bbox":["1",2,1500,"9"],"text_positions":[2.7,"3",true,2]}', (True, "manipulated", ["face_swap", "text_attribute"], [1.0, 2.0, 1000.0, 9.0], [1, 2, 3])),
    ('```JSON\n{"label":"real"}\n```', (True, "pristine", [], None, [])),
    ('so: {"verdict":"orig","types":[],"image_bbox":"null"} ok', (True, "pristine", [], None, [])),
    ('{"verdict":"real","verdict":"fake","badcase_types":["ts"],"evidence_text_pos":[49]}', (True, "manipulated", ["text_swap"], None, [49])),
]
INVALID_JSON = ["not json", "", "[{}]", '[{"verdict":"real"}]', "```", "}{", "None", "1"]
INVALID_SCHEMA = [
    '{"verdict":null,"label":"real"}', "{}", '{"verdict":"real","types":"fs,"}', '{"verdict":"real","types":["fs"]}', '{"verdict":"fake"}', '{"verdict":"real","image_bbox":[1,2,3,4]}', '{"verdict":"fake","types":["ts"],"text_positions":[50]}',
    '{"verdict":"fake","types":["fs"],"image_bbox":[5,5,1,9]}', '{"verdict":"fake","types":["fs"],"image_bbox":[NaN,1,2,3]}', '{"verdict":"fake","types":["ts"],"text_positions":[1e999]}', '{"verdict":"fake","types":["ts"],"text_positions":{"a":1}}',
    '{"verdict":"fake","types":["ts"],"text_positions":["2.5"]}', '{"verdict":"fake","types":5}', '{"verdict":"fake","types":["fs"],"image_bbox":[1,2,3]}', '{"verdict":"fake","types":["fs"],"image_bbox":[null,1,2,3]}', '{"verdict":"fake","types":["ts"],"text_positions":0}',
]


def test_parse(spark):
    rows = [t for t, _ in PARSES] + INVALID_JSON + INVALID_SCHEMA + [None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").withColumn("p", parse.parse_response(F.col("t"))).orderBy("i").collect()
    for r, (_, want) in zip(got, PARSES):
        assert tuple(r["p"])[:5] == want
    for r in got[len(PARSES) :]:
        kind = "invalid_schema: " if r["t"] in INVALID_SCHEMA else "invalid_json: "
        assert not r["p"]["valid"] and r["p"]["error"].startswith(kind), r
        assert tuple(r["p"])[1:5] == (None, [], None, [])
    objects = spark.createDataFrame([('{"label":"real"}', True), (None, True)], "t string, o boolean").withColumn("p", parse.parse_response(F.col("t"), is_object=F.col("o"))).collect()
    assert [r["p"]["valid"] for r in objects] == [True, False]


def random_answer(rng):
    types_ = [t for t in types.TYPE_ORDER if rng.random() < 0.4]
    corner = sorted(rng.randrange(0, 1001) for _ in range(2)), sorted(rng.randrange(0, 1001) for _ in range(2))
    box = [corner[0][0], corner[1][0], corner[0][1], corner[1][1]] if set(types_) & set(types.IMAGE_TYPES) and rng.random() < 0.8 else None
    words = sorted({rng.randrange(50) for _ in range(rng.choice([0, 2, 45]))}) if set(types_) & set(types.TEXT_TYPES) else []
    return {"verdict": "manipulated" if types_ else "pristine", "types": types_, "image_bbox": box, "text_positions": words}


def test_rewards_agree_with_the_callable(spark):
    rng = random.Random(1)
    rows = [(i, random_answer(rng), json.dumps(random_answer(rng)) if rng.random() < 0.9 else "junk") for i in range(300)]
    rows += [(900, {"verdict": "pristine", "types": [], "image_bbox": None, "text_positions": []}, json.dumps({"verdict": "fake", "types": list(types.TYPE_ORDER), "image_bbox": [0, 0, 1000, 1000], "text_positions": list(range(40))}))]
    df = spark.createDataFrame([(i, (t["verdict"], t["types"], t["image_bbox"], t["text_positions"]), r) for i, t, r in rows], f"id int, target {types.TARGET.simpleString()}, response string")
    scored = rewards.score_rewards(df.withColumn("parsed", parse.parse_response(F.col("response")))).collect()
    by = {r["id"]: r for r in scored}
    for i, t, r in rows:
        assert by[i]["reward"] == pytest.approx(rewards.reward_of(t, r), abs=1e-12)
    assert by[900]["reward"] == -0.75 and by[900]["breakdown"]["penalty"] == 0.5
    mixed = {"verdict": "manipulated", "types": ["face_swap", "text_swap"], "image_bbox": [0, 0, 10, 10], "text_positions": [1]}
    said = {"verdict": "manipulated", "types": ["face_swap"], "image_bbox": [0, 0, 10, 10], "text_positions": []}
    assert rewards.reward_of(mixed, said, {"image_text_mixed": 1.6}) == pytest.approx(1.6 * (0.5 + 0.25 * 2 / 3 + 0.25 * 0.5))
    assert rewards.reward_of(mixed, "not json") == -0.5


def test_reward_callback():
    pristine = {"verdict": "pristine", "types": [], "image_bbox": None, "text_positions": []}
    fake = {"verdict": "manipulated", "types": ["ts"], "image_bbox": None, "text_positions": [1]}
    good = json.dumps(pristine)
    call = rewards.make_reward()
    assert call([[{"role": "assistant", "content": good}]], target=pristine) == [1.0]
    assert call([good, good, "x", "y"], target=[pristine, fake])[:2] == [1.0, 1.0] and call([good], meta=[{"target": pristine}]) == [1.0]
    assert rewards.completion_text({"text": "a"}) == "a" and rewards.completion_text([]) == "[]" and rewards.completion_text({}) == ""
    for bad in ({}, {"target": [pristine, fake]}):
        with pytest.raises(ValueError):
            call([good] * 3, **bad)


def test_case_weights(spark):
    counts = spark.createDataFrame([("normal", 100), ("face_swap", 25), ("image_text_mixed", 4), ("x", 9), ("none", 0)], "case string, n long")
    got = {r["case"]: r["weight"] for r in rewards.case_weights(counts).collect()}
    assert got == {"normal": 0.6, "face_swap": 1.0 if math.sqrt(17 / 25) > 1 else pytest.approx(math.sqrt(17 / 25)), "image_text_mixed": 2.0, "x": pytest.approx(math.sqrt(17 / 9))}


def test_recognised_answers(spark):
    """What column functions decide is what the parser says, on answers near the canonical form."""
    rng = random.Random(2)
    verdicts, names = ["manipulated", "pristine", "fake", "real", "unknown", "Fake"], [*parse.TYPE_ALIASES, "other"]
    blank = lambda: "\u00a0" if rng.random() < 0.003 else rng.choice(["", "", "", " ", "\n\t "])
    number = lambda: rng.choice(["0", "1", "7.5", "-3", "999", "1000", "1200.25", "-0", "0.5", "00", "1e3", "1.", "123456789012345678", "NaN", '"5"', "-0.0"])
    texts = ["", None, "{}", '{"verdict":"pristine"}']
    for _ in range(4000):
        good = rng.random() < 0.6
        v = rng.choice(verdicts[:4] if good else verdicts)
        types = [] if v in ("pristine", "real") and good else rng.choices(names[:-1] if good else names, k=rng.randrange(0 if not good else 1, 4))
        if good and types and rng.random() < 0.7:
            types += ["fs", "text_swap"]
        box = "null" if rng.random() < 0.3 else "[" + f",{blank()}".join(rng.choice((["0", "10"], ["20.5", "900"])[k > 1]) if good else number() for k in range(4 if rng.random() < 0.95 else rng.randrange(6))) + "]"
        words = [str(rng.randrange(50)) if good else rng.choice(["0", "49", "50", "3.7", "-1", "07"]) for _ in range(rng.randrange(3))]
        fields = [f'"{rng.choice(k)}"{blank()}:{blank()}{x}' for k, x in zip([n for _, n in parse.FIELDS], (f'"{v}"', "[" + f"{blank()},".join(f'"{t}"' for t in types) + "]", box, "[" + ",".join(words) + "]"))]
        if rng.random() < 0.1:
            rng.shuffle(fields)
        if rng.random() < 0.05:
            fields.append(rng.choice(fields))
        texts.append(blank() + "{" + f"{blank()},{blank()}".join(fields) + "}" + blank() + rng.choice(["", "", "", "x", "}"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["p"], r["native"]) for r in df.select("i", parse.parse_response(F.col("t")).alias("p"), parse.recognised(F.col("t")).alias("native")).collect()}
    for i, t in enumerate(texts):
        want = parse.parse_one(t)
        assert tuple(got[i][0]) == want, t
        assert got[i][1] is None or tuple(got[i][1]) == want
    valid = [i for i, t in enumerate(texts) if parse.parse_one(t)[0]]
    assert len(valid) > 500 and sum(got[i][1] is not None for i in valid) > 0.5 * len(valid)
