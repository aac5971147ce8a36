import json
import math
import random

import pytest

from lattica.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, call_id string, turn long, content string"
TOOLS = [("f", "x", "integer", True), ("f", "y", "string", False), ("g", "z", "object", True)]


def link(spark, calls, results):
    c = spark.createDataFrame([(*r, "clash") for r in calls], CALLS)
    t = spark.createDataFrame(TOOLS, "name string, param string, kind string, required boolean")
    return chat.link_calls(c, spark.createDataFrame(results, RESULTS), t)


def test_linking_and_validation(spark):
    calls = [
        (1, "a", 1, "f", '{"y": "s", "x": 1}', None), (1, "b", 2, "f", '{"x": "1"}', ["a"]), (1, "c", 3, "f", "{}", ["nowhere", "c"]), (1, "d", 4, "f", '{"x":1,"w":2}', None), (1, "e", 5, "g", '{"z": {"b": 1, "a": [1, 2]}}', None),
        (1, "g", 6, "nope", "{}", None), (1, "h", 7, "f", "[1]", None), (1, "i", 8, "f", "not json", None), (1, "j", 9, "f", None, None), (2, "a", 1, "f", '{"x": 2}', None), (2, "a", 1, "f", '{"x": 2}', None), (None, "a", 1, "f", '{"x": 3}', None),
    ]
    results = [(1, "a", 3, "late"), (1, "a", 2, "b"), (1, "a", 2, "a"), (1, "zz", 5, "orphan"), (2, "a", 2, None), (1, "e", 6, "é\n\"q\"")]
    got = {(r["conv_id"], r["call_id"]): r for r in link(spark, calls, results).collect()}
    assert len(got) == 12
    errors = {k[1]: r["errors"] for k, r in got.items() if k[0] == 1}
    assert errors == {"a": [], "b": ["kind:x"], "c": ["missing:x"], "d": ["unknown:w"], "e": [], "g": ["no_such_tool"], "h": ["not_an_object"], "i": ["not_an_object"], "j": ["not_an_object"], "zz": None}
    a = got[1, "a"]
    assert (a["result"], a["n_results"], a["status"], a["arguments"]) == ("a", 3, "linked", '{"x":1,"y":"s"}')
    assert json.loads(got[1, "e"]["record"]) == {"arguments": {"z": {"a": [1, 2], "b": 1}}, "call_id": "e", "conv_id": 1, "name": "g", "result": 'é\n"q"'}
    assert got[1, "zz"]["status"] == "orphan_result" and got[1, "d"]["status"] == "invalid" and got[2, "a"]["n_calls"] == 2 and got[2, "a"]["status"] == "linked"
    assert (got[None, "a"]["status"], got[None, "a"]["ready"], got[None, "a"]["depth"]) == ("no_result", 1, 0)


def plain_places(calls):
    """(conv, call) -> (ready, depth), or None on a cycle or behind one, from the definition."""
    turn, deps = {}, {}
    for conv, call, t, *_, before in calls:
        if conv is not None and call is not None:
            turn[conv, call] = min(turn.get((conv, call), t), t)
            deps.setdefault((conv, call), set()).update((conv, b) for b in before or [] if b is not None and b != call)
    deps = {k: {d for d in v if d in turn} for k, v in deps.items()}
    places = {}
    while True:
        free = [k for k in turn if k not in places and all(d in places for d in deps[k])]
        if not free:
            return {k: places.get(k) for k in turn}
        for k in free:
            places[k] = max([(turn[k], 0), *((places[d][0], places[d][1] + 1) for d in deps[k])])


def check_places(spark, calls):
    want = plain_places(calls)
    got = link(spark, calls, []).collect()
    assert len(got) == len({str(c) for c in calls})
    for r in got:
        place = want.get((r["conv_id"], r["call_id"]), (r["turn"], 0))
        if place is not None and place[0] < r["turn"]:  # a later call of the same identifier
            place = (r["turn"], 0)
        assert (r["ready"], r["depth"]) == (place or (None, None)), r
        assert (r["status"] == "cycle") == (place is None)


def test_topological_order(spark):
    # c needs b, b needs a, but all come in the other order; x and y need each other; w waits for x
    deps = [("a", 9, []), ("b", 5, ["a"]), ("c", 2, ["b"]), ("d", 1, []), ("e", 9, ["a", "c"]), ("f", 20, ["e"]), ("x", 3, ["y"]), ("y", 4, ["x"]), ("w", 1, ["x"])]
    calls = [(1, i, t, "f", '{"x":1}', d) for i, t, d in deps]
    got = {r["call_id"]: r for r in link(spark, calls, []).collect()}
    place = {i: (got[i]["ready"], got[i]["depth"], got[i]["turn"], i) for i, _, _ in deps if got[i]["ready"] is not None}
    assert {i for i, _, _ in deps} - set(place) == {"x", "y", "w"} and got["x"]["status"] == "cycle"
    for i, _, before in deps:
        if i in place:
            assert all(place[b] < place[i] for b in before)
    check_places(spark, calls)


@pytest.mark.parametrize("seed", [1, 2])
def test_places_by_definition(spark, seed):
    """Random conversations with chains, joints, cycles, repeated identifiers and nulls."""
    rng, calls = random.Random(seed), []
    for conv in range(12):
        n = rng.randrange(1, 9)
        for k in range(n):
            before = rng.sample([f"c{i}" for i in range(n)], rng.randrange(0, min(n, 3) if conv % 2 else min(n, 2)))
            calls.append((conv, f"c{k}", rng.randrange(6), "f", '{"x":1}', before))
    calls += [(50, f"k{i:02}", 100 - i, "f", "{}", [f"k{i - 1:02}"]) for i in range(40)]  # a chain against its turns
    calls += [(51, "a", 1, "f", "{}", None), (51, "a", 7, "f", "[]", ["b"]), (51, "b", 3, "f", "{}", []), (51, "z", 2, "f", "{}", ["a"])]
    calls += [(None, "a", 3, "f", "{}", ["b"]), (None, "b", 5, "f", "{}", ["a"]), (1, None, 4, "f", "{}", ["c0"]), (2, "n", 4, "f", "{}", [None])]
    check_places(spark, calls)


def test_unrelated_rows_change_nothing(spark):
    calls = [(None, "a", 1, "f", '{"x":1}', None), (2, "a", 1, "f", '{"x":1}', []), (2, "a", 7, "f", '{"x":2}', []), (2, "b", 3, "f", '{"x":1}', ["a"])]
    other = [(9, "p", 1, "f", "{}", ["q"]), (9, "q", 2, "f", "{}", [])]
    alone, together = (sorted(str(r) for r in link(spark, c, []).where("conv_id is null or conv_id <> 9").collect()) for c in (calls, calls + other))
    assert alone == together


def test_null_turns(spark):
    calls = [(1, "a", None, "f", '{"x":1}', None), (1, "b", None, "f", '{"x":1}', ["a"]), (1, "c", 2, "f", '{"x":1}', ["b"]), (1, "d", None, "f", '{"x":1}', ["c"])]
    got = {r["call_id"]: (r["ready"], r["depth"], r["status"]) for r in link(spark, calls, []).collect()}
    assert got == {"a": (None, 0, "no_result"), "b": (None, 1, "no_result"), "c": (2, 0, "no_result"), "d": (2, 1, "no_result")}


def test_empty(spark):
    assert link(spark, [], []).count() == 0
    assert link(spark, [], [(1, "a", 1, "r")]).count() == 1


@pytest.mark.parametrize("n", [12, 100, 1000])
@pytest.mark.parametrize("step", [1, -1])
def test_rounds_are_logarithmic(spark, n, step, monkeypatch):
    """Calls that each depend on the next two (or the two before, against their turns)."""
    rounds = []
    read = chat._rounds
    monkeypatch.setattr(chat, "_rounds", lambda *a: rounds.append(found := read(*a)) or found)
    calls = [(1, f"k{i}", i * step, "f", "{}", [f"k{i + 1}", f"k{i + 2}"]) for i in range(n)] + [(1, "end", 5, "f", "{}", ["k0"]), (1, "k0", 99_999, "f", "{}", []), (1, "x", 0, "f", "{}", ["y"]), (1, "y", 9, "f", "{}", [])]
    check_places(spark, calls)
    (places,) = rounds
    parts = {f.rsplit("/", 2)[-2] for f in places.inputFiles()}
    assert 0 < len(parts) <= 2 * math.log2(n) + 4


def test_shortcuts_around_cycles(spark):
    rng, calls = random.Random(5), []
    for conv in range(30):
        n = rng.randrange(3, 8)
        for k in range(n):  # dense: most have shortcuts, many have cycles
            calls.append((conv, f"c{k}", rng.randrange(4), "f", "{}", [f"c{i}" for i in range(n) if rng.random() < (0.5 if conv % 2 else 0.8) and (conv % 3 or i > k)]))
    check_places(spark, calls)
