import json

import pytest
from marlstone.operators import extraction as X
from marlstone.operators import graph as G


def answer(content, finish="stop"):
    return {"choices": [{"finish_reason": finish, "message": {"content": content if isinstance(content, str) else json.dumps(content)}}]}


GOOD = {"entities": [{"name": "Ada", "type": "person", "attributes": {"born": "1815", "n": 3}}, {"name": "Bo"}, {"name": "London", "type": "city"}], "relations": [{"source": "Ada", "target": "London", "type": "lives in"}, {"source": "Ada", "target": 2, "type": "x"}, 7]}


def asked(*answers):
    requests, left = [], list(answers)

    def call(body):
        requests.append(body)
        return left.pop(0)

    return requests, call


def test_json_mode_first():
    requests, call = asked(answer(GOOD))
    found = X.extract_one(call, "Ada in London", "m", ("person",), ("lives in",))
    assert found["entities"] == [{"name": "Ada", "type": "person", "attributes": {"born": "1815"}}, None, {"name": "London", "type": "city", "attributes": {}}]
    assert found["relations"] == [{"source": "Ada", "target": "London", "type": "lives in"}, None, None]
    assert [r["response_format"] for r in requests] == [{"type": "json_object"}] and "max_tokens" not in requests[0]
    assert requests[0]["messages"][1] == {"role": "user", "content": "Ada in London"} and "lives in" in requests[0]["messages"][0]["content"]


@pytest.mark.parametrize("bad", [answer(GOOD, "length"), answer("{"), answer([]), answer({"entities": []}), answer({"entities": {}, "relations": []}), {}, {"choices": []}, {"choices": [{"message": {"content": None}}]}])
def test_one_bounded_retry(bad):
    requests, call = asked(bad, answer(GOOD))
    assert X.extract_one(call, "t", "m")["entities"][0]["name"] == "Ada"
    second = requests[1]
    schema = second["response_format"]["json_schema"]["schema"]
    assert second["max_tokens"] == 2048 and schema["properties"]["entities"]["maxItems"] == 6 and schema["properties"]["relations"]["maxItems"] == 8
    assert schema["properties"]["entities"]["items"]["properties"]["name"] == {"type": "string", "maxLength": 40} and schema["required"] == ["entities", "relations"]
    requests, call = asked(bad, bad)
    with pytest.raises(ValueError, match="no valid extraction"):
        X.extract_one(call, "t", "m")
    assert len(requests) == 2


def test_failed_calls():
    requests, call = asked()
    with pytest.raises(ValueError, match="reached"):
        X.extract_one(call, "t", "m")
    assert len(requests) == 1
    with pytest.raises(ValueError, match="configured"):
        X.extract_one(call, "t", " ")


def test_segments(spark):
    def make_call():
        def call(body):
            text = body["messages"][1]["content"]
            if "down" in text:
                raise OSError
            if "odd" in text and body["response_format"]["type"] == "json_object":
                return {"choices": [{"message": {"content": "{"}}]}
            names = text.split()
            found = {"entities": [{"name": n, "type": "word"} for n in [*names, "Absent"]], "relations": [{"source": names[0], "target": t, "type": "near"} for t in [*names[1:], "Absent"]] if names else []}
            return {"choices": [{"message": {"content": __import__("json").dumps(found)}}]}

        return call

    segments = spark.createDataFrame([(1, "red blue"), (2, "odd one"), (3, "down"), (4, None)], "segment_id long, text string")
    found = X.extract(segments, make_call, "m").cache()
    assert {r.segment_id: r.error for r in found.collect()} == {1: None, 2: None, 3: "the extraction model can't be reached", 4: None}
    entities = G.grounded_entities(found)
    assert sorted((r.segment_id, r.name) for r in entities.collect()) == [(1, "blue"), (1, "red"), (2, "odd"), (2, "one")]
    assert sorted(map(tuple, G.valid_relations(found, entities).collect())) == [(1, "red", "blue", "near"), (2, "odd", "one", "near")]
    assert X.extract(segments.limit(0), make_call, "m").count() == 0
