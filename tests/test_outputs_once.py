"""Model output is read once: a text is parsed as often as there are questions about it, and odd rooms change no other room."""
import __spark_entry__ as entry
from conftest import DATA
from atrium.sources.outputs import parse_outputs

OK = '{"id": %s, "room_type": "Bedroom", "floor_polygon": [{"x": 0, "z": 0}, {"x": 4.50, "z": 0}, {"x": 4e0, "z": "3"}]}'
ODD = ['5', 'null', '[1, 2]', '"text"', '{"id": 1}', '{"floor_polygon": {"x": 1}}', '{"floor_polygon": [1, {"x": 1, "z": 1}]}', '{"floor_polygon": [null]}',
       '{"floor_polygon": null}', '{"id": {"a": [1, 2.50]}, "room_type": 7, "floor_polygon": [{"x": {"y": 1}, "z": 0}, {"x": 1, "z": 0}, {"x": 1, "z": 1}]}']


def test_texts_are_parsed_once_per_question(spark):
    d = entry.queries()["parse_accounting"](spark, DATA)
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        text = d._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    # one value alone, a value before other text, whole room objects
    assert text.lower().count("parsejson") + text.lower().count("parse_json") <= 3


def test_odd_rooms_spoil_no_other(spark):
    texts = [(f"{i}-{j}", f'{{"rooms": [{", ".join([OK % 1] * i + [o] + [OK % 2])}]}}{tail}') for i in (0, 1) for j, o in enumerate(ODD) for tail in ("", " done")]
    d = parse_outputs(spark.createDataFrame(texts, "name string, text string"))
    for r in d.collect():
        i = int(r.name[0])
        assert r.status == ("json_prefix" if r.text.endswith("done") else "json")
        assert (r.n_output, r.n_dropped, [f.id for f in r.found]) == (i + 2, 1, ["1"] * i + ["2"])
        assert all([(p.x, p.y) for p in f.ring] == [(0.0, 0.0), (4.5, 0.0), (4.0, 3.0)] for f in r.found)
