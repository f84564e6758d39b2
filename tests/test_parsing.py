"""Every tier of the answer cascade, as data rows."""

from pyspark.sql import functions as F

from gaugewright.functions.parsing import breaks_off, parse_response

LONG = "The panel weighed every rating in turn and then compared them with the others, noting how far each one lay from the rest of "

CASES = [
    # raw, prompt, structured, answer, strategy
    ("<answer>42</answer>", "", None, 42, "xml_tag"),
    ("<answer>10</answer> no, <ANSWER> 2.5 </ANSWER>", "", None, 2, "xml_tag"),
    ("x <answer>0.5</answer>", "", None, 0, "xml_tag"),
    ("My final answer is 73", "", None, 73, "final_answer"),
    ("My final answer is 730", "", None, None, "failed"),
    ("the estimated market index is approximately 61", "", None, 61, "final_answer"),
    ("**55**", "", None, 55, "final_answer"),
    ("The maximum index is 27", "", None, 27, "regex"),
    ("Therefore the index is 64", "", None, 64, "final_answer"),
    (" 88 ", "", None, 88, "regex"),
    ("-5", "", None, None, "failed"),
    ("150", "", None, None, "failed"),
    ("Given 30 and 40.\nSo 35", "", None, 35, "regex"),
    ("values 30, 40 and 50 here", "seen 30 and 40", None, 50, "regex"),
    ("values 30, 40 and 50 here", "", None, 50, "last_number"),
    ('{"name": "lookup", "value": 50}', "", None, None, "failed"),
    ("nothing", "", None, None, "failed"),
    ("", "", None, None, "failed"),
    (None, "", None, None, "failed"),
    ("17", "", '{"answer": 9}', 9, "structured"),
    ("17", "", '{"answer": 9.0}', 9, "structured"),
    ("17", "", '{"answer": 9.5}', 17, "regex"),
    ("17", "", '{"answer": "9"}', 17, "regex"),
    ("17", "", '{"answer": true}', 1, "structured"),
    ("17", "", "[9]", 17, "regex"),
    ("17", "", "broken", 17, "regex"),
    ("17", "", '{"answer": 101}', 17, "regex"),
    ("12 and 99 were seen\n" + LONG + "the", "", None, None, "failed"),
    ("  7 \n", "", None, 7, "regex"),
]


def test_cascade(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string, prompt string, structured string")
    got = {r["i"]: r["p"] for r in df.select("i", parse_response(F.col("raw"), F.col("prompt"), F.col("structured")).alias("p")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if (got[i]["answer"], got[i]["strategy"], got[i]["ok"]) != (c[3], c[4], c[3] is not None)]
    assert not wrong


def test_breaks_off(spark):
    df = spark.createDataFrame([(LONG + "the",), (LONG + "it.",), ("short of the",), (LONG + "12",), (LONG + "and then,",)], "t string")
    assert [r[0] for r in df.select(breaks_off(F.col("t"))).collect()] == [True, False, False, False, False]
