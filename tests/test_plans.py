"""Plans that must hold at scale."""

import io
from contextlib import redirect_stdout

from lorewell.operators import edges as E
from lorewell.operators import knowledge as K
from lorewell.operators.sizes import broadcast_if_small
from lorewell.operators.scratch import scratch_root, written

EDGE = "start string, end string, relation string, weight double"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def extraction(spark):
    edges = written(spark.createDataFrame([("dog", "pet", "/r/IsA", 1.0)] * 3, EDGE), "e")
    messages = written(
        spark.createDataFrame([(1, "a dog", "x")], "id long, text string, unused string"), "m"
    )
    return K.message_knowledge(messages, K.build_index(edges, 3, 1), ["id"])


def test_extraction_shuffles_once_when_edges_are_small(spark):
    text = plan(K.knowledge_arrays(extraction(spark), ["id"]))
    tree = text.split("\n\n")[0]
    lines = tree.splitlines()
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    depth = lines[union].index("Union")
    second = next(i for i in range(union + 2, len(lines)) if lines[i][depth : depth + 2] == "+-")
    # nothing is shuffled behind the union, and short sentences only once before it
    assert " Exchange " not in "\n".join(lines[:union])
    assert sum(" Exchange " in line for line in lines[union:second]) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "EvalPython" not in text
    assert "unused" not in text


def test_extraction_without_broadcast_cuts_groups_before_the_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(extraction(spark))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tree = text.split("\n\n")[0]
    assert "SortMergeJoin" in tree
    assert tree.index("WindowGroupLimit") < tree.rindex("WindowGroupLimit")


def test_only_open_cases_reach_python(spark):
    df = spark.createDataFrame([("run", "running"), ("a", "b")], "start string, end string")
    text = plan(E.drop_same_stem(df))
    assert "ArrowEvalPython" in text and "BatchEvalPython" not in text and "Exchange" not in text


def test_top_relations_are_broadcast(spark):
    rows = [("/r/a", 1.0)] * 3
    edges = written(spark.createDataFrame(rows, "relation string, weight double"), "e")
    tree = plan(E.restrict_relations(edges, E.top_relations(edges))).split("\n\n")[0]
    assert "BroadcastHashJoin" in tree and "SortMergeJoin" not in tree


def test_broadcast_only_within_the_limit(spark):
    table = written(spark.range(1000).selectExpr("id", "uuid() u"), "sized")
    other = spark.range(10)
    for limit, joined in ((1 << 20, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        try:
            text = plan(other.join(broadcast_if_small(table, limit), "id"))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert joined in text


def test_scratch_is_where_the_session_says(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
