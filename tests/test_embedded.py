"""The bounded walk over embedded JSON against the same walk in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lotwright.sources import embedded


def brute(body, depth=6, nodes=10_000):
    try:
        queue, found, seen = [(json.loads(body), 0)], [], 0
    except (TypeError, ValueError):
        return []
    text = lambda v: v if isinstance(v, str) else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else ""
    while queue and seen < nodes:
        node, at = queue.pop(0)
        if not isinstance(node, (dict, list)):
            continue
        seen += 1
        for key, value in sorted(node.items()) if isinstance(node, dict) else enumerate(node):
            if str(key).lower() == "portalchildren":
                parts = [text(v) for v in value] if isinstance(value, list) else (text(value) if value else "").split(",")
                found += [x.strip() for x in parts if re.fullmatch(r"\s*[0-9]+\s*", x)]
            elif at < depth and isinstance(value, (dict, list)):
                queue.append((value, at + 1))
    return list(dict.fromkeys(found))


def walked(spark, bodies, **bounds):
    rows = spark.createDataFrame(list(enumerate(bodies)), "id long, body string").withColumn("level", F.lit(1)).withColumn("ids", F.lit(2))
    out = [[] for _ in bodies]
    for r in sorted(embedded.children(rows, "body", ["id", "level"], **bounds).collect()):
        assert r["level"] == 1 and r["pos"] == len(out[r["id"]])
        out[r["id"]].append(r["child"])
    return out


def grown(own, depth):
    kind = own.random()
    if depth == 0 or kind < 0.3:
        return own.choice([1, 0, 34, 3.0, "12", "x", " 7 , 8", "", None, True, '{"portalChildren":[99]}', [5, "6", None, [7]], {}])
    if kind < 0.45:
        return [grown(own, depth - 1) for _ in range(own.randint(0, 3))]
    return {own.choice(["a", "b", "z", "portalChildren", "PortalCHILDREN", "portal"]): grown(own, depth - 1) for _ in range(own.randint(0, 4))}


def test_walk_equals_plain_python(spark):
    own = random.Random(4)
    bodies = [json.dumps(grown(own, own.randint(0, 10))) for _ in range(300)]
    nest = lambda n: json.dumps(json.loads("{" + '"a":{' * n + '"portalChildren":[1]' + "}" * n + "}"))
    bodies += [nest(5), nest(6), nest(7), None, "", "broken {", "12", '"portalChildren"', "[]", '{"portalChildren":0}', '{"portalChildren":[0]}', '{"portal":{"portalChildren":["12",34,"bad"]}}']
    want = [brute(b) for b in bodies]
    assert walked(spark, bodies) == want
    assert want[300] == ["1"] and want[301] == ["1"] and want[302] == [] and want[-1] == ["12", "34"]


@pytest.mark.parametrize(("depth", "nodes"), [(6, 5), (6, 12), (2, 1000), (0, 1)])
def test_bounds_cut_in_the_order_of_visits(spark, depth, nodes):
    own = random.Random(depth * 100 + nodes)
    bodies = [json.dumps(grown(own, 7)) for _ in range(150)]
    assert walked(spark, bodies, depth=depth, nodes=nodes) == [brute(b, depth, nodes) for b in bodies]


def test_scripts_are_found_by_id(spark):
    pages = ["""<script type="application/json" id='s'>{"a":1}</script>""", """<SCRIPT id="s2" type="application/json">{}</SCRIPT><script id=s type=application/json>\n[2]</script>""", '<script id="s">{}</script>', None]
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select(embedded.script_json(F.col("html"), "s").alias("x")).collect()
    assert [r["x"] and r["x"].strip() for r in rows] == ['{"a":1}', "[2]", None, None]


def test_nothing_is_shuffled(spark):
    rows = embedded.children(spark.createDataFrame([(1, "{}")], "id long, body string"), "body", ["id"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
