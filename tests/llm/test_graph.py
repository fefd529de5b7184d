import random

import pytest
from lakelens.llm import common, graph


def test_components_with_hubs(spark):
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 200)] + [(900, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(0, 0), (5, 0)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    inner = {x for a, b in edges if a != b for x in (a, b)}
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()
    assert sorted((r["node"], r["component"]) for r in got if r["node"] != r["component"]) == sorted((x, find(x)) for x in inner if find(x) != x)
    assert {r["node"] for r in got} == inner


def test_release_drops_what_the_application_wrote(spark):
    kept = common.materialize(spark.range(3).toDF("n"), "kept-until-released")
    assert kept.count() == 3
    common.release(spark)
    with pytest.raises(Exception, match="(?i)not_exist|not exist|no such file"):
        kept.count()


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: Conf)  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
